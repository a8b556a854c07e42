"""Graph analytics as sparse linear algebra on Spark DataFrames."""
