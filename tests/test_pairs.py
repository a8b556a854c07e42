"""Part-supplier pairs are summed up in partitions of bounded size, without a sum before the shuffle."""

from lattica.plans import graphs as g


def test_partitions_grow_with_the_lines(spark, medium, monkeypatch):
    monkeypatch.setattr(g, "LINES", 5000)
    lines = spark.read.parquet(f"{medium}/lineitem.parquet").count()
    for pairs in (g.ps(spark, medium), g.ps2(spark, medium)):
        assert pairs.df.rdd.getNumPartitions() == -(-lines // 5000)


def test_no_sum_before_the_shuffle(spark, medium):
    plan = g.ps(spark, medium).df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "HashAggregate" not in plan.split("Exchange")[1]
