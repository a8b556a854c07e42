"""Mixing sources to target weights: whole copies of documents, plus a hash-seeded Bernoulli copy for the fraction.

Only ids, sizes and hashes are shuffled, never texts: a document finds its copies from a small table with a row per source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.llm.shared import WORD, fits, fresh, materialize, table

#: Seeds that a source chooses from.
SEEDS = 64
#: Draws are whole numbers below this.
RANGE = 1 << 40
#: Parts of a source's rows where the table of sources is too large to broadcast.
SALTS = 64


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _mark(doc_id: Column, text: Column, seed: str) -> Column:
    """MD5 of a document's id and text, the same in every engine; its halves make the draws."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")))))


def _half(mark: Column, k: int) -> Column:
    return F.conv(F.substring(mark, 1 + 10 * k, 10), 16, 10).cast("long")


def _hit(h1: Column, h2: Column, k: Column, p: Column) -> Column:
    """Whether draw k, uniform below RANGE, falls in the fraction p."""
    return F.pmod(h1 + k * h2, F.lit(RANGE)) < p * float(RANGE)


def source_targets(sized: DataFrame, weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size, target) from (source, size).

    Sources by code point, null last, take the weights in turn and share
    share x all sizes; a target above cap x its source's size stops there and the
    excess goes to the others by weight. That process ends at min(level x weight, cap x size)
    for one level, found here in one pass over the sources sorted by cap x size / weight.
    There is one row per source, so these windows run in one task.
    """
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = by.withColumn("place", place)
    w = w.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("double"))
    w = w.withColumn("most", cap * F.col("source_size")).withColumn("full_at", F.col("most") / F.col("w"))
    all_rows, before = Window.partitionBy(), Window.orderBy("full_at", "place").rowsBetween(Window.unboundedPreceding, -1)
    w = w.withColumn("left", share * F.sum("source_size").over(all_rows) - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
    w = w.withColumn("left_w", F.sum("w").over(all_rows) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    w = w.withColumn("level", F.col("left") / F.col("left_w")).withColumn("pos", F.row_number().over(Window.orderBy("full_at", "place")))
    w = w.withColumn("first_open", F.min(F.when(F.col("level") < F.col("full_at"), F.col("pos"))).over(all_rows))
    w = w.withColumn("final", F.max(F.when(F.col("pos") == F.col("first_open"), F.col("level"))).over(all_rows))
    full = F.col("first_open").isNull() | (F.col("pos") < F.col("first_open"))
    return w.select("source", "source_size", F.when(full, F.col("most")).otherwise(F.col("final") * F.col("w")).alias("target"))


def _apart(df: DataFrame, repeats: DataFrame, h1: str, h2: str, row: str) -> DataFrame:
    """df, where rows that share a doc_id and text get hashes of their own from column row, which is dropped."""
    (r1, r2) = fresh(df, "r1", "r2")
    again = repeats.select(F.col("h1").alias(r1), F.col("h2").alias(r2))
    d = df.join(fits(again), (F.col(h1) == F.col(r1)) & (F.col(h2) == F.col(r2)), "left")
    own = F.md5(F.concat_ws(":", *(F.col(c).cast("string") for c in (h1, h2, row))))
    shared = F.col(r1).isNotNull()
    d = d.withColumns({h1: F.when(shared, _half(own, 0)).otherwise(F.col(h1)), h2: F.when(shared, _half(own, 1)).otherwise(F.col(h2))})
    return d.drop(r1, r2, row)


def _with_source(df: DataFrame, plan: DataFrame, source: Column, key: str) -> DataFrame:
    """df with the columns of plan (s, ...), which has a row per source. Where these are too many to broadcast, a source's rows are dealt to several tasks by key."""
    small = fits(plan)
    if small is not plan:
        return df.join(small, source.eqNullSafe(F.col("s"))).drop("s")
    d, p = df.withColumn("salt", F.pmod(F.col(key), F.lit(SALTS))), plan.withColumn("salt2", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return d.join(p, source.eqNullSafe(F.col("s")) & (F.col("salt") == F.col("salt2"))).drop("s", "salt", "salt2")


def mix_plan(sized: DataFrame, weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0) -> tuple[DataFrame, DataFrame]:
    """(a row per source, hashes of repeated documents), from sizes() of the documents.

    rate = target / source_size; each document is taken whole = floor(rate) times, and once more if a draw of its own falls in the
    fraction p. Draws hash the doc_id, the text and a seed, so documents are drawn independently.
    A source has the one of SEEDS seeds for which its sum comes nearest to its target: with few or uneven documents, one
    seed's sum may be far off, while the best of 64 rarely is. Rows: s (the source), source_size, target, whole, p, k (the seed).
    """
    targets = materialize(source_targets(sized, weights, share, cap), "mix-targets").withColumnRenamed("source", "s")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    targets = targets.withColumn("whole", F.floor(rate)).withColumn("p", rate - F.floor(rate))
    repeats = materialize(sized.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h1", "h2"), "mix-repeats")
    own = _apart(sized.select("source", "size", "h1", "h2", "row"), repeats, "h1", "h2", "row").where("size > 0")
    each = _with_source(own, targets.select("s", "p"), F.col("source"), "h1").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(SEEDS - 1))))
    sums = each.groupBy("source", "k").agg(F.sum(F.when(_hit(F.col("h1"), F.col("h2"), F.col("k"), F.col("p")), F.col("size")).otherwise(0)).alias("more"))
    sums = sums.join(targets, F.col("source").eqNullSafe(F.col("s"))).withColumn("off", F.abs(F.col("whole") * F.col("source_size") + F.col("more") - F.col("target")))
    best = sums.groupBy("source").agg(F.min(F.struct("off", "k")).alias("best")).select("source", F.col("best.k").alias("k"))
    plan = targets.join(best, F.col("s").eqNullSafe(F.col("source")), "left").drop("source").withColumn("k", F.coalesce("k", F.lit(0)))
    return materialize(plan, "mix-plan"), repeats


def sizes(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """(doc_id, source, size, h1, h2, row) of every row."""
    text, doc_id = F.col("text").cast("string"), F.col("doc_id").cast("long")
    d = docs.select(doc_id.alias("doc_id"), F.col("source").cast("string").alias("source"), n_words(text).alias("size"), _mark(doc_id, text, seed).alias("mark"), F.monotonically_increasing_id().alias("row"))
    return d.select("doc_id", "source", "size", _half(F.col("mark"), 0).alias("h1"), _half(F.col("mark"), 1).alias("h2"), "row")


def mix(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: str = "mix") -> DataFrame:
    """The rows of docs, each as often as the mix takes it, with the columns of docs.

    Null texts have size 0. Documents of size 0 are taken like others of their
    source; a source of total size 0 gives no rows. An empty table gives an empty one. Rows that share a doc_id
    (or have none) are drawn apart by their texts; those that share the text too, by their place in the
    input's partitions, so for these reruns agree as long as docs is dealt alike. Columns may have any names.
    """
    plan, repeats = mix_plan(materialize(sizes(docs, seed), "mix-sizes"), weights, share, cap)
    own = dict(zip(("mark", "h1", "h2", "row", "copies", "copy"), fresh(docs, "m_mark", "m_h1", "m_h2", "m_row", "m_copies", "m_copy"), strict=True))
    d = docs.withColumns({own["mark"]: _mark(F.col("doc_id").cast("long"), F.col("text").cast("string"), seed), own["row"]: F.monotonically_increasing_id()})
    d = d.withColumns({own["h1"]: _half(F.col(own["mark"]), 0), own["h2"]: _half(F.col(own["mark"]), 1)}).drop(own["mark"])
    d = _apart(d, repeats, own["h1"], own["h2"], own["row"])
    # the row as one column, so that no name of docs meets one of the plan
    d = d.select(F.struct(*(F.col(c) for c in docs.columns)).alias("doc"), F.col("source").cast("string").alias("source"), F.col(own["h1"]).alias("h1"), F.col(own["h2"]).alias("h2"))
    d = _with_source(d, plan.select("s", "whole", "p", "k"), F.col("source"), "h1")
    copies = (F.col("whole") + _hit(F.col("h1"), F.col("h2"), F.col("k"), F.col("p")).cast("long")).cast("int")
    d = d.withColumn("copies", copies).where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return d.select(*(F.col("doc").getField(c).alias(c) for c in docs.columns))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the words that the mix takes of each."""
    sized = materialize(sizes(table(spark, sf_dir, "documents")), "mix-sizes")
    plan, repeats = mix_plan(sized)
    d = _with_source(_apart(sized, repeats, "h1", "h2", "row"), plan, F.col("source"), "h1")
    copies = F.col("whole") + _hit(F.col("h1"), F.col("h2"), F.col("k"), F.col("p")).cast("long")
    return d.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"))


QUERIES = {"op7_mixing": op7_mixing}
ORACLE_SQL = {
    "op7_mixing": rf"""
WITH d AS (SELECT doc_id, text, source, CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source),
w AS (SELECT *, CASE place % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, 2.0::DOUBLE * source_size AS most FROM s),
v AS (SELECT *, most / w AS full_at, 1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(most) OVER b, 0) AS lft,
  sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS left_w, row_number() OVER (ORDER BY most / w, place) AS pos
  FROM w WINDOW b AS (ORDER BY most / w, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, lft / left_w AS level, min(CASE WHEN lft / left_w < full_at THEN pos END) OVER () AS first_open FROM v),
t AS (SELECT source, source_size, CASE WHEN first_open IS NULL OR pos < first_open THEN most
  ELSE max(CASE WHEN pos = first_open THEN level END) OVER () * w END AS target FROM f),
m AS (SELECT *, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS mark FROM d),
r AS (SELECT m.doc_id, m.source, m.size, t.source_size, t.target, floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END) AS whole,
  CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END - floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END) AS p,
  CAST('0x' || substr(mark, 1, 10) AS BIGINT) AS h1, CAST('0x' || substr(mark, 11, 10) AS BIGINT) AS h2 FROM m JOIN t ON m.source IS NOT DISTINCT FROM t.source),
e AS (SELECT source, k, abs(any_value(whole) * any_value(source_size) + sum(CASE WHEN (h1 + k * h2) % {RANGE} < p * {RANGE}.0 THEN size ELSE 0 END) - any_value(target)) AS off FROM r, range({SEEDS}) x(k) GROUP BY source, k),
b AS (SELECT source, k, row_number() OVER (PARTITION BY source ORDER BY off, k) AS place FROM e)
SELECT doc_id, size, source_size, target, size * CAST(whole + CASE WHEN (h1 + k * h2) % {RANGE} < p * {RANGE}.0 THEN 1 ELSE 0 END AS BIGINT) AS taken
FROM r JOIN b ON r.source IS NOT DISTINCT FROM b.source AND place = 1"""
}
