"""Benchmark decontamination in DataFrame operations only: size-partitioned MinHash containment search, then exact shingles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.shared import fits, fresh, materialize, table

SPLIT = r"[^\p{L}\p{N}]+"


def normal_words(text: Column) -> Column:
    """Lower-cased runs of letters and digits; null gives an empty array."""
    return F.filter(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), SPLIT), lambda w: w != "")


def _windows(words: Column, n: int, make) -> Column:
    """make(i) for every start i of n consecutive words; null if there are fewer."""
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(0), F.size(words) - n), make))


def _hash_at(words: Column, n: int):
    return lambda i: F.xxhash64(*(F.get(words, i + j) for j in range(n)))


def _hashes(words: Column, n: int) -> Column:
    return _windows(words, n, _hash_at(words, n))


def _texts(words: Column, n: int) -> Column:
    return _windows(words, n, lambda i: F.array_join(F.slice(words, i + 1, n), " "))


def _hash_of(n: int):
    """The hash that _hashes gives n words, from their text."""
    return lambda s: F.xxhash64(*(F.get(F.split(s, " "), F.lit(j)) for j in range(n)))


def contaminated(docs: DataFrame, items: DataFrame, n: int = 5, threshold: float = 0.8) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_matched, containment) of documents that hold at least threshold of an item's distinct shingles.

    Texts are compared as lower-cased runs of letters and digits. Items shorter than a
    shingle are one shingle of their own length; items without words match nothing.

    Search: items fall into classes by size, bounds doubling. A class whose largest item
    has u shingles keeps of each item the floor((1 - threshold) u) + 1 smallest hashes:
    a document that lacks at most floor((1 - threshold) n) of an item's n shingles holds
    one of them, so the search loses nothing. Verification compares shingles as strings.
    Rows that share a doc_id count as one document, rows that share an item_id with different texts as
    one item each (the id may repeat); null ids match nothing. Either table may be empty. Other columns
    are ignored, whatever their names.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    return _contaminated(d, items, n, threshold)


def _contaminated(d: DataFrame, items: DataFrame, n: int, threshold: float) -> DataFrame:
    """The same for (doc_id, text) without nulls; the id may be of any type."""
    it = items.select(F.col("item_id").cast("long").alias("item_id"), normal_words(F.col("text")).alias("w")).where("item_id is not null and size(w) > 0").distinct()
    it = it.withColumn("len", F.least(F.size("w"), F.lit(n)))
    own = F.coalesce(*(F.when(F.col("len") == k, F.array_distinct(_texts(F.col("w"), k))) for k in range(1, n + 1)))
    it = it.select("item_id", F.xxhash64(F.array_join("w", " ")).alias("version"), "len", own.alias("shingles")).withColumn("n_shingles", F.size("shingles"))
    it = materialize(it, "items")
    upper = F.pow(F.lit(2), F.floor(F.log2("n_shingles")) + 1) - 1
    keep = F.floor(F.round((1 - threshold) * upper, 6)) + 1
    by_hash = F.coalesce(*(F.when(F.col("len") == k, F.transform("shingles", _hash_of(k))) for k in range(1, n + 1)))
    sig = it.select("item_id", F.explode(F.slice(F.array_sort(by_hash), F.lit(1), keep.cast("int"))).alias("h")).distinct()
    sig = materialize(sig, "signatures")
    lengths = sorted(r[0] for r in it.select("len").distinct().collect())  # n values at most
    small_sig = fits(sig)

    words = d.select("doc_id", normal_words(F.col("text")).alias("w"))
    seen = None
    for k in lengths:
        part = words.select("doc_id", F.explode(_hashes(F.col("w"), k)).alias("h"))
        seen = part if seen is None else seen.unionByName(part)
    if seen is None:
        seen = words.select("doc_id", F.lit(0).cast("long").alias("h")).limit(0)
    cand = materialize(seen.join(small_sig, "h").select("doc_id", "item_id").distinct(), "candidates")

    ids = cand.select("doc_id").distinct()
    near = d.join(fits(ids), "doc_id", "left_semi").select("doc_id", normal_words(F.col("text")).alias("w"))
    held = None
    for k in lengths:
        part = near.select("doc_id", F.explode(F.array_distinct(_texts(F.col("w"), k))).alias("shingle"))
        held = part if held is None else held.unionByName(part)
    if held is None:
        held = near.select("doc_id", F.lit("").alias("shingle")).limit(0)
    each = it.select("item_id", "version", "n_shingles", F.explode("shingles").alias("shingle"))
    # only what a candidate's item needs is looked for, so a shingle that many items share makes no pairs of documents and items
    need = cand.join(fits(each), "item_id")
    hits = need.join(held, ["doc_id", "shingle"], "left_semi")
    found = hits.groupBy("doc_id", "item_id", "version", "n_shingles").agg(F.count("*").alias("n_matched"))
    found = found.where(F.col("n_matched") >= F.ceil(F.round(threshold * F.col("n_shingles"), 6)))
    return found.select("doc_id", "item_id", F.col("n_shingles").cast("long").alias("n_shingles"), "n_matched", (F.col("n_matched") / F.col("n_shingles")).alias("containment"))


def decontaminate(docs: DataFrame, items: DataFrame, n: int = 5, threshold: float = 0.8) -> DataFrame:
    """docs without the documents that hold an item, with the columns of docs, whatever their names.

    All rows of a doc_id go if one of them, or all together, hold an item; a row without a doc_id is judged by its own text.
    """
    (bad_id,) = fresh(docs, "bad_id")
    text = F.col("text").cast("string")
    key = F.coalesce(F.col("doc_id").cast("long").cast("string"), F.concat(F.lit("text "), F.md5(text)))
    d = docs.select(key.alias("doc_id"), text.alias("text")).where("doc_id is not null and text is not null")
    bad = materialize(_contaminated(d, items, n, threshold).select(F.col("doc_id").alias(bad_id)).distinct(), "contaminated")
    return docs.join(fits(bad), key == F.col(bad_id), "left_anti")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items in all documents."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _sql(n: int = 5) -> str:
    words = r"list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '')"
    return f"""
WITH i AS (SELECT item_id, {words} AS w FROM benchmark),
iw AS (SELECT item_id, w, least(len(w), {n}) AS k FROM i WHERE len(w) > 0),
s AS (SELECT DISTINCT item_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda x: array_to_string(w[x:x + k - 1], ' '))) AS shingle FROM iw),
c AS (SELECT item_id, count(*) AS n_shingles FROM s GROUP BY 1),
dw AS (SELECT doc_id, {words} AS w FROM documents WHERE text IS NOT NULL),
ks AS (SELECT DISTINCT k FROM iw),
ds AS (SELECT DISTINCT doc_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda x: array_to_string(w[x:x + k - 1], ' '))) AS shingle FROM dw, ks WHERE len(w) >= k),
m AS (SELECT doc_id, item_id, count(*) AS n_matched FROM ds JOIN s USING (k, shingle) GROUP BY 1, 2)
SELECT doc_id, item_id, n_shingles, n_matched, n_matched / n_shingles AS containment FROM m JOIN c USING (item_id) WHERE n_matched >= ceil(round(0.8 * n_shingles, 6))"""


QUERIES = {"op5_decontaminate": op5_decontaminate}
ORACLE_SQL = {"op5_decontaminate": _sql()}
