"""SimHash near-duplicates by meet-in-the-middle ball hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.components import components
from lattica.llm.shared import fits, fresh, join_hot, lean, materialize, partitions, small_batches, table

_BLOCK = 1 << 15
_SHIFTS, _LANES = np.arange(8, dtype=np.uint64)[:, None], np.uint64(0x0101010101010101)


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of the word shingles of a text, repeats included.

    A-Z are lower-cased; fewer words than a shingle make one shingle; no
    words (empty, null, white space) give 0. A bit is set if it is set in over half the hashes.
    """
    # bytes.split() without arguments splits at U+0020 and U+0009-U+000D, no others
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    h = xxhash.xxh64_intdigest
    ones, n = np.zeros(64, np.int64), max(1, len(w) - words + 1)
    for at in range(0, n, _BLOCK):  # a bounded block of hashes at a time, however long the text
        part = w[at : at + _BLOCK + words - 1]
        if len(part) < words or words == 1:
            hashes = [h(b" ".join(part), seed)] if words > 1 else [h(x, seed) for x in part]
        elif words == 3:
            hashes = [h(b"%b %b %b" % x, seed) for x in zip(part, part[1:], part[2:], strict=False)]
        else:
            hashes = [h(b" ".join(x), seed) for x in zip(*(part[i:] for i in range(words)), strict=False)]
        ones += bit_counts(np.array(hashes, "<u8"))
    return majority(ones, n)


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of 64-bit hashes have each bit, the lowest first."""
    if not len(hashes):
        return np.zeros(64, np.int64)
    # bit k of each byte, for each k; sums of 255 of them fit their bytes
    lanes = np.add.reduceat((hashes >> _SHIFTS) & _LANES, np.arange(0, len(hashes), 255), axis=1)
    return lanes.astype("<u8").view(np.uint8).reshape(8, -1, 8).sum(axis=1, dtype=np.int64).T.ravel()


def majority(ones: np.ndarray, n: int) -> int:
    """The bits that over half of n hashes have."""
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp long) of every row; other columns are ignored, whatever their names."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = [_signed(fingerprint(x.as_py(), words, seed)) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(run), "doc_id long, fp long")


def simhash_links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """Verified links (a, b) between distinct fingerprints' representatives (fp, rep): enough of them that components are those of all links.

    Ball hashing: each fingerprint emits itself and its 64 variants with one bit
    flipped (half the radius). Two fingerprints at 2 bits or fewer share a
    variant. A variant has at most 65 fingerprints, whatever the data, and all
    of them are within the radius of one another, so each is linked to the
    smallest only.
    """
    if radius not in (0, 1, 2):
        raise ValueError("radius must be 0, 1 or 2")
    if radius == 0:
        return fps.select(F.col("rep").alias("a"), F.col("rep").alias("b")).limit(0)
    flips = F.array(F.lit(0), *(F.lit(_signed(1 << i)) for i in range(64)))
    # fingerprints are small and their balls 65 times as large: dealt out first
    ball = fps.repartition(2 * partitions(fps.sparkSession)).select("fp", "rep", F.explode(flips).alias("flip")).select(F.col("fp").bitwiseXOR(F.col("flip")).alias("variant"), F.struct("rep", "fp").alias("x"))
    met = ball.groupBy("variant").agg(F.collect_list("x").alias("met")).where(F.size("met") > 1)
    pairs = met.select(F.array_min("met").alias("low"), F.explode("met").alias("x"))
    return (
        pairs.where("x.rep > low.rep")
        .where(F.bit_count(F.col("x.fp").bitwiseXOR(F.col("low.fp"))) <= radius)
        .select(F.col("low.rep").alias("a"), F.col("x.rep").alias("b"))
        .distinct()
    )


def simhash_components(docs: DataFrame, words: int = 3, radius: int = 2, seed: int = 42) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id reachable over links of at most radius
    bits. Copies share a fingerprint and enter the search once. Null or empty
    texts have fingerprint 0, linked like any other. Rows repeated with one doc_id
    each get a row. Rows without a doc_id join the component of their fingerprint; if no
    row of it has an id, component_id is null.
    """
    own = materialize(fingerprints(docs, words, seed), "simhash")
    reps = materialize(own.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "simhash-reps")
    named = components(simhash_links(reps.where("rep is not null").select("fp", "rep"), radius))
    named = reps.join(named.withColumnRenamed("node", "rep"), "rep", "left").select("fp", F.coalesce("component", "rep").alias("component_id"), "n")
    return join_hot(own, materialize(named, "simhash-named"), ["fp"], "n").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, words: int = 5, radius: int = 2, seed: int = 42) -> DataFrame:
    """The rows of docs less those whose near-duplicate group has a smaller doc_id; columns as in docs.

    Texts without words are all alike: one of them stays. Rows without a doc_id stay.
    Rows that repeat the doc_id which stays are repeated in the result too.
    """
    found = simhash_components(docs, words, radius, seed)
    (gone_id,) = fresh(docs, "gone_id")
    gone = materialize(found.where("doc_id > component_id").select(F.col("doc_id").alias(gone_id)).distinct(), "simhash-gone")
    return docs.join(fits(gone), F.col("doc_id").cast("long") == F.col(gone_id), "left_anti")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """simhash_components over documents: three-word shingles, at most 2 bits."""
    return simhash_components(table(spark, sf_dir, "documents"))


QUERIES = {"op3_simhash": op3_simhash}
ORACLE_SQL: dict[str, str] = {}
