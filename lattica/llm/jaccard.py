"""Near-duplicates by Jaccard similarity of word shingles: SimHash balls and, beyond their reach, MinHash bands find candidates, exact shingle sets verify them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.llm.components import components
from lattica.llm.shared import fits, fresh, join_hot, lean, materialize, partitions, small_batches
from lattica.llm.simhash import bit_counts, majority, simhash_links

#: Bands of so many rows each: two sets of similarity s share none with chance (1 - s^5)^32, 3e-6 at 0.8.
BANDS, ROWS = 32, 5
#: MinHash rows of a sketch, which keeps 4 bits of each. A pair is verified only if so many of them agree: at 0.8 fewer do with
#: chance 4e-5, at 0.7 so many do with chance 0.1.
SKETCH, AGREE = 512, 381
#: Members of a bucket that are compared with one centre at most; larger buckets are split for that step.
STAR = 256
#: Rows of a bucket on either side of a task's comparisons of all pairs at most.
SIDE = 1024
_BLOCK = 1 << 15
_CONSTANTS = np.random.default_rng(42).integers(0, 1 << 64, (3, BANDS * ROWS, 1), np.uint64) | np.array([[[0]], [[1]], [[1]]], np.uint64)
_SKETCH = np.random.default_rng(44).integers(0, 1 << 32, (3, SKETCH, 1), np.uint32) | np.array([[[0]], [[1]], [[1]]], np.uint32)
_BAND = np.random.default_rng(43).integers(0, 1 << 64, (2, BANDS, 1), np.uint64) | np.array([[[0]], [[1]]], np.uint64)


def shingle_hashes(text: str | None, words: int = 5) -> Iterator[np.ndarray]:
    """The 64-bit hashes of the word shingles of a text, repeats included, a bounded block at a time; words and short texts as in simhash.fingerprint."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    h, n = xxhash.xxh64_intdigest, max(1, len(w) - words + 1) if w else 0
    for at in range(0, n, _BLOCK):
        part = w[at : at + _BLOCK + words - 1]
        found = map(b" ".join, zip(*(part[i:] for i in range(words)), strict=False)) if len(part) >= words else [b" ".join(part)]
        yield np.fromiter(map(h, found), np.uint64)


def shingles(text: str | None, words: int = 5) -> np.ndarray:
    """The distinct hashes of the word shingles of a text, ascending."""
    return _distinct([np.unique(x) for x in shingle_hashes(text, words)])


def _distinct(parts: list[np.ndarray]) -> np.ndarray:
    return parts[0] if len(parts) == 1 else np.unique(np.concatenate([np.empty(0, np.uint64), *parts]))


def set_and_fingerprint(text: str | None, words: int = 5) -> tuple[np.ndarray, int]:
    """shingles() of a text and its SimHash, simhash.fingerprint with seed 0, from the same hashes."""
    parts, ones, n = [], np.zeros(64, np.int64), 0
    for x in shingle_hashes(text, words):
        parts.append(np.unique(x))
        ones += bit_counts(x)
        n += len(x)
    return _distinct(parts), majority(ones, n)


def minima(own: np.ndarray) -> np.ndarray:
    """The MinHash rows of a set of hashes."""
    return _least(own, _CONSTANTS, 29)


def _least(own: np.ndarray, constants: np.ndarray, shift: int) -> np.ndarray:
    """The least of each of several hashes of the elements; each hash is (x ^ add) * by, its high bits folded in, * again."""
    add, by, again = constants[:, :, 0]
    low = np.full(len(add), np.iinfo(own.dtype).max, own.dtype)
    # a row for each element, so that minima are of whole rows; a bounded block, however long the text
    room = np.empty((2, min(len(own), 256), len(add)), own.dtype)
    for at in range(0, len(own), 256):
        part = own[at : at + 256, None]
        x, high = room[:, : len(part)]
        np.bitwise_xor(part, add, out=x)
        np.multiply(x, by, out=x)
        np.right_shift(x, own.dtype.type(shift), out=high)
        np.bitwise_xor(x, high, out=x)
        np.multiply(x, again, out=x)
        np.minimum(low, x.min(axis=0), out=low)
    return low


def bands(low: np.ndarray) -> np.ndarray:
    """A hash for each band of MinHash rows."""
    start, by = _BAND
    out = start[:, 0]
    for k in range(ROWS):
        out = (out ^ low[k::ROWS]) * by[:, 0]
        out = out ^ (out >> np.uint64(31))
    return out


def sketch(own: np.ndarray) -> np.ndarray:
    """Four bits of each of SKETCH MinHash rows of a set of hashes, 16 of them in a long."""
    low = _least((own >> np.uint64(32)).astype(np.uint32), _SKETCH, 15)
    # the high bits of a product are its best, and a minimum's highest are 0
    four = ((low * np.uint32(0x9E3779B1)) >> np.uint32(28)).astype(np.uint8)
    return (four[::2] | four[1::2] << np.uint8(4)).view("<i8")


def agreeing(a: Column, b: Column) -> Column:
    """How many rows of two sketches agree."""
    differ = F.lit(0)
    for i in range(SKETCH // 16):
        x = F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))
        x = x.bitwiseOR(F.shiftright(x, 1))
        x = x.bitwiseOR(F.shiftright(x, 2))
        differ = differ + F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))
    return F.lit(SKETCH) - differ


def signatures(docs: DataFrame, words: int = 5) -> DataFrame:
    """(doc_id, key, n, fp, bands, sketch) of the rows with a doc_id: a 128-bit hash of the shingle set, its size, the SimHash, the set's bands and sketch; texts without words have no bands."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for x in b.column(1):  # one set at a time is held
                own, fp = set_and_fingerprint(x.as_py(), words)
                some = len(own) > 0
                rows.append((xxhash.xxh3_128_digest(own.tobytes()), len(own), fp - (fp >> 63 << 64), bands(minima(own)).view(np.int64) if some else [], sketch(own) if some else []))
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            kinds = [pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            arrays = [b.column(0), *(pa.array(x, kind) for x, kind in zip(columns, kinds, strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "key", "n", "fp", "bands", "sketch"])

    return _ids_and_texts(docs).mapInArrow(lean(run), "doc_id long, key binary, n long, fp long, bands array<long>, sketch array<long>")


def ball_pairs(reps: DataFrame, radius: int = 2) -> DataFrame:
    """Pairs (a, b), a < b, of representatives (rep, fp) whose fingerprints are within the radius: of equal fingerprints each
    with the smallest representative, of others as simhash_links gives them, so components are those of all pairs within the radius."""
    first = materialize(reps.groupBy("fp").agg(F.min("rep").alias("first"), F.count("*").alias("m")), "jaccard-fingerprints")
    equal = join_hot(reps.select("fp", "rep"), first.where("m > 1"), ["fp"], "m").where("rep > first").select(F.col("first").alias("a"), F.col("rep").alias("b"))
    return simhash_links(first.select("fp", F.col("first").alias("rep")), radius).unionByName(equal)


def _ids_and_texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")


def _similar(pairs: DataFrame, docs: DataFrame, reps: DataFrame, words: int, threshold: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) of representatives whose shingle sets have a Jaccard similarity of threshold or more; only their texts are shuffled."""
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    wanted = materialize(reps.select("rep", "key").join(fits(nodes), "rep"), "jaccard-wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rep, key, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                own = shingles(text, words)
                if xxhash.xxh3_128_digest(own.tobytes()) == key:  # a doc_id may have other rows
                    yield pa.RecordBatch.from_arrays([pa.array([rep], pa.int64()), pa.array([own.view(np.int64)], pa.list_(pa.int64()))], ["rep", "own"])

    texts = _ids_and_texts(docs).join(fits(wanted), F.col("doc_id") == F.col("rep")).select("rep", "key", "text")
    # rows that repeat a document give its set again: links are made distinct
    sets = materialize(texts.mapInArrow(lean(run), "rep long, own array<long>"), "jaccard-sets")
    both = F.size(F.array_intersect("own_a", "own_b"))
    num, den = threshold
    # both / (a + b - both) >= num / den
    enough = both * (num + den) >= num * (F.size("own_a") + F.size("own_b"))
    return _with_sets(_with_sets(pairs, pairs, sets, "a"), pairs, sets, "b").where(enough).select("a", "b").distinct()


def _with_sets(df: DataFrame, pairs: DataFrame, sets: DataFrame, side: str) -> DataFrame:
    """df, whose rows are pairs, with the sets of one side; the pairs of a frequent representative are dealt to several tasks."""
    often = materialize(pairs.groupBy(side).count().where(F.col("count") > STAR).select(side, F.ceil(F.col("count") / STAR).alias("parts")), "jaccard-often")
    often, parts = fits(often), F.coalesce("parts", F.lit(1))
    left = df.join(often, side, "left").withColumn("part", F.pmod(F.xxhash64("a", "b"), parts)).drop("parts")
    right = sets.select(F.col("rep").alias(side), F.col("own").alias(f"own_{side}")).join(often, side, "left")
    right = right.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("parts")
    return left.join(right, [side, "part"]).drop("part")


def jaccard_components(docs: DataFrame, words: int = 5, threshold: tuple[int, int] = (4, 5)) -> DataFrame:
    """(doc_id, component_id) of the rows with a doc_id; component_id is the smallest doc_id reachable over links of similarity num/den or more.

    Equal shingle sets enter the search once. Those whose SimHash fingerprints are within 2 bits meet in a ball
    (simhash.simhash_links); most pairs at the threshold differ in more, so sets that share a band meet in its bucket too. First each
    is compared with one centre of its bucket, and buckets within one component are done; then
    every other pair of a bucket or ball that is not in one component yet is compared, by sketches first and by
    their sets if the sketches agree. No pair that meets is left out: it is in one component already, or its
    sketches are too far apart, or it is verified.
    """
    spark = docs.sparkSession
    num, den = threshold
    own = materialize(signatures(docs, words), "jaccard")
    reps = materialize(own.groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"), F.count("*").alias("copies")), "jaccard-reps")
    # sketches join only what meets: most rows are alone in their bands
    rows = reps.select("rep", "n", F.explode("bands").alias("band")).repartition(2 * partitions(spark), "band")
    often = materialize(rows.groupBy("band").agg(F.count("*").alias("m")).where("m > 1"), "jaccard-bands")
    met = join_hot(rows, often, ["band"], "m").join(reps.select("rep", "sketch", "bands"), "rep")
    met = materialize(met.withColumn("part", F.pmod(F.xxhash64("rep", "band"), F.ceil(F.col("m") / STAR))), "jaccard-met")

    def alike(n: str, m: str):
        """Sizes at which the similarity can be reached."""
        return F.least(n, m) * den >= F.greatest(n, m) * num

    star = met.withColumn("low", F.min(F.struct("rep", "n", "sketch")).over(Window.partitionBy("band", "part")))
    close = agreeing(F.col("low.sketch"), F.col("sketch")) >= AGREE
    tried = materialize(star.where("low.rep < rep").where(alike("low.n", "n")).where(close).select(F.col("low.rep").alias("a"), F.col("rep").alias("b")).distinct(), "jaccard-pairs")
    links = materialize(_similar(tried, docs, reps, words, threshold), "jaccard-links")
    named = materialize(components(links), "jaccard-components")

    at = met.select("band", "rep", "n", "sketch", "bands", "m").join(named.withColumnRenamed("node", "rep"), "rep", "left").withColumn("c", F.coalesce("component", "rep")).drop("component")
    at = materialize(at, "jaccard-at")
    mixed = at.groupBy("band").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count("*").alias("rows")).where("low < high").select("band", "rows")
    at = materialize(join_hot(at, materialize(mixed, "jaccard-open"), ["band"], "rows"), "jaccard-mixed")
    # a large bucket is dealt out in blocks: a row of block i meets those of block j in task (i, j)
    sides = F.ceil(F.col("m") / SIDE)
    block, every = F.pmod(F.xxhash64("rep", "band"), sides), F.explode(F.sequence(F.lit(0).cast("long"), sides - 1))
    x, y = (at.select("band", *(F.col(c).alias(f"{c}_{k}") for c in ("rep", "n", "c", "sketch", "bands")), block.alias("ij"[k == "y"]), every.alias("ij"[k == "x"])) for k in "xy")
    # conditions of the join itself: what they rule out is never a row
    on = (F.col("x.band") == F.col("y.band")) & (F.col("x.i") == F.col("y.i")) & (F.col("x.j") == F.col("y.j"))
    on = on & F.expr("rep_x < rep_y and c_x <> c_y") & alike("n_x", "n_y") & (agreeing(F.col("sketch_x"), F.col("sketch_y")) >= AGREE)
    # a pair comes from the first band that it shares, no other
    first = F.coalesce(*(F.when(F.get("bands_x", F.lit(k)) == F.get("bands_y", F.lit(k)), F.get("bands_x", F.lit(k))) for k in range(BANDS)))
    on = on & (first == F.col("x.band"))
    left = x.alias("x").join(y.alias("y"), on).select(F.col("rep_x").alias("a"), F.col("rep_y").alias("b"))
    # and what meets in a ball; lists of pairs first, as sketches are wide
    balls = ball_pairs(reps.where("n > 0"))
    for k in "ab":
        balls = balls.join(fits(named).select(F.col("node").alias(k), F.col("component").alias(f"c_{k}")), k, "left")
    balls = materialize(balls.where(F.coalesce("c_a", "a") != F.coalesce("c_b", "b")).select("a", "b").distinct(), "jaccard-balls")
    lows = balls.groupBy("a").agg(F.count("*").alias("m")).join(reps.select(F.col("rep").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("sketch_a")), "a")
    balls = join_hot(balls, materialize(lows, "jaccard-lows"), ["a"], "m").join(reps.select(F.col("rep").alias("b"), "n", "sketch"), "b")
    balls = balls.where(alike("n_a", "n")).where(agreeing(F.col("sketch_a"), F.col("sketch")) >= AGREE).select("a", "b")
    left = materialize(left.unionByName(balls).distinct().join(tried, ["a", "b"], "left_anti"), "jaccard-pairs")
    more = materialize(_similar(left, docs, reps, words, threshold), "jaccard-links")
    if more.limit(1).count():
        named = components(links.unionByName(more))
    named = reps.join(named.withColumnRenamed("node", "rep"), "rep", "left").select("key", F.coalesce("component", "rep").alias("component_id"), "copies")
    return join_hot(own.select("doc_id", "key"), materialize(named, "jaccard-named"), ["key"], "copies").select("doc_id", "component_id")


def keep_first(docs: DataFrame, words: int = 5, threshold: tuple[int, int] = (4, 5)) -> DataFrame:
    """The rows of docs less those whose near-duplicate group has a smaller doc_id; columns as in docs.

    Texts without words are all alike: one of them stays. Rows without a doc_id stay.
    Rows that repeat the doc_id which stays are repeated in the result too.
    """
    found = jaccard_components(docs, words, threshold)
    (gone_id,) = fresh(docs, "gone_id")
    gone = materialize(found.where("doc_id > component_id").select(F.col("doc_id").alias(gone_id)).distinct(), "jaccard-gone")
    return docs.join(fits(gone), F.col("doc_id").cast("long") == F.col(gone_id), "left_anti")
