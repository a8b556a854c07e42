"""Documents in chunk files, and rounds that ask what keys of a chunk are shared with the rest of the corpus.

A chunk is about 2 MB of whole documents, written once to the shared folder and read again in
every round, so texts are not shuffled. A round: each chunk sends its distinct keys to
buckets by hash, already reduced, so that a key that a third of all rows have costs one entry per chunk; each
bucket answers each chunk; the answers are a table in the shared folder. Buckets are as many as the corpus
needs for each to stay small.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.shared import lean, materialize, partitions, read_file, scratch, small_batches, write_file

CHUNK_BYTES = 2 << 20
#: Chunks that a task of a round works on at most, about.
CHUNKS_A_TASK = 8
#: Text behind a bucket's keys, about.
BUCKET_BYTES = 48 << 20
NO_ID = np.iinfo(np.int64).max
MANIFEST = "uri string, docs long, bytes long"
ROWS = "bucket int, chunk long, blob binary"


class Chunk:
    """Documents one after another, each followed by a line feed that belongs to none."""

    def __init__(self, packed: bytes):
        n = struct.unpack_from("<q", packed)[0]
        self.ids = np.frombuffer(packed, "<i8", n, 8)
        self.null = np.frombuffer(packed, np.uint8, n, 8 + 8 * n).astype(bool)
        lens = np.frombuffer(packed, "<i8", n, 8 + 9 * n)
        self.raw = zstandard.ZstdDecompressor().decompress(packed[8 + 17 * n :])
        self.data = np.frombuffer(self.raw, np.uint8)
        self.start = np.concatenate([[0], np.cumsum(lens + 1)])[:-1].astype(np.int64)
        self.end = self.start + lens

    @staticmethod
    def pack(ids: list[int | None], texts: list[bytes]) -> bytes:
        null = np.array([i is None for i in ids], np.uint8)
        keys = np.array([NO_ID if i is None else i for i in ids], "<i8")
        lens = np.array([len(t) for t in texts], "<i8")
        body = zstandard.ZstdCompressor(level=1).compress(b"\n".join([*texts, b""]))
        return struct.pack("<q", len(ids)) + keys.tobytes() + null.tobytes() + lens.tobytes() + body

    def id_list(self) -> list[int | None]:
        return [None if n else int(i) for i, n in zip(self.ids, self.null, strict=True)]


def write_chunks(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Write docs (doc_id, text; null texts are empty) and return the manifest, a row per chunk with its number.

    Only files in the manifest count; a task that runs again writes others.
    """
    spark = docs.sparkSession
    small_batches(spark, 500)
    folder = scratch(spark, "chunks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        texts: list[bytes] = []
        size = 0

        def close() -> pa.RecordBatch:
            write_file(uri := f"{folder}/{uuid.uuid4().hex}.chunk", Chunk.pack(ids, texts))
            return pa.RecordBatch.from_pydict({"uri": [uri], "docs": pa.array([len(ids)], pa.int64()), "bytes": pa.array([size], pa.int64())})

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids.append(i)
                texts.append(t)
                size += len(t) + 1
                if size >= chunk_bytes:
                    yield close()
                    ids, texts, size = [], [], 0
        if ids:
            yield close()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    written = materialize(rows.mapInArrow(lean(run), MANIFEST), "chunk-files")
    return materialize(written.withColumn("chunk", F.monotonically_increasing_id()), "chunk-manifest")


def bucket_count(manifest: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> int:
    return 1 + (manifest.agg(F.sum("bytes")).first()[0] or 0) // bucket_bytes


#: Groups of buckets from which on they get larger rather than more, and buckets of one group at most.
GROUPS, TOGETHER = 128, 8


def together(buckets: int) -> int:
    """How many buckets share a row of each chunk, so that rows stay few; they are solved one by one."""
    return max(1, min(TOGETHER, buckets // GROUPS))


def pack(blobs: list[tuple[int, bytes]]) -> bytes:
    numbers, sizes = [b for b, _ in blobs], [len(x) for _, x in blobs]
    return b"".join([struct.pack(f"<I{2 * len(blobs)}I", len(blobs), *numbers, *sizes), *(x for _, x in blobs)])


def unpack(packed: bytes) -> list[tuple[int, bytes]]:
    n = struct.unpack_from("<I", packed)[0]
    both, at, out = struct.unpack_from(f"<{2 * n}I", packed, 4), 4 + 8 * n, []
    for b, size in zip(both[:n], both[n:], strict=True):
        out.append((b, packed[at : at + size]))
        at += size
    return out


Answers = list[dict[int, bytes]]


def each_chunk(manifest: DataFrame, rounds: list[DataFrame], work: Callable[[int, Chunk, Answers], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """work() over every chunk with its answers from earlier rounds, by bucket.

    Chunks and answers are dealt by chunk to a stated number of partitions: a manifest row is small,
    so adaptive execution would gather all chunks in a few tasks.
    """
    tasks = max(partitions(manifest.sparkSession) * 2, manifest.count() // CHUNKS_A_TASK)
    rows = manifest.select("chunk", "uri").repartition(tasks, "chunk")
    for k, answers in enumerate(rounds):
        own = answers.repartition(tasks, "chunk").groupBy("chunk").agg(F.collect_list(F.struct("bucket", "blob")).alias(f"answers{k}"))
        rows = rows.join(own, "chunk", "left")
    n = len(rounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                got = [dict(y for x in b.column(2 + k)[i].as_py() or [] for y in ([(x["bucket"], x["blob"])] if x["bucket"] >= 0 else unpack(x["blob"]))) for k in range(n)]
                yield from work(b.column(0)[i].as_py(), Chunk(read_file(b.column(1)[i].as_py())), got)

    return rows.mapInArrow(lean(run), schema)


def solve_group(packed: list[bytes], solve: Callable[[list[bytes]], list[bytes]]) -> list[bytes]:
    """Answers of a group of buckets, bucket by bucket, so that only one is worked on at a time."""
    asked: dict[int, list[tuple[int, bytes]]] = {}
    for k, x in enumerate(packed):
        for b, blob in unpack(x):
            asked.setdefault(b, []).append((k, blob))
    answers: list[list[tuple[int, bytes]]] = [[] for _ in packed]
    while asked:
        b, rows = asked.popitem()
        for (k, _), x in zip(rows, solve([x for _, x in rows]), strict=True):
            answers[k].append((b, x))
    return [pack(x) for x in answers]


def ask(manifest: DataFrame, rounds: list[DataFrame], emit: Callable[[Chunk, Answers], Iterator[tuple[int, bytes]]], solve: Callable[[list[bytes]], list[bytes]], name: str, group: int = 1) -> DataFrame:
    """One round: emit() gives a chunk's (bucket, blob), solve() a bucket's answers, one for each blob.

    group: that many neighbouring buckets share a row of a chunk, whose number is negative.
    """

    def work(number: int, chunk: Chunk, got: Answers) -> Iterator[pa.RecordBatch]:
        rows = list(emit(chunk, got))
        if group > 1:
            own: dict[int, list[tuple[int, bytes]]] = {}
            for b, x in rows:
                own.setdefault(-1 - b // group, []).append((b, x))
            rows = [(b, pack(x)) for b, x in own.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([number] * len(rows), pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "chunk", "blob"])

    def answer(t: pa.Table) -> pa.Table:
        blobs = t.column("blob").to_pylist()
        blobs = solve(blobs) if group == 1 else solve_group(blobs, solve)
        return pa.table({"bucket": t.column("bucket"), "chunk": t.column("chunk"), "blob": pa.array(blobs, pa.binary())})

    return materialize(each_chunk(manifest, rounds, work, ROWS).groupBy("bucket").applyInArrow(answer, ROWS), name)


# Hashes of substrings, vectorised. A string's hash is a sum of random 64-bit values of its bytes times powers of an odd
# number, the same wherever the string stands, then mixed.

BASE = 0x9E3779B97F4A7C15
_u = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _u(30))) * _u(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _u(27))) * _u(0x94D049BB133111EB)
    return x ^ (x >> _u(31))


def _tables() -> tuple[np.ndarray, np.ndarray]:
    h = [int.from_bytes(hashlib.blake2b(bytes([i]), digest_size=16, key=b"lattica").digest(), "little") for i in range(256)]
    return np.array([x >> 64 for x in h], _u), np.array([x & (1 << 64) - 1 for x in h], _u)


TABLES = _tables()
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i for i < n, kept by each worker."""
    if not _powers or len(_powers[0]) < n:
        m = max(n, CHUNK_BYTES + (CHUNK_BYTES >> 3))
        _powers[:] = [np.concatenate([[_u(1)], np.multiply.accumulate(np.full(m - 1, _u(b)))]) for b in (BASE, pow(BASE, -1, 1 << 64))]
    return _powers[0][:n], _powers[1][:n]


class Prefix:
    """Hashes of any substring of a byte array, by one of two tables."""

    def __init__(self, values: np.ndarray):
        self.up, self.down = powers(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, _u)
        np.cumsum(values * self.up[: len(values)], out=self.sums[1:])

    @classmethod
    def of_bytes(cls, data: np.ndarray, which: int = 0) -> Prefix:
        return cls(TABLES[which][data])

    def spans(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix((self.sums[b] - self.sums[a]) * self.down[a] + (b - a).astype(_u))

    def grams(self, k: int) -> np.ndarray:
        n = len(self.sums) - k
        return mix((self.sums[k:] - self.sums[:n]) * self.down[:n] + _u(k)) if n > 0 else np.zeros(0, _u)


def distinct(hi: np.ndarray, lo: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of a first occurrence of each distinct key in ascending order, place of each element among them, counts)."""
    order = np.argsort(hi, kind="stable") if lo is None else np.lexsort((lo, hi))
    h = hi[order]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    if lo is not None:
        x = lo[order]
        new[1:] |= x[1:] != x[:-1]
    place = np.empty(len(h), np.int64)
    place[order] = np.cumsum(new) - 1
    at = np.flatnonzero(new)
    return order[at], place, np.diff(np.append(at, len(h)))


def bucket_bounds(hi: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(buckets that occur, bounds of each) in ascending keys hi."""
    b = ((hi >> _u(32)) * _u(buckets) >> _u(32)).astype(np.int64)
    at = np.flatnonzero(np.append(True, b[1:] != b[:-1])) if len(b) else np.zeros(0, np.int64)
    return b[at], np.append(at, len(b))


def send_keys(hi: np.ndarray, lo: np.ndarray | None, again: np.ndarray, buckets: int) -> Iterator[tuple[int, bytes]]:
    """A chunk's distinct ascending keys, and whether the chunk itself has each more than once."""
    own, bounds = bucket_bounds(hi, buckets)
    for k, b in enumerate(own):
        s = slice(bounds[k], bounds[k + 1])
        n = bounds[k + 1] - bounds[k]
        yield int(b), struct.pack("<IB", n, lo is not None) + hi[s].tobytes() + (b"" if lo is None else lo[s].tobytes()) + np.packbits(again[s]).tobytes()


def solve_shared(blobs: list[bytes]) -> list[bytes]:
    """A bit for each key: whether another chunk has it, or one has it more than once."""
    his, los, again, sizes = [], [], [], []
    for x in blobs:
        n, two = struct.unpack_from("<IB", x)
        his.append(np.frombuffer(x, _u, n, 5))
        if two:
            los.append(np.frombuffer(x, _u, n, 5 + 8 * n))
        again.append(np.unpackbits(np.frombuffer(x, np.uint8, -1, 5 + 8 * n * (1 + two)), count=n))
        sizes.append(n)
    _, place, counts = distinct(np.concatenate(his), np.concatenate(los) if los else None)
    shared = counts > 1
    shared |= np.bincount(place, np.concatenate(again), minlength=len(counts)) > 0
    out = shared[place]
    return [np.packbits(x).tobytes() for x in np.split(out, np.cumsum(sizes)[:-1])]


def received_bits(hi: np.ndarray, answers: dict[int, bytes], buckets: int) -> np.ndarray:
    """The answers to send_keys(), in the order of the keys."""
    out = np.zeros(len(hi), bool)
    own, bounds = bucket_bounds(hi, buckets)
    for k, b in enumerate(own):
        n = bounds[k + 1] - bounds[k]
        out[bounds[k] : bounds[k + 1]] = np.unpackbits(np.frombuffer(answers[int(b)], np.uint8), count=n)
    return out


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n places the windows of this width at starts cover."""
    diff = np.zeros(n + 1, np.int32)
    np.add.at(diff, starts, 1)
    np.add.at(diff, starts + width, -1)
    return np.cumsum(diff[:n]) > 0


@lru_cache(maxsize=1)
def white() -> np.ndarray:
    table = np.zeros(256, bool)
    table[[32, 9, 10, 11, 12, 13]] = True
    return table
