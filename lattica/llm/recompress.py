"""Repeated passages of words by recompression.

A document's words are symbols. A round first makes each maximal run of one symbol a symbol, named by the
symbol and the run's length, so that repetitive text shrinks at once. Then it pairs: a hash of a
symbol's name, new in each round, makes it a left or a right one, and a left one followed by a right
one become one symbol, named by the two. A run is on the side of the symbol it repeats. What becomes of a symbol
depends on it and its neighbours alone, so equal passages get equal symbols inside. At an edge of a passage, the
run there may be longer outside, and what is paired with that run goes with it; dropping these in each
round leaves the core that every occurrence of the passage has in common.

Names are hashes of what they stand for, so that they are global without asking anyone. A Spark round then
tells which high-level symbols the corpus has more than once; a window of words all of whose long core
symbols are shared may repeat, others can't. A second round verifies these by 128-bit hashes of their words,
two chains of 64 bits over both halves of a keyed hash of each word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from lattica.llm.chunks import Answers, Chunk, _u, ask, bucket_count, covered, distinct, each_chunk, mix, received_bits, send_keys, solve_shared, white, write_chunks
from lattica.llm.shared import WORD, table

ROUNDS = 4
#: Words that a symbol stands for at least to be asked about.
LONG = 4
SEED = 0x1A77_1CA0
#: Odd numbers by which names and window hashes are multiplied.
_RUN, _PAIR, _ROUND, _CHAINS = 0xD6E8FEB86659FD93, 0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F, (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


class Words:
    """The words of a chunk, 128-bit hashes of them, and the windows that lie in one document."""

    def __init__(self, chunk: Chunk, width: int):
        space = white()[chunk.data]
        begin = np.flatnonzero(~space & np.append(True, space[:-1]))
        self.first = np.searchsorted(begin, chunk.start)
        self.last = np.searchsorted(begin, chunk.end)
        # bytes.split() without arguments splits at the same six bytes; the line feed after each document ends its last word
        coded = pa.array(chunk.raw.split(), pa.large_binary()).dictionary_encode()
        hashes = b"".join(xxhash.xxh3_128_digest(w, SEED) for w in coded.dictionary.to_pylist())
        self.hi, self.lo = np.frombuffer(hashes, "<u8").reshape(-1, 2)[coded.indices.to_numpy()].T if len(coded) else (np.zeros(0, _u), np.zeros(0, _u))
        self.n = len(begin)
        self.windows = np.flatnonzero(np.arange(self.n) + width <= np.repeat(self.last, self.last - self.first))
        self.width = width

    def window_keys(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of the words of the windows at these places; a multiplication and a shift for each word, so no power of a base is in them."""
        out = []
        for half, odd in zip((self.hi, self.lo), _CHAINS, strict=True):
            x = np.full(len(at), _u(odd))
            for j in range(self.width):
                x = (x ^ half[at + j]) * _u(odd)
                x ^= x >> _u(29)
            out.append(x)
        return out[0], out[1]


def recompress(words: Words, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(names, lengths in words, core begins, core ends): the symbols after so many rounds, and for each window the range of symbols in its core."""
    name, size = words.hi, np.ones(words.n, np.int64)
    opens = np.zeros(words.n + 1, bool)  # first of its document
    opens[words.first] = True
    opens = opens[: words.n]
    a, b = words.windows, words.windows + words.width
    for r in range(rounds):
        if not len(name):
            break
        right = mix(name + _u((_ROUND * (r + 1)) & ((1 << 64) - 1))) >> _u(63) == 1
        # runs become symbols; windows lose those at their edges
        head = opens.copy()
        head[0] = True
        head[1:] |= name[1:] != name[:-1]
        at, run = np.flatnonzero(head), np.cumsum(head) - 1
        times = np.diff(np.append(at, len(name)))
        full = a < b
        a, b = np.where(full, run[np.minimum(a, len(name) - 1)] + 1, 0), np.where(full, run[b - 1], 0)
        name = np.where(times > 1, mix(name[at] * _u(_RUN) + times.astype(_u)), name[at])
        size, right, opens = np.add.reduceat(size, at), right[at], opens[at]
        # pairs become symbols; windows lose those that hold a run just lost
        joined = np.zeros(len(name), bool)  # with the next one
        joined[:-1] = ~right[:-1] & right[1:] & ~opens[1:]
        full = a < b
        a = a + (full & joined[np.maximum(a, 1) - 1])
        full = a < b
        b = b - (full & joined[b - 1])
        full = a < b
        stays = np.append(True, ~joined[:-1])
        to = np.cumsum(stays)
        a, b = np.where(full, to[np.minimum(a, len(name) - 1)] - 1, 0), np.where(full, to[b - 1], 0)
        following = np.append(name[1:], _u(0))
        name = np.where(joined, mix(name * _u(_PAIR) + mix(following + _u(r))), name)[stays]
        size = np.where(joined, size + np.append(size[1:], 0), size)[stays]
        opens = opens[stays]
    return name, size, a, b


def _long_symbols(words: Words) -> tuple:
    name, size, a, b = recompress(words)
    long = np.flatnonzero(size >= LONG)
    first, place, counts = distinct(name[long])
    return name[long][first], place, counts, long, a, b, len(name)


def _candidates(words: Words, answers: dict[int, bytes], buckets: int) -> np.ndarray:
    """Starts of the windows all of whose long core symbols are shared."""
    keys, place, _, long, a, b, n = _long_symbols(words)
    shared = received_bits(keys, answers, buckets)
    alone = np.zeros(n + 1, np.int64)
    alone[long + 1] = ~shared[place]
    alone = np.cumsum(alone)
    return words.windows[alone[b] == alone[a]]


RESULT = "doc_id long, n_words long, n_removed long, kept string, kept_sha256 string"


def drop_repeats(docs: DataFrame, width: int = 35, with_text: bool = True) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept (the words left, joined by a space; null unless with_text), kept_sha256.

    Removes every word covered by a window of width words whose word sequence also starts
    elsewhere, in another document or the same; words are runs of other than ASCII white space. Windows are
    judged on the input. Null and empty texts have no words; so do texts of white space. Rows
    that repeat a document repeat its windows, whatever their doc_id, which may be null. Columns other than
    doc_id and text are ignored, whatever their names. A document longer than a chunk has a chunk of its own, and
    is in one task's memory at a time, some 100 bytes for each of its bytes.
    """
    manifest = write_chunks(docs)
    buckets = bucket_count(manifest)

    def symbols(chunk: Chunk, got: Answers) -> Iterator[tuple[int, bytes]]:
        keys, _, counts, *_ = _long_symbols(Words(chunk, width))
        yield from send_keys(keys, None, counts > 1, buckets)

    def windows(chunk: Chunk, got: Answers) -> Iterator[tuple[int, bytes]]:
        words = Words(chunk, width)
        hi, lo = words.window_keys(_candidates(words, got[0], buckets))
        first, _, counts = distinct(hi, lo)
        yield from send_keys(hi[first], lo[first], counts > 1, buckets)

    def finish(number: int, chunk: Chunk, got: Answers) -> Iterator[pa.RecordBatch]:
        words = Words(chunk, width)
        at = _candidates(words, got[0], buckets)
        hi, lo = words.window_keys(at)
        first, place, _ = distinct(hi, lo)
        gone = covered(at[received_bits(hi[first], got[1], buckets)[place]], width, words.n)
        total = np.append(0, np.cumsum(gone))
        removed = total[words.last] - total[words.first]
        kept = []
        for k, (s, e) in enumerate(zip(chunk.start.tolist(), chunk.end.tolist(), strict=True)):
            own = chunk.raw[s:e].split()
            if removed[k]:
                own = [w for w, g in zip(own, gone[words.first[k] : words.last[k]].tolist(), strict=True) if not g]
            kept.append(b" ".join(own))
        arrays = [pa.array(chunk.id_list(), pa.int64()), pa.array(words.last - words.first, pa.int64()), pa.array(removed, pa.int64())]
        text = pa.array([x.decode("utf-8", "replace") for x in kept] if with_text else [None] * len(kept), pa.string())
        yield pa.RecordBatch.from_arrays([*arrays, text, pa.array([hashlib.sha256(x).hexdigest() for x in kept])], ["doc_id", "n_words", "n_removed", "kept", "kept_sha256"])

    shared = ask(manifest, [], symbols, solve_shared, "symbols")
    repeated = ask(manifest, [shared], windows, solve_shared, "windows")
    return each_chunk(manifest, [shared, repeated], finish, RESULT)


def op9_recompress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """drop_repeats over documents, without the kept text: windows of 35 words."""
    return drop_repeats(table(spark, sf_dir, "documents"), with_text=False).drop("kept")


QUERIES = {"op9_recompress": op9_recompress}
ORACLE_SQL = {
    "op9_recompress": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
s AS (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35),
n AS (SELECT r, i, count(*) OVER (PARTITION BY array_to_string(w[i:i + 34], ' ')) AS n FROM s),
g AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS p FROM n WHERE n > 1),
k AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
t AS (SELECT k.r, string_agg(word, ' ' ORDER BY k.p) AS kept, count(*) AS n FROM k LEFT JOIN g ON g.r = k.r AND g.p = k.p WHERE g.p IS NULL GROUP BY k.r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN t ON t.r = d.r"""
}
