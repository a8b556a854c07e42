"""Long byte matches with earlier documents, by run-length indexes that Spark deals out.

Every string of 50 bytes belongs to the smallest hash among its grams, its anchor, which is the same wherever the string
stands. A first Spark round tells which anchors occur in more than one document; all strings
without such an anchor are unique. A second round sends what is left, as the distinct segments of consecutive
strings with one anchor, to the anchor's bucket, so that all occurrences of a string meet in one
bucket. Segments alike are one there. Where an anchor has several different segments, the bucket builds a run-length
index of the runs of their strings whose hashes come twice (run_index) and streams their matching statistics: where a match reaches 50 bytes, the
index's sample gives the smallest document that has it. An anchor with very many segments is hot: its strings are dealt
one by one, by their 128-bit hashes, so that no task gets an unbounded group.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

from lattica.llm.chunks import Answers, Chunk, Prefix, _u, ask, bucket_bounds, bucket_count, distinct, each_chunk, mix, together, write_chunks
from lattica.llm.run_index import RunIndex, ranges
from lattica.llm.shared import table

GRAM = 24
#: Strings that a segment has at most; longer ones (bytes that repeat with a short period) are cut.
SEGMENT = 4096
#: Strings that a text of an index has at most: all texts are streamed side by side, so that a few long ones would take a step for each symbol.
RUN = 256
#: Segments from which on an anchor is hot.
HOT = 4096
#: Text behind a bucket, about.
BUCKET = 8 << 20
LAST = np.iinfo(np.int64).max


#: Places whose hashes are made at a time, so that what is in hand stays in a core's cache.
BLOCK = 1 << 15
_MIX = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def least_hashes(data: np.ndarray, gram: int, span: int = 1) -> np.ndarray:
    """The least hash of span consecutive grams, from each place on where they fit; equal grams have equal hashes, and others may."""
    n = len(data) - gram - span + 2
    if n <= 0:
        return np.zeros(0, _u)
    # eight bytes from any place on, as a number
    words = np.ndarray(len(data), "<u8", np.append(data, np.zeros(8, np.uint8)), 0, (1,))
    offsets = [*range(8, gram - 8, 8), *([gram - 8] if gram > 8 else [])]
    reach, out = max(0, gram - 8), np.empty(n, _u)
    own, one, two = (np.empty(min(n, BLOCK) + span + more, _u) for more in (reach, 0, 0))
    for s in range(0, n, BLOCK):
        m = min(BLOCK, n - s)
        size = m + span - 1
        w, x, y = own[: size + reach], one[:size], two[:size]
        np.copyto(w, words[s : s + len(w)])
        if gram < 8:
            w &= _u((1 << 8 * gram) - 1)
        np.multiply(w[:size], _u(_MIX[0]), out=x)
        for o in offsets:
            x ^= np.right_shift(x, _u(32), out=y)
            x += w[o : o + size]
            x *= _u(_MIX[1])
        x ^= np.right_shift(x, _u(32), out=y)
        x *= _u(_MIX[0])
        have = 1  # grams behind each minimum, by doubling
        while have * 2 <= span:
            x, y = np.minimum(x[:-have], x[have:], out=y[: len(x) - have]), x
            have *= 2
        out[s : s + m] = np.minimum(x[:m], x[span - have : span - have + m])
    return out


def in_parts(begin: np.ndarray, size: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, size) of runs cut to this size at most, and how many parts there are of each."""
    parts = -(-size // most)
    past = ranges(np.zeros(len(parts), np.int64), parts) * most
    return np.repeat(begin, parts) + past, np.minimum(np.repeat(size, parts) - past, most), parts


class Segments:
    """Runs of consecutive strings of one document that have one anchor."""

    def __init__(self, chunk: Chunk, width: int):
        gram = min(GRAM, width)
        anchors = least_hashes(chunk.data, gram, width - gram + 1)
        long = np.flatnonzero(chunk.end - chunk.start >= width)
        start, stop = chunk.start[long], chunk.end[long] - width + 1  # where a document's strings start
        new = np.zeros(len(anchors) + 1, bool)
        new[1:-1] = anchors[1:] != anchors[:-1]
        new[start] = new[stop] = True
        at = np.flatnonzero(new)
        lo = np.searchsorted(at, start)
        count = np.searchsorted(at, stop) - lo
        rows, doc = ranges(lo, count), np.repeat(long, count)
        begin = at[rows]
        size = at[rows + 1] - begin
        if len(size) and size.max() > SEGMENT:
            begin, size, parts = in_parts(begin, size, SEGMENT)
            doc = np.repeat(doc, parts)
        # minima of hashes are small; mixed again, they deal evenly to buckets
        self.begin, self.strings, self.key, self.doc, self.width = begin, size, mix(anchors[begin]), doc, width

    def keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(distinct anchors ascending, place of each segment's anchor among them, its segments, whether several documents of the chunk have it)."""
        order = np.argsort(self.key)
        keys = self.key[order]
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        at = np.flatnonzero(new)
        place = np.empty(len(keys), np.int64)
        place[order] = np.cumsum(new) - 1
        doc = self.doc[order]
        several = np.append(doc[1:] != doc[:-1], False) & ~np.append(new[1:], True)  # some neighbours of one anchor are of two documents
        return keys[at], place, np.diff(np.append(at, len(keys))), np.logical_or.reduceat(several, at) if len(at) else new

    def pick(self, rows: np.ndarray) -> None:
        self.begin, self.strings, self.key, self.doc = (x[rows] for x in (self.begin, self.strings, self.key, self.doc))


def send_anchors(keys: np.ndarray, counts: np.ndarray, several: np.ndarray, buckets: int) -> Iterator[tuple[int, bytes]]:
    own, bounds = bucket_bounds(keys, buckets)
    weight = np.minimum(counts, 255).astype(np.uint8)
    for k, b in enumerate(own):
        r = slice(bounds[k], bounds[k + 1])
        yield int(b), struct.pack("<I", bounds[k + 1] - bounds[k]) + keys[r].tobytes() + weight[r].tobytes() + np.packbits(several[r]).tobytes()


def solve_anchors(blobs: list[bytes]) -> list[bytes]:
    """Two bits for each anchor: whether several documents have it, and whether it is hot."""
    sizes = [struct.unpack_from("<I", x)[0] for x in blobs]
    keys = np.concatenate([np.frombuffer(x, "<u8", n, 4) for x, n in zip(blobs, sizes, strict=True)])
    weight = np.concatenate([np.frombuffer(x, np.uint8, n, 4 + 8 * n) for x, n in zip(blobs, sizes, strict=True)])
    several = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8, -1, 4 + 9 * n), count=n) for x, n in zip(blobs, sizes, strict=True)])
    _, place, counts = distinct(keys)
    shared = (counts > 1) | (np.bincount(place, several, minlength=len(counts)) > 0)
    hot = shared & (np.bincount(place, weight, minlength=len(counts)) >= HOT)
    cuts = np.cumsum(sizes)[:-1]
    return [np.packbits(x).tobytes() + np.packbits(y).tobytes() for x, y in zip(np.split(shared[place], cuts), np.split(hot[place], cuts), strict=True)]


def received_anchors(keys: np.ndarray, answers: dict[int, bytes], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    own, bounds = bucket_bounds(keys, buckets)
    bits = np.unpackbits(np.frombuffer(b"".join(answers[int(b)] for b in own), np.uint8))
    n = np.diff(bounds)
    half = -(-n // 8) * 8  # bits of either answer, with those that fill a byte
    begin = np.cumsum(2 * half) - 2 * half
    shared, hot = (bits[ranges(x, n)].astype(bool) for x in (begin, begin + half))
    return shared, hot


class Shared:
    """What of a chunk has shared anchors: its distinct segments, and the strings of hot anchors one by one."""

    def __init__(self, chunk: Chunk, width: int, answers: dict[int, bytes], buckets: int):
        s = self.segments = Segments(chunk, width)
        keys, place, *_ = s.keys()
        shared, hot = (x[place] for x in received_anchors(keys, answers, buckets))
        strings = s.strings[hot]
        self.at, self.at_doc = ranges(s.begin[hot], strings), np.repeat(s.doc[hot], strings)
        self.hi, self.lo = (Prefix.of_bytes(chunk.data, k).spans(self.at, self.at + width) if len(self.at) else np.zeros(0, _u) for k in (0, 1))
        self.hot_first, self.hot_place, _ = distinct(self.hi, self.lo)
        s.pick(np.flatnonzero(shared & ~hot))
        sizes = s.strings + width - 1
        which, _ = same_bytes(chunk.data[ranges(s.begin, sizes)], sizes)  # equal bytes have one anchor
        order = np.lexsort((which, s.key))
        new = np.ones(len(order), bool)
        new[1:] = which[order][1:] != which[order][:-1]
        self.place = np.empty(len(order), np.int64)  # of each segment among the distinct ones, which are in order of their anchors
        self.place[order] = np.cumsum(new) - 1
        self.rows = order[new]
        ids = np.full(len(self.rows), LAST)
        np.minimum.at(ids, self.place, chunk.ids[s.doc])
        hot_ids = np.full(len(self.hot_first), LAST)
        np.minimum.at(hot_ids, self.hot_place, chunk.ids[self.at_doc])
        self.ids, self.hot_ids = ids, hot_ids

    def send(self, data: np.ndarray, buckets: int) -> Iterator[tuple[int, bytes]]:
        """Segments to buckets by anchor; strings of hot anchors to as many buckets beyond these."""
        s, codec = self.segments, zstandard.ZstdCompressor(level=1)
        begin, key = s.begin[self.rows], s.key[self.rows]
        sizes = s.strings[self.rows] + s.width - 1
        own, bounds = bucket_bounds(key, buckets)
        ends = np.append(0, np.cumsum(sizes))[bounds]
        text, short, ids, group = data[ranges(begin, sizes)], sizes.astype("<u4"), self.ids.astype("<i8"), key.astype("<u4")
        for k, b in enumerate(own):
            r = slice(bounds[k], bounds[k + 1])
            parts = [short[r], ids[r], group[r], text[ends[k] : ends[k + 1]]]
            yield int(b), codec.compress(struct.pack("<BI", 0, r.stop - r.start) + b"".join(x.tobytes() for x in parts))
        hi, lo = self.hi[self.hot_first], self.lo[self.hot_first]
        own, bounds = bucket_bounds(hi, buckets)
        for k, b in enumerate(own):
            r = slice(bounds[k], bounds[k + 1])
            yield buckets + int(b), codec.compress(struct.pack("<BI", 1, len(hi[r])) + hi[r].tobytes() + lo[r].tobytes() + self.hot_ids[r].astype("<i8").tobytes())

    def receive(self, answers: dict[int, bytes], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, document within the chunk, smallest doc_id) of each string."""
        s, codec = self.segments, zstandard.ZstdDecompressor()

        def joined(own: np.ndarray, base: int) -> np.ndarray:
            return np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(codec.decompress(answers[base + int(b)]), "<i8") for b in own)])

        least = joined(bucket_bounds(s.key[self.rows], buckets)[0], 0)
        counts = s.strings[self.rows]
        base = (np.cumsum(counts) - counts)[self.place] if len(self.rows) else np.zeros(0, np.int64)
        hot = joined(bucket_bounds(self.hi[self.hot_first], buckets)[0], buckets)[self.hot_place]
        at = np.concatenate([ranges(s.begin, s.strings), self.at])
        return at, np.concatenate([np.repeat(s.doc, s.strings), self.at_doc]), np.concatenate([least[ranges(base, s.strings)], hot])


def same_bytes(text: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of each segment among the distinct ones, a segment of each number): segments stand one after another and are compared byte by byte."""
    offsets = np.append(0, np.cumsum(sizes)).astype(np.int64)
    array = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(text))])
    place = array.dictionary_encode().indices.to_numpy().astype(np.int64)  # numbered as they first come
    return place, np.unique(place, return_index=True)[1]


def solve_least(width: int, blobs: list[bytes]) -> list[bytes]:
    """A bucket's answers: the smallest doc_id of each string of each segment, or of each string of hot anchors."""
    codec = zstandard.ZstdDecompressor()
    raw = [codec.decompress(x) for x in blobs]
    return _solve_hot(raw) if raw[0][0] else _solve_segments(width, raw)


def _split(answer: np.ndarray, sizes: list[int]) -> list[bytes]:
    codec = zstandard.ZstdCompressor(level=1)
    return [codec.compress(x.astype("<i8").tobytes()) for x in np.split(answer, np.cumsum(sizes)[:-1])]


def _solve_hot(raw: list[bytes]) -> list[bytes]:
    sizes = [struct.unpack_from("<I", x, 1)[0] for x in raw]
    hi, lo, ids = (np.concatenate([np.frombuffer(x, t, n, 5 + 8 * k * n) for x, n in zip(raw, sizes, strict=True)]) for k, t in enumerate(("<u8", "<u8", "<i8")))
    _, place, counts = distinct(hi, lo)
    least = np.full(len(counts), LAST)
    np.minimum.at(least, place, ids)
    return _split(least[place], sizes)


def repeated(text: np.ndarray, sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first place, segment, strings) of the runs of strings whose hashes are not alone; segments stand one after another.

    Equal strings have equal hashes, so no string that comes twice is left out. Whether strings of one hash are equal is left to the index.
    """
    begin, strings = np.cumsum(sizes) - sizes, sizes - width + 1
    hashes = least_hashes(text, width)[ranges(begin, strings)]
    order = np.argsort(hashes)
    ordered = hashes[order]
    alike = ordered[1:] == ordered[:-1]
    # a place after each segment stays empty, so that runs end with it
    begin += np.arange(len(sizes))
    at, twice = ranges(begin, strings), np.zeros(len(text) + len(sizes) + 1, bool)
    twice[at[order[1:][alike]]] = twice[at[order[:-1][alike]]] = True
    edge = np.flatnonzero(np.diff(twice, prepend=False))
    first, runs, _ = in_parts(edge[::2], edge[1::2] - edge[::2], RUN)
    of = np.searchsorted(begin, first, "right") - 1
    return first - of, of, runs


def _solve_segments(width: int, raw: list[bytes]) -> list[bytes]:
    ns = [struct.unpack_from("<I", x, 1)[0] for x in raw]
    sizes, ids, group, text = (
        np.concatenate([np.frombuffer(x, t, -1 if t == np.uint8 else n, 5 + at * n) for x, n in zip(raw, ns, strict=True)]) for t, at in (("<u4", 0), ("<i8", 4), ("<u4", 12), (np.uint8, 16))
    )
    sizes = sizes.astype(np.int64)
    begin = np.cumsum(sizes) - sizes
    place, first = same_bytes(text, sizes)
    least = np.full(len(first), LAST)
    np.minimum.at(least, place, ids)
    strings = sizes[first] - width + 1
    offset = np.cumsum(strings) - strings
    answer = np.repeat(least, strings)
    # where all segments of an anchor are alike, the smallest document that has it is already known
    _, of, alike = np.unique(group[first], return_inverse=True, return_counts=True)
    several = np.flatnonzero(alike[of] > 1)
    if len(several):
        own = sizes[first][several]
        part = text[ranges(begin[first][several], own)]
        at, of, runs = repeated(part, own, width)
        own = runs + width - 1
        to = offset[several][of] + at - (np.cumsum(sizes[first][several]) - sizes[first][several])[of]
        part = part[ranges(at, own)]
        found = RunIndex(part, own, least[several][of], width).stream(part, own)
        answer[ranges(to, runs)] = found[ranges(np.cumsum(own) - own, runs)]
    out = answer[ranges(offset[place], strings[place])]
    per_row = np.append(0, np.cumsum(strings[place]))
    ends = np.cumsum(ns)
    return _split(out, [int(per_row[e] - per_row[e - n]) for e, n in zip(ends, ns, strict=True)])


def spans(starts: np.ndarray, width: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, stops) of the maximal runs of the n places that the strings of this width at starts cover."""
    own = np.zeros(n + 1, bool)
    own[starts] = True
    edge = np.flatnonzero(own[1:] != own[:-1]) + 1
    if own[0]:
        edge = np.append(0, edge)
    a, b = edge[::2], edge[1::2] + width - 1
    apart = a[1:] > b[:-1]
    return a[np.append(True, apart)[: len(a)]], b[np.append(apart, True)[: len(b)]]


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<start:long,stop:long>>, kept binary, kept_sha256 string"


def drop_matches(docs: DataFrame, width: int = 50, with_text: bool = True) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, spans (removed byte ranges), kept (the bytes left; null unless with_text), kept_sha256.

    Removes every byte covered by a string of width bytes that also starts in a document with a smaller
    doc_id; strings are judged on the input and do not cross documents. Texts are UTF-8; null
    counts as empty. A null doc_id is larger than any other, and rows of equal doc_id, or
    without one, don't count for one another.
    """
    manifest = write_chunks(docs)
    buckets = bucket_count(manifest, BUCKET)

    def anchors(chunk: Chunk, got: Answers) -> Iterator[tuple[int, bytes]]:
        keys, _, counts, several = Segments(chunk, width).keys()
        yield from send_anchors(keys, counts, several, buckets)

    def segments(chunk: Chunk, got: Answers) -> Iterator[tuple[int, bytes]]:
        yield from Shared(chunk, width, got[0], buckets).send(chunk.data, buckets)

    def finish(number: int, chunk: Chunk, got: Answers) -> Iterator[pa.RecordBatch]:
        at, doc, least = Shared(chunk, width, got[0], buckets).receive(got[1], buckets)
        starts, stops = spans(at[least < chunk.ids[doc]], width, len(chunk.data))
        lo, hi = np.searchsorted(starts, chunk.start), np.searchsorted(starts, chunk.end)
        removed, kept, cut = [], [], []
        for k, (a, b) in enumerate(zip(chunk.start.tolist(), chunk.end.tolist(), strict=True)):
            cuts = list(zip(starts[lo[k] : hi[k]].tolist(), stops[lo[k] : hi[k]].tolist(), strict=True))
            parts, at = [], a
            for x, y in cuts:
                parts.append(chunk.raw[at:x])
                at = y
            kept.append(b"".join([*parts, chunk.raw[at:b]]))
            removed.append(sum(y - x for x, y in cuts))
            cut.append([{"start": x - a, "stop": y - a} for x, y in cuts])
        span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        arrays = [pa.array(chunk.id_list(), pa.int64()), pa.array(chunk.end - chunk.start, pa.int64()), pa.array(removed, pa.int64()), pa.array([len(x) for x in cut], pa.int64()), pa.array(cut, span)]
        text = pa.array(kept if with_text else [None] * len(kept), pa.binary())
        yield pa.RecordBatch.from_arrays([*arrays, text, pa.array([hashlib.sha256(x).hexdigest() for x in kept])], ["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept", "kept_sha256"])

    shared = ask(manifest, [], anchors, solve_anchors, "anchors", together(buckets))
    least = ask(manifest, [shared], segments, lambda blobs: solve_least(width, blobs), "segments", together(buckets))
    return each_chunk(manifest, [shared, least], finish, RESULT)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """drop_matches over documents, without the kept bytes and spans: strings of 50 bytes."""
    return drop_matches(table(spark, sf_dir, "documents"), with_text=False).drop("kept", "spans")


QUERIES = {"op10_suffix_dedup": op10_suffix_dedup}
ORACLE_SQL: dict[str, str] = {}
