"""Token ids in sorted-string-table shards: prefix-compressed blocks, sparse block index, Bloom filter and footer.

A shard, all integers little-endian:

    magic   8 bytes, b"LATSST01"
    blocks  zstd frames; each holds entries one after another: varint shared key bytes, varint
            other key bytes, varint value bytes, those key bytes, the value
    index   per block: varint key length, last key, then offset u64, length u32, crc32 of the frame u32, entries u32
    bloom   bits of all keys
    footer  72 bytes: index offset, index length, bloom offset, bloom length, entries, tokens (u64 each),
            blocks u32, width of an id u16, Bloom probes u16, reserved 8 bytes, magic

Keys are the doc_id as 8 big-endian bytes with the sign flipped, so that bytes sort
as numbers do; a null doc_id is the empty key and sorts first. Values are ids of 2 bytes
if the vocabulary allows, else 4. Equal keys stand side by side.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.llm.run_index import ranges
from lattica.llm.shared import lean, materialize, one_thread, partitions, read_file, scratch, small_batches, table, write_file

MAGIC = b"LATSST01"
FOOTER = struct.Struct("<6QIHHQ8s")
ENTRY = struct.Struct("<QIII")
BLOCK_BYTES = 1 << 18
SHARD_BYTES = 48 << 20
PROBES = 7
#: Bytes of text that are encoded at a time, about.
PORTION = 4 << 20
#: Pieces met first, which the most common ones are among, whose ids a worker remembers at most, some 200 bytes each, and the longest it remembers.
REMEMBERED, LONG_PIECE = 250_000, 64


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else struct.pack(">Q", (doc_id + (1 << 63)) & ((1 << 64) - 1))


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key)[0] - (1 << 63) if key else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 0x7F) << shift
        if b < 0x80:
            return n, at
        shift += 7


def _probes(key: bytes, bits: int) -> list[int]:
    h = xxhash.xxh3_128_intdigest(key)
    a, b = h & ((1 << 64) - 1), h >> 64 | 1
    return [(a + i * b) % bits for i in range(PROBES)]


class ShardWriter:
    """Collects (key, value) in ascending order; bytes() is the whole file."""

    def __init__(self, width: int):
        self.width, self.out, self.block = width, bytearray(MAGIC), bytearray()
        self.keys: list[bytes] = []
        self.last, self.in_block, self.tokens, self.index = b"", 0, 0, bytearray()
        self.blocks, self.codec = 0, zstandard.ZstdCompressor(level=1)

    def add(self, key: bytes, value: bytes) -> None:
        if self.keys and key < self.last:
            raise ValueError("keys must not fall")
        shared = len(os.path.commonprefix((self.last, key))) if self.in_block else 0
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.keys.append(key)
        self.last, self.in_block, self.tokens = key, self.in_block + 1, self.tokens + len(value) // self.width
        if len(self.block) >= BLOCK_BYTES:
            self._close_block()

    def _close_block(self) -> None:
        if self.in_block:
            frame = self.codec.compress(bytes(self.block))
            self.index += _varint(len(self.last)) + self.last + ENTRY.pack(len(self.out), len(frame), zlib.crc32(frame), self.in_block)
            self.out += frame
            self.block, self.in_block, self.blocks = bytearray(), 0, self.blocks + 1

    def size(self) -> int:
        return len(self.out) + len(self.block)

    def bytes(self) -> bytes:
        self._close_block()
        bits = max(64, 10 * len(self.keys) + 7 & ~7)
        bloom = np.zeros(bits, np.uint8)
        for k in dict.fromkeys(self.keys):
            bloom[_probes(k, bits)] = 1
        bloom = np.packbits(bloom, bitorder="little").tobytes()
        at = len(self.out)
        footer = FOOTER.pack(at, len(self.index), at + len(self.index), len(bloom), len(self.keys), self.tokens, self.blocks, self.width, PROBES, 0, MAGIC)
        return bytes(self.out + self.index + bloom + footer)


class ShardReader:
    """Reads a shard: entries() in order, get(doc_id) by Bloom filter, then binary search in the block index."""

    def __init__(self, data: bytes):
        self.data = data
        at, n, self.bloom_at, self.bloom_len, self.entries_n, self.tokens, blocks, self.width, _, _, magic = FOOTER.unpack(data[-FOOTER.size :])
        if magic != MAGIC or data[:8] != MAGIC:
            raise ValueError("not a shard")
        self.last_keys, self.blocks, end = [], [], at + n
        while at < end:
            k, at = _read_varint(data, at)
            self.last_keys.append(data[at : at + k])
            self.blocks.append(ENTRY.unpack_from(data, at + k))
            at += k + ENTRY.size
        if len(self.blocks) != blocks:
            raise ValueError("damaged index")

    @classmethod
    def open(cls, uri: str) -> ShardReader:
        return cls(read_file(uri))

    def _block(self, i: int) -> Iterator[tuple[bytes, bytes]]:
        offset, length, crc, n = self.blocks[i]
        frame = self.data[offset : offset + length]
        if zlib.crc32(frame) != crc:
            raise ValueError("damaged block")
        raw, at, key = zstandard.ZstdDecompressor().decompress(frame), 0, b""
        for _ in range(n):
            shared, at = _read_varint(raw, at)
            own, at = _read_varint(raw, at)
            size, at = _read_varint(raw, at)
            key = key[:shared] + raw[at : at + own]
            yield key, raw[at + own : at + own + size]
            at += own + size

    def _ids(self, value: bytes) -> np.ndarray:
        return np.frombuffer(value, f"<u{self.width}").astype("<u4")

    def entries(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for i in range(len(self.blocks)):
            for k, v in self._block(i):
                yield id_of(k), self._ids(v)

    def may_hold(self, key: bytes) -> bool:
        bits = self.bloom_len * 8
        return all(self.data[self.bloom_at + p // 8] >> p % 8 & 1 for p in _probes(key, bits))

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every document with this doc_id, none if the shard has none."""
        key, out = key_of(doc_id), []
        if not self.may_hold(key):
            return out
        for i in range(bisect_left(self.last_keys, key), len(self.blocks)):
            for k, v in self._block(i):
                if k == key:
                    out.append(self._ids(v))
                elif k > key:
                    return out
        return out


class Encoder:
    """Ids of texts by the tokenizers library, with the ids of pieces remembered.

    A byte-level tokenizer with its own splitting pattern encodes each piece that the pattern finds by
    itself, so ids of pieces can be joined. For texts of plain characters, on whose classes all
    Unicode versions agree, that pattern is applied here. Other texts are split before
    single spaces that a non-space follows, where the pattern always splits. Other tokenizers, and texts that
    spell an added token, are encoded whole.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        from tokenizers import Tokenizer

        self.remembered = remembered

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.pieces = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer") and not spec.get("post_processor") and not spec.get("truncation")
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.known: dict[str, bytes] = {}

    def whole(self, texts: list[str]) -> list[bytes]:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        flat, ends = np.fromiter(chain.from_iterable(ids), f"<u{self.width}").tobytes(), np.cumsum([0, *map(len, ids)]) * self.width
        return [flat[i:j] for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]

    def split(self, text: str) -> list[str]:
        """Pieces whose ids are those of the text when joined."""
        if any(a in text for a in self.added):
            return [text]
        if _PLAIN.fullmatch(text):
            return _PIECE.findall(text)
        if _LOOSE.search(text):
            return _BEFORE.split(text)
        first, *rest = text.split(" ")  # the quick way to the same pieces
        return [first, *map(" ".__add__, rest)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as bytes. Distinct pieces of all texts are found by Arrow and looked up once."""
        if not self.pieces:
            return self.whole(texts)
        pieces = list(map(self.split, texts))
        coded = pa.array(list(chain.from_iterable(pieces)), pa.large_string()).dictionary_encode()
        own = coded.dictionary.to_pylist()
        found = list(map(self.known.get, own))
        new = [i for i, v in enumerate(found) if v is None]
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            for i, v in zip(part, self.whole([own[i] for i in part]), strict=True):
                found[i] = v
                if len(self.known) < self.remembered and len(own[i]) <= LONG_PIECE:
                    self.known[own[i]] = v
        codes = coded.indices.to_numpy()
        size = np.fromiter(map(len, found), np.int64, len(found)) // self.width
        start = np.cumsum(size) - size
        ids = np.frombuffer(b"".join(found), f"<u{self.width}")[ranges(start[codes], size[codes])]
        ends = np.append(0, np.cumsum(size[codes]))[np.cumsum([0, *map(len, pieces)])]
        return [ids[i:j].tobytes() for i, j in zip(ends[:-1], ends[1:], strict=True)]


_LETTER = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_PLAIN = re.compile(f"[\t\n\r\\x20-\\x7e\u00a1-\u00a9\u00ab\u00ac\u00ae-\u00b1\u00b4\u00b6-\u00b8\u00bb\u00bf\u00d7\u00f7{_LETTER[6:]}\u2013\u2014\u2018-\u201e\u2020-\u2022\u2026\u2039\u203a\u20ac]*")
#: The published splitting pattern of byte-level BPE, with its letter and number classes narrowed to plain characters.
_PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[0-9]+| ?[^\\s{_LETTER}0-9]+|\\s+(?!\\S)|\\s+")
#: A space before white space or the end; where it is not found, splitting at every space is right.
_LOOSE = re.compile(r" (?:\s|$)")
_BEFORE = re.compile(r"(?= \S)")
_encoders: dict[str, Encoder] = {}


def encoder(path: str, remembered: int = REMEMBERED) -> Encoder:
    """One for each worker and tokenizer file."""
    one_thread()
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    _encoders[path].remembered = remembered
    return _encoders[path]


def _portions(b: pa.RecordBatch) -> Iterator[tuple[list, list[str]]]:
    """(ids, texts) of a batch, some MB at a time."""
    sizes = np.cumsum(pc.binary_length(b.column(1)).to_numpy(zero_copy_only=False))
    cuts = np.unique(np.append(np.searchsorted(sizes, np.arange(0, sizes[-1] if len(sizes) else 0, PORTION)), b.num_rows))
    cuts = cuts if cuts[0] == 0 else np.append(0, cuts)
    for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        yield b.column(0).slice(i, j - i).to_pylist(), b.column(1).slice(i, j - i).to_pylist()


def each_once(encode: Callable[[list[str]], list[bytes]], texts: list[str]) -> Iterator[bytes]:
    """encode(texts), with each distinct text encoded once: the mix repeats documents, and their copies stand side by side."""
    own = list(dict.fromkeys(texts))
    return map(dict(zip(own, encode(own), strict=True)).__getitem__, texts)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


MANIFEST = "part int, seq int, uri string, docs long, tokens long"


def write_shards(docs: DataFrame, folder: str, tokenizer: str = "byte_bpe_50k.json", end_id: int | None = 2, shard_bytes: int = SHARD_BYTES, remembered: int = REMEMBERED) -> DataFrame:
    """Encode docs (doc_id, text; other columns are ignored) into shards under folder, in ascending doc_id order.

    Returns the manifest, a row per shard; (part, seq) orders the shards. Null texts
    are empty; end_id is added to each document. Rows with equal doc_id keep a place each,
    ordered by their text's hash, and a doc_id that many rows share is dealt over several
    tasks. A task that runs again writes files of other names; only those
    in the manifest count. An empty table gives no shards. remembered: pieces whose ids a worker keeps, memory for time.
    """
    spark = docs.sparkSession
    small_batches(spark, 1000)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("salt", F.xxhash64("text")).repartitionByRange(partitions(spark) * 2, "doc_id", "salt").sortWithinPartitions("doc_id", "salt").drop("salt")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyspark import TaskContext

        enc, part, seq = encoder(tokenizer_path(tokenizer), remembered), TaskContext.get().partitionId(), 0
        end = b"" if end_id is None else np.array([end_id], f"<u{enc.width}").tobytes()
        shard = ShardWriter(enc.width)

        def close() -> pa.RecordBatch:
            write_file(uri := f"{folder}/{part:06d}-{seq:05d}-{uuid.uuid4().hex[:8]}.sst", shard.bytes())
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "uri": [uri], "docs": pa.array([len(shard.keys)], pa.int64()), "tokens": pa.array([shard.tokens], pa.int64())})

        for b in batches:
            for ids, texts in _portions(b):
                for d, v in zip(ids, each_once(enc.encode, texts), strict=True):
                    shard.add(key_of(d), v + end)
                    if shard.size() >= shard_bytes:
                        yield close()
                        shard, seq = ShardWriter(enc.width), seq + 1
        if shard.keys:
            yield close()

    return materialize(rows.mapInArrow(lean(run), MANIFEST), "sst-manifest")


def read_shards(manifest: DataFrame) -> DataFrame:
    """A row per document from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    spark = manifest.sparkSession
    # one row per shard
    order = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.select("uri", F.coalesce(F.sum("tokens").over(order), F.lit(0)).alias("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows: tuple[list, list, list, list] = ([], [], [], [])
                for d, ids in ShardReader.open(uri).entries():
                    for to, x in zip(rows, (d, start, len(ids), zlib.crc32(ids.tobytes())), strict=True):
                        to.append(x)
                    start += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in rows], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.repartition(partitions(spark)).mapInArrow(lean(run), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op2_sst(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards, read back; a query by itself has memory to remember more pieces than a stage of the pipeline."""
    return read_shards(write_shards(table(spark, sf_dir, "documents"), scratch(spark, "sst"), remembered=4 * REMEMBERED))


QUERIES = {"op2_sst": op2_sst}
ORACLE_SQL: dict[str, str] = {}
