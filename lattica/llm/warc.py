"""WARC archives whose records are compressed one by one with a dictionary that the file itself carries.

A file starts with a skippable frame (magic 0x184D2A5D) that holds a Zstandard
dictionary; then every record is a Zstandard frame of its own that needs it, so
a record can be read alone from its offset. Records that repeat a payload are
written as revisits that refer to the first one.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.shared import join_hot, lean, materialize, partitions, read_file, scratch, small_batches, table, write_file

DICT_MAGIC = 0x184D2A5D
#: Payload bytes in a file before the next one is begun.
FILE_BYTES = 32 << 20
#: A file's dictionary is trained on its records, evenly spaced, up to so many bytes of them, each at most SAMPLE bytes.
TRAIN_BYTES, SAMPLE, DICT_BYTES = 1 << 20, 8 << 10, 32 << 10
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    """A UUID (version 8) that spells the page_id; the nil UUID for none."""
    if page_id is None:
        return f"<urn:uuid:{uuid.UUID(int=0)}>"
    x = page_id & ((1 << 64) - 1)
    return f"<urn:uuid:{uuid.UUID(int=(x >> 16) << 80 | 8 << 76 | 2 << 62 | (x & 0xFFFF) << 16 | 0x1A77)}>"


def page_of(rid: str) -> int | None:
    n = uuid.UUID(rid.strip("<>").removeprefix("urn:uuid:")).int
    if n == 0:
        return None
    x = (n >> 80) << 16 | n >> 16 & 0xFFFF
    return x - (1 << 64) if x >> 63 else x


def build_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, revisit: bool = False) -> bytes:
    """A response with its payload, or a revisit with only the HTTP header of one."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    uri = "".join((url or "urn:x-none").split()) or "urn:x-none"
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest(payload)}"]
    if revisit:
        head += [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """(WARC fields in lower case, HTTP header, payload) of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("damaged WARC record")
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, http, payload


def train(records: list[bytes]) -> bytes:
    """A dictionary from records spread evenly over the file; too few of them give one of raw content."""
    step = max(1, sum(min(len(r), SAMPLE) for r in records) // TRAIN_BYTES)
    samples = [r[:SAMPLE] for r in records[::step]]
    if len(samples) >= 16:
        try:
            return zstandard.train_dictionary(DICT_BYTES, samples, k=512, d=8, level=3).as_bytes()
        except zstandard.ZstdError:  # records too alike or too small to train on
            pass
    return b"".join(samples)[:DICT_BYTES]


def pack_file(records: list[bytes]) -> bytes:
    d = train(records)
    codec = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=True)
    return b"".join([struct.pack("<II", DICT_MAGIC, len(d)), d, *map(codec.compress, records)])


def read_records(data: bytes) -> Iterator[bytes]:
    magic, n = struct.unpack_from("<II", data)
    if magic != DICT_MAGIC:
        raise ValueError("no dictionary frame")
    codec, rest = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + n])), memoryview(data)[8 + n :]
    while rest:
        one = codec.decompressobj()
        yield one.decompress(rest)
        rest = rest[len(rest) - len(one.unused_data) :] if one.unused_data else rest[:0]


def roles(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, size, sha, refers_to) of the pages that revisit another.

    Payloads of at least min_bytes that agree in size and SHA-256 are equal. The group's
    smallest page_id is the response; rows that repeat that page_id are responses too. If
    no page of a group has an id, all are responses.
    """
    p = materialize(pages.select("page_id", "size", "sha").where(F.col("size") >= min_bytes), "warc-digests")
    first = p.groupBy("size", "sha").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 and refers_to is not null")
    again = join_hot(p, materialize(first, "warc-first"), ["size", "sha"], "n").where(~F.col("page_id").eqNullSafe(F.col("refers_to")))
    return again.select("page_id", "size", "sha", "refers_to").distinct()


MANIFEST = "uri string, records long"


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write a record for each row of pages (page_id, url, html; null html is empty) and return the manifest, a row per file.

    Other columns are ignored, whatever their names; an empty table gives no files. Rows that repeat a page_id have a record each.
    The html crosses the network once, dealt by page and digest: a payload that a third of
    all pages share is spread like any other.
    """
    spark = pages.sparkSession
    small_batches(spark, 500)
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    p = p.withColumn("size", F.length("html")).withColumn("sha", F.unhex(F.sha2("html", 256)))
    again = materialize(roles(p, min_bytes), "warc-revisits").select(F.col("page_id").alias("r_id"), F.col("size").alias("r_size"), F.col("sha").alias("r_sha"), "refers_to")
    on = F.col("page_id").eqNullSafe(F.col("r_id")) & (F.col("size") == F.col("r_size")) & (F.col("sha") == F.col("r_sha"))
    rows = p.repartition(partitions(spark) * 2, F.coalesce("page_id", F.lit(0)), "sha").join(again, on, "left").select("page_id", "url", "html", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = 0

        def close() -> pa.RecordBatch:
            write_file(uri := f"{folder}/{uuid.uuid4().hex}.warc.zst", pack_file(held))
            return pa.RecordBatch.from_pydict({"uri": [uri], "records": pa.array([len(held)], pa.int64())})

        for b in batches:
            for i in range(b.num_rows):
                page, url, body, to = (b.column(k)[i].as_py() for k in range(4))
                held.append(build_record(page, url, body, to, to is not None))
                size += len(held[-1])
                if size >= file_bytes:
                    yield close()
                    held, size = [], 0
        if held:
            yield close()

    return materialize(rows.mapInArrow(lean(run), MANIFEST), "warc-manifest")


def read_archives(manifest: DataFrame) -> DataFrame:
    """A row per record, in no order: page_id, payload_bytes and payload_digest of the full payload, record_type, refers_to, url."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri in b.column(0).to_pylist():
                out: tuple[list, ...] = ([], [], [], [], [], [])
                for raw in read_records(read_file(uri)):
                    fields, http, payload = parse_record(raw)
                    kind, said = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
                    size = int(http.rsplit(b"Content-Length:", 1)[1])
                    if kind == "response" and (digest(payload) != said or len(payload) != size):
                        raise ValueError("payload does not match its digest")
                    to = page_of(fields["warc-refers-to"]) if kind == "revisit" else None
                    for col, x in zip(out, (page_of(fields["warc-record-id"]), size, said, kind, to, fields["warc-target-uri"]), strict=True):
                        col.append(x)
                types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"])

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"
    return manifest.select("uri").repartition(partitions(manifest.sparkSession)).mapInArrow(lean(run), schema)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record for every page, read back from the archives."""
    return read_archives(write_archives(table(spark, sf_dir, "pages"), scratch(spark, "warc"))).drop("url")


QUERIES = {"op4_warc": op4_warc}
ORACLE_SQL: dict[str, str] = {}
