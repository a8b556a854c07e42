"""Where intermediate tables and files live, and how lineage is cut.

Everything that must outlive a task goes to the folder that the cluster shares
(``spark.checkpoint.dir``); an executor that is lost takes nothing with it.
"""

from __future__ import annotations

import ctypes
import functools
import os
import posixpath
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.store import scratch

#: ASCII white space as the contracts have it: space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: runs once, and its lineage ends there."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """A-Z only, whatever the locale."""
    return F.translate(c, UPPER, LOWER)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """names, lengthened until none is a column of df."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        out.append(n)
    return out


#: Rows, and bytes of text in them, of a table that is broadcast at most; beyond either, joins shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 16 << 20


def fits(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if it is small, by rows and by the bytes of its strings; counts no further than one row beyond the bound."""
    wide = [F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in df.dtypes if kind in ("string", "binary")]
    text = F.coalesce(F.sum(sum(wide[1:], wide[0])), F.lit(0)) if wide else F.lit(0)
    n, held = df.limit(rows + 1).agg(F.count(F.lit(1)), text).first()
    return F.broadcast(df) if n <= rows and held <= size else df


#: A key is hot if more rows have it than this, and more than a 1024th of all.
HOT_ROWS = 10_000


def join_hot(rows: DataFrame, groups: DataFrame, on: list[str], n: str, total: int | None = None) -> DataFrame:
    """rows joined with groups, which has a row per key and in column n how many of rows have it.

    Keys that are hot, fewer than 1024 whatever the data, are broadcast, so their rows stay
    where they are; the others are shuffled. Both frames are read twice: they should be written tables. Null keys match nothing.
    """
    total = groups.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0]
    bound = max(HOT_ROWS, total >> 10)
    hot = groups.where(F.col(n) > bound)
    if not hot.limit(1).count():
        return rows.join(groups, on)
    hot = F.broadcast(hot)
    return rows.join(hot, on).unionByName(rows.join(hot.select(*on), on, "left_anti").join(groups.where(F.col(n) <= bound), on))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Arrow batches hold so many bytes, about, and one row at least.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches bounded by rows and bytes, as rows are whole documents, and this package on every worker.

    Plans read these settings when they run, after the call that made them, so they stay; tighter ones are left as they are.
    """
    for key, bound in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        own = _bytes(spark.conf.get(key))
        if not 0 < own <= bound:
            spark.conf.set(key, str(bound))
    ship_package(spark)


def _bytes(x: str) -> int:
    """A size as Spark writes it; 0 for what is no plain number of bytes, kilobytes or megabytes."""
    number, unit = x.lower().rstrip("b").rstrip("kmg"), x.lower().rstrip("b")[-1:]
    return int(number) << {"k": 10, "m": 20, "g": 30}.get(unit, 0) if number.isdigit() else 0


def release() -> None:
    """Give memory that this worker has freed back to the system: idle workers stay, and others run beside them."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def lean(work):
    """A function over batches that releases memory when it ends."""

    @functools.wraps(work)
    def run(batches):
        try:
            yield from work(batches)
        finally:
            release()

    return run


# Files that Python reads and writes in the shared store, by any scheme pyarrow knows.


def store(uri: str):
    """(file system, path) of a URI or plain path."""
    from pyarrow import fs

    if "://" not in uri:
        return fs.LocalFileSystem(), uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri)


def write_file(uri: str, data) -> None:
    """Whole or not at all: written beside its place under a name of its own, then moved there."""
    where, path = store(uri)
    where.create_dir(posixpath.dirname(path), recursive=True)
    own = f"{path}.{uuid.uuid4().hex}.tmp"
    with where.open_output_stream(own, compression=None) as out:
        out.write(data)
    where.move(own, path)


def read_file(uri: str) -> bytes:
    where, path = store(uri)
    with where.open_input_stream(path, compression=None) as f:
        return f.read()


def one_thread() -> None:
    """Spark runs a worker per core; native libraries must not add threads of their own."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ.setdefault("OMP_NUM_THREADS", "1")


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once for an application, unless PYTHONPATH already gives it to them."""
    import zipfile

    import lattica

    root, app = os.path.dirname(os.path.dirname(os.path.abspath(lattica.__file__))), spark.sparkContext.applicationId
    if app in _shipped or root in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="lattica-"), "lattica.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(os.path.join(root, "lattica")):
            for n in names:
                if n.endswith(".py"):
                    z.write(os.path.join(folder, n), os.path.relpath(os.path.join(folder, n), root))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)
