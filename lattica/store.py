"""The cluster's shared folder, where iterative plans cut their lineage."""

from __future__ import annotations

import itertools
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Rows of a bucket, about.
BUCKET_ROWS = 250_000

_local: dict[str, str] = {}
_count = itertools.count()


_roots: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir with its file system, Spark's default one if it names none; a temporary folder only in local mode, where it is unset."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if sc.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = _local.setdefault(sc.applicationId, "") or tempfile.mkdtemp(prefix="lattica-")
        _local[sc.applicationId] = found
    path = sc._jvm.org.apache.hadoop.fs.Path(found)
    return path.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")


def _root(spark: SparkSession) -> str:
    """The application's own folder in the shared one, removed when the driver ends."""
    sc = spark.sparkContext
    root = f"{shared_dir(spark)}/lattica/{sc.applicationId}"
    if _roots.get(sc.applicationId) != root:
        path = sc._jvm.org.apache.hadoop.fs.Path(root)
        fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _roots[sc.applicationId] = root
    return root


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{_root(spark)}/{name}-{next(_count)}-{uuid.uuid4().hex[:8]}"


def cut(df: DataFrame, name: str, **measures) -> tuple[DataFrame, dict]:
    """Write df to the shared folder and read it again: one action, after which df has no lineage.

    measures are aggregates observed while writing, so that a loop's stop test needs no
    job of its own. The count of rows is always among them, as n.
    """
    spark, path, seen = df.sparkSession, scratch(df.sparkSession, name), Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n"), *(c.alias(k) for k, c in measures.items())).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), seen.get


def bucketed(df: DataFrame, key: str, name: str, rows: int | None = None) -> DataFrame:
    """df as a table dealt and sorted by key: joins on key in later rounds shuffle only their other side.

    There is a bucket for BUCKET_ROWS rows, and no more than Spark shuffles to: a round has a task for each. rows: of df, if they are known.
    """
    spark = df.sparkSession
    if rows is None:
        df, seen = cut(df, name)
        rows = seen["n"]
    n = min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(1, -(-rows // BUCKET_ROWS)))
    table = f"lattica_{name}_{uuid.uuid4().hex}"
    df.repartition(n, key).write.bucketBy(n, key).sortBy(key).format("parquet").option("path", scratch(spark, name)).saveAsTable(table)
    return spark.table(table)
