"""Exact deduplication against a persistent digest index, bucketed and sorted by hash."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.shared import LOWER, UPPER, ascii_lower, join_hot, materialize, scratch, table


def digest(text: Column) -> Column:
    """SHA-256 (binary) of the text after lower-casing A-Z; null counts as empty."""
    return F.unhex(F.sha2(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))).cast("binary"), 256))


class DigestIndex:
    """A table of (digest, keep_id, batch) in Parquet, bucketed and sorted by digest.

    The index is the state that outlives a run: open it again with the same name and
    path. A batch meets it in a sort-merge join for which its side is not shuffled, as its buckets are
    already dealt by digest; Spark still sorts each bucket, as it does not trust the order of several files.
    compact() makes one file of each bucket's files. buckets should be so many that one is sorted in a
    task's memory, 1 for each 10 million digests expected.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, name: str | None = None, buckets: int = 64):
        self.spark, self.buckets = spark, buckets
        self.path = path or scratch(spark, "digest-index")
        self.name = name or f"lattica_digests_{uuid.uuid4().hex}"
        self._create()

    def _create(self) -> None:
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (digest BINARY, keep_id BIGINT, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}'"
        )

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def state(self, groups: DataFrame) -> DataFrame:
        """groups (digest, ...) with what the index has of each: old_id and old_batch, null for new digests. The index is read once."""
        old = self.read().select("digest", F.col("keep_id").alias("old_id"), F.col("batch").alias("old_batch"))
        return groups.join(old.hint("merge"), "digest", "left")

    def new(self, groups: DataFrame) -> DataFrame:
        """The rows of groups (digest, keep_id, ...) whose digest the index lacks."""
        return groups.join(self.read().hint("merge"), "digest", "left_anti")

    def append(self, groups: DataFrame, batch: str) -> None:
        """One sorted file per bucket and batch, of groups (digest, keep_id)."""
        rows = groups.select("digest", "keep_id", F.lit(batch).alias("batch")).repartition(self.buckets, "digest")
        rows.write.bucketBy(self.buckets, "digest").sortBy("digest").mode("append").format("parquet").option("path", self.path).saveAsTable(self.name)

    def compact(self, path: str) -> None:
        """Write the index anew at path, a file for each bucket, and use that from now on; the old files stay for whoever reads them."""
        rows = self.read().repartition(self.buckets, "digest")
        name = f"{self.name}_{uuid.uuid4().hex[:8]}"
        rows.write.bucketBy(self.buckets, "digest").sortBy("digest").format("parquet").option("path", path).saveAsTable(name)
        self.name, self.path = name, path

    def decide(self, docs: DataFrame, batch: str) -> tuple[DataFrame, DataFrame]:
        """(result of a batch, its digests that the index lacks); nothing is appended."""
        own = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest(F.col("text")).alias("digest")), "digests")
        # partial aggregates: a third of all rows in one group still meet as a row per task
        groups = own.groupBy("digest").agg(F.max("doc_id").alias("last_id"), F.count("*").alias("group_size"))
        state = materialize(self.state(groups), "digest-state")
        # what this batch itself has appended in a run before is not old
        old = F.col("old_batch").isNotNull() & (F.col("old_batch") != batch)
        named = state.select("digest", "group_size", old.alias("old"), F.when(old, F.col("old_id")).otherwise(F.col("last_id")).alias("keep_id"))
        kept = ~F.col("old") & F.col("doc_id").eqNullSafe(F.col("keep_id"))
        out = join_hot(own, named, ["digest"], "group_size").select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
        return out, state.where("old_batch is null").select("digest", F.col("last_id").alias("keep_id"))

    def ingest(self, docs: DataFrame, batch: str | None = None, into: str | None = None) -> DataFrame:
        """Decide on a batch, store the result, then append what is new.

        Returns one row per document, dropped ones too: doc_id, keep_id,
        group_size (copies in this batch), kept, text_sha256. Within the batch the largest
        doc_id stays; a text that the index has from another batch keeps the earlier document. Null
        texts count as empty; rows without a doc_id are never the one kept while
        another has one. Rows that repeat the doc_id that stays are all marked as kept. Columns other than doc_id
        and text are ignored, whatever their names; an empty table gives no rows.

        The result is written (to the path into, or to the shared folder) before anything is appended. A batch that is run again under
        its name, whether it was lost before, between or after the two writes, gives the same
        result and appends what is still missing. Without a name the batch counts as a new one.
        """
        batch = batch or uuid.uuid4().hex
        out, new = self.decide(docs, batch)
        if into is None:
            out = materialize(out, "digest-result")
        else:
            out.write.mode("overwrite").parquet(into)
            out = self.spark.read.schema(out.schema).parquet(into)
        self.append(new, batch)
        return out


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as the first batch of a new index."""
    return DigestIndex(spark, buckets=16).ingest(table(spark, sf_dir, "documents"))


QUERIES = {"op8_exact_dedup": op8_exact_dedup}
ORACLE_SQL = {
    "op8_exact_dedup": f"""
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{LOWER}')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)"""
}
