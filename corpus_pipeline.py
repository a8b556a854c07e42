"""A training corpus from raw documents: toxicity filter, near-duplicates, benchmark decontamination, source mixing, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as
Parquet to the cluster's shared folder and reads it again for the next. All but the last return the columns of documents, whatever further ones there are and whatever their names; empty tables give
empty ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import decontaminate, jaccard, mixing, sst, toxicity
from lattica.llm.shared import materialize, scratch, table


def clean_of_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what scores as toxic; the lexicon is learned from documents and labels of sf_dir.

    Null and empty texts stay; repeated rows stay or go together. No labels, no documents: nothing is dropped.
    """
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of each group of near-duplicates, the one with the smallest doc_id; similarity 0.8 or more on five-word shingles.

    Texts without words, null ones too, are one group. Rows without a doc_id stay; rows that repeat the doc_id that stays are all kept.
    """
    return jaccard.keep_first(docs, words=5)


def clean_of_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold 0.8 or more of a benchmark item's five-word shingles.

    Rows of one doc_id go together; rows without one are judged by their own texts. Null texts hold nothing.
    """
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it.

    Rows that repeat a doc_id, or have none, are drawn one by one; null texts have no words and are drawn at their source's rate.
    """
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in sorted-string-table shards, read back: a row per document taken.

    Null texts have the end id only. Copies of a document stand side by side; rows without a doc_id come first.
    """
    return sst.read_shards(sst.write_shards(docs, scratch(spark, "corpus")))


STAGES = [
    ("toxicity", clean_of_toxicity),
    ("simhash_near_dedup", one_of_each_group),
    ("benchmark_decontamination", clean_of_benchmarks),
    ("mixing", mixed),
    ("token_output", tokens),
]

#: Jaccard similarity and byte-pair encoding have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir).select("doc_id", F.col("start"), "n_tokens", "ids_crc32")
