"""The corpus pipeline: language ID, near duplicates, repeated passages, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the next stage's docs. All but the last return the columns of documents.

* language_id: documents without an identified language go (null, empty, no letters, a script that no
  learned language uses); of the others the predicted language becomes ``lang``.
* near_duplicates: of each group of linked documents the smallest id stays; rows without an id stay.
* repeated_passages: bytes that repeat a smaller id's passage go, with the pieces of a character
  that such a cut leaves; n_chars is counted anew; documents of which nothing is left go.
* secrets: each span is replaced by its kind in brackets.
* packing: the pieces of the remaining documents in sequences.

In every stage: an empty table gives an empty one; null texts go with the first stage; texts are worked on
whole, whatever their length; repeated rows with an id become one in near_duplicates, rows without an
id all stay; ties are those of the operators; extra columns are handed on untouched up to packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gpsight.llm import language, ngram_join, packing, secret_scan, suffix_dedup
from gpsight.llm.common import materialize, short_batches, table

# SQL can't express these stages; tests hold them against brute force.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    short_batches(spark)
    return language.keep_identified(docs, language.learn(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    short_batches(spark)
    groups = ngram_join.jaccard_join(docs)
    stay = groups.filter("doc_id = component_id").select("doc_id").distinct()
    # an id can be repeated: the same row once
    kept = docs.join(stay, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.select(*docs.columns).union(docs.filter("doc_id IS NULL"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    short_batches(spark)
    found = suffix_dedup.remove_repeats(docs, carry=True)
    text = F.when(F.size("spans") == 0, F.col("row.text")).otherwise(F.col("readable"))
    changed = found.withColumn("text_left", text).filter((F.size("spans") == 0) | (F.trim("text_left") != ""))
    return changed.select(*(
        F.col("text_left").alias("text") if c == "text" else
        F.when(F.size("spans") == 0, F.col("row.n_chars")).otherwise(F.length("text_left")).cast("long").alias("n_chars")
        if c == "n_chars" else F.col(f"row.`{c}`") for c in docs.columns))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    short_batches(spark)
    found = secret_scan.scan_secrets(docs, carry=True)
    return found.select(*(
        F.col("masked").alias("text") if c == "text" else
        F.when(F.size("spans") == 0, F.col("row.n_chars")).otherwise(F.length("masked")).cast("long").alias("n_chars")
        if c == "n_chars" else F.col(f"row.`{c}`") for c in docs.columns))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    short_batches(spark)
    return packing.pack_documents(docs)


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages),
          ("secrets", secrets), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents; each stage's result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
