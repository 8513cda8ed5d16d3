"""From raw documents to a token file, in five stages.

Each stage works on all that its predecessor kept, which is written as Parquet and read again.

Every stage takes null and repeated doc_ids, null and empty texts, any further columns and empty tables. Rows are judged
one by one; what a stage decides of a row never falls on another row that has its doc_id but another text. A null or empty text has no letters,
so it goes with the first stage; were it to come later, it would be similar to nothing, clean, of size 0 in the mix, and
one end id in the token file.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trenchwork.llm import decontaminate, jaccard, langid, mixing, tokenids
from trenchwork.store import join_small, materialize


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without letters and those whose language stays a guess (mean probability under 0.3).
    Repeated rows are kept or dropped alike."""
    return langid.accepted(docs, least_score=0.3)


def row_key() -> Column:
    """Tells documents apart whose doc_id is null or repeated; rows of equal id and text share a verdict."""
    return F.xxhash64("doc_id", "text")


def one_row_each(keyed: DataFrame, groups: DataFrame) -> DataFrame:
    """(_key, doc_id, component_id): a row for each key, however many rows have it, as all of those share them."""
    labels = groups.groupBy(F.col("doc_id").alias("_key")).agg(F.min("component_id").alias("component_id"))
    return labels.join(keyed.groupBy("_key").agg(F.min("doc_id").alias("doc_id")), "_key")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of five-word Jaccard similarity 0.8 or more: that with the smallest doc_id, null last.
    Of repeated rows one stays; a document without words is a group of its own, so equal ones of those are one row too."""
    keyed = docs.withColumn("_key", row_key())
    groups = jaccard.similar_components(keyed.withColumn("doc_id", F.col("_key")), k=5, percent=80)
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_key")).alias("least")
    first = materialize(one_row_each(keyed, groups).groupBy("component_id").agg(least).select("least._key"), "kept-keys")
    kept = join_small(keyed, first, "_key", "left_semi")
    again = keyed.groupBy("_key").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
    return (kept.dropDuplicates(["doc_id", "text"]) if again else kept).drop("_key")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold ten consecutive words of a benchmark item, or a whole shorter item.
    An item without words, or an empty benchmark, drops nothing."""
    keyed = docs.withColumn("_key", row_key())
    judged = decontaminate.contamination(keyed.withColumn("doc_id", F.col("_key")), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hit = materialize(judged.where("contaminated").select(F.col("doc_id").alias("_key")).distinct(), "contaminated-keys")
    return join_small(keyed, hit, "_key", "left_anti").drop("_key")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of a mix of sources by weights 3, 1, 2, of 150 % of all words; repeats are rows.
    A null source is one of them; the last document that a source gives may be cut at a word."""
    return mixing.mixed_documents(docs, weights=(3, 1, 2), share=1.5, cap=2.0)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write the token file and return what is read back from it, for each row; null doc_ids come first."""
    return tokenids.token_digests(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixture),
    ("token_output", token_output),
]

#: No stage but decontamination can be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
