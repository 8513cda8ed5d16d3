"""Features and results kept as partitioned tables: features by dataset and kind, results by job and rank.

What is read of them are the folders that the filters on these columns leave (see PartitionFilters in the plan). A dataset, or a
job, that is saved again replaces what it had and touches no other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FEATURE_KEYS, RESULT_KEYS = ("dataset", "kind"), ("job", "rank")
#: The folder of features without a kind.
NONE = "UNKNOWN"


def _save(rows: DataFrame, to: str, keys: tuple[str, str]) -> None:
    # Only the partitions that are written are replaced; each value's rows stand in few files, however many tasks there are.
    rows.repartition(*keys, F.pmod(F.monotonically_increasing_id(), F.lit(8))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(to)


def save_features(features: DataFrame, to: str, dataset: str) -> None:
    """Keep features (with ``kind``) as those of a dataset."""
    _save(features.withColumns({"dataset": F.lit(dataset), "kind": F.coalesce("kind", F.lit(NONE))}), to, FEATURE_KEYS)


def load_features(spark: SparkSession, at: str, dataset: str, *kinds: str) -> DataFrame:
    """The features of a dataset, of some kinds or all."""
    found = spark.read.parquet(at).where(F.col("dataset") == dataset)
    return found.where(F.col("kind").isin(*kinds)) if kinds else found


def save_result(features: DataFrame, to: str, job: str) -> None:
    """Keep the result features (with ``rank``) of a job."""
    _save(features.withColumn("job", F.lit(job)), to, RESULT_KEYS)


def load_result(spark: SparkSession, at: str, job: str, rank: int | None = None) -> DataFrame:
    """The result of a job, of one rank or of all."""
    found = spark.read.parquet(at).where(F.col("job") == job)
    return found if rank is None else found.where(F.col("rank") == rank)


def previews(spark: SparkSession, at: str, job: str) -> DataFrame:
    """(rank, object_type, n, length, cost): what a job's variants consist of."""
    return load_result(spark, at, job).groupBy("rank", "object_type").agg(F.count("*").alias("n"), F.sum("length").alias("length"), F.sum("cost").alias("cost"))
