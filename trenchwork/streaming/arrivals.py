"""Features that arrive as newline-delimited files, counted by kind as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.geojson import features_of


def arriving_features(spark: SparkSession, folder: str) -> DataFrame:
    schema = "type string, id string, geometry struct<type string, coordinates string>, properties string"
    lines = spark.readStream.schema(schema).json(folder)
    return features_of(lines.select(F.lit(None).cast("long").alias("ord"), F.struct("type", "id", "geometry", "properties").alias("f")))


def arriving_kinds(spark: SparkSession, folder: str) -> DataFrame:
    """A running count by kind; write it with output mode ``complete``."""
    return arriving_features(spark, folder).groupBy("kind").agg(F.count("*").alias("n"))
