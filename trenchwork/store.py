"""Intermediate tables in the shared folder, and joins with small tables.

Lineage is cut with Parquet tables under ``spark.checkpoint.dir``: executors can be
lost at any time and every later read still finds the whole table.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table of at most this many narrow rows (about 64 bytes each) may be broadcast.
BROADCAST_ROWS = 500_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; a temporary one only in local mode without the setting."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    made = tempfile.mkdtemp(prefix="trenchwork-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return the table that was written."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def by_key(df: DataFrame, *keys: str, rows: int = 200_000) -> DataFrame:
    """``df`` with the rows of a key in one task, in one task more than a shuffle has or so many that each holds about ``rows``.

    A number that is given is not made smaller by AQE, which would put as many rows together as are small before a step that makes
    many of each. With just as many tasks as a shuffle has, one by the same keys below would serve, and that is made smaller.
    ``df`` should be cheap to count.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(tasks + 1, -(-df.count() // rows)), *keys)


def join_small(big: DataFrame, small: DataFrame, on: str | list[str] | Column, how: str = "inner", limit: int = BROADCAST_ROWS) -> DataFrame:
    """Join, broadcasting ``small`` only if it was counted to hold at most ``limit`` rows.

    Beyond the limit the join is an ordinary shuffled one, whose skewed partitions AQE splits.
    ``small`` should be cheap to count, such as a materialized table.
    """
    if small.limit(limit + 1).count() <= limit:
        small = F.broadcast(small)
    return big.join(small, on, how)
