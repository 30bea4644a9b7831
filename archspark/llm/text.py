"""Small helpers of the text operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many partitions as there are cores.

    Parquet splits only between row groups, and a table of long texts may have few. Rows are moved only then; which
    task holds a row changes nothing in the results.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(2 * cores)


def least_by_hash(df: DataFrame, key: str, rows: int) -> DataFrame:
    """About the ``rows`` rows of least hash of ``key`` (never more, each key once): the same however the table lies.

    A threshold on the hash leaves hardly more rows than asked before anything is sorted or sent, so the cost of the
    sample does not grow with the number of partitions.
    """
    hashed = df.withColumn("_h", F.xxhash64(F.col(key)))
    different = hashed.agg(F.approx_count_distinct("_h", 0.02)).first()[0]
    share = 1.5 * rows / max(different, 1) + 1e-3
    if share < 1.0:
        hashed = hashed.where(F.col("_h") <= int(share * (1 << 64)) - (1 << 63))
    return hashed.dropDuplicates(["_h"]).orderBy("_h").limit(rows).drop("_h")
