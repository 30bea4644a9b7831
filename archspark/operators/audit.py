"""Append-only log of requests as a partition-free Parquet table, and its queries."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archspark.schemas import AUDIT


def once(log: DataFrame) -> DataFrame:
    """Each record once."""
    return log.dropDuplicates(["id"])


def get(log: DataFrame, record_id: int) -> DataFrame:
    """One record, or none; the filter is pushed to the scan."""
    return once(log.where(F.col("id") == record_id))


def recent(log: DataFrame, limit: int = 20) -> DataFrame:
    return once(log).orderBy(F.desc("id")).limit(limit)


def for_target(log: DataFrame, target: str, limit: int = 20) -> DataFrame:
    return recent(log.where(F.col("target") == target), limit)


def failures(log: DataFrame, limit: int = 20) -> DataFrame:
    return recent(log.where("error is not null"), limit)


def count(log: DataFrame) -> DataFrame:
    return log.agg(F.count_distinct("id").alias("records"))


class AuditLog:
    """One writer appends; ids follow the greatest one there."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def read(self) -> DataFrame:
        try:
            return self.spark.read.schema(AUDIT).parquet(self.path)
        except Exception as e:  # nothing was written yet
            if "PATH_NOT_FOUND" in str(e):
                return self.spark.createDataFrame([], AUDIT)
            raise

    def record(self, **fields) -> int:
        """Append one record and return its id."""
        last = self.read().agg(F.max("id")).first()[0] or 0
        row = {"id": last + 1, "created_at": datetime.now(UTC).isoformat(), **fields}
        unknown = set(row) - set(AUDIT.names)
        if unknown:
            raise ValueError(f"unknown fields: {sorted(unknown)}")
        self.spark.createDataFrame([tuple(row.get(n) for n in AUDIT.names)], AUDIT).coalesce(1).write.mode("append").parquet(self.path)
        return last + 1
