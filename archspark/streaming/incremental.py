"""Sources that change while they are analysed: an extension with Structured Streaming.

New or changed files arrive as rows; each micro-batch extracts them and replaces what was known of their paths.  A
second stream counts requests in windows of event time, late rows included up to a watermark.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from archspark.sources.extract import extract


def newest(batch: DataFrame) -> DataFrame:
    """The last version of each path in a batch."""
    return batch.groupBy("path").agg(F.max(F.struct("seen_at", "language", "content")).alias("x")).select("path", "x.language", "x.content")


def extract_changes(files: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, **trigger) -> StreamingQuery:
    """``files`` is a stream of ``path, language, content, seen_at``; ``sink(nodes, batch_id)`` replaces their paths."""

    def each(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            sink(extract(newest(batch)), batch_id)

    return files.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def requests_per_window(requests: DataFrame, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Requests and failures of each model in windows of ``logged_at``; rows later than the watermark are dropped by it."""
    timed = requests.withColumn("at", F.col("logged_at").cast("timestamp"))
    counted = timed.withWatermark("at", late).groupBy(F.window("at", window), "model").agg(F.count("*").alias("requests"), F.count("error").alias("failures"))
    return counted.select(F.col("window.start").alias("window_start"), "model", "requests", "failures")


def read_requests(spark: SparkSession, path: str, schema) -> DataFrame:  # noqa: ANN001
    return spark.readStream.schema(schema).parquet(path)
