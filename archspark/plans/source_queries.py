"""Queries of extraction and snapshots."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archspark.plans.adapters import files
from archspark.session import durable, shared_dir
from archspark.sources import extract, snapshot


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from archspark.functions.names import language_of_extension

    return files(spark, sf_dir).where("content is not null").select("path", language_of_extension(F.col("path")).alias("language"), "content")


def extract_source_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named imports, classes and functions of every readable file, from its source."""
    found = extract.extract(_sources(spark, sf_dir))
    return found.groupBy("path").agg(*[F.count_if((F.col("kind") == k) & (F.col("name") != "")).alias(n) for n, k in (("classes", 1), ("functions", 2), ("imports", 3))], F.count("node_id").alias("nodes"))


def extract_source_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of imports of each file that has any, from its source."""
    found = extract.extract(_sources(spark, sf_dir)).where("kind = 3 and name <> ''")
    return found.groupBy("path").agg(F.count("*").alias("imports"))


def snapshot_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All extracted nodes, written as snapshots into the shared folder and read again; one row per node kind."""
    nodes = durable(extract.extract(_sources(spark, sf_dir)).where("error is null"))
    folder = f"{shared_dir(spark)}/snapshots-{uuid.uuid4().hex}"
    snapshot.write(nodes, folder)
    back = snapshot.read(spark, folder)
    same = back.select("path", "node_id", "kind", "name", "byte_start", "byte_end", "parent_index").join(nodes.select("path", "node_id", "kind", "name", "byte_start", "byte_end", "parent_index"), ["path", "node_id", "kind", "name", "byte_start", "byte_end", "parent_index"], "left_semi")
    return same.groupBy("kind").agg(F.count("*").alias("nodes")).join(nodes.groupBy("kind").agg(F.count("*").alias("written")), "kind")


QUERIES = {f.__name__: f for f in (extract_source_nodes, extract_source_imports, snapshot_roundtrip)}

SQL = {
    "extract_source_imports": r"""
SELECT path, len(regexp_extract_all(content, CASE WHEN path LIKE '%.py' OR path LIKE '%.pyi' THEN '(?m)^[ \t]*(import [\w.]+|from [\w.]+ import)' ELSE '(?m)^[ \t]*#[ \t]*include[ \t]*[<"]' END)) AS imports
FROM (SELECT DISTINCT path, content FROM files WHERE content IS NOT NULL) WHERE imports > 0""",
}
