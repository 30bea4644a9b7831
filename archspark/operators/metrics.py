"""Coupling metrics of modules and lists ranked by them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archspark.functions.names import instability
from archspark.operators.graph import degrees


def module_metrics(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Ca, Ce, instability and derived flags of each vertex; further columns of ``vertices`` are kept, nulls as 0."""
    kept = [c for c in ("node_count", "class_count", "function_count", "import_count") if c in vertices.columns]
    found = degrees(vertices, edges).withColumn("instability", instability(F.col("ca"), F.col("ce")))
    found = found.withColumns({
        "total_coupling": F.col("ca") + F.col("ce"),
        "is_isolated": (F.col("ca") == 0) & (F.col("ce") == 0),
        "is_foundational": (F.col("ca") > 0) & (F.col("ce") == 0),
    })
    if not kept:
        return found
    return found.join(vertices.select("path", *kept), "path", "left").fillna(0, kept)


def one_module(vertices: DataFrame, edges: DataFrame, path: str) -> DataFrame:
    """Metrics of one vertex from its own edges only (the filter reaches the scans); KeyError if it is unknown."""
    own = vertices.where(F.col("path") == path)
    if own.isEmpty():
        raise KeyError(path)
    near = edges.where((F.col("source") == path) | (F.col("target") == path))
    return module_metrics(own, near).where(F.col("path") == path)



def ranked(metrics: DataFrame) -> DataFrame:
    """Most unstable first, then by Ca, then by path."""
    return metrics.orderBy(F.desc("instability"), F.desc("ca"), "path")


def most_unstable(metrics: DataFrame, n: int = 10) -> DataFrame:
    return metrics.where("ca > 0").orderBy(F.desc("instability"), F.desc("ca"), "path").limit(n)


def most_depended_upon(metrics: DataFrame, n: int = 10) -> DataFrame:
    return metrics.orderBy(F.desc("ca"), F.desc("instability"), "path").limit(n)


def bands(metrics: DataFrame) -> DataFrame:
    """Colour band of each module: red from 0.7, yellow from 0.4; an editor shows none under 3 dependents."""
    i = F.col("instability")
    return metrics.withColumns({"band": F.when(i >= 0.7, "red").when(i >= 0.4, "yellow").otherwise("green"), "decorated": F.col("ca") >= 3})
