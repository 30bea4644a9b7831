"""Syntax trees as tables: what breaks their layout, and moving about in them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archspark.operators.hierarchy import hierarchy

#: Rules of the layout, in the order they are reported.
RULES = ("root", "parent", "children", "bounds", "nesting")


def _once(nodes: DataFrame) -> DataFrame:
    return nodes.dropDuplicates(["file_id", "node_id"])


def children(nodes: DataFrame) -> DataFrame:
    """``file_id, node_id, child_id`` by the child ranges; ranges of childless nodes say nothing.

    A range is spread over its ids (clipped to those of its file), which are then looked up: no node meets a range that
    does not hold it.
    """
    once = _once(nodes).where("file_id is not null and node_id is not null")
    extent = once.groupBy("file_id").agg(F.min("node_id").alias("least"), F.max("node_id").alias("most"))
    ranges = once.where("child_count > 0 and first_child_index is not null").select("file_id", "node_id", F.col("first_child_index").alias("lo"), (F.col("first_child_index") + F.col("child_count") - 1).alias("hi"))
    clipped = ranges.join(extent, "file_id").withColumns({"lo": F.greatest("lo", "least"), "hi": F.least("hi", "most")}).where("lo <= hi")
    ids = clipped.select("file_id", "node_id", F.explode(F.transform(F.sequence("lo", "hi"), lambda x: x.cast("int"))).alias("child_id"))
    return ids.join(once.select("file_id", F.col("node_id").alias("child_id")), ["file_id", "child_id"], "left_semi").select("file_id", "node_id", "child_id")


def walk(nodes: DataFrame) -> DataFrame:
    """``file_id, root_id, node_id, depth, position``: every tree depth first, ordered by ``position``."""
    return hierarchy(nodes, with_paths=False).where("state = 'ok'").select("file_id", "root_id", "node_id", "depth", F.col("entry").alias("position"))


def violations(nodes: DataFrame) -> DataFrame:
    """``file_id, node_id, rule`` of each node that breaks the layout.

    ``root``: -1 as parent elsewhere than at node 0, or another parent there; ``parent``: a parent that is null, not there
    or not before the node; ``children``: a range that holds a node with another parent; ``bounds``: offsets negative or
    in the wrong order; ``nesting``: a range of bytes outside its parent's. One row a node and rule.
    """
    once = _once(nodes).select("file_id", "node_id", "parent_index", "first_child_index", "child_count", "byte_start", "byte_end")
    up = once.select("file_id", F.col("node_id").alias("parent_index"), F.col("byte_start").alias("up_start"), F.col("byte_end").alias("up_end"), F.lit(True).alias("there"))
    joined = once.join(up, ["file_id", "parent_index"], "left")
    own = joined.select(
        "file_id",
        "node_id",
        F.explode(
            F.array_compact(
                F.array(
                    F.when((F.col("parent_index") == -1) != (F.col("node_id") == 0), "root"),
                    F.when(F.col("parent_index").isNull() | ((F.col("parent_index") >= 0) & (F.col("there").isNull() | (F.col("parent_index") >= F.col("node_id")))), "parent"),
                    F.when((F.col("byte_start") < 0) | (F.col("byte_end") < F.col("byte_start")), "bounds"),
                    F.when((F.col("byte_start") < F.col("up_start")) | (F.col("byte_end") > F.col("up_end")), "nesting"),
                )
            )
        ).alias("rule"),
    )
    inner = once.select("file_id", F.col("node_id").alias("child_id"), F.col("parent_index").alias("of"))
    claims = children(nodes).join(inner, ["file_id", "child_id"]).where("of is null or of <> node_id").select("file_id", "node_id").distinct().withColumn("rule", F.lit("children"))
    return own.unionByName(claims)
