"""Dependencies between files from their syntax nodes: imports and inheritance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archspark import schemas as S
from archspark.functions.names import base_types, last_of_type, own_name
from archspark.operators import graph
from archspark.operators.resolve import resolve


def imports_of(nodes: DataFrame) -> DataFrame:
    """``import_id, from_file, raw`` of the import nodes that have a name."""
    return nodes.where((F.col("kind") == S.IMPORT) & (F.col("name") != "")).select(F.concat_ws(":", "path", "node_id").alias("import_id"), F.col("path").alias("from_file"), F.col("name").alias("raw"))


def class_definitions(nodes: DataFrame) -> DataFrame:
    """``class_name, definitions, path``: classes by own name, one definition per class node."""
    named = nodes.where(F.col("kind") == S.CLASS).select("path", own_name(F.col("name")).alias("class_name")).where("class_name <> ''")
    return named.groupBy("class_name").agg(F.count("*").alias("definitions"), F.min("path").alias("path"))


def inheritance(nodes: DataFrame) -> DataFrame:
    """Dependencies on the one file that defines a base type; bases defined nowhere or more than once give none."""
    bases = nodes.where(F.col("kind") == S.CLASS).select(F.col("path").alias("source"), F.explode(base_types(F.col("name"))).alias("raw_target"))
    once = class_definitions(nodes).where("definitions = 1").select("class_name", F.col("path").alias("target"))
    found = bases.withColumn("class_name", last_of_type(F.col("raw_target"))).join(once, "class_name").where("source <> target")
    return found.select("source", "target", F.lit("inheritance").alias("kind"), F.lit("resolved").alias("resolution"), "raw_target")


def dependencies(files: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(dependencies, resolved imports). External imports and imports of the file itself give no dependency."""
    resolved = resolve(files, imports_of(nodes))
    taken = resolved.where("resolution <> 'external' and target <> from_file").select(F.col("from_file").alias("source"), "target", F.lit("import").alias("kind"), "resolution", F.col("raw").alias("raw_target"))
    return taken.unionByName(inheritance(nodes)), resolved


def vertices(files: DataFrame, nodes: DataFrame) -> DataFrame:
    """All files with their numbers of nodes, classes, functions and imports; files without nodes stay with zeros."""
    counts = nodes.groupBy("path").agg(
        F.count("*").cast("int").alias("node_count"),
        *[F.count_if(F.col("kind") == k).cast("int").alias(name) for k, name in ((S.CLASS, "class_count"), (S.FUNCTION, "function_count"), (S.IMPORT, "import_count"))],
    )
    return files.select("path").distinct().join(counts, "path", "left").fillna(0)


def build_graph(files: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(vertices, collapsed edges, resolved imports)."""
    found, resolved = dependencies(files, nodes)
    return vertices(files, nodes), graph.collapse(found), resolved


def kind_counts(nodes: DataFrame) -> DataFrame:
    """One column for each node kind, zeros included."""
    return nodes.groupBy("path").agg(*[F.count_if(F.col("kind") == k).alias(name.lower()) for k, name in enumerate(S.KINDS)])
