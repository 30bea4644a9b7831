"""Declarations as chunks of text: every function, and classes without methods."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archspark import schemas as S
from archspark.functions.names import own_name
from archspark.operators.cohesion import enclosing_classes, scopes


@dataclass(frozen=True)
class ChunkingConfig:
    """Inclusive bounds in bytes; classes can be left out."""

    min_bytes: int = 80
    max_bytes: int = 8_000
    include_classes: bool = True

    def __post_init__(self) -> None:
        if not 0 < self.min_bytes <= self.max_bytes:
            raise ValueError("0 < min_bytes <= max_bytes is needed")


def chunk(nodes: DataFrame, files: DataFrame, config: ChunkingConfig = ChunkingConfig()) -> DataFrame:
    """Chunks of the declarations in ``nodes`` cut from ``files(file_id, content)``.

    Byte ranges are cut from the UTF-8 bytes, broken characters are replaced, and lines are counted in bytes too.
    Files without content give none (see :func:`unreadable`).
    """
    kinds = [S.FUNCTION, S.CLASS] if config.include_classes else [S.FUNCTION]
    size = F.col("byte_end") - F.col("byte_start")
    wanted = nodes.where(F.col("kind").isin(kinds) & (F.col("name") != "") & (F.col("byte_start") >= 0) & size.between(config.min_bytes, config.max_bytes))
    wanted = wanted.select("file_id", "path", "node_id", "kind", own_name(F.col("name")).alias("name"), "byte_start", "byte_end").where("name <> ''").dropDuplicates(["file_id", "node_id"])
    owners = scopes(nodes).where("is_method and method_id is null").select("file_id", F.col("class_id").alias("node_id")).distinct().withColumn("has_method", F.lit(True))
    above = enclosing_classes(nodes).select("file_id", "node_id", F.col("enclosing_class").alias("parent_class"))
    wanted = wanted.join(owners, ["file_id", "node_id"], "left").where((F.col("kind") == S.FUNCTION) | F.col("has_method").isNull()).join(above, ["file_id", "node_id"], "left")
    texts = files.where("content is not null").select("file_id", F.col("content").cast("binary").alias("raw")).dropDuplicates(["file_id"])
    cut = wanted.join(texts, "file_id").where("byte_end <= octet_length(raw)")
    text = F.expr("make_valid_utf8(cast(substring(raw, cast(byte_start as int) + 1, cast(byte_end - byte_start as int)) as string))")
    newlines = lambda b: F.length(b) - F.length(F.translate(b, "\n", ""))
    head = F.expr("make_valid_utf8(cast(substring(raw, 1, cast(byte_start as int)) as string))")
    first = (newlines(head) + 1).cast("int")
    qualified = F.concat_ws(".", "parent_class", "name")
    kind = F.when(F.col("kind") == S.FUNCTION, "function").otherwise("class")
    return cut.select(
        F.concat_ws(":", "path", F.col("byte_start").cast("string"), F.substring(F.sha2(text, 256), 1, 16)).alias("chunk_id"),
        "file_id", "path", kind.alias("kind"), "name", qualified.alias("qualified_name"), "parent_class", text.alias("text"), "byte_start", "byte_end",
        first.alias("line_start"), (first + newlines(text)).cast("int").alias("line_end"),
    )


def unreadable(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """Paths with nodes whose file has no content."""
    there = files.where("content is not null").select("path").distinct()
    return nodes.select("path").distinct().join(there, "path", "left_anti")


def embedding_text(chunks: DataFrame) -> DataFrame:
    """The text that is embedded: where it stands, then the code."""
    return chunks.withColumn("embedding_text", F.concat("path", F.lit(" :: "), "qualified_name", F.lit("\n\n"), "text"))
