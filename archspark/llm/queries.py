"""Queries of the text operators and, where SQL can express them over whole tables, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archspark.llm import bpe, docpairs, leakage, pairs, provenance, reading, secrets, splitting, syntax
from archspark.session import table


def _gathered(spark: SparkSession, sf_dir: str, with_texts: bool = False) -> DataFrame:
    """Both tables read once: the candidates of every text."""
    index, requests = table(spark, sf_dir, "chunk_index"), table(spark, sf_dir, "requests")
    return secrets.gather([("chunk_index", index, "point_id", "text", "path"), ("requests", requests, "id", "prompt", None)], with_texts)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every credential in the indexed chunks and in the prompts."""
    read = _gathered(spark, sf_dir)
    return secrets.found_in(read, secrets.learn_from(read))


def p1_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both texts of every row with the credentials masked."""
    read = _gathered(spark, sf_dir, with_texts=True)
    return secrets.redacted_in(read, secrets.learn_from(read)).dropDuplicates(["tbl", "row_id"])


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that people did not write for their repository."""
    return p2_causes(spark, sf_dir).select("file_id")


def p2_causes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """These files with the reason."""
    return provenance.files_to_remove(table(spark, sf_dir, "files"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that had to be cut, and how."""
    return p3_pieces(spark, sf_dir).where("piece_no = 0").select("chunk_no", "cut")


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every oversized chunk."""
    return splitting.split(table(spark, sf_dir, "chunks"))


def p3_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each cut chunk put together again from its pieces: bytes, least and most offsets, and a digest of the text."""
    own = F.expr("cast(substring(cast(text as binary), cast(own_start - byte_start as int) + 1) as string)")
    parts = p3_pieces(spark, sf_dir).withColumn("own", own)
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece_no", "own"))), lambda x: x["own"]), "")
    return parts.groupBy("chunk_no").agg(F.min("byte_start").alias("first_byte"), F.max("byte_end").alias("last_byte"), F.sha2(whole, 256).alias("digest"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that do not parse as the language of their extension."""
    return syntax.faults(table(spark, sf_dir, "files")).select("file_id")


def p5_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """These files with furthest failure and cause."""
    return syntax.faults(table(spark, sf_dir, "files"))


def p5_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates per repository and language beside the recorded ``files_failed``."""
    return syntax.rates(table(spark, sf_dir, "files"), table(spark, sf_dir, "run_statistics"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defective pairs of prompt and response, with their defect."""
    return pairs.found(table(spark, sf_dir, "requests"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Function chunks with documentation that says something."""
    return docpairs.pairs(table(spark, sf_dir, "chunks"), with_texts=False)


def p7_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name, description and code of these functions."""
    return docpairs.pairs(table(spark, sf_dir, "chunks"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return bpe.encode(table(spark, sf_dir, "documents"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold at least 12 consecutive words of an evaluation item."""
    return leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reading grade of every prose document."""
    return reading.grades(table(spark, sf_dir, "documents"), table(spark, sf_dir, "reading_labels"))


QUERIES = {
    "p1_found": p1_found, "p1_redacted": p1_redacted, "p2_found": p2_found, "p2_causes": p2_causes, "p3_found": p3_found, "p3_pieces": p3_pieces, "p3_cover": p3_cover, "p5_found": p5_found, "p5_faults": p5_faults, "p5_rates": p5_rates, "p6_found": p6_found, "p7_found": p7_found, "p7_pairs": p7_pairs, "p8_ids": p8_ids, "p9_found": p9_found,
    "p10_found": p10_found,
}

SQL: dict[str, str] = {
    "p3_found": """
SELECT chunk_no, CASE WHEN list_max([strlen(x) + 1 FOR x IN string_split(text, chr(10))[:-2]]) > 8000
    OR strlen(string_split(text, chr(10))[-1]) > 8000 THEN 'forced' ELSE 'natural' END AS cut
FROM (SELECT DISTINCT chunk_no, text FROM chunks WHERE strlen(text) > 8000)""",
    "p3_cover": """
SELECT chunk_no, byte_start AS first_byte, byte_start + strlen(text) AS last_byte, sha256(text) AS digest
FROM (SELECT DISTINCT chunk_no, text, byte_start FROM chunks WHERE strlen(text) > 8000)""",
    "p9_found": """
WITH item AS (SELECT DISTINCT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM eval_items WHERE text IS NOT NULL),
gram AS (SELECT item_id, unnest([array_to_string(w[i:i + 11], ' ') FOR i IN range(1, len(w) - 10)]) AS g FROM item WHERE len(w) >= 12),
doc AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
shingle AS (SELECT doc_id, unnest([array_to_string(w[i:i + 11], ' ') FOR i IN range(1, len(w) - 10)]) AS g FROM doc WHERE len(w) >= 12)
SELECT DISTINCT s.doc_id, i.item_id FROM shingle s JOIN gram i ON i.g = s.g""",
}
