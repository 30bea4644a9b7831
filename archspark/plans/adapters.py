"""The tables at hand as the engine's abstractions: files, nodes, edges, imports, vectors and audit rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archspark.session import table


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Syntax nodes, each once."""
    return table(spark, sf_dir, "ast_nodes").dropDuplicates(["file_id", "node_id"])


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "files").dropDuplicates(["file_id"])


def _key(kind: str, column: str):
    return F.concat(F.lit(f"{kind}:"), F.col(column).cast("string"))


def business_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Foreign keys as dependencies ``source, target, kind``, one row for each referring row: acyclic, four layers deep."""
    t = lambda name: table(spark, sf_dir, name)
    lines = t("lineitem").select(_key("order", "l_orderkey").alias("source"), F.explode(F.array(F.struct(_key("part", "l_partkey").alias("target"), F.lit("import").alias("kind")), F.struct(_key("supplier", "l_suppkey").alias("target"), F.lit("inheritance").alias("kind")))).alias("x")).select("source", "x.*")
    rest = [
        t("orders").select(_key("order", "o_orderkey").alias("source"), _key("customer", "o_custkey").alias("target"), F.lit("import").alias("kind")),
        t("customer").select(_key("customer", "c_custkey").alias("source"), _key("nation", "c_nationkey").alias("target"), F.lit("import").alias("kind")),
        t("supplier").select(_key("supplier", "s_suppkey").alias("source"), _key("nation", "s_nationkey").alias("target"), F.lit("import").alias("kind")),
        t("nation").select(_key("nation", "n_nationkey").alias("source"), _key("region", "n_regionkey").alias("target"), F.lit("import").alias("kind")),
    ]
    for part in rest:
        lines = lines.unionByName(part)
    return lines


DEPENDENCY_SQL = """
dep AS (
  SELECT 'order:' || l_orderkey AS source, 'part:' || l_partkey AS target, 'import' AS kind FROM lineitem
  UNION ALL SELECT 'order:' || l_orderkey, 'supplier:' || l_suppkey, 'inheritance' FROM lineitem
  UNION ALL SELECT 'order:' || o_orderkey, 'customer:' || o_custkey, 'import' FROM orders
  UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey, 'import' FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'import' FROM supplier
  UNION ALL SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey, 'import' FROM nation),
edge AS (SELECT source, target, count(*) AS weight, bool_or(kind = 'import') AS imp, bool_or(kind = 'inheritance') AS inh FROM dep GROUP BY 1, 2),
vertex AS (SELECT source AS path FROM edge UNION SELECT target FROM edge UNION SELECT 'part:' || p_partkey FROM part)"""


def business_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) of the foreign keys; parts that nobody ordered stay as isolated vertices."""
    from archspark.operators.graph import collapse, vertices_of

    edges = collapse(business_dependencies(spark, sf_dir))
    parts = table(spark, sf_dir, "part").select(_key("part", "p_partkey").alias("path"))
    return vertices_of(edges).unionByName(parts).distinct(), edges


def request_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) that the audit log has seen: targets on their dependencies, dependents on targets. It has cycles."""
    from archspark.operators.graph import vertices_of

    log = table(spark, sf_dir, "requests").where("target is not null").select("target", "dependencies", "dependents")
    down = log.select(F.col("target").alias("source"), F.explode("dependencies").alias("target"))
    up = log.select(F.explode("dependents").alias("source"), "target")
    edges = down.unionByName(up).where("source is not null and target is not null").distinct()
    return vertices_of(edges), edges


REQUEST_EDGE_SQL = """
edge AS (
  SELECT DISTINCT source, target FROM (
    SELECT target AS source, unnest(dependencies) AS target FROM requests WHERE target IS NOT NULL
    UNION ALL SELECT unnest(dependents), target FROM requests WHERE target IS NOT NULL)
  WHERE source IS NOT NULL AND target IS NOT NULL)"""


def import_corpus(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(files, imports) from parts: file ``brand/type/name``; part k imports the file of part k + 1 under one of four names."""
    p = table(spark, sf_dir, "part").select("p_partkey", *[F.translate(c, " ", "_").alias(c) for c in ("p_brand", "p_type", "p_name")])
    path = F.concat_ws("/", "p_brand", "p_type", "p_name")
    known = p.select(path.alias("path")).distinct()
    k = F.col("p_partkey") % 4
    raw = F.when(k == 0, F.col("p_name")).when(k == 1, F.concat_ws("/", "p_type", "p_name")).when(k == 2, path).otherwise(F.concat(F.lit("ext/"), F.col("p_name")))
    named = p.select((F.col("p_partkey") - 1).alias("p_partkey"), raw.alias("raw"))
    imports = p.select("p_partkey", path.alias("from_file")).join(named, "p_partkey").select(F.col("p_partkey").cast("string").alias("import_id"), "from_file", "raw")
    return known, imports


IMPORT_SQL = r"""
p AS (SELECT p_partkey AS k, replace(p_brand, ' ', '_') AS b, replace(p_type, ' ', '_') AS t, replace(p_name, ' ', '_') AS n FROM part),
f AS (SELECT DISTINCT b || '/' || t || '/' || n AS path FROM p),
imp AS (
  SELECT a.k AS import_id, a.b || '/' || a.t || '/' || a.n AS from_file,
    CASE q.k % 4 WHEN 0 THEN q.n WHEN 1 THEN q.t || '/' || q.n WHEN 2 THEN q.b || '/' || q.t || '/' || q.n ELSE 'ext/' || q.n END AS raw
  FROM p a JOIN p q ON q.k = a.k + 1),
suf AS (SELECT path, array_to_string(string_split(path, '/')[i:], '/') AS suffix FROM f, range(1, 4) r(i) WHERE i <= len(string_split(path, '/'))),
beside AS (SELECT i.*, regexp_replace(from_file, '/[^/]*$', '') || '/' || raw AS near FROM imp i),
pair AS (
  SELECT b.import_id, b.from_file, s.path,
    CASE WHEN string_split(s.path, '/')[1] <> string_split(b.from_file, '/')[1] THEN 0 WHEN string_split(s.path, '/')[2] <> string_split(b.from_file, '/')[2] THEN 1
      WHEN string_split(s.path, '/')[3] <> string_split(b.from_file, '/')[3] THEN 2 ELSE 3 END AS shared
  FROM beside b JOIN suf s ON s.suffix = b.raw WHERE b.near NOT IN (SELECT path FROM f)),
best AS (SELECT import_id, count(*) AS n, first(path ORDER BY shared DESC, path) AS path FROM pair GROUP BY 1),
res AS (
  SELECT b.import_id, b.from_file, b.raw, CASE WHEN f.path IS NOT NULL THEN f.path WHEN s.path IS NOT NULL THEN s.path ELSE b.raw END AS target,
    CASE WHEN f.path IS NOT NULL OR s.n = 1 THEN 'resolved' WHEN s.n > 1 THEN 'ambiguous' ELSE 'external' END AS resolution,
    CASE WHEN f.path IS NOT NULL THEN 1 ELSE coalesce(s.n, 0) END AS candidates
  FROM beside b LEFT JOIN f ON f.path = b.near LEFT JOIN best s ON s.import_id = b.import_id)"""
