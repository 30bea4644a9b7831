"""Queries of import resolution, edges, cohesion, chunks, vectors, context and audit, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archspark.operators import arena, audit, chunk, cohesion, context, edges, policy, resolve, vectors
from archspark.plans.adapters import IMPORT_SQL, business_graph, files, import_corpus, nodes
from archspark.session import table

# --------------------------------------------------------------------------- resolution and edges


def suffix_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.suffix_index(import_corpus(spark, sf_dir)[0]).select("suffix", "path")


def import_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.resolve(*import_corpus(spark, sf_dir)).select("import_id", "from_file", "raw", "target", "resolution", "candidates")


def import_ambiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.ambiguity(*import_corpus(spark, sf_dir), top=3).select("import_id", "path", F.col("preference").cast("bigint").alias("preference"))


def resolution_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.statistics(resolve.resolve(*import_corpus(spark, sf_dir)))


def unresolved_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.unresolved(resolve.resolve(files(spark, sf_dir), edges.imports_of(nodes(spark, sf_dir))))


def relative_import_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each Python file imports its neighbour ``.x`` of every name in its folder's parent, one climb up."""
    known = files(spark, sf_dir).select("path").where("path like '%.py'")
    name = F.regexp_extract("path", r"([^/]+)/([^/]+)\.py$", 2)
    folder = F.regexp_extract("path", r"([^/]+)/([^/]+)\.py$", 1)
    up = known.select(F.concat_ws(":", F.lit("up"), "path").alias("import_id"), F.col("path").alias("from_file"), F.concat(F.lit(".."), folder, F.lit("."), name).alias("raw"))
    same = known.select(F.concat_ws(":", F.lit("same"), "path").alias("import_id"), F.col("path").alias("from_file"), F.concat(F.lit("."), name).alias("raw"))
    return resolve.resolve(known, up.unionByName(same)).select("import_id", "target", "resolution", "candidates")


def inheritance_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges.inheritance(nodes(spark, sf_dir)).select("source", "target", "raw_target")


def kind_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges.kind_counts(nodes(spark, sf_dir))


def file_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges.vertices(files(spark, sf_dir), nodes(spark, sf_dir))


def arena_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arena.violations(table(spark, sf_dir, "ast_nodes"))


def arena_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arena.walk(table(spark, sf_dir, "ast_nodes")).select("file_id", "root_id", "node_id", "depth")


# --------------------------------------------------------------------------- cohesion


def class_cohesion(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cohesion.class_cohesion(nodes(spark, sf_dir))
    return found.select("file_id", "class_id", "class_name", "method_count", "field_count", "lcom1", "lcom4", "is_cohesive", "suggested_split")


def lcom4_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cohesion.class_cohesion(nodes(spark, sf_dir)).where("method_count >= 2")
    return found.select("file_id", "class_id", F.array_join(F.transform("components", lambda g: F.array_join(g, "+")), "|").alias("components"))


def cohesion_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohesion.least_cohesive(cohesion.class_cohesion(nodes(spark, sf_dir))).select("path", "class_name", "method_count", "lcom4")


def violations_cohesion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.cohesion_violations(cohesion.class_cohesion(nodes(spark, sf_dir))).select("rule", "severity", "subject", "measured", "threshold")


def enclosing_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohesion.enclosing_classes(nodes(spark, sf_dir)).where("class_id is not null").select("file_id", "node_id", "class_id", "enclosing_class")


# --------------------------------------------------------------------------- chunks


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk.chunk(nodes(spark, sf_dir), files(spark, sf_dir).select("file_id", "path", "content"))


def chunk_declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir).select("chunk_id", "file_id", "kind", "qualified_name", "byte_start", "byte_end", "line_start", "line_end")


def chunk_unreadable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk.unreadable(nodes(spark, sf_dir), files(spark, sf_dir))


def document_chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk ids of whole documents: path, offset and the digest of the text."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    return d.select("doc_id", F.concat_ws(":", "source", F.lit("0"), F.substring(F.sha2("text", 256), 1, 16)).alias("chunk_id"), (F.length("text") - F.length(F.translate("text", "\n", "")) + 1).cast("bigint").alias("lines"))


# --------------------------------------------------------------------------- vectors


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("point_id"), F.col("embedding").alias("vector"), F.concat(F.lit("label"), F.col("label").cast("string")).alias("path"))


def _query(spark: SparkSession, sf_dir: str) -> list[float]:
    return list(table(spark, sf_dir, "embeddings").orderBy("vec_id").select("embedding").first()[0])


def _found(df: DataFrame) -> DataFrame:
    return df.select("point_id", "path", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(vectors.search(_points(spark, sf_dir), _query(spark, sf_dir)))


def vector_topk_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(vectors.search(_points(spark, sf_dir), _query(spark, sf_dir), paths=["label1", "label3"]))


def vector_topk_min_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(vectors.search(_points(spark, sf_dir), _query(spark, sf_dir), limit=50, min_score=0.25))


def vector_scope_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(vectors.search(_points(spark, sf_dir), _query(spark, sf_dir), paths=[]))


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


def _found_all(df: DataFrame) -> DataFrame:
    return df.select("query_id", "point_id", "path", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


def vector_topk_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 20 against all points."""
    return _found_all(vectors.search_all(_points(spark, sf_dir), _queries(spark, sf_dir)))


def vector_topk_scoped_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    scope = spark.createDataFrame([("label1",), ("label3",)], "path string")
    return _found_all(vectors.search_all(_points(spark, sf_dir), _queries(spark, sf_dir), paths=scope))


def vector_topk_min_score_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found_all(vectors.search_all(_points(spark, sf_dir), _queries(spark, sf_dir), limit=50, min_score=0.25))


def vector_latest_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points indexed again later replace their older rows."""
    return vectors.latest(table(spark, sf_dir, "chunk_index").select("point_id", "path", "qualified_name", "indexed_at")).select("point_id", "path", "qualified_name", "indexed_at")


def vector_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of all chunks after the points of one kind came again under another name."""
    t = table(spark, sf_dir, "chunks").select(F.col("chunk_no").alias("point_id"), "path", "kind", "qualified_name").distinct()
    again = t.where("kind = 'class'").withColumn("qualified_name", F.upper("qualified_name"))
    return vectors.upsert(t, again)


def vector_delete_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _points(spark, sf_dir).drop("vector")
    return vectors.delete_paths(points, ["label0", "label7"]).groupBy("path").agg(F.count("*").alias("points"))


def vector_payload_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    from archspark.operators.metrics import module_metrics

    orders = table(spark, sf_dir, "orders").select(F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).alias("path"))
    return vectors.with_metrics(orders, module_metrics(*business_graph(spark, sf_dir))).select("path", "afferent_coupling", "efferent_coupling", "instability")


def hash_embed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("embedding_text"))
    return vectors.embed(d, vectors.HashEmbedder(64)).select("doc_id", "vector")


# --------------------------------------------------------------------------- context and audit


def context_greedy_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per file, its chunks in order under a budget of 4,000 characters, 1,500 each, 12 chunks."""
    t = table(spark, sf_dir, "chunks").select("chunk_no", "path", F.length("text").alias("size")).distinct()
    items = t.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("chunk_no", "size"))).alias("items"))
    shaped = F.transform("items", lambda x: F.struct(x["chunk_no"].alias("id"), x["size"].alias("size")))
    kept = context.first_fit(shaped, context.ContextBudget(4_000, 1_500, 12))
    out = items.select("path", kept.alias("x"))
    return out.select("path", F.col("x.used").alias("used"), F.array_join("x.kept", ",").alias("kept"), F.size("x.dropped").cast("bigint").alias("dropped"))


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "requests").select("id", "created_at", "target", "model", "error", "prompt_chars")


def audit_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.recent(_log(spark, sf_dir))


def audit_for_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _log(spark, sf_dir)
    busiest = log.where("target is not null").groupBy("target").agg(F.count_distinct("id").alias("n")).orderBy(F.desc("n"), "target").first()[0]
    return audit.for_target(log, busiest)


def audit_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.failures(_log(spark, sf_dir))


def audit_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.count(_log(spark, sf_dir))


def audit_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.get(_log(spark, sf_dir), 7)


QUERIES = {
    f.__name__: f
    for f in (
        suffix_index, import_resolution, import_ambiguity, resolution_stats, unresolved_targets, relative_import_resolution, inheritance_edges, kind_counts, file_vertices, arena_violations, arena_walk,
        class_cohesion, lcom4_components, cohesion_ranked, violations_cohesion, enclosing_classes, chunk_declarations, chunk_unreadable, document_chunk_ids,
        vector_topk, vector_topk_scoped, vector_topk_min_score, vector_topk_all, vector_topk_scoped_all, vector_topk_min_score_all, vector_scope_empty, vector_latest_points, vector_upsert, vector_delete_paths, vector_payload_metrics, hash_embed_documents,
        context_greedy_budget, audit_recent, audit_for_target, audit_failures, audit_count, audit_get,
    )
}

# --------------------------------------------------------------------------- SQL

_NODE = """node AS (
  SELECT file_id, node_id, min(path) AS path, min(kind) AS kind, min(name) AS name, min(parent_index) AS p, min(first_child_index) AS f, min(child_count) AS c, min(byte_start) AS b, min(byte_end) AS e
  FROM ast_nodes WHERE file_id IS NOT NULL AND node_id IS NOT NULL GROUP BY 1, 2),
open_node AS (
  SELECT n.file_id, n.node_id, min(r.node_id) AS p FROM node n JOIN node r ON r.file_id = n.file_id AND r.c > 0 AND n.node_id >= r.f AND n.node_id < r.f + r.c
  WHERE n.p IS NULL GROUP BY 1, 2),
tree AS (
  SELECT n.*, CASE WHEN n.p IS NULL THEN o.p WHEN n.p < 0 THEN NULL ELSE n.p END AS parent
  FROM node n LEFT JOIN open_node o ON o.file_id = n.file_id AND o.node_id = n.node_id)"""
#: Nearest scope and class of each node that a root reaches.
_SCOPE = (
    _NODE
    + """,
scope AS (
  SELECT file_id, node_id, kind, name, path, NULL::INTEGER AS near, NULL::INTEGER AS near_kind, NULL::INTEGER AS class_id FROM tree WHERE parent IS NULL
  UNION ALL
  SELECT t.file_id, t.node_id, t.kind, t.name, t.path, CASE WHEN s.kind IN (1, 2) THEN s.node_id ELSE s.near END,
    CASE WHEN s.kind IN (1, 2) THEN s.kind ELSE s.near_kind END, CASE WHEN s.kind = 1 THEN s.node_id ELSE s.class_id END
  FROM tree t JOIN scope s ON s.file_id = t.file_id AND s.node_id = t.parent),
method AS (SELECT file_id, node_id AS method_id, near AS class_id, CASE WHEN name = '' THEN '<anonymous:' || node_id || '>' ELSE name END AS name FROM scope WHERE kind = 2 AND near_kind = 1),
owner AS (
  SELECT file_id, node_id, near AS at FROM scope WHERE kind IN (4, 7) AND near IS NOT NULL
  UNION ALL SELECT o.file_id, o.node_id, s.near FROM owner o JOIN scope s ON s.file_id = o.file_id AND s.node_id = o.at WHERE s.near IS NOT NULL),
used AS (
  SELECT DISTINCT m.file_id, m.class_id, m.method_id, s.kind, CASE WHEN s.kind = 7 THEN s.name ELSE string_split(string_split(s.name, '.')[-1], '::')[-1] END AS name
  FROM owner o JOIN method m ON m.file_id = o.file_id AND m.method_id = o.at JOIN scope s ON s.file_id = o.file_id AND s.node_id = o.node_id WHERE s.name <> ''),
class AS (SELECT file_id, node_id AS class_id, path, trim(string_split(name, ' : ')[1]) AS class_name FROM node WHERE kind = 1 AND trim(string_split(name, ' : ')[1]) <> '')"""
)
_LCOM = (
    _SCOPE
    + """,
named AS (SELECT file_id, class_id, name, max(method_id) AS method_id FROM method GROUP BY 1, 2, 3),
link AS (
  SELECT a.file_id, a.class_id, a.method_id AS x, b.method_id AS y FROM used a JOIN used b ON b.file_id = a.file_id AND b.class_id = a.class_id AND b.name = a.name AND a.kind = 7 AND b.kind = 7
  UNION SELECT u.file_id, u.class_id, u.method_id, n.method_id FROM used u JOIN named n ON n.file_id = u.file_id AND n.class_id = u.class_id AND n.name = u.name WHERE u.kind = 4
  UNION SELECT u.file_id, u.class_id, n.method_id, u.method_id FROM used u JOIN named n ON n.file_id = u.file_id AND n.class_id = u.class_id AND n.name = u.name WHERE u.kind = 4),
near_to AS (
  SELECT file_id, class_id, method_id AS x, method_id AS y FROM method
  UNION SELECT r.file_id, r.class_id, r.x, l.y FROM near_to r JOIN link l ON l.file_id = r.file_id AND l.class_id = r.class_id AND l.x = r.y),
part AS (SELECT file_id, class_id, x AS method_id, min(y) AS part FROM near_to GROUP BY 1, 2, 3),
size AS (SELECT file_id, class_id, count(*) AS m FROM method GROUP BY 1, 2),
sharing AS (
  SELECT a.file_id, a.class_id, count(DISTINCT (a.method_id, b.method_id)) AS s FROM used a JOIN used b ON b.file_id = a.file_id AND b.class_id = a.class_id AND b.name = a.name
  WHERE a.kind = 7 AND b.kind = 7 AND a.method_id < b.method_id GROUP BY 1, 2),
lcom AS (
  SELECT c.file_id, c.class_id, c.path, c.class_name, coalesce(z.m, 0)::INTEGER AS method_count,
    coalesce((SELECT count(DISTINCT u.name) FROM used u WHERE u.file_id = c.file_id AND u.class_id = c.class_id AND u.kind = 7), 0)::INTEGER AS field_count,
    greatest(0, coalesce(z.m, 0) * (coalesce(z.m, 0) - 1) // 2 - 2 * coalesce(h.s, 0))::BIGINT AS lcom1,
    coalesce((SELECT count(DISTINCT p.part) FROM part p WHERE p.file_id = c.file_id AND p.class_id = c.class_id), 0)::INTEGER AS lcom4
  FROM class c LEFT JOIN size z ON z.file_id = c.file_id AND z.class_id = c.class_id LEFT JOIN sharing h ON h.file_id = c.file_id AND h.class_id = c.class_id)"""
)


def _vector(where: str, limit: int) -> str:
    score = "list_dot_product(e.embedding::DOUBLE[], q.v::DOUBLE[])"
    return (
        f"WITH q AS (SELECT embedding AS v FROM embeddings ORDER BY vec_id LIMIT 1), s AS (SELECT vec_id AS point_id, 'label' || label AS path, {score} AS score FROM embeddings e, q) "
        f"SELECT point_id, path, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, point_id) AS rank FROM s WHERE {where} ORDER BY s.score DESC, point_id LIMIT {limit}"
    )


def _vector_all(where: str, limit: int) -> str:
    score = "list_dot_product(e.embedding::DOUBLE[], q.v::DOUBLE[])"
    return (
        f"WITH q AS (SELECT vec_id AS query_id, embedding AS v FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT query_id, vec_id AS point_id, 'label' || label AS path, {score} AS score FROM embeddings e, q) "
        f"SELECT query_id, point_id, path, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY s.score DESC, point_id) AS rank FROM s WHERE {where} QUALIFY rank <= {limit}"
    )


_LOGGED = "SELECT DISTINCT id, created_at, target, model, error, prompt_chars FROM requests"

SQL = {
    "suffix_index": f"WITH {IMPORT_SQL.strip()} SELECT suffix, path FROM suf",
    "import_resolution": f"WITH {IMPORT_SQL.strip()} SELECT import_id::VARCHAR AS import_id, from_file, raw, target, resolution, candidates FROM res",
    "import_ambiguity": f"""WITH {IMPORT_SQL.strip()} SELECT import_id::VARCHAR AS import_id, path, preference FROM (
  SELECT p.import_id, p.path, row_number() OVER (PARTITION BY p.import_id ORDER BY shared DESC, p.path) AS preference FROM pair p JOIN res r ON r.import_id = p.import_id AND r.resolution = 'ambiguous') WHERE preference <= 3""",
    "resolution_stats": f"""WITH {IMPORT_SQL.strip()} SELECT count(*) FILTER (WHERE resolution = 'resolved') AS resolved, count(*) FILTER (WHERE resolution = 'ambiguous') AS ambiguous,
  count(*) FILTER (WHERE resolution = 'external') AS external, count(*) AS total, count(*) FILTER (WHERE resolution <> 'external') / count(*) AS resolved_ratio FROM res""",
    "unresolved_targets": f"WITH {_NODE} SELECT name AS raw, count(*) AS n FROM node WHERE kind = 3 AND name <> '' GROUP BY 1",
    "relative_import_resolution": r"""
WITH f AS (SELECT DISTINCT path FROM files WHERE path LIKE '%.py'),
g AS (SELECT path, regexp_extract(path, '([^/]+)/([^/]+)\.py$', 1) AS folder, regexp_extract(path, '([^/]+)/([^/]+)\.py$', 2) AS name FROM f)
SELECT 'up:' || path AS import_id, CASE WHEN contains(folder, '.') THEN '..' || folder || '.' || name ELSE path END AS target,
  CASE WHEN contains(folder, '.') THEN 'external' ELSE 'resolved' END AS resolution, CASE WHEN contains(folder, '.') THEN 0 ELSE 1 END::BIGINT AS candidates FROM g
UNION ALL SELECT 'same:' || path, path, 'resolved', 1 FROM g""",
    "inheritance_edges": f"""WITH {_NODE},
class AS (SELECT path, trim(string_split(name, ' : ')[1]) AS own, unnest(string_split(array_to_string(string_split(name, ' : ')[2:], ' : '), ',')) AS base FROM node WHERE kind = 1 AND contains(name, ' : ')),
def AS (SELECT trim(string_split(name, ' : ')[1]) AS own, count(*) AS n, min(path) AS path FROM node WHERE kind = 1 GROUP BY 1 HAVING trim(string_split(min(name), ' : ')[1]) <> '')
SELECT c.path AS source, d.path AS target, trim(c.base) AS raw_target FROM class c JOIN def d ON d.own = string_split(string_split(trim(c.base), '::')[-1], '.')[-1] AND d.n = 1 WHERE d.path <> c.path AND trim(c.base) <> ''""",
    "kind_counts": f"WITH {_NODE} SELECT path, " + ", ".join(f"count(*) FILTER (WHERE kind = {k}) AS {name}" for k, name in enumerate(("file", "class", "function", "import", "call", "variable", "other", "fieldaccess"))) + " FROM node GROUP BY path",
    "file_vertices": f"""WITH {_NODE} SELECT f.path, coalesce(count(n.node_id), 0)::INTEGER AS node_count, count(*) FILTER (WHERE n.kind = 1)::INTEGER AS class_count, count(*) FILTER (WHERE n.kind = 2)::INTEGER AS function_count,
  count(*) FILTER (WHERE n.kind = 3)::INTEGER AS import_count FROM (SELECT DISTINCT path FROM files) f LEFT JOIN node n ON n.path = f.path GROUP BY f.path""",
    "arena_violations": f"""WITH {_NODE}
SELECT file_id, node_id, 'root' AS rule FROM node WHERE (p = -1) <> (node_id = 0)
UNION ALL SELECT n.file_id, n.node_id, 'parent' FROM node n LEFT JOIN node u ON u.file_id = n.file_id AND u.node_id = n.p WHERE n.p IS NULL OR n.p >= 0 AND (u.node_id IS NULL OR n.p >= n.node_id)
UNION ALL SELECT file_id, node_id, 'bounds' FROM node WHERE b < 0 OR e < b
UNION ALL SELECT n.file_id, n.node_id, 'nesting' FROM node n JOIN node u ON u.file_id = n.file_id AND u.node_id = n.p WHERE n.b < u.b OR n.e > u.e
UNION ALL SELECT DISTINCT n.file_id, n.node_id, 'children' FROM node n JOIN node k ON k.file_id = n.file_id AND n.c > 0 AND k.node_id >= n.f AND k.node_id < n.f + n.c WHERE k.p IS NULL OR k.p <> n.node_id""",
    "arena_walk": f"""WITH RECURSIVE {_NODE},
down AS (SELECT file_id, node_id AS root_id, node_id, 0 AS depth FROM tree WHERE parent IS NULL UNION ALL SELECT t.file_id, d.root_id, t.node_id, d.depth + 1 FROM tree t JOIN down d ON d.file_id = t.file_id AND d.node_id = t.parent)
SELECT file_id, root_id, node_id, depth FROM down""",
    "class_cohesion": f"WITH RECURSIVE {_LCOM} SELECT file_id, class_id, class_name, method_count, field_count, lcom1, lcom4, lcom4 <= 1 AS is_cohesive, greatest(lcom4, 1) AS suggested_split FROM lcom",
    "lcom4_components": f"""WITH RECURSIVE {_LCOM},
grp AS (SELECT p.file_id, p.class_id, p.part, list_sort(list(m.name)) AS g FROM part p JOIN method m ON m.file_id = p.file_id AND m.method_id = p.method_id GROUP BY 1, 2, 3)
SELECT l.file_id, l.class_id, string_agg(array_to_string(g, '+'), '|' ORDER BY len(g) DESC, g) AS components FROM lcom l JOIN grp ON grp.file_id = l.file_id AND grp.class_id = l.class_id WHERE l.method_count >= 2 GROUP BY 1, 2""",
    "cohesion_ranked": f"WITH RECURSIVE {_LCOM} SELECT path, class_name, method_count, lcom4 FROM lcom WHERE lcom4 > 1 ORDER BY lcom4 DESC, method_count DESC, path, class_name, class_id LIMIT 10",
    "violations_cohesion": f"WITH RECURSIVE {_LCOM} SELECT 'cohesion' AS rule, 'warning' AS severity, path || '::' || class_name AS subject, lcom4::DOUBLE AS measured, 1.0::DOUBLE AS threshold FROM lcom WHERE method_count >= 3 AND lcom4 > 1",
    "enclosing_classes": f"WITH RECURSIVE {_SCOPE} SELECT s.file_id, s.node_id, s.class_id, c.class_name AS enclosing_class FROM scope s LEFT JOIN class c ON c.file_id = s.file_id AND c.class_id = s.class_id WHERE s.class_id IS NOT NULL",
    "chunk_declarations": f"""WITH RECURSIVE {_SCOPE},
body AS (SELECT file_id, any_value(encode(content)) AS raw FROM files WHERE content IS NOT NULL GROUP BY 1),
decl AS (
  SELECT n.file_id, n.path, n.kind, trim(string_split(n.name, ' : ')[1]) AS name, n.b, n.e, c.class_name AS parent_class, decode(y.raw[n.b + 1:n.e]) AS t, decode(y.raw[1:n.b]) AS head
  FROM node n JOIN body y ON y.file_id = n.file_id LEFT JOIN scope s ON s.file_id = n.file_id AND s.node_id = n.node_id LEFT JOIN class c ON c.file_id = s.file_id AND c.class_id = s.class_id
  WHERE n.name <> '' AND n.b >= 0 AND n.e - n.b BETWEEN 80 AND 8000 AND n.e <= octet_length(y.raw)
    AND (n.kind = 2 OR n.kind = 1 AND (n.file_id, n.node_id) NOT IN (SELECT (file_id, class_id) FROM method)))
SELECT path || ':' || b || ':' || substring(sha256(t), 1, 16) AS chunk_id, file_id, CASE kind WHEN 2 THEN 'function' ELSE 'class' END AS kind, CASE WHEN parent_class IS NULL THEN name ELSE parent_class || '.' || name END AS qualified_name,
  b AS byte_start, e AS byte_end, (1 + length(head) - length(replace(head, chr(10), '')))::INTEGER AS line_start,
  (1 + length(head) - length(replace(head, chr(10), '')) + length(t) - length(replace(t, chr(10), '')))::INTEGER AS line_end
FROM decl WHERE name <> ''""",
    "chunk_unreadable": "SELECT DISTINCT a.path FROM ast_nodes a WHERE a.path NOT IN (SELECT path FROM files WHERE content IS NOT NULL)",
    "document_chunk_ids": "SELECT doc_id, source || ':0:' || substring(sha256(text), 1, 16) AS chunk_id, (length(text) - length(replace(text, chr(10), '')) + 1)::BIGINT AS lines FROM documents WHERE text IS NOT NULL",
    "vector_topk": _vector("true", 10),
    "vector_topk_scoped": _vector("path IN ('label1', 'label3')", 10),
    "vector_topk_min_score": _vector("s.score >= 0.25", 50),
    "vector_topk_all": _vector_all("true", 10),
    "vector_topk_scoped_all": _vector_all("path IN ('label1', 'label3')", 10),
    "vector_topk_min_score_all": _vector_all("s.score >= 0.25", 50),
    "vector_scope_empty": _vector("false", 10),
    "vector_latest_points": "SELECT DISTINCT point_id, path, qualified_name, indexed_at FROM chunk_index QUALIFY indexed_at = max(indexed_at) OVER (PARTITION BY point_id)",
    "vector_upsert": "SELECT DISTINCT chunk_no AS point_id, path, kind, CASE WHEN kind = 'class' THEN upper(qualified_name) ELSE qualified_name END AS qualified_name FROM chunks",
    "vector_delete_paths": "SELECT 'label' || label AS path, count(*) AS points FROM embeddings WHERE label NOT IN (0, 7) GROUP BY 1",
    "vector_payload_metrics": """WITH e AS (SELECT DISTINCT 'order:' || l_orderkey AS s, 'part:' || l_partkey AS t FROM lineitem UNION SELECT 'order:' || l_orderkey, 'supplier:' || l_suppkey FROM lineitem UNION SELECT 'order:' || o_orderkey, 'customer:' || o_custkey FROM orders),
n AS (SELECT s, count(*) AS ce FROM e GROUP BY 1)
SELECT 'order:' || o_orderkey AS path, 0::BIGINT AS afferent_coupling, coalesce(ce, 0) AS efferent_coupling, CASE WHEN coalesce(ce, 0) = 0 THEN 0.0 ELSE 1.0 END::DOUBLE AS instability FROM orders LEFT JOIN n ON n.s = 'order:' || o_orderkey""",
    "context_greedy_budget": """
WITH RECURSIVE item AS (SELECT path, chunk_no, least(length(text), 1500) AS size, row_number() OVER (PARTITION BY path ORDER BY chunk_no) AS i FROM (SELECT DISTINCT chunk_no, path, text FROM chunks)),
fold AS (
  SELECT path, 0::BIGINT AS i, 0::BIGINT AS used, 0 AS n, '' AS kept, 0::BIGINT AS dropped FROM item WHERE i = 1
  UNION ALL
  SELECT f.path, f.i + 1, CASE WHEN ok THEN f.used + f.size ELSE f.used END, CASE WHEN ok THEN n + 1 ELSE n END, CASE WHEN NOT ok THEN kept WHEN kept = '' THEN chunk_no::VARCHAR ELSE kept || ',' || chunk_no END,
    CASE WHEN ok THEN dropped ELSE dropped + 1 END
  FROM (SELECT f.*, x.chunk_no, x.size, (f.n < 12 AND f.used + x.size <= 4000) AS ok FROM fold f JOIN item x ON x.path = f.path AND x.i = f.i + 1) f)
SELECT path, used, kept, dropped FROM fold QUALIFY i = max(i) OVER (PARTITION BY path)""",
    "audit_recent": f"{_LOGGED} ORDER BY id DESC LIMIT 20",
    "audit_for_target": f"WITH t AS (SELECT target FROM (SELECT DISTINCT id, target FROM requests) WHERE target IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, target LIMIT 1) {_LOGGED} WHERE target = (SELECT target FROM t) ORDER BY id DESC LIMIT 20",
    "audit_failures": f"{_LOGGED} WHERE error IS NOT NULL ORDER BY id DESC LIMIT 20",
    "audit_count": "SELECT count(DISTINCT id) AS records FROM requests",
    "audit_get": f"{_LOGGED} WHERE id = 7",
}
