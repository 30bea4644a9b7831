"""Queries of problem 4 (hierarchies) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from archspark.operators.hierarchy import hierarchy
from archspark.session import table


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes that reach no root, with the reason."""
    return hierarchy(table(spark, sf_dir, "ast_nodes"), with_paths=False, only_lost=True).select("file_id", "node_id", "state")


def p4_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node with parent, depth, root, number of descendants and full path."""
    return hierarchy(table(spark, sf_dir, "ast_nodes")).select("file_id", "node_id", "parent_id", "state", "depth", "root_id", "descendants", "path")


def p4_large_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with every tree of more than 600 rows ranked by joins, as trees beyond a task's bound are."""
    return hierarchy(table(spark, sf_dir, "ast_nodes"), max_tree_rows=600).select("file_id", "node_id", "parent_id", "state", "depth", "root_id", "descendants", "path")


QUERIES = {"p4_found": p4_found, "p4_nodes": p4_nodes, "p4_large_trees": p4_large_trees}

_TREE = """
WITH RECURSIVE node AS (
  SELECT file_id, node_id, min(parent_index) AS p, min(first_child_index) AS f, min(child_count) AS c
  FROM ast_nodes WHERE file_id IS NOT NULL AND node_id IS NOT NULL GROUP BY file_id, node_id),
open_node AS (
  SELECT n.file_id, n.node_id, min(r.node_id) AS p
  FROM node n JOIN node r ON r.file_id = n.file_id AND r.c > 0 AND n.node_id >= r.f AND n.node_id < r.f + r.c
  WHERE n.p IS NULL GROUP BY 1, 2),
linked AS (
  SELECT n.file_id, n.node_id, CASE WHEN n.p IS NULL THEN o.p WHEN n.p < 0 THEN NULL ELSE n.p END AS parent
  FROM node n LEFT JOIN open_node o ON o.file_id = n.file_id AND o.node_id = n.node_id),
tree AS (
  SELECT l.file_id, l.node_id, l.parent, (l.parent IS NOT NULL AND q.node_id IS NULL) AS missing
  FROM linked l LEFT JOIN node q ON q.file_id = l.file_id AND q.node_id = l.parent),
down AS (
  SELECT file_id, node_id, node_id AS root_id, 0 AS depth, CAST(node_id AS VARCHAR) AS path, missing
  FROM tree WHERE parent IS NULL OR missing
  UNION ALL
  SELECT t.file_id, t.node_id, d.root_id, d.depth + 1, d.path || '/' || CAST(t.node_id AS VARCHAR), d.missing
  FROM tree t JOIN down d ON d.file_id = t.file_id AND d.node_id = t.parent WHERE NOT t.missing),
lost AS (SELECT t.file_id, t.node_id, t.parent FROM tree t ANTI JOIN down d ON d.file_id = t.file_id AND d.node_id = t.node_id),
climb AS (
  SELECT file_id, node_id, parent AS a FROM lost
  UNION
  SELECT c.file_id, c.node_id, l.parent FROM climb c JOIN lost l ON l.file_id = c.file_id AND l.node_id = c.a),
cyclic AS (SELECT file_id, node_id FROM climb WHERE a = node_id),
state AS (
  SELECT t.file_id, t.node_id, CASE WHEN t.missing THEN NULL ELSE t.parent END AS parent_id,
    CASE WHEN y.node_id IS NOT NULL THEN 'in_cycle' WHEN d.node_id IS NULL THEN 'below_cycle' WHEN d.missing THEN 'orphaned' ELSE 'ok' END AS state,
    d.depth, d.root_id, d.path
  FROM tree t LEFT JOIN down d ON d.file_id = t.file_id AND d.node_id = t.node_id
  LEFT JOIN cyclic y ON y.file_id = t.file_id AND y.node_id = t.node_id)
"""

SQL = {
    "p4_found": _TREE + "SELECT file_id, node_id, state FROM state WHERE state <> 'ok'",
    "p4_nodes": _TREE.rstrip()
    + """,
above AS (
  SELECT file_id, node_id, parent_id AS a FROM state WHERE parent_id IS NOT NULL AND state <> 'in_cycle'
  UNION ALL
  SELECT x.file_id, x.node_id, s.parent_id FROM above x JOIN state s ON s.file_id = x.file_id AND s.node_id = x.a
  WHERE s.parent_id IS NOT NULL AND s.state <> 'in_cycle'),
below AS (SELECT file_id, a, count(*) AS n FROM above GROUP BY 1, 2)
SELECT s.file_id, s.node_id, CAST(s.parent_id AS INTEGER) AS parent_id, s.state,
  CASE WHEN s.state = 'ok' THEN CAST(s.depth AS INTEGER) END AS depth, CASE WHEN s.state = 'ok' THEN CAST(s.root_id AS INTEGER) END AS root_id,
  CASE WHEN s.state <> 'in_cycle' THEN CAST(coalesce(b.n, 0) AS BIGINT) END AS descendants, CASE WHEN s.state = 'ok' THEN s.path END AS path
FROM state s LEFT JOIN below b ON b.file_id = s.file_id AND b.a = s.node_id""",
}
SQL["p4_large_trees"] = SQL["p4_nodes"]
