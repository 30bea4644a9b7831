"""Queries on the dependencies that the audit log, the files and the places hold, where other tables give no rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archspark.operators import chunk, edges, metrics, policy
from archspark.plans.adapters import REQUEST_EDGE_SQL, files, request_graph
from archspark.schemas import CLASS
from archspark.session import table


def isolated_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that no audited request depends on or names as dependent."""
    vertices, links = request_graph(spark, sf_dir)
    known = vertices.unionByName(files(spark, sf_dir).select("path")).distinct()
    return metrics.module_metrics(known, links).where("is_isolated").select("path")


def violations_instability_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Much used and unstable files of the audited requests."""
    found = metrics.module_metrics(*request_graph(spark, sf_dir))
    return policy.instability_violations(found).select("rule", "severity", "subject", "message", "measured", "threshold")


def files_without_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of the snapshot whose source cannot be read any more."""
    known = table(spark, sf_dir, "files").select("path", "content")
    return chunk.unreadable(known.select("path"), known)


def place_inheritance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of customers, nations and regions, each derived from the next: bases with and without a namespace, unknown
    ones, and names that two files define."""
    t = lambda name: table(spark, sf_dir, name)
    under = lambda c: F.translate(c, " ", "_")
    node = lambda df, path, name: df.select(path.alias("path"), F.lit(CLASS).cast("tinyint").alias("kind"), name.alias("name"))
    nations = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    customers = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = node(t("region"), F.format_string("region/%d.hpp", F.col("r_regionkey").cast("bigint")), under("r_name"))
    rows = rows.unionByName(node(nations, F.format_string("nation/%d.hpp", F.col("n_nationkey").cast("bigint")), F.concat(under("n_name"), F.lit(" : geo::"), under("r_name"), F.lit(" , Missing"))))
    rows = rows.unionByName(node(customers, F.format_string("customer/%d.py", F.col("c_custkey").cast("bigint")), F.concat(F.lit("Customer"), (F.col("c_custkey") % 7).cast("string"), F.lit(" : Customer1, geo."), under("n_name"))))
    return edges.inheritance(rows).select("source", "target", "raw_target")


QUERIES = {f.__name__: f for f in (isolated_files, violations_instability_requests, files_without_content, place_inheritance)}

_DEGREE = f"""WITH {REQUEST_EDGE_SQL.strip()},
ends AS (SELECT target AS path, 1 AS i, 0 AS o FROM edge UNION ALL SELECT source, 0, 1 FROM edge),
degree AS (SELECT path, sum(i)::BIGINT AS ca, sum(o)::BIGINT AS ce FROM ends GROUP BY path)
"""

SQL = {
    "isolated_files": _DEGREE + "SELECT DISTINCT path FROM files WHERE path NOT IN (SELECT path FROM degree)",
    "violations_instability_requests": _DEGREE
    + "SELECT 'instability' AS rule, 'error' AS severity, path AS subject, 'Instability ' || printf('%.2f', ce / (ca + ce)) || ' exceeds 0.40 with ' || ca || ' dependents' AS message, ce / (ca + ce) AS measured, 0.4::DOUBLE AS threshold FROM degree WHERE ca >= 3 AND ce / (ca + ce) > 0.4",
    "files_without_content": "SELECT DISTINCT path FROM files WHERE path NOT IN (SELECT path FROM files WHERE content IS NOT NULL)",
    "place_inheritance": """SELECT 'nation/' || n_nationkey || '.hpp' AS source, 'region/' || r_regionkey || '.hpp' AS target, 'geo::' || replace(r_name, ' ', '_') AS raw_target
FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 'customer/' || c_custkey || '.py', 'nation/' || n_nationkey || '.hpp', 'geo.' || replace(n_name, ' ', '_') FROM customer JOIN nation ON c_nationkey = n_nationkey""",
}
