"""Queries of coupling, graph structure, traversal and policy, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archspark.operators import graph, metrics, policy
from archspark.plans.adapters import DEPENDENCY_SQL, REQUEST_EDGE_SQL, business_dependencies, business_graph, request_graph

ONE = "nation:7"


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.module_metrics(*business_graph(spark, sf_dir))


def module_coupling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metrics(spark, sf_dir).select("path", "ca", "ce", "instability", "total_coupling")


def module_coupling_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.one_module(*business_graph(spark, sf_dir), ONE).select("path", "ca", "ce", "instability")


def most_unstable_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.most_unstable(_metrics(spark, sf_dir)).select("path", "ca", "ce", "instability")


def most_depended_upon_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.most_depended_upon(_metrics(spark, sf_dir)).select("path", "ca", "ce", "instability")


def isolated_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metrics(spark, sf_dir).where("is_isolated").select("path")


def foundational_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metrics(spark, sf_dir).where("is_foundational").select("path", "ca")


def instability_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.bands(_metrics(spark, sf_dir)).groupBy("band", "decorated").agg(F.count("*").alias("modules"))


def edge_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.collapse(business_dependencies(spark, sf_dir)).select("source", "target", "weight", F.array_join("kinds", ",").alias("kinds"))


def graph_summary_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.summary(*business_graph(spark, sf_dir), with_cycles=False)


def graph_summary_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    vertices, edges = request_graph(spark, sf_dir)
    return graph.summary(vertices, edges.withColumn("kinds", F.array(F.lit("import"))))


def scc_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.strong_components(request_graph(spark, sf_dir)[1])


def cycles_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.cycles(request_graph(spark, sf_dir)[1]).select("component", "size", F.array_join("members", ",").alias("members"))


def topological_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.layers(*business_graph(spark, sf_dir))


def topological_layers_cyclic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.layers(*request_graph(spark, sf_dir))


def _hub(edges: DataFrame) -> str:
    """The vertex most depended upon, by path among equals."""
    return edges.groupBy("target").count().orderBy(F.desc("count"), "target").first()[0]


def _radius(spark: SparkSession, sf_dir: str, **options) -> tuple[DataFrame, str]:
    vertices, edges = request_graph(spark, sf_dir)
    hub = _hub(edges)
    return graph.blast_radius(vertices, edges, hub, **options), hub


def blast_radius_dependents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.reach((e := request_graph(spark, sf_dir)[1]), _hub(e), 2, True)


def blast_radius_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.reach((e := request_graph(spark, sf_dir)[1]), _hub(e), 3, False)


def blast_radius_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _radius(spark, sf_dir)[0].select("direction", "path", "distance", F.col("rank").cast("bigint").alias("rank"), "total")


def blast_radius_all_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    radius, hub = _radius(spark, sf_dir)
    return graph.all_paths(radius, hub).select("path")


def _violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.violations(_metrics(spark, sf_dir))


def violations_instability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.instability_violations(_metrics(spark, sf_dir)).select("rule", "severity", "subject", "message", "measured", "threshold")


def violations_efferent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.efferent_violations(_metrics(spark, sf_dir), policy.Thresholds(max_efferent=8)).select("rule", "severity", "subject", "message", "measured", "threshold")


def violations_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.cycle_violations(graph.cycles(request_graph(spark, sf_dir)[1])).select("rule", "severity", "subject", "measured", "threshold")


def violations_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.ranked(policy.violations(_metrics(spark, sf_dir), t=policy.Thresholds(max_efferent=8))).select("rule", "severity", "subject", "measured", "threshold")


def gate_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.gate(policy.violations(_metrics(spark, sf_dir), t=policy.Thresholds(max_efferent=8)))


QUERIES = {
    f.__name__: f
    for f in (
        module_coupling, module_coupling_one, most_unstable_top10, most_depended_upon_top10, isolated_modules, foundational_modules, instability_bands, edge_collapse, graph_summary_counts,
        graph_summary_full, scc_components, cycles_ranked, topological_layers, topological_layers_cyclic, blast_radius_dependents, blast_radius_dependencies, blast_radius_capped,
        blast_radius_all_paths, violations_instability, violations_efferent, violations_cycles, violations_ranked, gate_status,
    )
}

_METRIC = f"""WITH {DEPENDENCY_SQL.strip()},
metric AS (
  SELECT v.path, coalesce(i.n, 0) AS ca, coalesce(o.n, 0) AS ce,
    CASE WHEN coalesce(i.n, 0) + coalesce(o.n, 0) = 0 THEN 0.0::DOUBLE ELSE coalesce(o.n, 0) / (coalesce(i.n, 0) + coalesce(o.n, 0)) END AS instability
  FROM vertex v LEFT JOIN (SELECT target, count(*) AS n FROM edge GROUP BY 1) i ON i.target = v.path LEFT JOIN (SELECT source, count(*) AS n FROM edge GROUP BY 1) o ON o.source = v.path)
"""
_CLOSURE = f"""WITH RECURSIVE {REQUEST_EDGE_SQL.strip()},
walk AS (SELECT source AS a, target AS b FROM edge UNION SELECT w.a, e.target FROM walk w JOIN edge e ON e.source = w.b),
mutual AS (SELECT x.a AS path, x.b AS other FROM walk x JOIN walk y ON y.a = x.b AND y.b = x.a),
comp AS (SELECT path, least(path, min(other)) AS component FROM mutual GROUP BY path)
"""
_LAYERS = """,
vertex AS (SELECT source AS path FROM edge UNION SELECT target FROM edge),
named AS (SELECT v.path, coalesce(c.component, v.path) AS name FROM vertex v LEFT JOIN comp c ON c.path = v.path),
short AS (SELECT DISTINCT a.name AS a, b.name AS b FROM edge e JOIN named a ON a.path = e.source JOIN named b ON b.path = e.target WHERE a.name <> b.name),
up AS (SELECT DISTINCT name, 0 AS layer FROM named UNION SELECT s.a, u.layer + 1 FROM up u JOIN short s ON s.b = u.name),
high AS (SELECT name, max(layer) AS layer FROM up GROUP BY 1)
"""
_HUB = """,
hub AS (SELECT target AS path FROM edge GROUP BY 1 ORDER BY count(*) DESC, target LIMIT 1),
{name} AS (SELECT path, 0 AS d FROM hub UNION SELECT e.{to}, r.d + 1 FROM {name} r JOIN edge e ON e.{at} = r.path WHERE r.d < {depth}),
{name}_near AS (SELECT path, min(d) AS distance FROM {name} GROUP BY 1 HAVING min(d) > 0)
"""
_BOTH = f"WITH RECURSIVE {REQUEST_EDGE_SQL.strip()}" + _HUB.format(name="up", to="source", at="target", depth=2) + _HUB.format(name="down", to="target", at="source", depth=2).replace("hub AS (SELECT target AS path FROM edge GROUP BY 1 ORDER BY count(*) DESC, target LIMIT 1),\n", "")
_VIOLATION = """,
violation AS (
  SELECT 'instability' AS rule, 'error' AS severity, path AS subject, instability AS measured, 0.4::DOUBLE AS threshold FROM metric WHERE ca >= 3 AND instability > 0.4
  UNION ALL SELECT 'efferent', 'warning', path, ce::DOUBLE, 8.0::DOUBLE FROM metric WHERE ce > 8)
"""

SQL = {
    "module_coupling": _METRIC + "SELECT path, ca, ce, instability, ca + ce AS total_coupling FROM metric",
    "module_coupling_one": _METRIC + f"SELECT path, ca, ce, instability FROM metric WHERE path = '{ONE}'",
    "most_unstable_top10": _METRIC + "SELECT path, ca, ce, instability FROM metric WHERE ca > 0 ORDER BY instability DESC, ca DESC, path LIMIT 10",
    "most_depended_upon_top10": _METRIC + "SELECT path, ca, ce, instability FROM metric ORDER BY ca DESC, instability DESC, path LIMIT 10",
    "isolated_modules": _METRIC + "SELECT path FROM metric WHERE ca = 0 AND ce = 0",
    "foundational_modules": _METRIC + "SELECT path, ca FROM metric WHERE ca > 0 AND ce = 0",
    "instability_bands": _METRIC + "SELECT CASE WHEN instability >= 0.7 THEN 'red' WHEN instability >= 0.4 THEN 'yellow' ELSE 'green' END AS band, ca >= 3 AS decorated, count(*) AS modules FROM metric GROUP BY 1, 2",
    "edge_collapse": f"WITH {DEPENDENCY_SQL.strip()} SELECT source, target, weight, CASE WHEN imp AND inh THEN 'import,inheritance' WHEN imp THEN 'import' ELSE 'inheritance' END AS kinds FROM edge",
    "graph_summary_counts": _METRIC
    + """SELECT (SELECT count(*) FROM vertex) AS nodes, (SELECT count(*) FROM edge) AS edges, (SELECT count(*) FROM edge WHERE imp) AS import_edges,
  (SELECT count(*) FROM edge WHERE inh) AS inheritance_edges, (SELECT count(*) FROM metric WHERE ca = 0 AND ce = 0) AS isolated,
  (SELECT count(*) FROM edge) / ((SELECT count(*) FROM vertex) * ((SELECT count(*) FROM vertex) - 1)) AS density""",
    "graph_summary_full": _CLOSURE
    + _LAYERS
    + """SELECT (SELECT count(*) FROM vertex) AS nodes, (SELECT count(*) FROM edge) AS edges, (SELECT count(*) FROM edge) AS import_edges, 0::BIGINT AS inheritance_edges, 0::BIGINT AS isolated,
  (SELECT count(*) FROM edge) / ((SELECT count(*) FROM vertex) * ((SELECT count(*) FROM vertex) - 1)) AS density,
  (SELECT count(DISTINCT component) FROM comp) AS cycles, (SELECT coalesce(max(n), 0) FROM (SELECT count(*) AS n FROM comp GROUP BY component)) AS largest_cycle,
  (SELECT max(layer) + 1 FROM high)::BIGINT AS layers""",
    "scc_components": _CLOSURE + "SELECT path, component FROM comp",
    "cycles_ranked": _CLOSURE + "SELECT component, count(*) AS size, string_agg(path, ',' ORDER BY path) AS members FROM comp GROUP BY 1",
    "topological_layers": f"WITH RECURSIVE {DEPENDENCY_SQL.strip()}, up AS (SELECT path, 0 AS layer FROM vertex UNION SELECT e.source, u.layer + 1 FROM up u JOIN edge e ON e.target = u.path) SELECT path, max(layer) AS layer FROM up GROUP BY 1",
    "topological_layers_cyclic": _CLOSURE + _LAYERS + "SELECT n.path, h.layer FROM named n JOIN high h ON h.name = n.name",
    "blast_radius_dependents": f"WITH RECURSIVE {REQUEST_EDGE_SQL.strip()}" + _HUB.format(name="up", to="source", at="target", depth=2) + "SELECT path, distance FROM up_near",
    "blast_radius_dependencies": f"WITH RECURSIVE {REQUEST_EDGE_SQL.strip()}" + _HUB.format(name="down", to="target", at="source", depth=3) + "SELECT path, distance FROM down_near",
    "blast_radius_capped": _BOTH
    + """SELECT direction, path, distance, rank, total FROM (
  SELECT 'dependents' AS direction, path, distance, row_number() OVER (ORDER BY distance, path) AS rank, count(*) OVER () AS total FROM up_near) WHERE rank <= 40
UNION ALL SELECT direction, path, distance, rank, total FROM (
  SELECT 'dependencies' AS direction, path, distance, row_number() OVER (ORDER BY distance, path) AS rank, count(*) OVER () AS total FROM down_near) WHERE rank <= 20""",
    "blast_radius_all_paths": _BOTH
    + """SELECT path FROM hub UNION SELECT path FROM (SELECT path, row_number() OVER (ORDER BY distance, path) AS r FROM up_near) WHERE r <= 40
UNION SELECT path FROM (SELECT path, row_number() OVER (ORDER BY distance, path) AS r FROM down_near) WHERE r <= 20""",
    "violations_instability": _METRIC
    + "SELECT 'instability' AS rule, 'error' AS severity, path AS subject, 'Instability ' || printf('%.2f', instability) || ' exceeds 0.40 with ' || ca || ' dependents' AS message, instability AS measured, 0.4::DOUBLE AS threshold FROM metric WHERE ca >= 3 AND instability > 0.4",
    "violations_efferent": _METRIC + "SELECT 'efferent' AS rule, 'warning' AS severity, path AS subject, 'Depends on ' || ce || ' files, more than 8' AS message, ce::DOUBLE AS measured, 8.0::DOUBLE AS threshold FROM metric WHERE ce > 8",
    "violations_cycles": _CLOSURE + "SELECT 'cycle' AS rule, 'error' AS severity, component AS subject, count(*)::DOUBLE AS measured, 0.0::DOUBLE AS threshold FROM comp GROUP BY component",
    "violations_ranked": _METRIC.rstrip() + _VIOLATION + "SELECT rule, severity, subject, measured, threshold FROM violation",
    "gate_status": _METRIC.rstrip() + _VIOLATION + "SELECT count(*) FILTER (WHERE severity = 'error') AS errors, count(*) FILTER (WHERE severity = 'warning') AS warnings, count(*) FILTER (WHERE severity = 'error') = 0 AS passed FROM violation",
}
