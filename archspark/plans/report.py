"""The report of a code base: metrics, cohesion, cycles and violations, its exports and its texts."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archspark.operators import cohesion, edges, graph, metrics, policy, resolve
from archspark.schemas import KINDS
from archspark.session import durable


@dataclass
class Report:
    """The tables of one analysis; each can be written as Parquet or exported as JSON."""

    vertices: DataFrame
    edges: DataFrame
    modules: DataFrame
    classes: DataFrame
    cycles: DataFrame
    violations: DataFrame
    resolution: DataFrame
    thresholds: policy.Thresholds

    def most_unstable(self, n: int = 10) -> DataFrame:
        return metrics.most_unstable(self.modules, n)

    def most_depended_upon(self, n: int = 10) -> DataFrame:
        return metrics.most_depended_upon(self.modules, n)

    def least_cohesive(self, n: int = 10) -> DataFrame:
        return cohesion.least_cohesive(self.classes, n)

    def gate(self) -> DataFrame:
        return policy.gate(self.violations)


def build(files: DataFrame, nodes: DataFrame, thresholds: policy.Thresholds = policy.Thresholds()) -> Report:
    """The report of ``files(path)`` and ``nodes`` (with ``file_id``); shared tables are written once and read again."""
    vertices, collapsed, resolved = edges.build_graph(files, nodes)
    collapsed = durable(collapsed)
    vertices = durable(vertices)
    modules = durable(metrics.module_metrics(vertices, collapsed))
    classes = durable(cohesion.class_cohesion(nodes))
    found_cycles = durable(graph.cycles(collapsed))
    return Report(vertices, collapsed, modules, classes, found_cycles, policy.violations(modules, classes, found_cycles, thresholds), resolve.statistics(resolved), thresholds)


def _plain(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def metrics_json(report: Report) -> str:
    """The whole report as JSON, keys sorted; the report of a repository is small enough for one document."""
    summary = _plain(graph.summary(report.vertices, report.edges))[0] | _plain(report.gate())[0]
    return json.dumps(
        {
            "summary": summary,
            "thresholds": asdict(report.thresholds),
            "resolution": _plain(report.resolution)[0],
            "modules": _plain(metrics.ranked(report.modules).drop("is_isolated", "is_foundational", "total_coupling")),
            "classes": _plain(cohesion.ranked(report.classes).drop("is_cohesive", "suggested_split", "file_id", "class_id")),
            "violations": _plain(policy.ranked(report.violations)),
            "cycles": [r["members"] or [r["component"]] for r in _plain(report.cycles.orderBy(F.desc("size"), "component"))],
        },
        indent=2,
        sort_keys=True,
    )


def graph_json(report: Report) -> str:
    """Nodes and edges in a fixed order, so that equal graphs give equal bytes."""
    return json.dumps({"nodes": _plain(report.vertices.orderBy("path")), "edges": _plain(report.edges.orderBy("source", "target"))}, indent=2, sort_keys=True)


def write_tables(report: Report, folder: str) -> None:
    """One Parquet table each."""
    for name in ("vertices", "edges", "modules", "classes", "cycles", "violations", "resolution"):
        getattr(report, name).write.mode("overwrite").parquet(f"{folder.rstrip('/')}/{name}")


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """An exported report as one row."""
    return spark.read.json(path, multiLine=True)


def pull_request_comment(report: dict, errors: int = 15, warnings: int = 20) -> str:
    """Markdown of a report that was read from its JSON."""
    found = report["violations"]
    lines = ["## Architecture report", "", "Passed." if not any(v["severity"] == policy.ERROR for v in found) else "**Failed.**", ""]
    s = report["summary"]
    lines += [f"{s['nodes']} files, {s['edges']} dependencies, {s.get('cycles', 0)} cycles.", ""]
    for title, severity, most in (("Errors", policy.ERROR, errors), ("Warnings", policy.WARNING, warnings)):
        rows = [v for v in found if v["severity"] == severity]
        if rows:
            lines += [f"### {title} ({len(rows)})", "", "| Rule | Subject | Message |", "|---|---|---|"]
            lines += [f"| {v['rule']} | `{v['subject']}` | {v['message'].replace('|', chr(92) + '|')} |" for v in rows[:most]]
            lines += [f"... and {len(rows) - most} more"] * (len(rows) > most) + [""]
    return "\n".join(lines)


def table_text(rows: list[dict], columns: list[str], width: int = 60) -> str:
    """Rows as aligned text."""
    cells = [columns, *[[("%.2f" % r[c] if isinstance(r[c], float) else str(r[c]))[:width] for c in columns] for r in rows]]
    widths = [max(len(row[k]) for row in cells) for k in range(len(columns))]
    return "\n".join("  ".join(c.ljust(w) for c, w in zip(row, widths)).rstrip() for row in cells)


def tree_text(nodes: DataFrame, path: str) -> str:
    """The syntax tree of one file, a line a node, indented by depth."""
    rows = nodes.where(F.col("path") == path).orderBy("node_id").collect()
    below: dict[int, list] = {}
    for r in rows:
        below.setdefault(-1 if r["parent_index"] is None else r["parent_index"], []).append(r)
    out, stack = [], [(r, 0) for r in reversed(below.get(-1, []))]
    while stack:
        r, depth = stack.pop()
        out.append("  " * depth + f"{KINDS[r['kind']]}{' ' + r['name'] if r['name'] else ''} [{r['byte_start']}, {r['byte_end']})")
        stack += [(c, depth + 1) for c in reversed(below.get(r["node_id"], []))]
    return "\n".join(out)
