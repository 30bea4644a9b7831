"""Command line: ``python -m archspark.cli sample|tune|master ...``.

Exit codes: 0 clean, 1 violations or failed reasoning, 2 could not run.
"""

from __future__ import annotations

import argparse
import os
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archspark import __version__
from archspark.operators import graph, policy, vectors
from archspark.operators.audit import AuditLog
from archspark.plans import pipeline, report
from archspark.sources import extract, snapshot, tree


def _spark() -> SparkSession:
    return SparkSession.builder.appName("archspark").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def with_ids(nodes: DataFrame) -> DataFrame:
    """Nodes with the file id the operators key by (a hash of the path)."""
    return nodes.withColumn("file_id", F.xxhash64("path"))


def _load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    nodes = with_ids(snapshot.read(spark, path)).cache()
    files = nodes.groupBy("path").agg(F.min("file_ordinal").alias("ordinal"))
    return files, nodes


def sample_run(a: argparse.Namespace) -> int:
    spark = _spark()
    began = time.time()
    nodes = extract.extract(tree.read(spark, a.path)).cache()
    failed = nodes.where("error is not null").count()
    os.makedirs(a.output, exist_ok=True)
    n = snapshot.write(nodes.where("error is null"), a.output)
    if not a.quiet:
        total = nodes.where("error is null").count()
        seconds = time.time() - began
        print(f"{n} files, {total} nodes, {failed} failed, {seconds:.2f} s, {n / seconds:.1f} files/s")
    return 0


def sample_benchmark(a: argparse.Namespace) -> int:
    spark = _spark()
    for name, parts in (("one task", 1), ("all cores", spark.sparkContext.defaultParallelism)):
        began = time.time()
        row = extract.extract(tree.read(spark, a.path).repartition(parts)).agg(F.count("node_id").alias("nodes"), F.count_distinct("path").alias("files"), F.count("error").alias("failed")).first()
        seconds = time.time() - began
        print(f"{name}: {row['files']} files, {row['nodes']} nodes, {row['failed']} failed, {seconds:.2f} s, {row['files'] / seconds:.1f} files/s")
    return 0


def tune_run(a: argparse.Namespace) -> int:
    spark = _spark()
    files, nodes = _load(spark, a.snapshot)
    thresholds = policy.Thresholds(max_instability=a.max_instability, min_afferent=a.min_afferent)
    made = report.build(files, nodes, thresholds)
    for title, df, columns in (
        ("Most unstable", made.most_unstable(a.top), ["path", "ca", "ce", "instability"]),
        ("Most depended upon", made.most_depended_upon(a.top), ["path", "ca", "ce", "instability"]),
        ("Least cohesive", made.least_cohesive(a.top), ["path", "class_name", "method_count", "lcom4"]),
        ("Violations", policy.ranked(made.violations).limit(15), ["severity", "rule", "subject", "message"]),
    ):
        rows = [r.asDict() for r in df.collect()]
        print(f"\n{title}\n" + (report.table_text(rows, columns) if rows else "none"))
    if a.show_layers:
        for r in graph.layers(made.vertices, made.edges).groupBy("layer").agg(F.count("*").alias("files")).orderBy("layer").limit(10).collect():
            print(f"layer {r['layer']}: {r['files']} files")
    for target, text in ((a.export_metrics, report.metrics_json), (a.export_graph, report.graph_json)):
        if target:
            os.makedirs(os.path.dirname(os.path.abspath(target)), exist_ok=True)
            with open(target, "w", encoding="utf-8") as f:
                f.write(text(made))
    gate = made.gate().first()
    print(f"\n{gate['errors']} errors, {gate['warnings']} warnings")
    return int(a.fail_on_instability and gate["errors"] > 0)


def tune_cycles(a: argparse.Namespace) -> int:
    spark = _spark()
    files, nodes = _load(spark, a.snapshot)
    made = report.build(files, nodes)
    rows = made.cycles.orderBy(F.desc("size"), "component").limit(a.limit).collect()
    for r in rows:
        members = r["members"] or [r["component"]]  # components beyond the bound of a listed one go by their least member
        print(f"{r['size']} files: " + " -> ".join(members[:8]) + (" ..." if r["size"] > 8 else ""))
    return 0


def _store(spark: SparkSession, a: argparse.Namespace) -> tuple[vectors.VectorStore, vectors.Embedder]:
    embedder = vectors.HashEmbedder(384)
    return vectors.VectorStore(spark, os.path.join(os.path.abspath(a.store), a.collection), embedder.name, embedder.dimensions), embedder


def master_index(a: argparse.Namespace) -> int:
    spark = _spark()
    files, nodes = _load(spark, a.snapshot)
    sources = tree.read(spark, a.repo_root).withColumn("file_id", F.xxhash64("path")).select("file_id", "path", "content")
    made = report.build(files, nodes)
    store, embedder = _store(spark, a)
    if a.recreate:
        store.write(store.points().limit(0)) if store.version() else None
    done = pipeline.index_snapshot(nodes, sources, made.modules, store, embedder)
    print(f"{done.chunks} chunks of {done.files} files with {done.embedder}; {done.unreadable_line()}")
    return 0


def master_search(a: argparse.Namespace) -> int:
    store, embedder = _store(_spark(), a)
    for r in pipeline.search_code(store, embedder, a.query, a.limit, a.path or None).orderBy("rank").collect():
        first = "\n    ".join(line[:78] for line in r["text"].splitlines()[:2])
        print(f"{r['rank']}. {r['score']:.3f} {r['citation']} {r['qualified_name']}\n    {first}")
    return 0


def master_refactor(a: argparse.Namespace) -> int:
    spark = _spark()
    files, nodes = _load(spark, a.snapshot)
    made = report.build(files, nodes)
    store, embedder = _store(spark, a)
    audit = None if a.no_audit else AuditLog(spark, os.path.abspath(a.audit_db))
    done = pipeline.run_refactor(made.vertices, made.edges, store, embedder, a.target, a.request, audit=audit, depth=a.depth, limit=a.limit)
    print("\n".join(done.summary_lines()))
    if a.show_prompt:
        print(done.context.prompt)
    print(done.reasoning.text or done.reasoning.error)
    return int(done.reasoning.error is not None)


def master_audit(a: argparse.Namespace) -> int:
    from archspark.operators import audit as queries

    log = AuditLog(_spark(), os.path.abspath(a.audit_db)).read()
    rows = queries.get(log, a.record_id) if a.record_id is not None else queries.failures(log, a.limit) if a.failures else queries.for_target(log, a.target, a.limit) if a.target else queries.recent(log, a.limit)
    for r in rows.collect():
        print(f"{r['id']} {(r['created_at'] or '')[:19]} {r['target']} {r['model']} {r['error'] or 'ok'}")
        if a.show_prompt:
            print(r["prompt"])
    return 0


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="archspark", description="Software architecture, measured on Spark.")
    groups = top.add_subparsers(dest="group")
    groups.add_parser("version").set_defaults(run=lambda a: print(__version__) or 0)
    sample = groups.add_parser("sample", help="source tree to snapshots").add_subparsers(dest="command")
    p = sample.add_parser("run")
    p.add_argument("path")
    p.add_argument("--output", default="snapshots")
    p.add_argument("--quiet", action="store_true")
    p.set_defaults(run=sample_run)
    p = sample.add_parser("benchmark")
    p.add_argument("path")
    p.set_defaults(run=sample_benchmark)
    tune = groups.add_parser("tune", help="snapshots to metrics and gate").add_subparsers(dest="command")
    p = tune.add_parser("run")
    p.add_argument("snapshot")
    p.add_argument("--top", type=int, default=10)
    p.add_argument("--max-instability", type=float, default=0.4)
    p.add_argument("--min-afferent", type=int, default=3)
    p.add_argument("--fail-on-instability", action="store_true")
    p.add_argument("--export-metrics")
    p.add_argument("--export-graph")
    p.add_argument("--show-layers", action="store_true")
    p.set_defaults(run=tune_run)
    p = tune.add_parser("cycles")
    p.add_argument("snapshot")
    p.add_argument("--limit", type=int, default=10)
    p.set_defaults(run=tune_cycles)
    master = groups.add_parser("master", help="index, search, requests, audit").add_subparsers(dest="command")

    def common(p: argparse.ArgumentParser) -> argparse.ArgumentParser:
        p.add_argument("--store", default="vectors")
        p.add_argument("--collection", default="code")
        return p

    p = common(master.add_parser("index"))
    p.add_argument("snapshot")
    p.add_argument("--repo-root", default=".")
    p.add_argument("--recreate", action="store_true")
    p.set_defaults(run=master_index)
    p = common(master.add_parser("search"))
    p.add_argument("query")
    p.add_argument("--limit", type=int, default=10)
    p.add_argument("--path", action="append")
    p.set_defaults(run=master_search)
    p = common(master.add_parser("refactor"))
    p.add_argument("snapshot")
    p.add_argument("target")
    p.add_argument("request")
    p.add_argument("--depth", type=int, default=2)
    p.add_argument("--limit", type=int, default=15)
    p.add_argument("--show-prompt", action="store_true")
    p.add_argument("--audit-db", default="audit")
    p.add_argument("--no-audit", action="store_true")
    p.set_defaults(run=master_refactor)
    p = master.add_parser("audit")
    p.add_argument("--audit-db", default="audit")
    p.add_argument("--record-id", type=int)
    p.add_argument("--target")
    p.add_argument("--failures", action="store_true")
    p.add_argument("--limit", type=int, default=20)
    p.add_argument("--show-prompt", action="store_true")
    p.set_defaults(run=master_audit)
    return top


def main(argv: list[str] | None = None) -> int:
    top = parser()
    a = top.parse_args(argv)
    if not hasattr(a, "run"):
        top.print_help()
        return 0
    try:
        return a.run(a)
    except (OSError, LookupError, ValueError) as e:
        print(f"could not run: {e}", file=sys.stderr)
        return 2
    except Exception as e:  # a failed Spark job
        print(f"could not run: {type(e).__name__}: {str(e).splitlines()[0]}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
