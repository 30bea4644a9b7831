"""Resolution, edges, cohesion, chunks, vectors, context, audit, snapshots, extraction and the command line."""

import io
import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from archspark import schemas as S
from archspark.operators import audit, chunk, cohesion, context, edges, resolve, vectors
from archspark.sources import extract, snapshot, tree

TREE = ["kernel/clock/wheel.hh", "kernel/clock/wheel.cc", "kernel/disk/queue.cc", "kernel/disk/block/queue.hh", "drivers/queue.hh", "drivers/wire.cxx"]
PACKAGES = ["lab/__init__.py", "lab/bench/__init__.py", "lab/bench/scale.py", "lab/bench/tare.py", "lab/notes.py", "tools/scale.py", "main.py"]


def resolved(spark, files, *imports):
    f = spark.createDataFrame([(p, k) for k, p in enumerate(files)], "path string, ordinal int")
    i = spark.createDataFrame([(str(k), *x) for k, x in enumerate(imports)], "import_id string, from_file string, raw string")
    return [(r.target, r.resolution, r.candidates) for r in resolve.resolve(f, i).orderBy("import_id").collect()]


def test_cpp_includes(spark):
    got = resolved(spark, TREE, ("kernel/clock/wheel.cc", "wheel.hh"), ("kernel/disk/queue.cc", "queue.hh"), ("drivers/wire.cxx", "block/queue.hh"), ("drivers/wire.cxx", "memory"), ("drivers/wire.cxx", ""), ("kernel/disk/queue.cc", "clock\\wheel.hh"))
    assert got == [("kernel/clock/wheel.hh", "resolved", 1), ("kernel/disk/block/queue.hh", "ambiguous", 2), ("kernel/disk/block/queue.hh", "resolved", 1), ("memory", "external", 0), ("", "external", 0), ("kernel/clock/wheel.hh", "resolved", 1)]


def test_python_imports(spark):
    got = resolved(spark, PACKAGES, ("main.py", "lab.bench.scale"), ("main.py", "lab.bench"), ("lab/bench/tare.py", ".scale"), ("lab/bench/tare.py", "..notes"), ("main.py", "json.decoder"))
    assert [x[0] for x in got] == ["lab/bench/scale.py", "lab/bench/__init__.py", "lab/bench/scale.py", "lab/notes.py", "json.decoder"]
    assert [x[1] for x in got] == ["resolved"] * 4 + ["external"]


def test_prefix_index_is_never_broadcast(spark):
    """Its rows are many a file, but are estimated as one: 40 files of 12 components have 6,240, and the driver would hold them all."""
    f = spark.createDataFrame([("/".join(f"{d}{k % (d + 2)}" for d in range(11)) + f"/{k}.hh", k) for k in range(40)], "path string, ordinal int")
    i = spark.createDataFrame([("0", "main.cc", "7.hh"), ("1", "main.cc", "none.hh")], "import_id string, from_file string, raw string")
    for found, rows in ((resolve.resolve(f, i).select("import_id", "resolution"), [("0", "resolved"), ("1", "external")]), (resolve.ambiguity(f, i), [])):
        assert sorted(tuple(r) for r in found.collect()) == rows
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin [suffix" in plan and "BroadcastHashJoin [suffix" not in plan


def nodes_of(spark, *files):
    """Nodes from (path, [(kind, name, parent)])."""
    rows = []
    for f, (path, items) in enumerate(files):
        rows += [(f, path, k, kind, name, 10 * k, 10 * k + 9, 0, 0, parent) for k, (kind, name, parent) in enumerate(items)]
    return spark.createDataFrame(rows, "file_id bigint, path string, node_id int, kind tinyint, name string, byte_start bigint, byte_end bigint, first_child_index bigint, child_count bigint, parent_index int")


def test_edges(spark):
    nodes = nodes_of(
        spark,
        ("a.py", [(S.FILE, "", -1), (S.IMPORT, "b", 0), (S.IMPORT, "b", 0), (S.IMPORT, "a", 0), (S.IMPORT, "os", 0), (S.CLASS, "A : Base,pkg.Twice,A", 0)]),
        ("b.py", [(S.FILE, "", -1), (S.CLASS, "Base", 0), (S.CLASS, "Twice", 0)]),
        ("c.py", [(S.FILE, "", -1), (S.CLASS, "Twice", 0)]),
    )
    files = nodes.select("path").distinct()
    vertices, graph, found = edges.build_graph(files, nodes)
    assert [(r.source, r.target, r.weight, r.kinds) for r in graph.collect()] == [("a.py", "b.py", 3, ["import", "inheritance"])]
    stats = resolve.statistics(found).first()
    assert (stats.resolved, stats.external, stats.total) == (3, 1, 4)
    assert {r.path: (r.node_count, r.class_count, r.import_count) for r in vertices.collect()} == {"a.py": (6, 1, 4), "b.py": (3, 2, 0), "c.py": (2, 1, 0)}


def cohesive(spark, *methods):
    """Cohesion of one class from (name, fields, calls)."""
    items = [(S.FILE, "", -1), (S.CLASS, "K", 0)]
    for name, fields, calls in methods:
        items.append((S.FUNCTION, name, 1))
        at = len(items) - 1
        items += [(S.FIELD_ACCESS, f, at) for f in fields] + [(S.CALL, c, at) for c in calls]
    r = cohesion.class_cohesion(nodes_of(spark, ("k.py", items))).first()
    return r.method_count, r.field_count, r.lcom1, r.lcom4


def test_cohesion(spark):
    assert cohesive(spark, ("a", "x", ""), ("b", "y", ""), ("c", "z", "")) == (3, 3, 3, 3)
    assert cohesive(spark, ("a", "x", ""), ("b", "x", ""), ("c", "x", "")) == (3, 1, 0, 1)
    assert cohesive(spark, ("a", ["user"], []), ("b", ["user"], []), ("c", ["smtp"], []), ("d", ["smtp"], []))[3] == 2
    assert cohesive(spark, ("run", [], ["self.do_work"]), ("do_work", ["state"], []), ("stop", ["state"], []))[3] == 1
    assert cohesive(spark, ("a", "", ""), ("b", "", ""), ("c", "", ""))[2:] == (3, 3)
    assert cohesive(spark, ("a", "a", ""), ("b", "b", ""), ("c", "c", ""), ("d", "d", ""), ("all", "abcd", "")) == (5, 4, 2, 1)
    assert cohesive(spark) == (0, 0, 0, 0) and cohesive(spark, ("one", "x", ""))[2:] == (0, 1)


def test_scopes_of_nested_classes(spark):
    items = [(S.FILE, "", -1), (S.CLASS, "A", 0), (S.FUNCTION, "m", 1), (S.CLASS, "B", 2), (S.FUNCTION, "n", 3), (S.CALL, "f", 4), (S.FUNCTION, "inner", 2)]
    rows = {(r.node_id, r.method_id) for r in cohesion.scopes(nodes_of(spark, ("a.py", items))).where("method_id is not null").collect()}
    assert rows == {(5, 4), (5, 2)}
    home = {r.node_id: r.enclosing_class for r in cohesion.enclosing_classes(nodes_of(spark, ("a.py", items))).collect()}
    assert home[5] == "B" and home[6] == "A" and home[1] is None


def test_chunks(spark):
    body = "class É:\n    def run(self):\n        return '" + "x" * 80 + "'\n"
    raw = body.encode()
    start = raw.index(b"def")
    row = [(0, "a.py", 0, S.FILE, "", 0, len(raw), 1, 1, -1), (0, "a.py", 1, S.CLASS, "É", 0, len(raw), 2, 1, 0), (0, "a.py", 2, S.FUNCTION, "run", start, len(raw), 0, 0, 1)]
    nodes = spark.createDataFrame(row + row[-1:], nodes_of(spark, ("z", [(0, "", -1)])).schema)
    files = spark.createDataFrame([(0, "a.py", body)], "file_id bigint, path string, content string")
    got = chunk.chunk(nodes, files).collect()
    assert [(c.qualified_name, c.kind, c.line_start, c.line_end, c.text) for c in got] == [("É.run", "function", 2, 4, raw[start:].decode())]
    assert chunk.unreadable(nodes, files.where("false")).count() == 1
    with pytest.raises(ValueError):
        chunk.ChunkingConfig(0, 10)


def test_hash_embedder_and_search(spark, tmp_path):
    e = vectors.HashEmbedder(64)
    a, zero = e.embed(["read the file", ""])
    assert math.isclose(sum(x * x for x in a), 1.0) and not any(zero) and e.embed(["Read THE file"])[0] == a
    store = vectors.VectorStore(spark, f"file://{tmp_path}/index", e.name, 64)
    rows = spark.createDataFrame([(f"p{k}", p, t) for k, (p, t) in enumerate([("a.py", "read the file"), ("b.py", "write a graph"), ("c.py", "read a graph")])], "point_id string, path string, text string")
    store.upsert(vectors.embed(rows, e, "text"))
    store.upsert(vectors.embed(rows.where("path = 'a.py'"), e, "text"))
    assert store.count() == 3
    q = e.embed(["read the file"])[0]
    assert store.search(q, limit=1).first().path == "a.py"
    assert store.search(q, paths=[]).count() == 0 and store.search(q).count() == 3 and store.search(q, paths=["b.py"]).count() == 1
    assert store.search(q, min_score=0.99).count() == 1
    store.delete_paths(["a.py"])
    store.delete_paths([])
    assert store.count() == 2
    with pytest.raises(ValueError):
        vectors.VectorStore(spark, f"file://{tmp_path}/index", "other", 64).points()
    with pytest.raises(ValueError):
        store.upsert(vectors.embed(rows, vectors.HashEmbedder(8), "text"))


def test_search_of_every_query(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 7)
    rng = random.Random(5)
    made = [(k, f"p{k % 3}", [rng.randint(-3, 3) / 7 for _ in range(8)]) for k in range(200)]
    made += [(200 + k, "p0", made[k][2]) for k in range(40)] + [(300, "p1", None), (301, "p1", [1.0, 2.0])]
    points = spark.createDataFrame(made, "point_id long, path string, vector array<float>")
    asked = points.where("point_id % 20 = 0").select(F.col("point_id").alias("query_id"), "vector")
    whole = [r for r in points.collect() if r.vector and len(r.vector) == 8]

    def brute(limit, paths, least):
        out = []
        for q in (r for r in whole if r.point_id % 20 == 0):
            scored = []
            for r in whole:
                s = 0.0
                for x, y in zip(q.vector, r.vector):
                    s += x * y
                scored.append((-s, r.point_id, r.path))
            scored = sorted(x for x in scored if (not paths or x[2] in paths) and (not least or -x[0] >= least))[:limit]
            out += [(q.point_id, i, p, -s, k + 1) for k, (s, i, p) in enumerate(scored)]
        return sorted(out)

    for limit, paths, least in ((3, None, 0.0), (10, ["p1"], 0.0), (50, None, 0.4), (500, None, 0.0)):
        scope = spark.createDataFrame([(p,) for p in paths], "path string") if paths else None
        got = vectors.search_all(points, asked, limit, scope, least).select("query_id", "point_id", "path", "score", "rank").collect()
        assert sorted(map(tuple, got)) == brute(limit, paths, least)
    assert vectors.search_all(points, asked.limit(0)).count() == 0 and vectors.search_all(points.limit(0), asked).count() == 0


def test_budget(spark):
    items = [(1, [(f"fn{k}", 100) for k in range(10)] + [("big", 50_000)])]
    df = spark.createDataFrame(items, "k int, items array<struct<id:string,size:int>>")
    fit = lambda *b: df.select(context.first_fit(df["items"], context.ContextBudget(*b)).alias("x")).first().x
    assert fit(120_000, 6_000, 3).dropped == [f"fn{k}" for k in range(3, 10)] + ["big"]
    assert fit(350, 100, 25).kept == ["fn0", "fn1", "fn2"]
    assert "big" in fit(120_000, 6_000, 25).kept
    with pytest.raises(ValueError):
        context.ContextBudget(100, 1_000)


def test_audit(spark, tmp_path):
    log = audit.AuditLog(spark, f"{tmp_path}/audit")
    assert log.read().count() == 0
    assert [log.record(target="a.py", request="r", model="m"), log.record(target="b.py", request="r", model="m", error="boom")] == [1, 2]
    rows = log.read()
    assert audit.get(rows, 2).first().error == "boom" and audit.get(rows, 9).count() == 0
    assert [r.id for r in audit.recent(rows).collect()] == [2, 1] and audit.for_target(rows, "a.py").count() == 1 and audit.failures(rows).count() == 1
    with pytest.raises(ValueError):
        log.record(nothing=1)


RECORD = ("src/é.cpp", [(0, "", 0, 50, 1, 1, -1), (1, "K : B", 5, 40, 2, 1, 0), (2, "run", 9, 30, 0, 0, 1)])


def packed(*records):
    f = io.BytesIO()
    snapshot.encode(records, f)
    return f.getvalue()


def test_snapshot_errors():
    good = packed(RECORD)
    assert [(r[1], *r[3:]) for r in snapshot.decode(io.BytesIO(good))] == [(RECORD[0], *n) for n in RECORD[1]]
    assert list(snapshot.decode(io.BytesIO(packed()))) == [] and list(snapshot.decode(io.BytesIO(packed(("a", []))))) == []
    with pytest.raises(snapshot.InvalidMagicError):
        list(snapshot.decode(io.BytesIO(b"NOPE" + good[4:])))
    with pytest.raises(snapshot.UnsupportedSchemaVersionError):
        list(snapshot.decode(io.BytesIO(good[:4] + struct.pack("<I", 1) + good[8:])))
    for cut in (3, 10, len(good) - 3):
        with pytest.raises(snapshot.SnapshotError):
            list(snapshot.decode(io.BytesIO(good[:cut])))
    with pytest.raises(snapshot.SnapshotError):
        list(snapshot.decode(io.BytesIO(packed(("a", [(9, "", 0, 0, 0, 0, -1)])))))
    with pytest.raises(snapshot.SnapshotError):
        list(snapshot.decode(io.BytesIO(good[:12] + struct.pack("<I", 1 << 30))))


def test_snapshot_round_trip(spark, tmp_path):
    nodes = nodes_of(spark, ("a.py", [(S.FILE, "", -1), (S.CLASS, "Ä", 0)]), ("b.py", [(S.FILE, "", -1)]))
    assert snapshot.write(nodes, str(tmp_path / "s"), 2) == 2
    back = snapshot.read(spark, str(tmp_path / "s"))
    columns = ["path", "node_id", "kind", "name", "byte_start", "byte_end", "parent_index"]
    assert sorted(map(tuple, back.select(columns).collect())) == sorted(map(tuple, nodes.select(columns).collect()))


SOURCE = '''import os
from . import x
from pkg.io import reader

class Worker(Base, pkg.Other):
    def run(self, items):
        self.state = helper(items)
        return self.finish()
'''
CPP_SOURCE = """#include <vector>
#include "core/engine.hpp"
using std::string;
namespace n {
class Reader : public Base<int, T>, private Other {
public:
    int read(const std::vector<int>& x) { for (auto y : x) { this->count_ += f(y); } return 0; }
    int count_ = 0;
};
long free_function(int a) { return g(a); }
}
"""


def kinds(tree_):
    out = {}
    for k, name, *_ in extract.layout(tree_):
        if name:
            out.setdefault(k, []).append(name)
    return out


def test_extract():
    py = kinds(extract.extract_python(SOURCE.encode()))
    assert py[S.IMPORT] == ["os", ".", "pkg.io"] and py[S.CLASS] == ["Worker : Base,pkg.Other"] and py[S.FUNCTION] == ["run"]
    assert sorted(py[S.FIELD_ACCESS]) == ["finish", "state"] and sorted(py[S.CALL]) == ["helper", "self.finish"]
    broken = kinds(extract.extract_python(SOURCE.encode() + b"\ndef broken(:\n"))
    assert broken[S.CLASS] == ["Worker : Base,pkg.Other"] and "broken" in broken[S.FUNCTION]
    cc = kinds(extract.extract_cpp(CPP_SOURCE.encode()))
    assert cc[S.IMPORT] == ["vector", "core/engine.hpp", "std::string"] and cc[S.CLASS] == ["Reader : Base<int,T>,Other"]
    assert cc[S.FUNCTION] == ["free_function", "read"] or cc[S.FUNCTION] == ["read", "free_function"]
    assert cc[S.FIELD_ACCESS] == ["count_"] and sorted(cc[S.CALL]) == ["f", "g"]
    for source in (b"", b"   \n", b"\xff\xfe{{{"):
        for f in (extract.extract_python, extract.extract_cpp):
            rows = extract.layout(f(source))
            assert rows[0][0] == S.FILE and all(p < k for k, (*_, p) in enumerate(rows))


def test_walk_and_cli(spark, tmp_path, capsys):
    from archspark import cli

    root = tmp_path / "repo"
    for name, text in {"a.py": "import b\nclass A(B):\n    pass\n", "b.py": "import a\nclass B:\n    def f(self):\n        return '" + "y" * 90 + "'\n", ".git/x.py": "", "build/y.py": "", "sub/.hidden.py": "", "n.txt": ""}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    assert tree.walk(str(root)) == ["a.py", "b.py", "sub/.hidden.py"]
    assert {r.path for r in tree.read_anywhere(spark, str(root)).collect()} == {"a.py", "b.py"}  # Hadoop hides dot files
    out = str(tmp_path / "snap")
    assert cli.main(["sample", "run", str(root), "--output", out, "--quiet"]) == 0
    assert cli.main(["tune", "run", out, "--export-metrics", str(tmp_path / "m.json"), "--export-graph", str(tmp_path / "g.json")]) == 0
    assert cli.main(["tune", "run", out, "--fail-on-instability"]) == 1
    assert cli.main(["tune", "cycles", out]) == 0
    assert "2 files: a.py -> b.py" in capsys.readouterr().out
    store = ["--store", str(tmp_path / "v")]
    assert cli.main(["master", "index", out, "--repo-root", str(root), *store]) == 0
    assert cli.main(["master", "search", "return y", *store]) == 0
    assert "b.py:3-4 B.f" in capsys.readouterr().out
    assert cli.main(["master", "refactor", out, "b.py", "split f", "--audit-db", str(tmp_path / "audit"), *store]) == 0
    assert cli.main(["master", "refactor", out, "nowhere.py", "x", "--no-audit", *store]) == 2
    assert cli.main(["master", "audit", "--audit-db", str(tmp_path / "audit")]) == 0
    assert "b.py dry-run ok" in capsys.readouterr().out
    assert cli.main(["tune", "run", str(tmp_path / "missing")]) == 2 and cli.main([]) == 0
    import json

    from archspark.plans.report import pull_request_comment

    text = pull_request_comment(json.loads((tmp_path / "m.json").read_text()))
    assert "Failed" in text and "cycle" in text


def test_index_reports_every_unreadable_file(spark, tmp_path):
    from archspark.plans import pipeline

    schema = "file_id bigint, path string, node_id int, parent_index int, first_child_index bigint, child_count bigint, kind int, name string, byte_start bigint, byte_end bigint"
    nodes = spark.createDataFrame([(k, f"f{k:04d}.py", 0, -1, None, None, S.FILE, "", 0, 10) for k in range(1203)], schema)
    files = spark.createDataFrame([(k, f"f{k:04d}.py", "x = 1\n" if k < 2 else None) for k in range(1203)], "file_id bigint, path string, content string")
    e = vectors.HashEmbedder(8)
    store = vectors.VectorStore(spark, f"file://{tmp_path}/index", e.name, 8)
    done = pipeline.index_snapshot(nodes, files, spark.createDataFrame([], "path string, ca int, ce int, instability double"), store, e)
    assert done.unreadable_count == 1201 and sorted(r.path for r in done.unreadable.collect()) == [f"f{k:04d}.py" for k in range(2, 1203)]
    assert done.unreadable_line() == "1201 unreadable: f0002.py, f0003.py, f0004.py (and 1198 more)"


def test_arena(spark):
    from archspark.operators import arena

    schema = "file_id bigint, node_id int, parent_index int, first_child_index bigint, child_count bigint, byte_start bigint, byte_end bigint"
    good = [(1, 0, -1, 1, 2, 0, 90), (1, 1, 0, 0, 0, 0, 10), (1, 2, 0, 3, 1, 10, 90), (1, 3, 2, 0, 0, 20, 30)]
    bad = [(2, 0, -1, 1, 1, 0, 50), (2, 1, None, 0, 0, 5, 4), (2, 2, 9, 0, 0, 0, 1), (2, 3, 0, 0, 0, 0, 60), (2, 4, -1, 10**12, 5, 0, 1)]
    df = spark.createDataFrame(good + bad + good[:1], schema)
    assert {(r.node_id, r.child_id) for r in arena.children(df.where("file_id = 1")).collect()} == {(0, 1), (0, 2), (2, 3)}
    assert [(r.node_id, r.depth) for r in arena.walk(df.where("file_id = 1")).orderBy("position").collect()] == [(0, 0), (1, 1), (2, 1), (3, 2)]
    assert {(r.file_id, r.node_id, r.rule) for r in arena.violations(df).collect()} == {(2, 1, "parent"), (2, 1, "bounds"), (2, 0, "children"), (2, 2, "parent"), (2, 3, "nesting"), (2, 4, "root")}
