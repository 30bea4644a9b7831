"""Graph operators, metrics and policy on small graphs with known answers."""

import random

import pytest
from pyspark.sql import functions as F

from archspark.functions.names import base_types, instability, last_of_call, last_of_type, own_name, shared_prefix, suffixes
from archspark.operators import graph, metrics, policy


def table(spark, *pairs, alone=()):
    edges = spark.createDataFrame([(*p, 1, ["import"]) for p in pairs], "source string, target string, weight bigint, kinds array<string>")
    names = sorted({x for p in pairs for x in p} | set(alone))
    return spark.createDataFrame([(n,) for n in names], "path string"), edges


def test_instability(spark):
    rng = random.Random(17)
    pairs = [(rng.randrange(40), rng.randrange(40)) for _ in range(30)] + [(0, 0)]
    cases = [((a, e), e / (a + e) if a + e else 0) for a, e in pairs]
    df = spark.createDataFrame([(a, b) for (a, b), _ in cases], "ca int, ce int")
    assert [r[0] for r in df.select(instability(F.col("ca"), F.col("ce"))).collect()] == [x for _, x in cases]


def test_layered_metrics(spark):
    m = {r.path: (r.ca, r.ce, r.instability) for r in metrics.module_metrics(*table(spark, ("app", "service"), ("app", "util"), ("service", "util"))).collect()}
    assert m == {"util": (2, 0, 0.0), "service": (1, 1, 0.5), "app": (0, 2, 1.0)}
    with pytest.raises(KeyError):
        metrics.one_module(*table(spark, ("a", "b")), "nowhere")


def test_collapse(spark):
    d = spark.createDataFrame([("a", "b", "import"), ("a", "b", "inheritance"), ("a", "b", "import"), ("b", "c", "import")], "source string, target string, kind string")
    assert {(r.source, r.target): (r.weight, r.kinds) for r in graph.collapse(d).collect()} == {("a", "b"): (3, ["import", "inheritance"]), ("b", "c"): (1, ["import"])}


def test_cycles(spark):
    _, edges = table(spark, ("a", "b"), ("b", "c"), ("c", "a"), ("x", "y"), ("y", "x"), ("c", "x"), ("s", "s"), ("d", "a"))
    assert [(r.component, r["size"], r.members) for r in graph.cycles(edges).collect()] == [("a", 3, ["a", "b", "c"]), ("x", 2, ["x", "y"]), ("s", 1, ["s"])]
    assert graph.cycles(table(spark, ("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"))[1]).count() == 0


def layer_map(df):
    return {r.path: r.layer for r in df.collect()}


def test_layers(spark):
    assert layer_map(graph.layers(*table(spark, ("a", "b"), ("b", "c")))) == {"c": 0, "b": 1, "a": 2}
    assert layer_map(graph.layers(*table(spark, ("a", "base"), ("b", "base")))) == {"base": 0, "a": 1, "b": 1}
    assert layer_map(graph.layers(*table(spark, ("a", "b"), ("b", "c"), ("c", "a"), ("t", "a"), alone=["lonely"]))) == {"a": 0, "b": 0, "c": 0, "t": 1, "lonely": 0}


def test_radius(spark):
    vertices, edges = table(spark, ("app", "service"), ("cli", "service"), ("service", "core"), ("core", "util"))
    r = graph.blast_radius(vertices, edges, "service").collect()
    side = lambda d: [x.path for x in sorted(r, key=lambda x: x["rank"]) if x.direction == d]
    assert side("dependencies") == ["core", "util"] and side("dependents") == ["app", "cli"]
    assert graph.reach(edges, "util", 5, True).count() == 4
    with pytest.raises(KeyError):
        graph.blast_radius(vertices, edges, "nowhere")
    with pytest.raises(ValueError):
        graph.blast_radius(vertices, edges, "util", depth=0)
    many = table(spark, *[(f"d{k:03}", "hub") for k in range(100)])
    top = graph.blast_radius(*many, "hub", max_dependents=10).collect()
    assert len(top) == 10 and {x.total for x in top} == {100} and top[0].path.startswith("d00")


def test_policy(spark):
    hub = table(spark, *[(f"u{k}", "hub") for k in range(4)], *[("hub", f"l{k}") for k in range(6)])
    v = policy.instability_violations(metrics.module_metrics(*hub)).collect()
    assert [(x.subject, x.severity, x.measured) for x in v] == [("hub", "error", 0.6)]
    low = table(spark, *[(f"u{k}", "hub") for k in range(2)], *[("hub", f"l{k}") for k in range(8)])
    assert policy.instability_violations(metrics.module_metrics(*low)).count() == 0
    both = table(spark, ("a", "b"), ("b", "a"), *[("app", f"x{k}") for k in range(25)])
    found = policy.violations(metrics.module_metrics(*both), cycles=graph.cycles(both[1]))
    assert [x.rule for x in policy.ranked(found).collect()] == ["cycle", "efferent"]
    assert policy.gate(found).first().asDict() == {"errors": 1, "warnings": 1, "passed": False}
    easy = policy.cycle_violations(graph.cycles(both[1]), policy.Thresholds(fail_on_cycles=False))
    assert policy.gate(easy).first().passed


def test_names(spark):
    df = spark.createDataFrame([("Own : a::Base , pkg.Other,", "a/b/c.py", "a/b/d.py")], "n string, p string, q string")
    r = df.select(own_name(F.col("n")), base_types(F.col("n")), suffixes(F.col("p")), shared_prefix(F.col("p"), F.col("q")), last_of_type(F.lit("x::y.Z")), last_of_call(F.lit("self.a.run"))).first()
    assert tuple(r) == ("Own", ["a::Base", "pkg.Other"], ["a/b/c.py", "b/c.py", "c.py"], 2, "Z", "run")


def test_impact_count(spark):
    many = table(spark, *[(f"d{k:03}", "hub") for k in range(30)])
    r = graph.impact_count(graph.blast_radius(*many, "hub", max_dependents=10)).first()
    assert (r.reachable, r.kept, r.truncated) == (30, 10, True)


def brute_components(pairs):
    names = sorted({x for p in pairs for x in p})
    ahead = {n: {n} for n in names}
    for _ in names:
        for a, b in pairs:
            ahead[a] |= ahead[b]
    return {n: min(m for m in names if m in ahead[n] and n in ahead[m]) for n in names}, ahead


def test_one_task_and_rounds_agree_with_brute_force(spark):
    rng = random.Random(8)
    for size, links in ((7, 9), (12, 16), (25, 30)):
        pairs = sorted({(f"v{rng.randrange(size):02}", f"v{rng.randrange(size):02}") for _ in range(links)})
        name, _ = brute_components(pairs)
        vertices, edges = table(spark, *pairs, alone=("zz",))
        loops = {a for a, b in pairs if a == b}
        sizes = {c: sum(x == c for x in name.values()) for c in name.values()}
        expected = {(v, c) for v, c in name.items() if sizes[c] > 1} | {(v, v) for v in loops if sizes[name[v]] == 1}
        condensed = {(name[a], name[b]) for a, b in pairs if name[a] != name[b]}
        level = dict.fromkeys(name.values(), 0)
        for _ in level:
            for a, b in condensed:
                level[a] = max(level[a], level[b] + 1)
        for task_edges in (graph.TASK_EDGES, 0):
            assert {(r.path, r.component) for r in graph.strong_components(edges, task_edges).collect()} == expected
            assert {r.path: r.layer for r in graph.layers(vertices, edges, task_edges).collect()} == {v: level[c] for v, c in name.items()} | {"zz": 0}


def test_long_rings_and_chains(spark):
    n = 20_000
    ring = spark.range(n).select(F.format_string("r%06d", "id").alias("source"), F.format_string("r%06d", (F.col("id") + 1) % n).alias("target"))
    found = graph.strong_components(ring).groupBy("component").count().collect()
    assert [(r.component, r["count"]) for r in found] == [("r000000", n)]
    chain = ring.where("target <> 'r000000'")
    assert graph.layers(graph.vertices_of(chain), chain).agg(F.max("layer"), F.count("*")).first() == (n - 1, n)
