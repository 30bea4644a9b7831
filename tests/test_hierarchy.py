"""Hierarchies against brute force, on both ways."""

import random

import pytest

from archspark.operators import hierarchy as hierarchy_module

from archspark.operators.hierarchy import descendants_of, hierarchy

SCHEMA = "file_id bigint, node_id int, parent_index int, first_child_index bigint, child_count bigint"


def brute(rows):
    best = {}
    for f, n, p, a, c in rows:
        if f is not None and n is not None:
            key = (p is None, p if p is not None else 0, a if a is not None else 0, c if c is not None else 0)
            if (f, n) not in best or key < best[f, n][0]:
                best[f, n] = (key, (p, a, c))
    node = {k: v[1] for k, v in best.items()}
    parent = {}
    for (f, n), (p, _, _) in node.items():
        if p is None:
            owners = [m for (g, m), (_, a, c) in node.items() if g == f and a is not None and c and c > 0 and a <= n < a + c]
            p = min(owners) if owners else -1
        parent[f, n] = None if p < 0 else (f, p)
    out = {}
    for k in node:
        seen, at = [], k
        while at is not None and at in node and at not in seen:
            seen.append(at)
            at = parent[at]
        if at is None:
            out[k] = ("ok", len(seen) - 1, seen[-1][1], "/".join(str(x[1]) for x in reversed(seen)))
        elif at in seen:
            out[k] = ("in_cycle" if at == k else "below_cycle", None, None, None)
        else:
            out[k] = ("orphaned", None, None, None)
    below = {k: 0 for k in node}
    for k in node:
        at, seen = parent[k], set()
        if out[k][0] == "in_cycle":
            continue
        while at is not None and at in node and at not in seen and out[at][0] != "in_cycle":
            below[at] += 1
            seen.add(at)
            at = parent[at]
    return {k: (*v, None if v[0] == "in_cycle" else below[k]) for k, v in out.items()}


def found(df):
    return {(r.file_id, r.node_id): (r.state, r.depth, r.root_id, r.path, r.descendants) for r in df.collect()}


def forest(seed, files=6, n=40):
    rng = random.Random(seed)
    rows = []
    for f in range(files):
        for k in range(n):
            p = rng.choice([-1, None, k, k + 1, 99]) if rng.random() < 0.2 else (rng.randrange(k) if k else -1)
            rows.append((f, k, p, rng.randrange(n) if rng.random() < 0.5 else None, rng.randrange(4)))
    rows += rng.sample(rows, 30)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("limit", [10_000, 5])
def test_like_brute_force(spark, seed, limit):
    rows = forest(seed)
    got = found(hierarchy(spark.createDataFrame(rows, SCHEMA), max_tree_rows=limit))
    assert got == brute(rows)


def test_large_tree_with_a_cycle_writes_no_endless_paths(spark, monkeypatch):
    from archspark.operators import hierarchy as module

    rows = [(1, k, k - 1, None, None) for k in range(6)] + [(1, 10, 11, None, None), (1, 11, 10, None, None)] + [(1, k, 10, None, None) for k in range(12, 90)] + [(1, 95, 99, None, None)]
    written, durable = [], module.durable

    def spy(df):
        out = durable(df)
        if "path" in out.columns:
            written.extend(len(r.path) for r in out.where("path is not null").collect())
        return out

    monkeypatch.setattr(module, "durable", spy)
    assert found(hierarchy(spark.createDataFrame(rows, SCHEMA), max_tree_rows=5)) == brute(rows)
    assert written and max(written) <= len("0/1/2/3/4/5")


def test_deep_chain_and_wide_star(spark):
    chain = [(1, k, k - 1, None, None) for k in range(3000)]
    star = [(2, k, -1 if k == 0 else 0, None, None) for k in range(3000)]
    got = {(r.file_id, r.node_id): r for r in hierarchy(spark.createDataFrame(chain + star, SCHEMA), with_paths=False).collect()}
    assert got[1, 2999].depth == 2999 and got[1, 0].descendants == 2999 and got[2, 0].descendants == 2999 and got[2, 7].depth == 1


def test_empty_null_and_clashing_columns(spark):
    assert hierarchy(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(None, 1, -1, None, None), (1, None, -1, None, None), (1, 0, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as depth", "'x' as state", "'y' as path")
    assert found(hierarchy(df)) == {(1, 0): ("ok", 0, 0, "0", 0)}


def test_descendants(spark):
    rows = [(1, 0, -1, None, None), (1, 1, 0, None, None), (1, 2, 1, None, None), (1, 3, 0, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    pairs = descendants_of(hierarchy(df), spark.createDataFrame([(1, 0), (1, 1)], "file_id bigint, node_id int"))
    assert {(r.ancestor_id, r.node_id) for r in pairs.collect()} == {(0, 1), (0, 2), (0, 3), (1, 2)}


def test_paths_of_a_long_chain_come_in_bounded_batches():
    import numpy as np

    n = 6000
    node = np.arange(n)
    seen, largest = 0, 0
    for rows, paths in hierarchy_module._path_batches(node, node, np.zeros(n, int), node, np.ones(n, bool)):
        assert paths[0].as_py().rpartition("/")[2] == str(rows[0])
        seen, largest = seen + len(rows), max(largest, paths.nbytes)
    assert seen == n and largest < 2 * hierarchy_module.PATH_BYTES
