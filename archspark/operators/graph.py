"""Dependency graphs: collapse, degrees, components, layers and bounded reach, all on edge tables.

An edge points from the dependent to what it depends on.  Iterations write each round to the shared folder, so plans
stay short and lost executors cost one round.  What is left of a graph once it has at most ``TASK_EDGES`` edges is finished
by one task of that bounded size, with the same result; larger rests are never gathered in one place.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archspark.session import drop_durable, durable


def collapse(dependencies: DataFrame) -> DataFrame:
    """One edge for all dependencies between two files: ``weight`` counts them, ``kinds`` is the sorted set of kinds."""
    return dependencies.groupBy("source", "target").agg(F.count("*").alias("weight"), F.array_sort(F.collect_set("kind")).alias("kinds"))


def degrees(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """``path, ca, ce`` of each vertex, in one shuffle of edge ends; isolated vertices stay with zeros."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("target").alias("path"), F.lit(1).alias("i"), F.lit(0).alias("o")), F.struct(F.col("source").alias("path"), F.lit(0).alias("i"), F.lit(1).alias("o")))).alias("e")).select("e.*")
    alone = vertices.select("path", F.lit(0).alias("i"), F.lit(0).alias("o"))
    return ends.unionAll(alone).groupBy("path").agg(F.sum("i").alias("ca"), F.sum("o").alias("ce"))


def vertices_of(edges: DataFrame) -> DataFrame:
    """All ends of edges."""
    return edges.select(F.explode(F.array("source", "target")).alias("path")).distinct()


#: Edges of a graph that one task may hold (some hundred megabytes).
TASK_EDGES = 2_000_000


def _in_one_task(edges: DataFrame, run: Callable[[np.ndarray, np.ndarray, int], np.ndarray], value: str) -> DataFrame:
    """``name`` and what ``run`` (sources, targets, number of names) gives for each end of a bounded edge table (``a``, ``b``).

    Names are numbered in their order as bytes, so a lesser number is a lesser name.
    """
    kind = "string" if value == "component" else "int"

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        n = table.num_rows
        ends = pa.chunked_array([*table["a"].chunks, *table["b"].chunks]).combine_chunks().dictionary_encode()
        order = pc.sort_indices(ends.dictionary)
        names = ends.dictionary.take(order)
        number = np.empty(len(names), np.int64)
        number[order.to_numpy()] = np.arange(len(names))
        codes = number[ends.indices.to_numpy()]
        found = run(codes[:n], codes[n:], len(names))
        keep = np.flatnonzero(found >= 0)
        column = names.take(pa.array(found[keep])) if kind == "string" else pa.array(found[keep], pa.int32())
        yield pa.RecordBatch.from_arrays([names.take(pa.array(keep)), column], ["name", value])

    return edges.select("a", "b").repartition(1).mapInArrow(whole, f"name string, {value} {kind}")


def _sorted_edges(a: np.ndarray, b: np.ndarray, n: int) -> tuple[list[int], list[int]]:
    """Begin of each vertex's targets, and the targets."""
    order = np.argsort(a, kind="stable")
    return np.searchsorted(a[order], np.arange(n + 1)).tolist(), b[order].tolist()


def components_of(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Least member of each vertex's strong component (one depth-first walk with a stack of its own)."""
    begin, targets = _sorted_edges(a, b, n)
    seen, low, out = [0] * n, [0] * n, np.full(n, -1, np.int64)
    open_, path, clock = [], [], 0
    for root in range(n):
        if seen[root]:
            continue
        path.append((root, begin[root]))
        clock += 1
        seen[root] = low[root] = clock
        open_.append(root)
        while path:
            v, at = path.pop()
            end = begin[v + 1]
            while at < end:
                w = targets[at]
                at += 1
                if not seen[w]:
                    path.append((v, at))
                    clock += 1
                    seen[w] = low[w] = clock
                    open_.append(w)
                    path.append((w, begin[w]))
                    break
                if out[w] < 0 and seen[w] < low[v]:
                    low[v] = seen[w]
            else:
                if low[v] == seen[v]:
                    k = len(open_) - 1
                    while open_[k] != v:
                        k -= 1
                    members = open_[k:]
                    del open_[k:]
                    out[members] = min(members)
                if path:
                    up = path[-1][0]
                    low[up] = min(low[up], low[v])
    return out


def cyclic_components_of(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """As :func:`components_of`, -1 for vertices that are components of their own."""
    found = components_of(a, b, n)
    return np.where(np.bincount(found, minlength=n)[found] > 1, found, -1)


def layers_of(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Layer of each vertex: 0 depends on nothing outside its component, k on something of layer k - 1."""
    name = components_of(a, b, n)
    a, b = name[a], name[b]
    links = np.unique(np.stack([b, a], 1)[a != b], axis=0) if (a != b).any() else np.zeros((0, 2), np.int64)
    begin, users = _sorted_edges(links[:, 0], links[:, 1], n)
    waits = np.bincount(links[:, 1], minlength=n)
    layer = np.zeros(n, np.int64)
    free = np.flatnonzero((waits == 0) & (name == np.arange(n))).tolist()
    left = waits.tolist()
    while free:
        following = []
        for v in free:
            for u in users[begin[v] : begin[v + 1]]:
                layer[u] = max(layer[u], layer[v] + 1)
                left[u] -= 1
                if not left[u]:
                    following.append(u)
        free = following
    return layer[name]


def strong_components(edges: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """``path, component`` of the vertices on cycles; a component is named after its least member.

    Graphs of more than ``task_edges`` edges take rounds of trimming (vertices without in- or out-edges are on no cycle) and of forward-backward colouring: every
    vertex takes the least name that reaches it; a colour's component are those of the colour that reach its root.
    Self-loops make components of one.
    """
    pairs = edges.select("source", "target").distinct()
    loops = pairs.where("source = target").select(F.col("source").alias("path"), F.col("source").alias("component"))
    work = durable(pairs.where("source <> target"))
    after = before = work.count()
    found: list[DataFrame] = []
    while True:
        if 0 < after <= task_edges:
            rest = _in_one_task(work.select(F.col("source").alias("a"), F.col("target").alias("b")), cyclic_components_of, "component")
            found.append(rest.withColumnRenamed("name", "path"))
            break
        while after:  # trim
            kept = work.join(work.select(F.col("target").alias("source")).distinct(), "source", "left_semi")
            kept = durable(kept.join(kept.select(F.col("source").alias("target")).distinct(), "target", "left_semi").select("source", "target"))
            after = kept.count()
            drop_durable(work)
            work, done, before = kept, after in (0, before) or after <= task_edges, after
            if done:
                break
        if not after:
            break
        if after <= task_edges:
            continue
        colour = durable(vertices_of(work).select("path", F.col("path").alias("colour")))
        while True:  # least name that reaches a vertex
            incoming = work.join(colour.select(F.col("path").alias("source"), "colour"), "source").groupBy(F.col("target").alias("path")).agg(F.min("colour").alias("least"))
            step = durable(colour.join(incoming, "path", "left").select("path", F.least("colour", F.coalesce("least", "colour")).alias("colour"), (F.col("least") < F.col("colour")).alias("moved")))
            drop_durable(colour)
            colour = step
            if step.where("moved").isEmpty():
                break
        colour = colour.select("path", "colour")
        inner = work.join(colour.select(F.col("path").alias("source"), F.col("colour").alias("c1")), "source").join(colour.select(F.col("path").alias("target"), F.col("colour").alias("c2")), "target").where("c1 = c2")
        inner = durable(inner.select("source", "target"))
        reached = durable(colour.where("path = colour"))
        frontier = reached
        while True:  # backward from the roots within a colour
            more = inner.join(frontier.select(F.col("path").alias("target"), "colour"), "target").select(F.col("source").alias("path"), "colour").distinct()
            more = durable(more.join(reached.select("path"), "path", "left_anti"))
            if more.isEmpty():
                break
            frontier, reached = more, durable(reached.unionByName(more))
        found.append(reached.select("path", F.col("colour").alias("component")))
        rest = durable(work.join(reached.select(F.col("path").alias("source")), "source", "left_anti").join(reached.select(F.col("path").alias("target")), "target", "left_anti").select("source", "target"))
        drop_durable(work, inner)
        work, before, after = rest, -1, rest.count()
    members = None
    for part in found:
        part = part.join(part.groupBy("component").count().where("count > 1").select("component"), "component").select("path", "component")
        members = part if members is None else members.unionByName(part)
    if members is None:
        return loops
    return members.unionByName(loops.join(members.select("path"), "path", "left_anti"))


#: Largest component whose members are listed in one row; of larger ones :func:`strong_components` gives the membership.
LISTED_MEMBERS = 100_000


def cycles(edges: DataFrame, limit: int | None = None) -> DataFrame:
    """``component, size, members`` of each cycle, largest first, then by least member (members null beyond the bound)."""
    found = durable(strong_components(edges))
    sizes = found.groupBy("component").agg(F.count("*").alias("size"))
    listed = found.join(sizes.where(F.col("size") <= LISTED_MEMBERS), "component").groupBy("component").agg(F.array_sort(F.collect_list("path")).alias("members"))
    ranked = sizes.join(listed, "component", "left").orderBy(F.desc("size"), "component")
    return ranked if limit is None else ranked.limit(limit)


def _peel(names: DataFrame, links: DataFrame) -> tuple[DataFrame | None, DataFrame | None]:
    """(layers ``a, layer`` of all names, None), or (None, links left) where they hang on a cycle."""
    work = durable(links)
    left = durable(names)
    done: DataFrame | None = None
    level = 0
    while not left.isEmpty():
        blocked = work.select("a").distinct()
        free = durable(left.join(blocked, "a", "left_anti").withColumn("layer", F.lit(level)))
        if free.isEmpty():
            return None, work
        done = free if done is None else done.unionByName(free)
        rest = durable(left.join(free.select("a"), "a", "left_anti"))
        shrunk = durable(work.join(free.select(F.col("a").alias("b")), "b", "left_anti").select("a", "b"))
        drop_durable(left, work)
        left, work, level = rest, shrunk, level + 1
    return (names.select("a", F.lit(0).alias("layer")).limit(0) if done is None else done), None


def layers(vertices: DataFrame, edges: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """``path, layer``: 0 depends on nothing, k on something of layer k - 1; members of a cycle share a layer.

    Each round peels what depends on nothing that is left and keeps the remaining edges only.  Where that comes to
    nothing the rest holds cycles: their components are found in that rest alone, and the condensed graph is peeled.
    """
    names = vertices.select(F.col("path").alias("a")).distinct()
    links = durable(edges.select(F.col("source").alias("a"), F.col("target").alias("b")).where("a <> b").distinct())
    if links.count() <= task_edges:
        ranked = _in_one_task(links, layers_of, "layer")
        return names.join(ranked, names["a"] == ranked["name"], "left").select(F.col("a").alias("path"), F.coalesce("layer", F.lit(0)).alias("layer"))
    done, rest = _peel(names, links)
    if rest is None:
        return done.select(F.col("a").alias("path"), "layer")
    members = durable(strong_components(rest.select(F.col("a").alias("source"), F.col("b").alias("target")), task_edges))
    name = lambda column: members.select(F.col("path").alias(column), F.col("component").alias(f"{column}_name"))
    named = links.join(name("a"), "a", "left").join(name("b"), "b", "left").select(F.coalesce("a_name", "a").alias("a"), F.coalesce("b_name", "b").alias("b"))
    whole = names.join(name("a"), "a", "left").select(F.col("a").alias("path"), F.coalesce("a_name", "a").alias("a"))
    done, _ = _peel(whole.select("a").distinct(), named.where("a <> b").distinct())
    return whole.join(done, "a").select("path", "layer")


def summary(vertices: DataFrame, edges: DataFrame, with_cycles: bool = True) -> DataFrame:
    """One row: numbers of vertices, edges, edges by kind, isolated vertices and density; cycles and layers if asked.

    Each number is an aggregate of its own, and the rows of aggregates are put side by side by one more.
    """
    def numbers(df: DataFrame, **values) -> DataFrame:
        one = df.agg(*[v.cast("bigint").alias(k) for k, v in values.items()])
        return one.select(F.explode(F.array(*[F.struct(F.col(k).alias("v"), F.lit(k).alias("name")) for k in values])).alias("x")).select("x.*")

    number = lambda df, value, name: numbers(df, **{name: value})
    parts = [
        numbers(vertices, nodes=F.count("*")),
        numbers(edges, edges=F.count("*"), import_edges=F.count_if(F.array_contains("kinds", "import")), inheritance_edges=F.count_if(F.array_contains("kinds", "inheritance"))),
        numbers(degrees(vertices, edges), isolated=F.count_if((F.col("ca") == 0) & (F.col("ce") == 0))),
    ]
    names = ["nodes", "edges", "import_edges", "inheritance_edges", "isolated"]
    if with_cycles:
        sizes = durable(strong_components(edges).groupBy("component").count())
        parts += [number(sizes, F.count("*"), "cycles"), number(sizes, F.coalesce(F.max("count"), F.lit(0)), "largest_cycle"), number(layers(vertices, edges), F.coalesce(F.max("layer") + 1, F.lit(0)), "layers")]
        names += ["cycles", "largest_cycle", "layers"]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    one = rows.agg(*[F.max(F.when(F.col("name") == n, F.col("v"))).alias(n) for n in names])
    n = F.col("nodes")
    return one.withColumn("density", F.when(n <= 1, 0.0).otherwise(F.col("edges") / (n * (n - 1))))


def reach(edges: DataFrame, start: str, depth: int, reverse: bool) -> DataFrame:
    """``path, distance`` within ``depth`` hops of ``start``, itself left out, by a frontier that meets no vertex twice."""
    a, b = ("target", "source") if reverse else ("source", "target")
    steps = edges.select(F.col(a).alias("at"), F.col(b).alias("path")).where("at <> path")
    seen = edges.sparkSession.createDataFrame([(start, 0)], "path string, distance int")
    frontier = seen
    for hop in range(1, depth + 1):
        new = steps.join(F.broadcast(frontier.select(F.col("path").alias("at"))) if hop == 1 else frontier.select(F.col("path").alias("at")), "at").select("path").distinct()
        new = durable(new.join(seen.select("path"), "path", "left_anti").withColumn("distance", F.lit(hop)))
        if new.isEmpty():
            break
        frontier, seen = new, seen.unionByName(new)
    return seen.where("distance > 0")


def blast_radius(vertices: DataFrame, edges: DataFrame, target: str, depth: int = 2, max_dependents: int = 40, max_dependencies: int = 20) -> DataFrame:
    """``direction, path, distance, rank, total`` of what depends on the target and what it depends on.

    Nearest first, ties by path; ``total`` counts the direction before the cut to its maximum. An unknown target raises
    KeyError, a depth under 1 ValueError.
    """
    if vertices.where(F.col("path") == target).isEmpty():
        raise KeyError(target)
    if depth < 1:
        raise ValueError("depth must be at least 1")
    edges = durable(edges.select("source", "target").distinct())
    both = reach(edges, target, depth, True).withColumn("direction", F.lit("dependents")).unionByName(reach(edges, target, depth, False).withColumn("direction", F.lit("dependencies")))
    totals = both.groupBy("direction").agg(F.count("*").alias("total"))
    parts = []
    for name, most in (("dependents", max_dependents), ("dependencies", max_dependencies)):
        top = both.where(F.col("direction") == name).orderBy("distance", "path").limit(most)
        parts.append(top.agg(F.array_sort(F.collect_list(F.struct("distance", "path"))).alias("p")).select(F.lit(name).alias("direction"), F.posexplode("p").alias("i", "x")))
    ranked = parts[0].unionByName(parts[1]).select("direction", F.col("x.path").alias("path"), F.col("x.distance").alias("distance"), (F.col("i") + 1).alias("rank"))
    return ranked.join(totals, "direction")


def impact_count(radius: DataFrame) -> DataFrame:
    """One row: vertices within the radius before any cut, and whether it was cut."""
    per = radius.groupBy("direction").agg(F.max("total").alias("total"), F.count("*").alias("kept"))
    return per.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("reachable"), F.coalesce(F.sum("kept"), F.lit(0)).alias("kept"), F.coalesce(F.max(F.col("total") > F.col("kept")), F.lit(False)).alias("truncated"))


def all_paths(radius: DataFrame, target: str) -> DataFrame:
    """``path, rank``: the target, its dependents, its dependencies; each path once, where it stands first."""
    place = F.when(F.col("direction") == "dependents", F.col("rank")).otherwise((1 << 40) + F.col("rank"))  # a radius holds fewer
    return radius.select("path", place.alias("rank")).unionByName(radius.sparkSession.createDataFrame([(target, 0)], "path string, rank int")).groupBy("path").agg(F.min("rank").alias("rank"))
