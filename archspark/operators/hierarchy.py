"""Parent-child rows to full hierarchies (problem 4).

A forest is given as rows ``(tree key, node, parent | null, child range)``.  The operator first peels leaves until only
cycles are left, cuts each cycle out, lays an Euler tour over the remaining trees (one *down* and one *up* arc per node)
and ranks the tour with parallel list ranking (pointer jumping).  Entry and exit positions of a node then give
everything else: its depth is the running sum of +1/-1 along the tour, its descendants are the nodes whose entry lies
between its entry and its exit, its root is the tour's head.

Two ways with the same result share that algorithm:

* trees of at most ``max_tree_rows`` rows are hashed by tree key and ranked many at a time by vectorised kernels over
  Arrow batches, so a task never holds more than one batch and one bounded tree;
* larger trees, of any size, are ranked by pointer jumping with joins (a logarithmic number of rounds, each written to
  the shared folder), so no task ever gathers them.  Here cycles are found by pointer jumping too, since peeling takes
  as many rounds as a tree is deep: what has not arrived after more jumps than there are nodes goes round a cycle, and
  the places it has come to are the cycle's nodes.

Defined cases:

* rows repeated for one ``(tree, node)`` count once (the smallest row holds); rows without tree or node id are no nodes;
* ``parent = -1`` (any negative) is a root; a parent that is not in the table orphans the node and all below it;
* a null parent is the node of the same tree whose child range (``child_count > 0``) holds the node; the smallest such
  node holds if there are several, and without one the node is a root;
* a node that is its own parent is a cycle of one;
* nodes that reach no root (``in_cycle``, ``below_cycle``, ``orphaned``) have null depth, root and path, and nodes in a
  cycle also null descendants;
* an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archspark.session import drop_durable, durable

#: Rows of a tree up to which one task may hold it (about 100 MB of kernel memory).
MAX_TREE_ROWS = 500_000

STATES = ("ok", "in_cycle", "below_cycle", "orphaned")
_OK, _CYCLE, _BELOW, _ORPHAN = range(4)

SCHEMA = (
    "file_id bigint, node_id int, parent_id int, state string, depth int, root_id int, "
    "entry bigint, exit bigint, descendants bigint"
)


def _nodes(df: DataFrame) -> DataFrame:
    return df.select(
        F.col("file_id").cast("bigint").alias("file_id"),
        F.col("node_id").cast("int").alias("node_id"),
        F.col("parent_index").cast("int").alias("parent_index"),
        F.col("first_child_index").cast("bigint").alias("first_child_index"),
        F.col("child_count").cast("bigint").alias("child_count"),
    ).where(F.col("file_id").isNotNull() & F.col("node_id").isNotNull())


# --------------------------------------------------------------------------- vectorised kernel


def resolve_parents(file: np.ndarray, node: np.ndarray, parent: np.ndarray, given: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Row of each node's parent; -1 for a root, -2 for a parent that is not there. Rows are sorted by (file, node)."""
    n = len(node)
    span = int(node.max(initial=0)) + 2
    low = int(node.min(initial=0))
    width = span - low
    key = file * width + (node - low)
    out = np.full(n, -1, np.int64)
    named = given & (parent >= 0)
    at = np.flatnonzero(named)
    want = parent[at].astype(np.int64)
    inside = (want >= low) & (want < span)
    target = file[at] * width + np.where(inside, want - low, 0)
    pos = np.searchsorted(key, target)
    hit = inside & (pos < n)
    hit[hit] = key[pos[hit]] == target[hit]
    out[at] = np.where(hit, pos, -2)
    open_rows = np.flatnonzero(~given)
    if len(open_rows):
        okey = key[open_rows]
        has = np.flatnonzero(count > 0)
        lo_node = np.clip(first[has], low, span)
        hi_node = np.clip(first[has] + count[has], low, span)
        lo = np.searchsorted(okey, file[has] * width + (lo_node - low))
        hi = np.searchsorted(okey, file[has] * width + (hi_node - low))
        reach = hi - lo
        keep = reach > 0
        has, lo, reach = has[keep], lo[keep], reach[keep]
        if len(has):
            owner = np.repeat(has, reach)
            inner = np.arange(reach.sum()) - np.repeat(np.cumsum(reach) - reach, reach) + np.repeat(lo, reach)
            best = np.full(len(open_rows), n, np.int64)
            np.minimum.at(best, inner, owner)
            found = best < n
            out[open_rows[found]] = best[found]
    return out


def peel(parent: np.ndarray) -> np.ndarray:
    """True for the nodes that are left when leaves are taken off again and again: those in cycles."""
    n = len(parent)
    linked = parent >= 0
    children = np.bincount(parent[linked], minlength=n)
    left = np.ones(n, bool)
    leaves = np.flatnonzero(children == 0)
    while len(leaves):
        left[leaves] = False
        up = parent[leaves]
        up = up[up >= 0]
        np.subtract.at(children, up, 1)
        up = np.unique(up)
        leaves = up[(children[up] == 0) & left[up]]
    return left


def euler_rank(parent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Entry, exit, depth and root row of each node of a forest (parent < 0: root), by list ranking of its Euler tours.

    Arc ``v`` goes down into node v, arc ``n + v`` goes up out of it. Each tree is a list of its own; its last arc is
    the root's up arc. Pointer jumping halves the remaining distance each round.
    """
    n = len(parent)
    ids = np.arange(n)
    order = np.lexsort((ids, parent))
    sorted_parent = parent[order]
    following = np.full(n, -1, np.int64)
    same = np.flatnonzero((sorted_parent[:-1] == sorted_parent[1:]) & (sorted_parent[:-1] >= 0))
    following[order[same]] = order[same + 1]
    first_child = np.full(n, -1, np.int64)
    starts = np.flatnonzero(np.r_[True, sorted_parent[1:] != sorted_parent[:-1]] & (sorted_parent >= 0)) if n else np.zeros(0, np.int64)
    first_child[sorted_parent[starts]] = order[starts]
    jump = np.empty(2 * n, np.int64)
    jump[:n] = np.where(first_child >= 0, first_child, ids + n)
    jump[n:] = np.where(following >= 0, following, np.where(parent >= 0, parent + n, ids + n))
    last = jump == np.arange(2 * n)
    steps = np.where(last, 0, 1).astype(np.int64)
    height = np.r_[np.ones(n, np.int64), -np.ones(n, np.int64)]
    height[last] = 0  # a list's end stands for itself, its own -1 is added below
    while True:
        ahead = jump[jump]
        if np.array_equal(ahead, jump):
            break
        steps += steps[jump]
        height += height[jump]
        jump = ahead
    end = jump[:n]
    root = end - n
    length = steps[root] + 1
    entry = length - 1 - steps[:n]
    leaving = length - 1 - steps[n:]
    depth = 1 - height[:n]  # what is still to fall from here: depth + 1 steps down, one of them the list's end
    return entry, leaving, depth, root


def rank_batch(file: np.ndarray, node: np.ndarray, parent: np.ndarray, given: np.ndarray, first: np.ndarray, count: np.ndarray) -> dict[str, np.ndarray]:
    """All columns of the result for whole trees; rows may repeat and stand in any order."""
    order = np.lexsort((count, first, parent, ~given, node, file))
    file, node, parent, given, first, count = (x[order] for x in (file, node, parent, given, first, count))
    if len(file):
        once = np.r_[True, (file[1:] != file[:-1]) | (node[1:] != node[:-1])]
        file, node, parent, given, first, count = (x[once] for x in (file, node, parent, given, first, count))
    dense = np.cumsum(np.r_[0, file[1:] != file[:-1]]) if len(file) else file
    up = resolve_parents(dense, node.astype(np.int64), parent.astype(np.int64), given, first, count)
    cyclic = peel(up)
    cut = np.where(cyclic, -1, up)
    entry, leaving, depth, root = euler_rank(cut)
    state = np.where(cyclic[root], _BELOW, np.where(up[root] == -2, _ORPHAN, _OK))
    state[cyclic] = _CYCLE
    return {"file": file, "node": node, "parent_row": up, "entry": entry, "exit": leaving, "depth": depth, "root": root, "state": state}


#: Bytes of paths after which a task hands over a batch; the paths of a chain of n nodes take n * n / 2 ids.
PATH_BYTES = 32 << 20


def _path_batches(node: np.ndarray, depth: np.ndarray, root: np.ndarray, entry: np.ndarray, ok: np.ndarray) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """Rows and their node ids from the root, joined by '/' (null where not ``ok``), in batches of bounded bytes.

    Nodes are taken in the order of their entries, so the ids above a node are a stack and only that is held.
    """
    lost = np.flatnonzero(~ok)
    if len(lost):
        yield lost, pa.nulls(len(lost), pa.string())
    rows = np.flatnonzero(ok)
    rows = rows[np.lexsort((entry[rows], root[rows]))]
    names, depths = node[rows].astype(str).tolist(), depth[rows].tolist()
    stack: list[str] = []
    out: list[str] = []
    size = start = 0
    for k, (name, d) in enumerate(zip(names, depths)):
        del stack[d:]
        stack.append(name)
        path = "/".join(stack)
        out.append(path)
        size += len(path)
        if size >= PATH_BYTES:
            yield rows[start : k + 1], pa.array(out, pa.string())
            out, size, start = [], 0, k + 1
    if out:
        yield rows[start:], pa.array(out, pa.string())


def _kernel(with_paths: bool, only_lost: bool):
    """Ranks the trees of partitions sorted by tree."""

    def run(table: pa.Table) -> Iterator[pa.RecordBatch]:
        col = lambda name, null: pc.fill_null(table[name], null).combine_chunks().to_numpy(zero_copy_only=False)
        given = table["parent_index"].combine_chunks().is_valid().to_numpy(zero_copy_only=False)
        r = rank_batch(col("file_id", 0), col("node_id", 0), col("parent_index", -1), given, col("first_child_index", 0), col("child_count", 0))
        keep = np.flatnonzero(r["state"] != _OK) if only_lost else slice(None)
        ok = r["state"][keep] == _OK
        cyclic = r["state"][keep] == _CYCLE
        up = r["parent_row"][keep]
        parent = np.where(up >= 0, r["node"][np.maximum(up, 0)], 0)
        null = lambda x, mask, kind: pa.array(x, kind, mask=mask)
        columns = {
            "file_id": pa.array(r["file"][keep], pa.int64()),
            "node_id": pa.array(r["node"][keep], pa.int32()),
            "parent_id": null(parent, up < 0, pa.int32()),
            "state": pa.array(np.array(STATES, object)[r["state"][keep]], pa.string()),
            "depth": null(r["depth"][keep], ~ok, pa.int32()),
            "root_id": null(r["node"][r["root"][keep]], ~ok, pa.int32()),
            "entry": null(r["entry"][keep], ~ok, pa.int64()),
            "exit": null(r["exit"][keep], ~ok, pa.int64()),
            "descendants": null((r["exit"][keep] - r["entry"][keep] - 1) // 2, cyclic, pa.int64()),
        }
        whole = pa.record_batch(columns)
        if not with_paths:
            yield whole
            return
        cut = {k: r[k][keep] for k in ("node", "depth", "root", "entry")}
        for rows, paths in _path_batches(*cut.values(), ok):
            yield pa.RecordBatch.from_arrays([*whole.take(pa.array(rows)).columns, paths], [*columns, "path"])

    return by_tree(run)


def by_tree(run):
    """mapInArrow function over partitions sorted by ``file_id``: ``run`` gets tables that hold whole trees only and gives
    a batch or several."""

    def all_of(found: pa.RecordBatch | Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return iter((found,)) if isinstance(found, pa.RecordBatch) else found

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            files = batch["file_id"].to_numpy()
            if rows < 60_000 or files[0] == files[-1]:
                continue
            at = int(np.searchsorted(files, files[-1]))  # the last tree may go on in the next batch
            held[-1] = batch.slice(0, at)
            yield from all_of(run(pa.Table.from_batches(held)))
            held, rows = [batch.slice(at)], batch.num_rows - at
        if held:
            yield from all_of(run(pa.Table.from_batches(held)))

    return split


# --------------------------------------------------------------------------- relational way for trees of any size


def _jump(base: DataFrame, rounds: int, with_paths: bool) -> DataFrame:
    """Where each node of ``base`` (``file_id, node_id, parent, missing``) ends, ``j``, after ``d`` steps; not ``done`` if it never does.

    ``path`` joins the ids from there by '/'; it is asked for nodes that reach a root only.
    """
    end = F.col("parent").isNull() | F.col("missing")
    hop = base.select("file_id", "node_id", F.when(end, F.col("node_id")).otherwise(F.col("parent")).alias("j"), F.when(end, F.lit(0)).otherwise(F.lit(1)).cast("bigint").alias("d"), F.when(end, F.col("node_id").cast("string")).otherwise(F.concat(F.col("parent").cast("string"), F.lit("/"), F.col("node_id").cast("string"))).alias("path"), end.alias("done"))
    if not with_paths:
        hop = hop.drop("path")
    for _ in range(rounds):
        right = hop.select("file_id", F.col("node_id").alias("j"), F.col("j").alias("j2"), F.col("d").alias("d2"), F.col("done").alias("done2"), *([F.col("path").alias("path2")] if with_paths else []))
        step = hop.where(~F.col("done")).join(right, ["file_id", "j"])  # what has arrived is not joined again
        columns = ["file_id", "node_id", F.col("j2").alias("j"), (F.col("d") + F.col("d2")).alias("d")]
        if with_paths:
            # both halves hold the node where they meet: the second begins after it
            columns.append(F.concat("path2", F.expr("substring(path, length(cast(j as string)) + 1)")).alias("path"))
        columns.append(F.col("done2").alias("done"))
        before, hop = hop, durable(hop.where("done").unionByName(step.select(*columns)))
        drop_durable(before)
        if hop.where(~F.col("done")).isEmpty():
            break
    return hop


def _next_siblings(forest: DataFrame) -> DataFrame:
    """``file_id, node_id, sibling`` of the nodes of ``forest`` (``file_id, node_id, up``) that have a next sibling.

    Nodes are sorted over all partitions by range, so a parent of any width is shared among tasks; only the first and the
    last node of each partition meet on the driver.
    """
    ends = ["file_id", "up", "node_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last = None

        def rows(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32()))], ["file_id", "up", "node_id", "sibling", "part", "place"])

        for batch in batches:
            if not batch.num_rows:
                continue
            file, up, node = (batch[c].to_numpy() for c in ends)
            if last is None:
                yield rows([(int(file[0]), int(up[0]), int(node[0]), None, part, 0)])
            elif last[:2] == (file[0], up[0]):
                yield rows([(int(last[0]), int(last[1]), int(last[2]), int(node[0]), None, None)])
            at = np.flatnonzero((file[1:] == file[:-1]) & (up[1:] == up[:-1]))
            empty = pa.nulls(len(at), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(file[at], pa.int64()), pa.array(up[at], pa.int32()), pa.array(node[at], pa.int32()), pa.array(node[at + 1], pa.int32()), empty, empty], ["file_id", "up", "node_id", "sibling", "part", "place"])
            last = (file[-1], up[-1], node[-1])
        if last is not None:
            yield rows([(int(last[0]), int(last[1]), int(last[2]), None, part, 1)])

    placed = forest.where("up is not null").select(*ends).repartitionByRange(*ends).sortWithinPartitions(*ends)
    found = durable(placed.mapInArrow(run, "file_id bigint, up int, node_id int, sibling int, part int, place int"))
    edges = found.where("part is not null").orderBy("part", "place").collect()  # two rows a partition
    bridges = [(a["file_id"], a["node_id"], b["node_id"]) for a, b in zip(edges[1::2], edges[2::2]) if (a["file_id"], a["up"]) == (b["file_id"], b["up"])]
    inner = found.where("part is null").select("file_id", "node_id", "sibling")
    return inner.unionByName(forest.sparkSession.createDataFrame(bridges, "file_id bigint, node_id int, sibling int"))


def _large(nodes: DataFrame, with_paths: bool, bound: int) -> DataFrame:
    """Pointer jumping by joins; ``bound`` is at least the number of rows of the largest tree."""
    value = F.struct(F.col("parent_index").isNull().alias("z"), "parent_index", "first_child_index", "child_count")
    once = durable(nodes.groupBy("file_id", "node_id").agg(F.min(value).alias("v")).select("file_id", "node_id", "v.parent_index", "v.first_child_index", "v.child_count"))
    # null parents: nodes and ranges meet in blocks of node ids, so a wide range is split over its blocks
    block = 4096
    ranges = once.where("child_count > 0 and first_child_index is not null").select("file_id", F.col("node_id").alias("owner"), F.col("first_child_index").alias("lo"), (F.col("first_child_index") + F.col("child_count")).alias("hi"))
    extent = once.groupBy("file_id").agg(F.min("node_id").alias("least"), F.max("node_id").alias("most"))
    ranges = ranges.join(extent, "file_id").withColumn("lo", F.greatest("lo", "least")).withColumn("hi", F.least("hi", F.col("most") + 1)).where("lo < hi")
    ranges = ranges.withColumn("block", F.explode(F.sequence(F.floor(F.col("lo") / block), F.floor((F.col("hi") - 1) / block))))
    unlinked = once.where("parent_index is null").select("file_id", "node_id", F.floor(F.col("node_id") / block).alias("block"))
    by_range = unlinked.join(ranges, ["file_id", "block"]).where("node_id >= lo and node_id < hi").groupBy("file_id", "node_id").agg(F.min("owner").alias("range_owner"))
    linked = once.join(by_range, ["file_id", "node_id"], "left").select("file_id", "node_id", F.when(F.col("parent_index").isNull(), F.coalesce("range_owner", F.lit(-1))).otherwise(F.greatest("parent_index", F.lit(-1))).alias("p"))
    there = once.select("file_id", F.col("node_id").alias("p"), F.lit(True).alias("there"))
    base = durable(linked.join(there, ["file_id", "p"], "left").select("file_id", "node_id", F.when(F.col("p") < 0, F.lit(None)).otherwise(F.col("p")).alias("parent"), (F.col("p").isNotNull() & (F.col("p") >= 0) & F.col("there").isNull()).alias("missing")))
    rounds = max(1, int(np.ceil(np.log2(bound + 1))) + 1)

    # doubling over parents: ends at a root or an orphan, or runs round a cycle for ever; no paths yet, as those of a cycle never end
    hop = _jump(base, rounds, False)
    looped = hop.where(~F.col("done")).select("file_id", F.col("j").alias("node_id")).distinct().withColumn("cyclic", F.lit(True))
    ends = base.select("file_id", F.col("node_id").alias("j"), F.col("missing").alias("end_missing"))
    state = F.when(F.col("cyclic"), "in_cycle").when(~F.col("done"), "below_cycle").when(F.col("end_missing"), "orphaned").otherwise("ok")
    out = durable(hop.join(looped, ["file_id", "node_id"], "left").join(ends, ["file_id", "j"]).join(base.select("file_id", "node_id", "parent", "missing"), ["file_id", "node_id"]).withColumn("state", state))
    drop_durable(hop)
    whole = out
    if with_paths:
        paths = _jump(out.where("state = 'ok'").select("file_id", "node_id", "parent", "missing"), rounds, True)
        whole = out.join(paths.select("file_id", "node_id", "path"), ["file_id", "node_id"], "left")

    # Euler tour of what is left when cycle edges are cut, ranked by doubling over its arcs (2 * node: down, + 1: up)
    cut = F.col("parent").isNull() | F.col("missing") | (F.col("state") == "in_cycle")
    forest = out.select("file_id", "node_id", F.when(~cut, F.col("parent")).alias("up"))
    nexts = forest.join(_next_siblings(forest), ["file_id", "node_id"], "left")
    firsts = forest.where("up is not null").groupBy("file_id", F.col("up").alias("node_id")).agg(F.min("node_id").alias("child"))
    arcs = nexts.join(firsts, ["file_id", "node_id"], "left").withColumn("node_id", F.col("node_id").cast("bigint"))
    down = F.struct((2 * F.col("node_id")).alias("arc"), F.coalesce(2 * F.col("child"), 2 * F.col("node_id") + 1).alias("j"))
    up = F.struct((2 * F.col("node_id") + 1).alias("arc"), F.coalesce(2 * F.col("sibling"), 2 * F.col("up") + 1, 2 * F.col("node_id") + 1).alias("j"))
    last = F.col("a.arc") == F.col("a.j")
    tour = durable(arcs.select("file_id", F.explode(F.array(down, up)).alias("a")).select("file_id", "a.arc", "a.j", F.when(last, 0).otherwise(1).cast("bigint").alias("s"), last.alias("done")))
    for _ in range(rounds + 1):
        right = tour.select("file_id", F.col("arc").alias("j"), F.col("j").alias("j2"), F.col("s").alias("s2"))
        moved = tour.where(~F.col("done")).join(right, ["file_id", "j"]).select("file_id", "arc", F.col("j2").alias("j"), (F.col("s") + F.col("s2")).alias("s"), (F.col("s2") == 0).alias("done"))
        before, tour = tour, durable(tour.where("done").unionByName(moved))
        drop_durable(before)
        if tour.where(~F.col("done")).isEmpty():
            break
    ranked = tour.groupBy("file_id", F.floor(F.col("arc") / 2).cast("int").alias("node_id")).agg(F.max(F.when(F.col("arc") % 2 == 0, F.col("s"))).alias("s_in"), F.max(F.when(F.col("arc") % 2 == 1, F.col("s"))).alias("s_out"), F.max((F.floor(F.col("j") / 2)).cast("int")).alias("tour_root"))
    length = ranked.where("node_id = tour_root").select("file_id", "tour_root", F.col("s_in").alias("last"))
    placed = ranked.join(length, ["file_id", "tour_root"])
    ok = F.col("state") == "ok"
    result = whole.join(placed, ["file_id", "node_id"]).select(
        "file_id", "node_id", F.when(~F.col("missing"), F.col("parent")).alias("parent_id"), "state",
        F.when(ok, F.col("d")).cast("int").alias("depth"), F.when(ok, F.col("j")).cast("int").alias("root_id"),
        F.when(ok, F.col("last") - F.col("s_in")).alias("entry"), F.when(ok, F.col("last") - F.col("s_out")).alias("exit"),
        F.when(F.col("state") != "in_cycle", ((F.col("s_in") - F.col("s_out") - 1) / 2).cast("bigint")).alias("descendants"),
        *(["path"] if with_paths else []),
    )
    return result


def hierarchy(df: DataFrame, *, with_paths: bool = True, only_lost: bool = False, max_tree_rows: int = MAX_TREE_ROWS) -> DataFrame:
    """Full hierarchy of every tree in ``df`` (columns of the module's docstring; ``path`` if ``with_paths``).

    ``only_lost`` keeps the nodes that reach no root.
    """
    nodes = _nodes(df)
    sizes = nodes.groupBy("file_id").count().where(F.col("count") > max_tree_rows)
    largest = sizes.agg(F.max("count")).first()[0]
    schema = SCHEMA + (", path string" if with_paths else "")
    small = nodes
    if largest:
        hot = durable(sizes.select("file_id"))
        small = nodes.join(hot, "file_id", "left_anti")
    spread = small.repartition("file_id").sortWithinPartitions("file_id")
    result = spread.mapInArrow(_kernel(with_paths, only_lost), schema)
    if largest:
        lost = _large(nodes.join(hot, "file_id", "left_semi"), with_paths, int(largest))
        result = result.unionByName(lost.where("state <> 'ok'") if only_lost else lost)
    return result


def descendants_of(tree: DataFrame, ancestors: DataFrame) -> DataFrame:
    """All descendants of each of ``ancestors`` (``file_id, node_id``) by their entry-exit intervals in ``tree``.

    One row per pair of the asked ancestors only; entries and exits are compared within a root's tour.
    """
    asked = ancestors.select("file_id", "node_id").distinct()
    top = tree.join(asked, ["file_id", "node_id"]).where("state = 'ok'").select("file_id", "root_id", F.col("node_id").alias("ancestor_id"), F.col("entry").alias("lo"), F.col("exit").alias("hi"))
    inner = tree.where("state = 'ok'").select("file_id", "root_id", "node_id", "entry")
    return inner.join(top, ["file_id", "root_id"]).where("entry > lo and entry < hi").select("file_id", "ancestor_id", "node_id")
