"""Cohesion of classes (LCOM1, LCOM4) and the scope pass it rests on.

The scope pass gives each node its nearest enclosing class and the methods it belongs to (several, where a class stands
in a method).  It runs over whole files in Arrow batches, level by level from the roots, so it holds one batch and one
file; the rest is relational.  Nodes whose parents are lost or cyclic belong to no class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archspark import schemas as S
from archspark.functions.names import last_of_call, own_name
from archspark.operators.hierarchy import by_tree, rank_batch

SCOPE = "file_id bigint, node_id int, method_id int, class_id int, is_method boolean, depth int"


def _scopes(table: pa.Table) -> pa.RecordBatch:
    col = lambda name, null: pc.fill_null(table[name], null).combine_chunks().to_numpy(zero_copy_only=False)
    given = table["parent_index"].combine_chunks().is_valid().to_numpy(zero_copy_only=False)
    file, node, kind = col("file_id", 0), col("node_id", 0), col("kind", S.OTHER)
    r = rank_batch(file, node, col("parent_index", -1), given, col("first_child_index", 0), col("child_count", 0))
    at = np.searchsorted(r["file"] * (1 << 32) + r["node"], file * (1 << 32) + node)
    kinds = np.full(len(r["node"]), S.OTHER, np.int64)
    kinds[at] = kind
    up, depth, ok = r["parent_row"], r["depth"], r["state"] == 0
    n = len(up)
    nearest = np.full(n, -1, np.int64)  # nearest class or function strictly above
    klass = np.full(n, -1, np.int64)  # nearest class strictly above
    rows = np.flatnonzero(ok & (depth > 0))
    rows = rows[np.argsort(depth[rows], kind="stable")]
    borders = np.flatnonzero(np.r_[True, depth[rows][1:] != depth[rows][:-1], True]) if len(rows) else np.zeros(1, np.int64)
    for a, b in zip(borders[:-1], borders[1:]):
        level = rows[a:b]
        p = up[level]
        nearest[level] = np.where((kinds[p] == S.CLASS) | (kinds[p] == S.FUNCTION), p, nearest[p])
        klass[level] = np.where(kinds[p] == S.CLASS, p, klass[p])
    method = (kinds == S.FUNCTION) & (nearest >= 0) & (kinds[np.maximum(nearest, 0)] == S.CLASS)
    owners = [(np.flatnonzero(ok), np.full(int(ok.sum()), -1, np.int64))]  # the node itself, without a method
    start = np.flatnonzero(ok & ((kinds == S.CALL) | (kinds == S.FIELD_ACCESS)))
    cursor = nearest[start]
    while len(start):  # climb from scope to scope, giving a row for each method passed
        hit = (cursor >= 0) & method[np.maximum(cursor, 0)]
        owners.append((start[hit], cursor[hit]))
        alive = cursor >= 0
        start, cursor = start[alive], nearest[cursor[alive]]
    who = np.concatenate([a for a, _ in owners])
    of = np.concatenate([b for _, b in owners])
    ids = lambda x: pa.array(r["node"][np.maximum(x, 0)], pa.int32(), mask=x < 0)
    in_class = np.where(of >= 0, nearest[np.maximum(of, 0)], klass[who])
    return pa.record_batch({
        "file_id": pa.array(r["file"][who], pa.int64()),
        "node_id": pa.array(r["node"][who], pa.int32()),
        "method_id": ids(of),
        "class_id": ids(in_class),
        "is_method": pa.array(method[who]),
        "depth": pa.array(depth[who], pa.int32()),
    })


def scopes(nodes: DataFrame) -> DataFrame:
    """Rows ``file_id, node_id, method_id, class_id, is_method, depth``.

    Each node has one row with a null method and its nearest enclosing class; calls and field accesses have one more for
    each method they stand in, with that method's class.
    """
    columns = nodes.select(*[F.col(c).cast(k).alias(c) for c, k in (("file_id", "bigint"), ("node_id", "int"), ("kind", "int"), ("parent_index", "int"), ("first_child_index", "bigint"), ("child_count", "bigint"))])
    spread = columns.where("file_id is not null and node_id is not null").repartition("file_id").sortWithinPartitions("file_id")
    return spread.mapInArrow(by_tree(_scopes), SCOPE)


def methods(nodes: DataFrame) -> DataFrame:
    """``file_id, class_id, method_id, name, fields, calls`` of each method of a named class."""
    once = nodes.select("file_id", "node_id", "kind", "name").dropDuplicates(["file_id", "node_id"])
    scope = scopes(nodes).join(once, ["file_id", "node_id"])
    own = scope.where("is_method and method_id is null").select("file_id", F.col("node_id").alias("method_id"), "name")
    # the class of a method is its nearest scope, which for a method is a class
    home = scope.where("is_method and method_id is null").select("file_id", F.col("node_id").alias("method_id"), "class_id")
    used = scope.where("method_id is not null").groupBy("file_id", "method_id").agg(
        F.collect_set(F.when((F.col("kind") == S.FIELD_ACCESS) & (F.col("name") != ""), F.col("name"))).alias("fields"),
        F.collect_set(F.when((F.col("kind") == S.CALL) & (F.col("name") != ""), last_of_call(F.col("name")))).alias("calls"),
    )
    named = F.when(F.col("name") == "", F.concat(F.lit("<anonymous:"), F.col("method_id").cast("string"), F.lit(">"))).otherwise(F.col("name"))
    empty = F.array().cast("array<string>")
    return own.join(home, ["file_id", "method_id"]).join(used, ["file_id", "method_id"], "left").select(
        "file_id", "class_id", "method_id", named.alias("name"), F.coalesce("fields", empty).alias("fields"), F.coalesce("calls", empty).alias("calls")
    )


def lcom(members: list[dict]) -> tuple[int, int, int, list[list[str]]]:
    """(fields, LCOM1, LCOM4, components) of one class from its methods in order of their ids."""
    names = [m["name"] for m in members]
    fields = [frozenset(m["fields"]) for m in members]
    n = len(members)
    everything = sorted(set().union(*fields)) if members else []
    number = {f: k for k, f in enumerate(everything)}
    uses = np.zeros((n, max(1, len(everything))), bool)
    for k, used in enumerate(fields):
        uses[k, [number[f] for f in used]] = True
    sharing = int(np.triu(uses.astype(np.float32) @ uses.T.astype(np.float32) > 0, 1).sum())
    lcom1 = max(0, n * (n - 1) // 2 - 2 * sharing) if n >= 2 else 0
    root = list(range(n))

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    first: dict[str, int] = {}
    last = {name: k for k, name in enumerate(names)}  # of methods with one name the last counts
    for k, m in enumerate(members):
        for f in fields[k]:
            root[find(k)] = find(first.setdefault(f, k))
        for call in m["calls"]:
            if call in last and last[call] != k:
                root[find(k)] = find(last[call])
    groups: dict[int, list[str]] = {}
    for k in range(n):
        groups.setdefault(find(k), []).append(names[k])
    components = sorted((sorted(g) for g in groups.values()), key=lambda g: (-len(g), g))
    return len(everything), lcom1, (len(components) if n >= 2 else min(n, 1)), components if n >= 2 else ([names] if n else [])


_LCOM = "field_count int, lcom1 bigint, lcom4 int, components array<array<string>>"


def _lcom_column(members: Column) -> Column:
    from pyspark.sql.functions import arrow_udf

    @arrow_udf(f"struct<{_LCOM.replace(' int', ':int').replace(' bigint', ':bigint').replace(' array', ':array')}>")
    def run(column: pa.Array) -> pa.Array:
        rows = [dict(zip(("field_count", "lcom1", "lcom4", "components"), lcom(m))) for m in column.to_pylist()]
        return pa.array(rows, pa.struct([("field_count", pa.int32()), ("lcom1", pa.int64()), ("lcom4", pa.int32()), ("components", pa.list_(pa.list_(pa.string())))]))

    return run(members)


def class_cohesion(nodes: DataFrame) -> DataFrame:
    """Cohesion of each named class: ``path, class_name, class_id, method_count, field_count, lcom1, lcom4, components``.

    A class's methods are gathered in one row, bounded by one file's size.
    """
    classes = nodes.where(F.col("kind") == S.CLASS).select("file_id", "path", F.col("node_id").alias("class_id"), own_name(F.col("name")).alias("class_name")).where("class_name <> ''").dropDuplicates(["file_id", "class_id"])
    grouped = methods(nodes).groupBy("file_id", "class_id").agg(F.array_sort(F.collect_list(F.struct("method_id", "name", "fields", "calls"))).alias("members"))
    nothing = F.array().cast("array<struct<method_id:int,name:string,fields:array<string>,calls:array<string>>>")
    rows = classes.join(grouped, ["file_id", "class_id"], "left").withColumn("members", F.coalesce("members", nothing))
    found = rows.select("file_id", "path", "class_name", "class_id", F.size("members").alias("method_count"), _lcom_column(F.col("members")).alias("x"))
    out = found.select("file_id", "path", "class_name", "class_id", "method_count", "x.field_count", "x.lcom1", "x.lcom4", "x.components")
    return out.withColumns({"is_cohesive": F.col("lcom4") <= 1, "suggested_split": F.greatest("lcom4", F.lit(1))})


def ranked(cohesion: DataFrame) -> DataFrame:
    """Least cohesive first, then by methods, path and class."""
    return cohesion.orderBy(F.desc("lcom4"), F.desc("method_count"), "path", "class_name", "class_id")


def least_cohesive(cohesion: DataFrame, n: int = 10) -> DataFrame:
    return ranked(cohesion.where("lcom4 > 1")).limit(n)


def enclosing_classes(nodes: DataFrame) -> DataFrame:
    """``file_id, node_id, enclosing_class``: nearest named class above each node, across functions."""
    named = nodes.where(F.col("kind") == S.CLASS).select("file_id", F.col("node_id").alias("class_id"), own_name(F.col("name")).alias("enclosing_class")).dropDuplicates(["file_id", "class_id"])
    own = scopes(nodes).where("method_id is null").select("file_id", "node_id", "class_id")
    return own.join(named, ["file_id", "class_id"], "left").select("file_id", "node_id", "class_id", "enclosing_class")
