"""Embedding of chunks and the vector table: upsert, delete, scoped search.

The table is a folder of immutable versions with a pointer file; a write makes a new version and then moves the pointer,
so readers never see half a write.  Search filters by path before it ranks, and ranking is a top-k that is combined
before anything is shuffled.
"""

from __future__ import annotations

import hashlib
import math
import re
import struct
import uuid
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class Embedder(Protocol):
    """Anything that turns texts into vectors of one length."""

    name: str
    dimensions: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class HashEmbedder:
    """Feature hashing: each token adds +1 or -1 at a place chosen by its digest; vectors have unit length, or are zero."""

    def __init__(self, dimensions: int = 384) -> None:
        if dimensions < 1:
            raise ValueError("dimensions must be positive")
        self.dimensions = dimensions
        self.name = f"hash-{dimensions}"
        self._memo: dict[str, tuple[int, float]] = {}

    def _place(self, token: str) -> tuple[int, float]:
        found = self._memo.get(token)
        if found is None:
            digest = hashlib.blake2b(token.encode(), digest_size=8).digest()
            found = struct.unpack_from("<I", digest)[0] % self.dimensions, 1.0 if digest[4] % 2 == 0 else -1.0
            if len(self._memo) < 200_000:
                self._memo[token] = found
        return found

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = np.zeros(self.dimensions)
            for token in re.findall(r"\w+", text.lower()):
                at, sign = self._place(token)
                v[at] += sign
            norm = math.sqrt(float(v @ v))
            out.append((v / norm if norm else v).tolist())
        return out


def default_embedder(dimensions: int = 384) -> Embedder:
    """The embedder that needs no model files; a semantic one is passed in by the user."""
    return HashEmbedder(dimensions)


def embed(df: DataFrame, embedder: Embedder, text_column: str = "embedding_text") -> DataFrame:
    """``vector array<float>`` of each row; the embedder is made once per worker and fed Arrow batches."""

    @F.arrow_udf("array<float>")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            yield pa.array(embedder.embed([t or "" for t in part.to_pylist()]), pa.list_(pa.float32()))

    return df.withColumn("vector", run(F.col(text_column)))


def point_id(chunk_id: str) -> str:
    """Name-based id of a chunk's point."""
    return str(uuid.uuid5(uuid.NAMESPACE_DNS, chunk_id))


def point_ids(df: DataFrame) -> DataFrame:
    @F.arrow_udf("string")
    def run(ids: pa.Array) -> pa.Array:
        return pa.array([None if x is None else point_id(x) for x in ids.to_pylist()], pa.string())

    return df.withColumn("point_id", run(F.col("chunk_id")))


def with_metrics(chunks: DataFrame, metrics: DataFrame) -> DataFrame:
    """Coupling of each chunk's file; files without metrics count as (0, 0, 0.0)."""
    own = metrics.select("path", F.col("ca").alias("afferent_coupling"), F.col("ce").alias("efferent_coupling"), "instability")
    return chunks.join(own, "path", "left").fillna({"afferent_coupling": 0, "efferent_coupling": 0, "instability": 0.0})


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """The table after new points replaced old ones of the same id."""
    return old.join(new.select("point_id").distinct(), "point_id", "left_anti").unionByName(new)


def latest(points: DataFrame, by: str = "indexed_at") -> DataFrame:
    """The newest row of each point (ties: the greatest row), as one combined maximum."""
    rest = [c for c in points.columns if c not in ("point_id", by)]
    best = points.groupBy("point_id").agg(F.max(F.struct(by, *rest)).alias("x"))
    return best.select("point_id", "x.*")


def delete_paths(points: DataFrame, paths: list[str]) -> DataFrame:
    """The table without points of these paths; an empty list deletes nothing."""
    if not paths:
        return points
    gone = points.sparkSession.createDataFrame([(p,) for p in set(paths)], "path string")
    return points.join(gone, "path", "left_anti")


def dot(vector: Column, query: list[float] | Column) -> Column:
    """Inner product in double precision, in vector order; cosine for unit vectors."""
    other = query if isinstance(query, Column) else F.array(*[F.lit(float(x)) for x in query])
    return F.aggregate(F.zip_with(vector, other, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)


def search(points: DataFrame, query: list[float], limit: int = 10, paths: list[str] | DataFrame | None = None, min_score: float = 0.0, vector_column: str = "vector") -> DataFrame:
    """The best ``limit`` points by score, then id, with ``score`` and ``rank``.

    ``paths`` None searches everything, an empty list finds nothing; ``min_score`` 0 sets no threshold.
    """
    if isinstance(paths, list):
        if not paths:
            points = points.limit(0)
        else:
            wanted = points.sparkSession.createDataFrame([(p,) for p in set(paths)], "path string")
            points = points.join(F.broadcast(wanted) if len(paths) <= 10_000 else wanted, "path", "left_semi")
    elif paths is not None:
        points = points.join(paths.select("path").distinct(), "path", "left_semi")
    scored = points.withColumn("score", dot(F.col(vector_column), query))
    if min_score:
        scored = scored.where(F.col("score") >= min_score)
    top = scored.orderBy(F.desc("score"), "point_id").limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "point_id")))  # over at most ``limit`` rows


#: Vectors of one block; a pair of blocks is scored by one matrix product.
BLOCK = 1024


def _packed(rows: DataFrame, name: str) -> DataFrame:
    """Blocks ``<name>_ids, <name>_dims, <name>_values`` of ``rows`` (``id``, ``v array<double>``), each of one vector length and sorted by id.

    Vectors that are null or hold a null have no score and are left out.
    """
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vectors = batch.column(0), batch.column(1)
            lengths = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
            for n in np.unique(lengths):
                rows_of_n = np.flatnonzero(lengths == n)
                for at in range(0, len(rows_of_n), BLOCK):
                    part = pa.array(rows_of_n[at : at + BLOCK])
                    key = pa.ListArray.from_arrays([0, len(part)], ids.take(part))
                    value = pa.ListArray.from_arrays([0, len(part) * int(n)], vectors.take(part).flatten())
                    yield pa.RecordBatch.from_arrays([key, pa.array([int(n)], pa.int32()), value], [f"{name}_ids", f"{name}_dims", f"{name}_values"])

    whole = rows.where("id is not null and v is not null and not exists(v, x -> x is null)")
    return whole.mapInArrow(run, f"{name}_ids array<{kind}>, {name}_dims int, {name}_values array<double>")


def _in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows in vector order, the same to the last bit as :func:`dot`."""
    out = np.zeros(len(a))
    for k in range(a.shape[1]):
        out += a[:, k] * b[:, k]
    return out


def _best_of_block(queries: np.ndarray, points: np.ndarray, limit: int, min_score: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query row, point row and exact score of the best ``limit`` points of each query (ties: the lesser point row).

    The matrix product only chooses: whatever its rounding could have moved past the border is scored again in order.
    """
    with np.errstate(all="ignore"):
        rough = queries @ points.T
        slack = 4 * (points.shape[1] + 1) * np.finfo(float).eps * np.outer(np.abs(queries).sum(1), np.abs(points).max(initial=0.0))
        border = np.partition(rough, -limit, axis=1)[:, [-limit]] - slack if rough.shape[1] > limit else np.full((len(queries), 1), -np.inf)
        if min_score:
            border = np.fmax(border, min_score - slack)
        q, p = np.nonzero(~(rough < border))  # what is no number is never cut here
        score = _in_order(queries[q], points[p])
    order = np.lexsort((p, np.where(np.isnan(score), 0.0, -score), ~np.isnan(score), q))  # as Spark sorts: NaN is greatest
    q, p, score = q[order], p[order], score[order]
    first = np.searchsorted(q, q)
    keep = np.arange(len(q)) - first < limit
    if min_score:
        keep &= ~(score < min_score)
    return q[keep], p[keep], score[keep]


def search_all(points: DataFrame, queries: DataFrame, limit: int = 10, paths: DataFrame | None = None, min_score: float = 0.0, vector_column: str = "vector") -> DataFrame:
    """:func:`search` for every row of ``queries`` (``query_id``, ``vector``): the columns of ``points`` without the vector, ``query_id``, ``score``, ``rank``.

    Ids are unique in either table.  Blocks of queries meet blocks of points; a task keeps the best ``limit`` of each query
    over the blocks it has seen, so only those are shuffled.  Vectors of other lengths than a query's have no score.
    """
    if limit < 1:
        raise ValueError("limit must be positive")
    if paths is not None:
        points = points.join(paths.select("path").distinct(), "path", "left_semi")
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wide = F.col(vector_column).cast("array<double>").alias("v")
    right = _packed(points.select(F.col("point_id").alias("id"), wide).repartition(parts, "id").sortWithinPartitions("id"), "p")
    left = _packed(queries.select(F.col("query_id").alias("id"), F.col("vector").cast("array<double>").alias("v")).repartition("id").sortWithinPartitions("id"), "q")
    kinds = [df.schema[name].dataType for df, name in ((queries, "query_id"), (points, "point_id"))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[object, pa.Table] = {}  # of each block of queries, by its least id and length

        def merged(held: pa.Table) -> pa.Table:
            """The best of each query over all blocks seen; ties by point id."""
            held = held.sort_by([("query_id", "ascending"), ("nan", "descending"), ("score", "descending"), ("point_id", "ascending")])
            ids = held["query_id"].combine_chunks().dictionary_encode().indices.to_numpy()
            return held.take(pa.array(np.flatnonzero(np.arange(len(ids)) - np.searchsorted(ids, ids) < limit)))

        for batch in batches:
            for row in range(batch.num_rows):
                cell = lambda name: batch.column(batch.schema.get_field_index(name))[row]  # noqa: B023, E731
                n = cell("q_dims").as_py()
                if n != cell("p_dims").as_py():
                    continue
                q_ids, p_ids = cell("q_ids").values, cell("p_ids").values
                a, b = (cell(x).values.to_numpy(zero_copy_only=False).reshape(len(ids), n) for x, ids in (("q_values", q_ids), ("p_values", p_ids)))
                q, p, score = _best_of_block(a, b, limit, min_score)
                got = pa.table({"query_id": q_ids.take(pa.array(q)), "point_id": p_ids.take(pa.array(p)), "score": pa.array(score), "nan": pa.array(np.isnan(score))})
                key = (q_ids[0].as_py(), n)
                best[key] = merged(pa.concat_tables([best.pop(key), got])) if key in best else got
                if len(best) > 16:  # the block used longest ago is done, or comes again and is merged later
                    yield from best.pop(next(iter(best))).drop_columns(["nan"]).to_batches()
        for held in best.values():
            yield from held.drop_columns(["nan"]).to_batches()

    schema = f"query_id {kinds[0].simpleString()}, point_id {kinds[1].simpleString()}, score double"
    some = left.crossJoin(right).mapInArrow(run, schema)
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "point_id")
    top = some.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= limit)
    return top.join(points.drop(vector_column), "point_id")


def citation(df: DataFrame) -> DataFrame:
    return df.withColumn("citation", F.format_string("%s:%d-%d", F.col("path"), F.col("line_start"), F.col("line_end")))


class VectorStore:
    """Versioned table of points under a folder all executors share."""

    def __init__(self, spark: SparkSession, folder: str, embedder_name: str, dimensions: int) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self.embedder_name, self.dimensions = embedder_name, dimensions

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _fs(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def version(self) -> str | None:
        """Folder of the current version; an index made by another embedder is refused."""
        if not self._fs().exists(self._path("CURRENT")):
            return None
        name, embedder, dimensions = self.spark.read.text(f"{self.folder}/CURRENT").first()[0].split("\t")
        if (embedder, int(dimensions)) != (self.embedder_name, self.dimensions):
            raise ValueError(f"the index holds vectors of {embedder} ({dimensions}), not of {self.embedder_name} ({self.dimensions})")
        return name

    def points(self) -> DataFrame | None:
        name = self.version()
        return None if name is None else self.spark.read.parquet(f"{self.folder}/{name}")

    def write(self, points: DataFrame) -> None:
        """A new version, then the pointer to it, put in place of the old one at once.

        The version before stays for readers that hold it; older ones are deleted.
        """
        before = self.version()
        name = f"v-{uuid.uuid4().hex}"
        # a path that holds a third of all points is written by several tasks
        points.repartition("path", F.pmod(F.xxhash64("point_id"), F.lit(8))).write.option("parquet.bloom.filter.enabled#path", "true").parquet(f"{self.folder}/{name}")
        out = self._fs().create(self._path("CURRENT.new"), True)
        out.write(f"{name}\t{self.embedder_name}\t{self.dimensions}".encode())
        out.close()
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        modes = gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        modes[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("CURRENT").toUri(), self.spark._jsc.hadoopConfiguration())
        context.rename(self._fs().makeQualified(self._path("CURRENT.new")), self._fs().makeQualified(self._path("CURRENT")), modes)
        for status in self._fs().listStatus(self._path("")):
            if status.getPath().getName().startswith("v-") and status.getPath().getName() not in (name, before):
                self._fs().delete(status.getPath(), True)

    def upsert(self, new: DataFrame) -> None:
        bad = new.where(F.size("vector") != self.dimensions)
        if not bad.isEmpty():
            raise ValueError(f"vectors must have {self.dimensions} dimensions")
        old = self.points()
        self.write(new if old is None else upsert(old, new))

    def replace_paths(self, new: DataFrame) -> None:
        """Points of the paths in ``new`` are replaced, so edited declarations leave nothing stale."""
        old = self.points()
        self.write(new if old is None else old.join(new.select("path").distinct(), "path", "left_anti").unionByName(new))

    def delete_paths(self, paths: list[str]) -> None:
        old = self.points()
        if old is not None and paths:
            self.write(delete_paths(old, paths))

    def count(self) -> int:
        points = self.points()
        return 0 if points is None else points.count()

    def search(self, query: list[float], **options) -> DataFrame:
        points = self.points()
        if points is None:
            raise LookupError("nothing is indexed yet")
        return search(points, query, **options)
