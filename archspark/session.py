"""Session helpers shared by every operator: table access and durable intermediate results."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table as a DataFrame; the columns needed are pruned by Catalyst."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors share: ``spark.checkpoint.dir`` of the session, or the checkpoint folder its context was given.

    Only where the session has none (tests, a laptop) a folder of our own is made, and remembered in the session.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        given = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = given.get() if given.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="archspark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage by writing a table in the shared folder and reading it again.

    A written table survives lost executors, is columnar and compressed, and is read with column pruning, which
    ``checkpoint()`` of rows is not.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/archspark-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._durable_path = path
    _made[path] = spark
    return out


_made: dict[str, SparkSession] = {}


@atexit.register
def _drop_all() -> None:
    """Leave nothing in the shared folder when the driver ends in order."""
    for path, spark in list(_made.items()):
        try:
            _delete(spark, path)
        except Exception:  # the session is gone; the folder is the cluster's to clear
            return


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    _made.pop(path, None)


def drop_durable(*tables: DataFrame) -> None:
    """Delete tables written by :func:`durable` that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_durable_path", None)
        if path:
            _delete(df.sparkSession, path)
