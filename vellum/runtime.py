"""Session-level plumbing shared by every operator: cutting lineage, sizing fan-out."""

from __future__ import annotations

import atexit
import pickle
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

_own_folder: str | None = None
_written: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors reach, as the cluster names it in ``spark.checkpoint.dir``.

    Where the setting is missing, a temporary folder is used on a single-JVM ``local`` master only; on a
    cluster a machine-local folder would be lost with its machine, so that is an error.
    """
    global _own_folder
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    if _own_folder is None:
        _own_folder = tempfile.mkdtemp(prefix="vellum-")
        atexit.register(shutil.rmtree, _own_folder, ignore_errors=True)
    return f"file://{_own_folder}"


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage is cut and survives lost executors."""
    spark = df.sparkSession
    home = f"{shared_folder(spark)}/vellum-{spark.sparkContext.applicationId}"
    if home not in _written:
        _written.add(home)
        atexit.register(_remove, spark, home)
    path = f"{home}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    again = spark.read.schema(df.schema).parquet(path)
    again._settled_at = path
    return again


def _remove(spark: SparkSession, path: str) -> None:
    """Remove a folder; where the JVM is gone already (at the end of the application) only a file path can be removed."""
    if path.startswith("file:"):
        shutil.rmtree(path.removeprefix("file:").replace("//", "/", 1), ignore_errors=True)
        return
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jvm.org.apache.hadoop.conf.Configuration()).delete(where, True)
    except Exception:  # noqa: BLE001, S110
        pass


def discard(df: DataFrame | None) -> None:
    """Remove a table written by :func:`settle` that nothing reads any more; the others go when the application ends."""
    path = getattr(df, "_settled_at", None)
    if path:
        jvm, spark = df.sparkSession._jvm, df.sparkSession
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def fan_out(spark: SparkSession) -> int:
    """Partitions for an explicit repartitioning: the session's shuffle width, one wave of cores at least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def shared(spark: SparkSession, value) -> Callable[[], object]:
    """A function that gives ``value`` in any task. It is broadcast as its pickle, classes by value as in functions for workers."""
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    held: list = []

    def get():
        if not held:
            held.append(pickle.loads(sent.value))  # noqa: S301
        return held[0]

    return get


def private(df: DataFrame, *names: str) -> list[str]:
    """Column names for an operator's own use which clash with no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
