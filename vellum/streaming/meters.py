"""Metric meters over streams of scalar rows."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from vellum.runtime import shared_folder

TRAILING = 20


def windowed_means(stream: DataFrame, at: str, name: str, value: str, width: str = "10 minutes", late: str = "20 minutes") -> DataFrame:
    """Mean, greatest and count of each name in tumbling windows; rows later than ``late`` are dropped."""
    return stream.withWatermark(at, late).groupBy(F.window(at, width), name).agg(F.avg(value).alias("avg"), F.max(value).alias("max"), F.count(value).alias("n")).select("window.start", "window.end", name, "avg", "max", "n")


def finished(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """What the stream has given when all that is there now has been read: each batch is written, the last one counts in "complete" mode.

    Checkpoint and batches lie in the shared folder, so the run survives lost executors.
    """
    spark, home = stream.sparkSession, f"{shared_folder(stream.sparkSession)}/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{home}/batches/{n if mode != 'complete' else 0}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{home}/checkpoint").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    return spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(f"{home}/batches")


def _trail(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    held, total, count = state.get if state.exists else ([], 0.0, 0)
    held = list(held)
    for f in frames:
        for v in f.sort_values("step")["value"]:
            held = [*held, float(v)][-TRAILING:]
            total, count = total + float(v), count + 1
    state.update((held, total, count))
    if count:
        order = sorted(held)
        yield pd.DataFrame({"name": [key[0]], "n": [count], "median": [order[(len(order) - 1) // 2]], "avg": [sum(held) / len(held)], "max": [max(held)], "global_avg": [total / count]})


def trailing_meters(stream: DataFrame, name: str, step: str, value: str) -> DataFrame:
    """After each batch the meter of every name that got rows: trailing lower median, mean and greatest, mean of all.

    State holds the last values and two numbers of each name. Null values are left out; rows are taken in the order
    of ``step`` within a batch.
    """
    lean = stream.where(f"`{value}` is not null").select(F.col(name).cast("string").alias("name"), F.col(step).cast("long").alias("step"), F.col(value).cast("double").alias("value"))
    return lean.groupBy("name").applyInPandasWithState(_trail, "name string, n long, median double, avg double, max double, global_avg double", "held array<double>, total double, count long", "update", GroupStateTimeout.NoTimeout)
