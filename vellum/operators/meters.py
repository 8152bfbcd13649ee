"""Metric series: trailing meters, running averages, cadences, divergence, time left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.operators.skew import balanced_positions, running_sums

TRAILING = 20


def trailing_meter(series: DataFrame, name: str, step: str, value: str, width: int = TRAILING) -> DataFrame:
    """Lower median, mean, greatest and last of the last ``width`` values of each series, with the running mean of all.

    A series may hold any share of the rows: it is cut into range partitions, each of which gets the width - 1 rows before it.
    """
    rows = running_sums(series.select(name, step, value), name, [step], value, "_sum", "_at", width - 1)
    frame = Window.partitionBy(name, "_part").orderBy("_at").rowsBetween(1 - width, 0)
    held = F.array_sort(F.collect_list(value).over(frame))
    median = F.element_at(held, F.floor((F.size(held) + 1) / 2).cast("int"))
    met = rows.select(name, step, median.alias("median"), F.avg(value).over(frame).alias("avg"), F.max(value).over(frame).alias("max"), F.col(value).alias("value"), (F.col("_sum") / F.col("_at")).alias("global_avg"), "_lent")
    return met.where("not _lent").drop("_lent")


def weighted_meter(series: DataFrame, name: str, value: str, weight: str) -> DataFrame:
    """total / count of each name, values weighted by ``weight``."""
    return series.groupBy(name).agg(F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(weight)).alias("global_avg"))


def at_cadence(series: DataFrame, step: str, every: int) -> DataFrame:
    return series.where(F.col(step) % every == 0)


def at_epoch_ends(epoch: Column, every: int) -> Column:
    """True for the last of every ``every`` epochs, counted from 0."""
    return (epoch + 1) % every == 0


def at_later_epochs(epoch: Column, every: int) -> Column:
    """True for every ``every``-th epoch but the first."""
    return (epoch != 0) & (epoch % every == 0)


def full_batches(rows: DataFrame, name: str, order: str, batch: int) -> DataFrame:
    """Rows of each name numbered from 1 by ``order``, without the rest that fills no batch; names of any size are counted in pieces."""
    numbered = balanced_positions(rows, name, [order], None, "at", "_n").withColumn("at", F.col("at") + 1)
    return numbered.where(F.col("at") <= batch * F.floor(F.col("_n") / batch)).drop("_n")


def diverged(value: Column) -> Column:
    """True for NaN and the infinities; null is no value and has not diverged."""
    return F.coalesce(F.isnan(value) | (F.abs(value) == float("inf")), F.lit(False))


def resume_point(step: Column, steps_per_epoch: int) -> tuple[Column, Column]:
    """(epoch, steps to skip in it)."""
    return F.floor(step / steps_per_epoch), step % steps_per_epoch


def time_left(series: DataFrame, name: str, step: str, seconds: str, total: Column) -> DataFrame:
    """Running mean of the step time times the steps left."""
    rows = running_sums(series, name, [step], seconds, "_sum", "_at")
    return rows.withColumn("eta", F.col("_sum") / F.col("_at") * (total - F.col("_at"))).drop("_sum", "_at", "_part")


def run_lengths(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(key, run, value, n, ends): runs of equal consecutive values and the running count at their end.

    A key may hold any share of the rows: the row before a piece is lent to it, and runs are counted by a balanced prefix sum.
    """
    lean = running_sums(rows.select(key, order, value).withColumn("_one", F.lit(0)), key, [order], "_one", "_sum", "_at", 1)
    w = Window.partitionBy(key, "_part").orderBy("_at")
    before = F.lag(F.struct(value)).over(w)
    new = F.when(before.isNull() | ~F.col(value).eqNullSafe(before[value]), 1).otherwise(0)
    flagged = lean.withColumn("_new", new).where("not _lent").select(key, "_at", value, "_new")
    numbered = balanced_positions(flagged, key, ["_at"], "_new", "_run", None)
    return numbered.groupBy(key, (F.col("_run") + F.col("_new")).alias("run"), value).agg(F.count(F.lit(1)).alias("n"), F.max("_at").alias("ends"))
