"""Per-key results where a few keys hold most rows.

Rows are range-partitioned on (key, order, tie-break) with Spark's sampled quantiles: because the order columns
take part in the range, a heavy key is cut into as many partitions as it needs. Each sorted partition is
folded into one partial state for each key in it; a key that crosses a partition boundary has several, and
these few are stitched in order. What follows the range shuffle is one small shuffle of states.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.runtime import fan_out, private

_STATE = "n long, first_at timestamp, last_at timestamp, first_tag string, last_tag string, switches long, longest_gap_us long, value_sum double, value_n long"
_FIELDS = [x.split()[0] for x in _STATE.split(", ")]


def _merge(a: list, b: list) -> list:
    """State of a's rows followed by b's."""
    gap = max(a[6], b[6], b[1] - a[2])
    return [a[0] + b[0], a[1], b[2], a[3], b[4], a[5] + b[5] + (a[4] != b[3]), gap, a[7] + b[7], a[8] + b[8]]


def _partials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns k (key), t (order, microseconds), g (tag), v (value or null), sorted by k, t; one state a key."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    schema = pa.schema([("k", pa.string()), ("part", pa.int32()), ("n", pa.int64()), ("first_at", pa.timestamp("us", "UTC")), ("last_at", pa.timestamp("us", "UTC")), ("first_tag", pa.string()), ("last_tag", pa.string()), ("switches", pa.int64()), ("longest_gap_us", pa.int64()), ("value_sum", pa.float64()), ("value_n", pa.int64())])

    def rows(keys: list, states: list) -> pa.RecordBatch:
        cols = list(zip(*states, strict=True))
        return pa.record_batch([pa.array(keys, pa.string()), pa.array([part] * len(keys), pa.int32())] + [pa.array(c, f.type) for c, f in zip(cols, list(schema)[2:], strict=True)], schema=schema)

    held_key, held = None, None
    for b in batches:
        if not b.num_rows:
            continue
        k, t, g = b.column("k"), b.column("t").to_numpy(zero_copy_only=False), b.column("g")
        v = b.column("v").to_numpy(zero_copy_only=False)
        good = ~np.isnan(v)
        n = len(t)
        new = np.ones(n, bool)
        other = np.zeros(n, bool)
        if n > 1:
            new[1:] = pc.not_equal(k.slice(1), k.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            other[1:] = pc.not_equal(g.slice(1), g.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        at = np.flatnonzero(new)
        end = np.append(at[1:], n)
        step = np.zeros(n, np.int64)
        step[1:] = t[1:] - t[:-1]
        step[new] = 0
        other[new] = False
        keys = k.take(pa.array(at)).to_pylist()
        states = [
            list(x)
            for x in zip(
                (end - at).tolist(), t[at].tolist(), t[end - 1].tolist(), g.take(pa.array(at)).to_pylist(), g.take(pa.array(end - 1)).to_pylist(),
                np.add.reduceat(other.astype(np.int64), at).tolist(), np.maximum.reduceat(step, at).tolist(), np.add.reduceat(np.where(good, v, 0.0), at).tolist(), np.add.reduceat(good.astype(np.int64), at).tolist(),
                strict=True,
            )
        ]
        if held is not None and keys[0] == held_key:
            states[0] = _merge(held, states[0])
        elif held is not None:
            keys.insert(0, held_key)
            states.insert(0, held)
        held_key, held = keys.pop(), states.pop()
        if keys:
            yield rows(keys, states)
    if held is not None:
        yield rows([held_key], [held])


def balanced_key_results(df: DataFrame, key: str, order: str, tie: str, tag: str, value: str, partitions: int | None = None) -> DataFrame:
    """One row for each non-null key: (key, n_rows, first_at, last_at, n_switches, longest_gap_s, mean_value).

    ``order`` is a timestamp, ``tie`` settles equal times, ``tag`` is a text whose changes between successive
    rows of a key are counted (null counts as the empty text), ``value`` a number whose mean is taken over its
    finite cells (null mean without any). Rows with a null key are left out; a null order sorts first and
    counts as the time 0 (1970). Repeated rows count as they stand. An empty table gives no rows; a key may
    hold any share of the rows. Extra columns are pruned.
    """
    n = partitions or fan_out(df.sparkSession)
    c = lambda x: F.col(f"`{x}`")
    number = c(value).cast("double")
    lean = df.where(c(key).isNotNull()).select(
        c(key).alias("k"),
        F.coalesce(F.unix_micros(c(order).cast("timestamp")), F.lit(0)).cast("long").alias("t"),
        c(tie).alias("o"),
        F.coalesce(c(tag), F.lit("")).alias("g"),
        F.when(F.isnan(number) | (F.abs(number) == float("inf")), None).otherwise(number).alias("v"),
    )
    ranged = lean.repartitionByRange(n, "k", "t", "o", "g", "v").sortWithinPartitions("k", "t", "o", "g", "v").select("k", "t", "g", "v")
    partial = ranged.mapInArrow(_partials, f"k string, part int, {_STATE}")
    pieces = partial.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("part", *_FIELDS))).alias("p"))

    def stitch(a, b):
        gap = F.greatest(a["longest_gap_us"], b["longest_gap_us"], F.unix_micros(b["first_at"]) - F.unix_micros(a["last_at"]))
        return F.struct(
            b["part"].alias("part"), (a["n"] + b["n"]).alias("n"), a["first_at"].alias("first_at"), b["last_at"].alias("last_at"), a["first_tag"].alias("first_tag"), b["last_tag"].alias("last_tag"),
            (a["switches"] + b["switches"] + (a["last_tag"] != b["first_tag"]).cast("long")).alias("switches"), gap.alias("longest_gap_us"), (a["value_sum"] + b["value_sum"]).alias("value_sum"), (a["value_n"] + b["value_n"]).alias("value_n"),
        )

    whole = F.aggregate(F.slice("p", 2, F.greatest(F.size("p") - 1, F.lit(0))), F.element_at("p", 1), stitch)
    return pieces.select("k", whole.alias("w")).select(
        F.col("k").alias(key),
        F.col("w.n").alias("n_rows"),
        F.col("w.first_at").alias("first_at"),
        F.col("w.last_at").alias("last_at"),
        F.col("w.switches").alias("n_switches"),
        (F.col("w.longest_gap_us") / 1e6).alias("longest_gap_s"),
        F.when(F.col("w.value_n") > 0, F.col("w.value_sum") / F.col("w.value_n")).alias("mean_value"),
    )


def _numbered(key: str, size: str):
    """Rows sorted by key: the sum of ``size`` before each row within its key and partition, and the partition's number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        last, carry = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            k, sizes = b.column(key), b.column(size).to_numpy(zero_copy_only=False)
            n = b.num_rows
            new = np.ones(n, bool)
            if n > 1:
                a, c = k.slice(1), k.slice(0, n - 1)
                same = pc.or_(pc.fill_null(pc.equal(a, c), False), pc.and_(a.is_null(), c.is_null()))
                new[1:] = ~same.to_numpy(zero_copy_only=False)
            goes_on = last is not None and last[0] == k[0].as_py()
            before = np.cumsum(sizes) - sizes
            first = np.flatnonzero(new)
            inner = before - np.repeat(before[first], np.diff(np.append(first, n)))
            if goes_on:
                inner[: first[1] if len(first) > 1 else n] += carry
            last, carry = (k[n - 1].as_py(),), inner[-1] + sizes[-1]
            yield pa.record_batch([*b.columns, pa.array(inner), pa.array(np.full(n, part, np.int32))], names=[*b.schema.names, "_inner", "_part"])

    return run


def ordered_pieces(df: DataFrame, key: str, order: list[str], size: Column | None = None, inner: str = "_inner", part: str = "_part") -> DataFrame:
    """``df``, settled in range partitions of (key, order), with the partition ``part`` and, in ``inner``, the sum of ``size``
    (1 if None) before each row among the rows of its key in its partition.

    One range shuffle sorts the rows; the numbers come from a pass over each sorted partition. A heavy key is cut into
    as many partitions as it needs. Null sizes count 0; null keys form one key.
    """
    from vellum.runtime import settle

    (sz,) = private(df, "_size")
    c = lambda x: F.col(f"`{x}`")
    amount = F.lit(1).cast("long") if size is None else size
    by = [c(key), *map(c, order)]
    ranged = df.withColumn(sz, amount).repartitionByRange(fan_out(df.sparkSession), *by).sortWithinPartitions(*by)
    kind = ranged.schema[sz].dataType.simpleString()
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranged.schema)
    return settle(ranged.mapInArrow(_numbered(key, sz), f"{schema}, _inner {kind}, _part int").withColumnsRenamed({"_inner": inner, "_part": part, sz: f"{inner}size"}))


def before_pieces(pieces: DataFrame, key: str, inner: str = "_inner", part: str = "_part", shift: str = "_shift") -> DataFrame:
    """(key, part, shift): what a key's earlier partitions add up to, for keys in more than one partition only.

    Such keys are the last of one partition and the first of the next, so there are fewer than two rows a partition.
    """
    from pyspark.sql import Window

    sums = pieces.groupBy(F.col(f"`{key}`").alias("pk"), F.col(part).alias("pp")).agg(F.max(F.col(inner) + F.col(f"{inner}size")).alias("ps"))
    crossing = sums.withColumn("cuts", F.count(F.lit(1)).over(Window.partitionBy("pk"))).where("cuts > 1")
    return crossing.select("pk", "pp", (F.sum("ps").over(Window.partitionBy("pk").orderBy("pp")) - F.col("ps")).alias(shift))


def balanced_positions(df: DataFrame, key: str, order: list[str], size: str | None, position: str = "position", total: str | None = "total") -> DataFrame:
    """``df`` with the running sum of ``size`` (1 if None) before each row of its key, and the key's total unless that name is None.

    The prefix sum of a hot key is spread over partitions: rows are ranged on (key, order) and numbered in their
    partition; the rows of a key that crosses partitions are shifted by the sum of its earlier ones, which comes
    from a broadcast of fewer than two rows a partition. ``order`` must be unique within a key for a defined
    result. Sizes are whole numbers of 0 or more; null sizes count 0; null keys form one key.
    """
    c = lambda x: F.col(f"`{x}`")
    inner, part, shift = private(df, "_inner", "_part", "_shift")
    amount = None if size is None else F.coalesce(c(size).cast("long"), F.lit(0).cast("long"))
    pieces = ordered_pieces(df, key, order, amount, inner, part)
    early = before_pieces(pieces, key, inner, part, shift)
    placed = pieces.join(F.broadcast(early), (F.col(part) == F.col("pp")) & c(key).eqNullSafe(F.col("pk")), "left")
    out = placed.select(*[c(x) for x in df.columns], (F.col(inner) + F.coalesce(shift, F.lit(0).cast("long"))).alias(position))
    if total is None:
        return out
    whole = pieces.groupBy(c(key).alias("pk")).agg(F.sum(f"{inner}size").alias(total))
    return out.join(whole, c(key).eqNullSafe(F.col("pk"))).drop("pk")


def running_sums(df: DataFrame, key: str, order: list[str], value: str, total: str = "running", count: str = "at", halo: int = 0, halo_flag: str = "_lent") -> DataFrame:
    """``df`` with the running sum of ``value`` to each row of its key, itself included, and its number from 1; see :func:`balanced_positions`.

    Also _part, the range partition. With ``halo`` the last ``halo`` rows of a key before a partition are lent to it,
    flagged by ``halo_flag`` (a boolean, false for the rows themselves), so that frames of ``halo`` rows before
    a row can be taken within (key, _part). Null values count 0.
    """
    from pyspark.sql import Window

    c = lambda x: F.col(f"`{x}`")
    numbers = ordered_pieces(df.withColumn("_v", F.coalesce(c(value).cast("double"), F.lit(0.0))), key, order)
    local = numbers.withColumn("_local", F.sum("_v").over(Window.partitionBy("_part", c(key)).orderBy("_inner").rowsBetween(Window.unboundedPreceding, 0)))
    sums = numbers.groupBy(c(key).alias("pk"), F.col("_part").alias("pp")).agg(F.sum("_v").alias("s"), F.count(F.lit(1)).alias("n"))
    by = Window.partitionBy("pk").orderBy("pp").rowsBetween(Window.unboundedPreceding, -1)
    # only keys that cross partitions, fewer than two rows a partition
    early = sums.withColumn("cuts", F.count(F.lit(1)).over(Window.partitionBy("pk"))).where("cuts > 1")
    early = early.select("pk", "pp", F.coalesce(F.sum("s").over(by), F.lit(0.0)).alias("s0"), F.coalesce(F.sum("n").over(by), F.lit(0)).alias("n0"), F.lag("pp").over(Window.partitionBy("pk").orderBy("pp")).alias("before"), "n")
    whole = local.join(F.broadcast(early.select("pk", "pp", "s0", "n0")), (F.col("_part") == F.col("pp")) & c(key).eqNullSafe(F.col("pk")), "left")
    own = whole.select(*map(c, df.columns), (F.col("_local") + F.coalesce("s0", F.lit(0.0))).alias(total), (F.col("_inner") + 1 + F.coalesce("n0", F.lit(0))).alias(count), "_part", F.lit(False).alias(halo_flag))
    if not halo:
        return own.drop(halo_flag)
    # a row is lent to every later partition of its key that starts fewer than ``halo`` rows behind it
    reach = early.where("n0 > 0").select(F.col("pk").alias("k2"), F.col("pp").alias("to"), "n0")
    tails = own.join(F.broadcast(reach), c(key).eqNullSafe(F.col("k2")) & (F.col(count) <= F.col("n0")) & (F.col(count) > F.col("n0") - halo))
    return own.unionByName(tails.select(*map(c, df.columns), total, count, F.col("to").alias("_part"), F.lit(True).alias(halo_flag)))
