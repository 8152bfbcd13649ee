"""Schedules, moving averages, losses on given logits, gradient clipping, token masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.functions.vectors import doubles, let, log_softmax, norm, softmax, total


def cosine_schedule(spark: SparkSession, base: float, final: float, steps: int, warmup: int = 0, start: float = 0.0) -> DataFrame:
    """(step, value): linear warm-up that includes ``base``, then half a cosine that never quite reaches ``final``."""
    if warmup > steps:
        raise ValueError("warm-up longer than the schedule")
    i, n = F.col("step") - warmup, steps - warmup
    rise = F.lit(start) if warmup == 1 else start + (base - start) * F.col("step") / max(1, warmup - 1)
    fall = final + 0.5 * (base - final) * (1 + F.cos(F.lit(3.141592653589793) * i / max(1, n)))
    return spark.range(steps).select(F.col("id").alias("step")).select("step", F.when(F.col("step") < warmup, rise).otherwise(fall).alias("value"))


def draw(*parts: Column | int) -> Column:
    """A whole number below 2 ** 48 from the parts' texts: the same in every engine that has md5."""
    text = F.concat_ws("|", *[x if isinstance(x, Column) else F.lit(str(x)) for x in parts])
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long")


def temperature_schedule(spark: SparkSession, warm: float, final: float, warm_epochs: int, epochs: int, start: int = 0) -> DataFrame:
    """(epoch, value): ``warm`` until epoch ``start``, linear from there to ``final`` (included) over the warm epochs, then constant."""
    rise = warm + (final - warm) * (F.col("epoch") - start) / max(1, warm_epochs - 1)
    value = F.when(F.col("epoch") < start, F.lit(warm)).when(F.col("epoch") < start + warm_epochs, rise).otherwise(F.lit(final))
    return spark.range(epochs).select(F.col("id").alias("epoch")).select("epoch", value.alias("value"))


def scaled_rate(rate: float, batch: int, world: int = 1) -> float:
    return rate * batch * world / 256


def masking_ratio(epoch: Column, start: int, ratios: list[float], spreads: list[float], *key: Column) -> Column:
    """0 before the start epoch; then one of the ratios, moved by up to its spread, both drawn by hash of the key."""
    if any(v > r for r, v in zip(ratios, spreads, strict=True)):
        raise ValueError("a spread exceeds its ratio")
    u = draw(F.lit("spread"), *key) / float(1 << 48)
    moved = F.array(*[F.lit(float(r - v)) + u * float(2 * v) for r, v in zip(ratios, spreads, strict=True)])
    return F.when(epoch < start, F.lit(0.0)).otherwise(F.element_at(moved, (F.pmod(draw(F.lit("choice"), *key), F.lit(len(ratios))) + 1).cast("int")))


def token_count(model_size: int, patch: int) -> int:
    """Patch tokens of a view."""
    return (model_size // patch) ** 2


def frozen(name: Column, epoch: Column, epochs: int) -> Column:
    """True for parameters of the last layer in the first ``epochs`` epochs, whose gradients are dropped."""
    return (epoch < epochs) & name.contains("last_layer")


def exponential_average(series: DataFrame, name: str, step: str, value: str, momentum: float) -> DataFrame:
    """(name, n, value): the fold c <- m * c + (1 - m) * x over the steps in order, from 0.

    It is the sum of (1 - m) * m ** (rows after x) * x, so a long series is added up in pieces once its rows are numbered.
    """
    from vellum.operators.skew import balanced_positions

    placed = balanced_positions(series.select(name, step, value), name, [step], None, "_at", "_n")
    weight = (1 - momentum) * F.pow(F.lit(float(momentum)), F.col("_n") - 1 - F.col("_at"))
    return placed.groupBy(name).agg(F.count(F.lit(1)).cast("int").alias("n"), F.sum(weight * F.col(value).cast("double")).alias("value"))


def blended_parameters(teacher: DataFrame, student: DataFrame, key: str, value: str, momentum: float) -> DataFrame:
    """Parameters of both, teacher * m + student * (1 - m); names on one side only are dropped."""
    t, s = teacher.select(key, F.col(value).alias("_t")), student.select(key, F.col(value).alias("_s"))
    return t.join(s, key).select(key, (momentum * F.col("_t") + (1 - momentum) * F.col("_s")).alias(value))


def cross_entropy(target: Column, logits: Column, center: Column | None, teacher_temperature: float, student_temperature: float = 0.1) -> Column:
    """-sum softmax((t - c) / T) * log_softmax(s / 0.1)."""
    t = target if center is None else F.zip_with(target, center, lambda a, b: a - b)
    return -total(F.zip_with(softmax(t, teacher_temperature), log_softmax(logits, student_temperature), lambda p, q: p * q))


def masked_mean(loss: Column, mask: Column) -> Column:
    """Sum of loss * mask over max(sum of mask, 1)."""
    m = F.transform(mask, lambda b: b.cast("double"))
    return total(F.zip_with(loss, m, lambda a, b: a * b)) / F.greatest(total(m), F.lit(1.0))


def clipped(v: str, most: float) -> tuple[Column, Column]:
    """(norm, vector scaled by most / (norm + 1e-6) where that is below 1)."""
    x = doubles(v)
    return norm(x), let(F.least(F.lit(1.0), most / (norm(x) + 1e-6)), lambda s: F.transform(x, lambda e: e * s))


def _first(ranked: Column, n: Column) -> Column:
    return F.transform(F.slice(ranked, F.lit(1), n.cast("int")), lambda s: s["i"])


def top_positions(attention: Column, ratio: float, lowest: bool = False) -> Column:
    """The int(T * ratio) positions (from 0) of the greatest, or least, elements, equal ones by position."""
    sign = 1 if lowest else -1
    order = F.array_sort(F.transform(attention, lambda x, i: F.struct((sign * x).alias("v"), i.alias("i"))))
    return _first(order, F.floor(F.size(attention) * ratio))


def top_mask(attention: Column, ratio: float, lowest: bool = False) -> Column:
    """True at the int(T * ratio) greatest (or least) positions, equal ones by position."""
    return let(top_positions(attention, ratio, lowest), lambda c: F.transform(attention, lambda x, i: F.array_contains(c, i)))


def seeded_mask(size: int, ratio: float, *key: Column) -> Column:
    """round(size * ratio) positions drawn by hash of the key."""
    order = F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.struct(draw(*key, i).alias("h"), i.alias("i"))))
    return let(_first(order, F.lit(round(size * ratio))), lambda c: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.array_contains(c, i)))


def hinted_mask(attention: Column, ratio: float, show_most: float, *key: Column) -> Column:
    """The top mask with int(T * show_most * ratio) of its int(T * show_most) most attended positions revealed, drawn by hash."""
    ranked = F.array_sort(F.transform(top_positions(attention, show_most), lambda i: F.struct(draw(*key, i).alias("h"), i.alias("i"))))
    shown = _first(ranked, F.floor(F.size(attention) * show_most * ratio))
    return let(F.array_except(top_positions(attention, ratio), shown), lambda c: F.transform(attention, lambda x, i: F.array_contains(c, i)))


def dropped_masks(mask: Column, probability: float, *key: Column) -> Column:
    """The mask, all false in rows whose uniform draw (by hash) exceeds the probability."""
    u = draw(*key) / float(1 << 48)
    return F.when(u > probability, F.transform(mask, lambda b: F.lit(False))).otherwise(mask)


def view_pairs(spark: SparkSession, n_global: int, n_views: int) -> DataFrame:
    """(q, v, kind): global views against every view; v = q is the patch term, the others the class term."""
    pairs = spark.range(n_global).select(F.col("id").alias("q")).withColumn("v", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_views - 1).cast("long"))))
    return pairs.withColumn("kind", F.when(F.col("q") == F.col("v"), "patch").otherwise("class"))


def seeded_order(rows: DataFrame, key: str, seed: int, epoch: int = 0) -> DataFrame:
    """A column ``turn`` by which an epoch's rows are shuffled: a draw by key and seed * 100003 + epoch."""
    return rows.withColumn("turn", draw(seed * 100003 + epoch, F.col(key)))


def shuffled(rows: DataFrame, key: str, seed: int, epoch: int = 0) -> DataFrame:
    """The rows with their ``position`` from 0 in the epoch's seeded order; numbered by range partitions, not in one task."""
    from vellum.operators.skew import balanced_positions

    ordered = seeded_order(rows, key, seed, epoch).withColumn("_all", F.lit(0))
    return balanced_positions(ordered, "_all", ["turn", key], None, "position", None).drop("_all", "turn")


def seeded_sample(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows without replacement, all of them if there are no more; the n least in the seeded order."""
    return seeded_order(rows, key, seed).orderBy("turn", key).limit(n).drop("turn")


def drawn_again(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n draws with replacement: the rows with ``draw_id`` 0 .. n - 1; no draws from an empty table."""
    from vellum.operators.skew import balanced_positions

    placed = balanced_positions(rows.withColumn("_all", F.lit(0)), "_all", [key], None, "_at", "_n").drop("_all")
    total = placed.agg(F.max("_n").alias("_total"))
    draws = rows.sparkSession.range(n).withColumnRenamed("id", "draw_id").join(F.broadcast(total), F.lit(True))
    return draws.withColumn("_at", F.pmod(draw(seed, F.col("draw_id")), F.col("_total"))).drop("_total").join(placed.drop("_n"), "_at").drop("_at")


def ranked_first(rows: DataFrame, by: str, order: list[Column], k: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= k)
