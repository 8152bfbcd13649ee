"""Token and window vectors to page vectors."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.functions.vectors import doubles, l2_normalized
from vellum.operators.training_math import ranked_first, seeded_order


def mean_vectors(rows: DataFrame, keys: list[str], vec: str, out: str = "vec") -> DataFrame:
    """Mean of the vectors of each key, combined map-side as whole vectors instead of one row an element."""
    return rows.groupBy(*keys).agg(Summarizer.mean(array_to_vector(doubles(vec))).alias("_m")).select(*keys, vector_to_array("_m").alias(out))


def pooled_mean(tokens: DataFrame, page: str, window: str, pos: str, vec: str, n_class: int) -> DataFrame:
    """(page, vec, n_windows): mean of patch tokens of a window, mean of windows, unit length."""
    windows = mean_vectors(tokens.where(F.col(pos) >= n_class), [page, window], vec)
    pages = mean_vectors(windows, [page], "vec")
    counts = windows.groupBy(page).agg(F.count(F.lit(1)).alias("n_windows"))
    return pages.join(counts, page).select(page, l2_normalized(F.col("vec")).alias("vec"), "n_windows")


def pooled_class(tokens: DataFrame, page: str, window: str, pos: str, vec: str, n_class: int) -> DataFrame:
    """(page, vec, n_windows): class tokens of a window end to end, mean of windows, unit length."""
    heads = tokens.where(F.col(pos) < n_class).groupBy(page, window).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), doubles(vec).alias("v")))), lambda x: x["v"])).alias("vec"))
    pages = mean_vectors(heads, [page], "vec")
    counts = heads.groupBy(page).agg(F.count(F.lit(1)).alias("n_windows"))
    return pages.join(counts, page).select(page, l2_normalized(F.col("vec")).alias("vec"), "n_windows")


def patch_rows(tokens: DataFrame, page: str, window: str, pos: str, vec: str, n_class: int) -> DataFrame:
    """(row, page, vec): every patch token, window-major, numbered from 0 over the whole table by a distributed count."""
    from vellum.operators.skew import balanced_positions

    kept = tokens.where(F.col(pos) >= n_class).select(F.col(page).alias("page"), F.col(window).alias("window"), F.col(pos).alias("pos"), F.col(vec).alias("vec"), F.lit(0).alias("one"))
    return balanced_positions(kept, "one", ["page", "window", "pos"], None, "row", None).select("row", "page", "vec")


def pooled(tokens: DataFrame, how: str, page: str, window: str, pos: str, vec: str, n_class: int) -> DataFrame:
    """One row a page (or, for "patches", a patch token) by the named strategy: mean, cls or patches."""
    ways = {"mean": pooled_mean, "cls": pooled_class, "patches": patch_rows}
    if how not in ways:
        raise ValueError(f"no pooling {how!r}; known: {sorted(ways)}")
    return ways[how](tokens, page, window, pos, vec, n_class)


def taken_tokens(rows: DataFrame, tokens: str, keep: list[int]) -> DataFrame:
    """Token 0 and the patch tokens with the ids ``keep``."""
    return rows.withColumn(tokens, F.concat(F.slice(tokens, 1, 1), F.transform(F.array(*map(F.lit, keep)), lambda i: F.element_at(tokens, i + 2))))


def projector_vectors(patches: DataFrame, page: str, window: str, vec: str, seed: int, most: int = 4) -> DataFrame:
    """(page, vec): mean of all patch tokens of at most ``most`` windows a page, drawn in the seeded order, at unit length."""
    windows = patches.select(page, window).distinct().withColumn("_key", F.concat_ws("|", page, window))
    drawn = ranked_first(seeded_order(windows, "_key", seed), page, [F.col("turn"), F.col(window)], most).select(page, window)
    return mean_vectors(patches.join(drawn, [page, window]), [page], vec).select(page, l2_normalized(F.col("vec")).alias("vec"))
