"""Sliding-window crops of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions.vectors import fraction_below, total
from vellum.operators.training_math import draw


def stride_of(size: int, overlap: float) -> int:
    """Half-even rounding of size * (1 - overlap), 1 at least."""
    if not 0 <= overlap < 1:
        raise ValueError(f"{overlap} is no share by which windows can overlap")
    return max(1, round(size * (1.0 - overlap)))


def starts(origin: Column, extent: Column, size: int, stride: int) -> Column:
    """Window starts on an axis: the origin alone if the extent is no larger than a window, else all that fit."""
    return F.when(extent <= size, F.array(origin)).otherwise(F.sequence(origin, F.greatest(origin, origin + extent - size), F.lit(stride)))


def window_grid(pages: DataFrame, size: int = 512, overlap: float = 0.5) -> DataFrame:
    """One row a window: the columns of ``pages`` and x, y, size.

    pages has width, height and, optionally null, x0, y0, x1, y1: bounds that are clipped to the page. The strip after the
    last window that fits stays uncovered; a page smaller than a window has one window at the origin. Rows with a null size give none.
    """
    stride = stride_of(size, overlap)
    zoned = {"x0", "y0", "x1", "y1"} <= set(pages.columns)
    w, h = F.col("width"), F.col("height")
    lo = lambda c, m: F.least(F.greatest(F.coalesce(F.col(c), F.lit(0)), F.lit(0)), m) if zoned else F.lit(0)
    hi = lambda c, m: F.greatest(F.least(F.coalesce(F.col(c), m), m), F.lit(0)) if zoned else m
    known = pages.where("width is not null and height is not null")
    axes = known.withColumns({"_ax": lo("x0", w), "_ay": lo("y0", h), "_bx": hi("x1", w), "_by": hi("y1", h)})
    ys = starts(F.col("_ay"), F.col("_by") - F.col("_ay"), size, stride)
    xs = starts(F.col("_ax"), F.col("_bx") - F.col("_ax"), size, stride)
    return axes.withColumn("y", F.explode(ys)).withColumn("x", F.explode(xs)).withColumn("size", F.lit(size)).drop("_ax", "_ay", "_bx", "_by")


def legacy_grid_a(pages: DataFrame, size: int, overlap: float) -> DataFrame:
    """The older grid whose range excludes its end, so that an exactly fitting last window is missing; pages must hold a window."""
    stride = int(size - size * overlap)
    axis = lambda n: F.sequence(F.lit(0), n - size - 1, F.lit(stride))
    fits = pages.where((F.col("width") > size) & (F.col("height") > size))
    return fits.withColumn("y", F.explode(axis(F.col("height")))).withColumn("x", F.explode(axis(F.col("width"))))


def legacy_grid_b(pages: DataFrame, size: int = 256, stride: int = 32) -> DataFrame:
    """The older dense grid, ends included; pages smaller than a window give none."""
    axis = lambda n: F.sequence(F.lit(0), n - size, F.lit(stride))
    fits = pages.where((F.col("width") >= size) & (F.col("height") >= size))
    return fits.withColumn("y", F.explode(axis(F.col("height")))).withColumn("x", F.explode(axis(F.col("width"))))


def foreground(rows: DataFrame, pixels: str, threshold: float, least: float) -> DataFrame:
    """Rows whose share of pixels under the threshold is at least ``least``; no filter at all if that is 0 or less."""
    return rows if least <= 0 else rows.where(fraction_below(F.col(pixels), threshold) >= least)


def crop_views(windows: DataFrame, n_global: int = 2, n_local: int = 4) -> DataFrame:
    """Each window once for every view: 1-based view number and kind."""
    views = F.sequence(F.lit(1), F.lit(n_global + n_local))
    return windows.withColumn("view", F.explode(views)).withColumn("kind", F.when(F.col("view") <= n_global, "global").otherwise("local"))


def cut_out(pixels: Column, width: Column | int, x: Column, y: Column, size: int) -> Column:
    """The pixels of a window, row by row, from a page's flat array."""
    return F.flatten(F.transform(F.sequence(y, y + size - 1), lambda r: F.slice(pixels, (r * width + x + 1).cast("int"), size)))


def sampled_windows(pages: DataFrame, pixels: str, size: int, overlap: float, threshold: float, least: float) -> DataFrame:
    """The windows of the grid whose share of pixels under the threshold is at least ``least``, with that share as ``ink``.

    pages has width, height and the flat array ``pixels``; windows must fit. With ``least`` of 0 or less all windows stay.
    """
    met = window_grid(pages, size, overlap)
    inked = met.withColumn("ink", fraction_below(cut_out(F.col(pixels), F.col("width"), F.col("x"), F.col("y"), size), threshold)).drop(pixels)
    return inked if least <= 0 else inked.where(F.col("ink") >= least)


def random_windows(pages: DataFrame, keys: list[str], found: DataFrame, n: int, seed: int) -> DataFrame:
    """(keys, draw_id, x, y, n_windows): n windows of each page drawn with replacement from ``found`` (keys, x, y), by hash.

    A page without any gets n rows with null corners, which stand for the whole page, and n_windows 0. A page's windows are a bounded list.
    """
    listed = found.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("y", "x"))).alias("_w"))
    drawn = pages.select(*keys).join(listed, keys, "left").withColumn("draw_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    size = F.coalesce(F.size("_w"), F.lit(0))
    pick = F.when(F.col("_w").isNotNull(), F.element_at("_w", (F.pmod(draw(seed, *[F.col(k) for k in keys], F.col("draw_id")), F.size("_w").cast("long")) + 1).cast("int")))
    return drawn.withColumn("_p", pick).select(*keys, "draw_id", F.col("_p.x").alias("x"), F.col("_p.y").alias("y"), size.alias("n_windows"))


def page_index(pages: DataFrame, keys: list[str], size: int = 512, overlap: float = 0.5) -> DataFrame:
    """(keys, n_windows, windows): a page's windows as one array of (x, y), row by row; no page at all is an error."""
    if not pages.limit(1).count():
        raise ValueError("there are no pages to index")
    held = window_grid(pages, size, overlap).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("y", "x"))).alias("w"))
    return held.select(*keys, F.size("w").alias("n_windows"), F.transform("w", lambda p: F.array(p["x"], p["y"])).alias("windows"))


def not_blank(rows: DataFrame, pixels: str, least: float) -> DataFrame:
    """The older filter: rows whose share of pixels other than 0 is at least ``least``; no filter if that is 0 or less."""
    share = F.try_divide(F.size(F.filter(F.col(pixels), lambda x: x != 0)).cast("double"), F.size(pixels))
    return rows if least <= 0 else rows.where(share >= least)


def foreground_tokens(pixels: Column, width: int, height: int, cell: int, least_white: float) -> Column:
    """Positions of the cells (of ``cell`` x ``cell`` pixels, row by row) whose mean is under ``least_white``."""
    across = width // cell
    mean = lambda t: total(F.transform(cut_out(pixels, width, (t % across) * cell, F.floor(t / across).cast("int") * cell, cell), lambda x: x.cast("double"))) / (cell * cell)
    return F.filter(F.sequence(F.lit(0), F.lit(across * (height // cell) - 1)), lambda t: mean(t) < least_white)
