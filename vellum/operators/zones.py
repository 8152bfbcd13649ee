"""Detections to main text zones: families, boxes, padding, fallbacks, quality summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions.text import family

FAMILIES = ("Text",)
# Colours of the families on the contact sheet, and the default.
COLOURS = {"Text": "#1f77b4", "Initial": "#d62728", "Damage": "#7f7f7f"}
DEFAULT_COLOUR = "#888888"


def exploded_detections(zones: DataFrame) -> DataFrame:
    """(zone_id, dataset, filename, pos, label, score, x0..y1) from arrays of texts; unparsable numbers become null."""
    rows = zones.select("zone_id", "dataset", "filename", F.posexplode("detections").alias("pos", "d"))
    at = lambda i: F.try_element_at("d", F.lit(i))
    corner = lambda i: at(i).try_cast("double").cast("int")
    return rows.select("zone_id", "dataset", "filename", "pos", at(1).alias("label"), at(2).try_cast("double").alias("score"), *[corner(i + 3).alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))])


def union_box(detections: DataFrame, keys: list[str], families: tuple[str, ...] = FAMILIES, least_score: float | None = None) -> DataFrame:
    """Box around the detections of the families; pages without any are absent."""
    some = detections.where(family("label").isin(*families))
    if least_score is not None:
        some = some.where(F.col("score") >= least_score)
    return some.groupBy(*keys).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.count(F.lit(1)).alias("n_boxes"))


def padded(pad: int, width: Column, height: Column) -> dict[str, Column]:
    """Corners moved out by ``pad`` and clipped to the page."""
    return {
        "x0": F.greatest(F.lit(0), F.col("x0") - pad),
        "y0": F.greatest(F.lit(0), F.col("y0") - pad),
        "x1": F.least(width, F.col("x1") + pad),
        "y1": F.least(height, F.col("y1") + pad),
    }


def main_zones(pages: DataFrame, detections: DataFrame, keys: list[str], pad: int = 0, families: tuple[str, ...] = FAMILIES) -> DataFrame:
    """pages (keys, width, height) with the padded main zone; without an in-family box the corners are null and fell_back is true."""
    boxes = union_box(detections, keys, families)
    joined = pages.join(boxes, keys, "left")
    there = F.col("n_boxes").isNotNull()
    out = joined.select(*keys, "width", "height", *[F.when(there, c).alias(n) for n, c in padded(pad, F.col("width"), F.col("height")).items()])
    return out.withColumn("fell_back", F.col("x0").isNull())


def top_detections(detections: DataFrame, keys: list[str], k: int = 8) -> DataFrame:
    """The k detections of greatest score of each page, stable by position; a null score comes last."""
    w = Window.partitionBy(*keys).orderBy(F.desc_nulls_last("score"), "pos")
    return detections.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def family_colour(label: str) -> Column:
    out = F.lit(DEFAULT_COLOUR)
    for name, colour in COLOURS.items():
        out = F.when(family(label) == name, colour).otherwise(out)
    return out


def large_enough(detections: DataFrame, width: Column, height: Column, least_share: float) -> DataFrame:
    """Boxes whose area is at least the share of the page."""
    area = (F.col("x1") - F.col("x0")).cast("long") * (F.col("y1") - F.col("y0"))
    return detections.where(area >= least_share * width.cast("double") * height)


def axis_aligned(corners: str) -> dict[str, Column]:
    """An oriented box, as an array of (x, y) structs, to its axis-aligned hull."""
    side = lambda f, n: f(F.transform(F.col(corners), lambda p: p[n]))
    return {"x0": side(F.array_min, "x"), "y0": side(F.array_min, "y"), "x1": side(F.array_max, "x"), "y1": side(F.array_max, "y")}
