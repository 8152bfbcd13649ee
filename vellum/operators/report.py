"""Reports as HTML pages of bounded size, made where the rows are; only legends pass through the driver."""

from __future__ import annotations

import colorsys
import html

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.functions.text import html_escaped
from vellum.operators.skew import balanced_positions

MOST_PAGES, MOST_POINTS, LEGEND = 500, 20_000, 60


def palette(n: int) -> list[str]:
    """n colours around the wheel."""
    return ["#" + "".join(f"{round(c * 255):02x}" for c in colorsys.hsv_to_rgb(i / max(n, 1), 0.65, 0.85)) for i in range(n)]


def legend(rows: DataFrame, category: str, most: int = LEGEND) -> DataFrame:
    """(category, count) by falling count, then name; the first ``most``."""
    return rows.groupBy(F.col(category).alias("category")).count().orderBy(F.desc("count"), "category").limit(most)


def _pages(lines: DataFrame, order: list[str], most: int, head: str, tail: str) -> DataFrame:
    """(page, html): the lines (order columns, line) in order, ``most`` on each page, so that no page grows with the table."""
    placed = balanced_positions(lines.withColumn("_all", F.lit(0)), "_all", order, None, "_at", None)
    held = placed.withColumn("page", F.floor(F.col("_at") / most)).groupBy("page").agg(F.array_sort(F.collect_list(F.struct("_at", "line"))).alias("l"))
    return held.select("page", F.concat(F.lit(head), F.array_join(F.transform("l", lambda x: x["line"]), "\n"), F.lit(tail)).alias("html"))


def scatter_pages(points: DataFrame, x: str, y: str, category: str, title: str = "vectors", most: int = MOST_POINTS) -> DataFrame:
    """(page, html): a dot a row, all rows on as many pages as they need, each with the legend of the LEGEND largest categories."""
    kinds = [(r[0], r[1]) for r in legend(points, category).collect()]
    rest = points.agg(F.count_distinct(category)).first()[0] - len([k for k, _ in kinds if k is not None])
    colour = dict(zip([k for k, _ in kinds], palette(len(kinds)), strict=True))
    shade = F.coalesce(F.element_at(F.create_map(*[F.lit(v) for k, c in colour.items() if k is not None for v in (k, c)]), F.col(category)), F.lit("#999")) if any(k is not None for k in colour) else F.lit("#999")
    number = lambda c: F.format_string("%.1f", F.col(c))
    line = F.concat(F.lit('<circle cx="'), number(x), F.lit('" cy="'), number(y), F.lit('" r="3" fill="'), shade, F.lit('"><title>'), html_escaped(F.coalesce(F.col(category).cast("string"), F.lit("None"))), F.lit("</title></circle>"))
    names = "".join(f'<li style="color:{colour[k]}">{html.escape(str(k))} ({n})</li>' for k, n in kinds) + (f"<li>+{rest} more</li>" if rest > 0 else "")
    head = f"<!doctype html><title>{html.escape(title)}</title><svg width=900 height=900>"
    return _pages(points.select(F.xxhash64(x, y).alias("o"), F.col(x).alias("ox"), F.col(y).alias("oy"), line.alias("line")), ["o", "ox", "oy"], most, head, f"</svg><ul>{names}</ul>")


def contact_sheets(pages: DataFrame, title: str = "zones", most: int = MOST_PAGES) -> DataFrame:
    """(page, html): a row a page image with its zone and its labels, all of them on as many sheets as they need; fallbacks are counted over all."""
    n, fell = pages.agg(F.count(F.lit(1)), F.count_if("fell_back")).first()
    text = lambda c: html_escaped(F.coalesce(F.col(c).cast("string"), F.lit("None")))
    line = F.concat(F.lit("<tr><td>"), text("filename"), F.lit("</td><td>"), text("zone"), F.lit("</td><td>"), text("labels"), F.lit("</td></tr>"))
    head = f"<!doctype html><title>{html.escape(title)}</title><p>{n} pages, {fell} without a zone</p><table>"
    return _pages(pages.select("filename", line.alias("line")), ["filename", "line"], most, head, "</table>")
