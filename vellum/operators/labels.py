"""Partial label tables: last present value wins, orphans, coverage, labels on rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.functions.text import filled, stripped
from vellum.runtime import settle

KEY = ["dataset", "filename"]


def valid_labels(rows: DataFrame) -> DataFrame:
    """Rows with a filename and a hand, both stripped; blank or null cells drop the row."""
    return rows.where(filled("filename") & filled("hand_id")).withColumns({"filename": stripped("filename"), "hand_id": stripped("hand_id")})


def label_table(rows: DataFrame, images: DataFrame, order: list[str]) -> DataFrame:
    """(dataset, filename, hand_id, confidence, source, notes): one row a labelled image.

    Later rows (by ``order``, which must be unique) overwrite the hand; of the optional columns the last present value
    counts, even if a later row lacks it. A null or NaN confidence is absent; null or empty source and notes are
    absent, white space is present and strips to the empty text. Labels of no image are dropped.
    """
    known = valid_labels(rows).join(images.select(*KEY).distinct(), KEY, "left_semi")
    at = F.struct(*order)
    sure = F.col("confidence").isNotNull() & ~F.isnan("confidence")
    last = lambda c, ok: F.max_by(F.when(ok, c), F.when(ok, at))
    text = lambda c: last(stripped(c), F.col(c).isNotNull() & (F.col(c) != ""))
    return known.groupBy(*KEY).agg(F.max_by("hand_id", at).alias("hand_id"), last(F.col("confidence"), sure).alias("confidence"), text("source").alias("source"), text("notes").alias("notes"))


def label_orphans(rows: DataFrame, images: DataFrame) -> DataFrame:
    """Valid rows whose file is no image of the folder; repeated rows stay repeated."""
    return valid_labels(rows).join(images.select(*KEY).distinct(), KEY, "left_anti")


def coverage(images: DataFrame, labelled: DataFrame) -> DataFrame:
    """(dataset, n_images, n_labeled, n_hands, label_coverage), coverage 0.0 for a folder without images."""
    counts = images.groupBy("dataset").agg(F.count_distinct("filename").alias("n_images"))
    known = labelled.groupBy("dataset").agg(F.count_distinct("filename").alias("n_labeled"), F.count_distinct("hand_id").alias("n_hands"))
    zero = F.lit(0).cast("long")
    share = F.coalesce(F.try_divide(F.coalesce("n_labeled", zero).cast("double"), F.col("n_images")), F.lit(0.0))
    return counts.join(known, "dataset", "left").select("dataset", "n_images", F.coalesce("n_labeled", zero).alias("n_labeled"), F.coalesce("n_hands", zero).alias("n_hands"), share.alias("label_coverage"))


def with_hand(rows: DataFrame, labelled: DataFrame, missing: str = "unlabeled") -> DataFrame:
    """Rows with the hand of their (dataset, filename), ``missing`` where there is none."""
    hands = labelled.select(*KEY, F.col("hand_id").alias("_hand"))
    return rows.join(hands, KEY, "left").withColumn("hand_id", F.coalesce("_hand", F.lit(missing))).drop("_hand")


def label_index(rows: DataFrame, label: str, row: str) -> DataFrame:
    """Label to the ascending list of its row ids."""
    return rows.groupBy(label).agg(F.array_sort(F.collect_list(row)).alias("rows"))


def same_label_pairs(rows: DataFrame, label: str, row: str) -> DataFrame:
    """Anchor-positive pairs within a label as a chain: each row with the next of its label, so no group is squared."""
    from pyspark.sql import Window

    w = Window.partitionBy(label).orderBy(row)
    return rows.select(label, F.col(row).alias("anchor"), F.lead(row).over(w).alias("positive")).where("positive is not null")


def triplets(rows: DataFrame, label: str, row: str, a_row: int, seed: int) -> DataFrame:
    """(anchor, k, positive, negative): ``a_row`` draws for every row: another row of its label and a row of another label, by hash.

    All pairs of a label would be its square; here a label of any size costs its rows times ``a_row``. Rows are numbered by label
    over range partitions, so that a label is a stretch of numbers and one draw never has to be repeated. A row
    alone in its label has no positive, and where there is one label there is no negative: these are null. Null labels take no part.
    """
    from vellum.operators.skew import balanced_positions
    from vellum.operators.training_math import draw

    known = rows.where(F.col(label).isNotNull()).select(F.col(label).alias("label"), F.col(row).alias("row"), F.lit(0).alias("_all"))
    placed = settle(balanced_positions(known, "_all", ["label", "row"], None, "at", "n_all").drop("_all"))
    extent = placed.groupBy("label").agg(F.min("at").alias("start"), F.count(F.lit(1)).alias("n"))
    asked = placed.join(extent, "label").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(a_row - 1))))
    pick = lambda what, n: F.pmod(draw(seed, F.lit(what), F.col("row"), F.col("k")), n)
    near = F.when(F.col("n") > 1, F.col("start") + F.pmod(F.col("at") - F.col("start") + 1 + pick("positive", F.col("n") - 1), F.col("n")))
    away = F.when(F.col("n_all") > F.col("n"), pick("negative", F.col("n_all") - F.col("n")))
    drawn = asked.select(F.col("row").alias("anchor"), "k", near.alias("p"), (away + F.when(away >= F.col("start"), F.col("n")).otherwise(F.lit(0))).alias("g"))
    names = lambda at, name: placed.select(F.col("at").alias(at), F.col("row").alias(name))
    return drawn.join(names("p", "positive"), "p", "left").join(names("g", "negative"), "g", "left").select("anchor", "k", "positive", "negative")


def first_k(rows: DataFrame, label: str, row: str, k: int, full: bool = False) -> DataFrame:
    """The k first rows of each label; with ``full`` a label of fewer rows is an error."""
    from pyspark.sql import Window

    if full and rows.groupBy(label).count().where(F.col("count") < k).limit(1).count():
        raise ValueError(f"a label has fewer than {k} rows")
    return rows.withColumn("at", F.row_number().over(Window.partitionBy(label).orderBy(row))).where(F.col("at") <= k).drop("at")
