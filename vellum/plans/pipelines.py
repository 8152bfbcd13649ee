"""Whole runs put together from the operators: page preparation, embedding, the scatter view, evaluation of a model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions.text import base_name, family, parent_name, regex_category
from vellum.operators import codebook, lineage, linalg, pooling, report, retrieval, zones
from vellum.runtime import settle
from vellum.sources import folders, matrices

KEYS = ["dataset", "filename"]


def prepared(pages: DataFrame, detections: DataFrame, pad: int = 0, families: tuple[str, ...] = zones.FAMILIES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(zones, documents, sheets) of pages (dataset, filename, width, height) and detections (dataset, filename, pos, label, score, x0 .. y1).

    zones has each page's padded main zone, null where it fell back, and its detections, scores rounded to 3 digits; documents a
    zones.json text a folder; sheets the contact sheets with the eight best detections of a page.
    """
    mains = zones.main_zones(pages, detections, KEYS, pad, families)
    told = F.array("label", F.bround("score", 3).cast("string"), *[F.col(c).cast("string") for c in ("x0", "y0", "x1", "y1")])
    listed = detections.groupBy(*KEYS).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", told.alias("d")))), lambda x: x["d"]).alias("detections"))
    box = F.when(~F.col("fell_back"), F.array(*[F.col(c).cast("int") for c in ("x0", "y0", "x1", "y1")]))
    made = mains.join(listed, KEYS, "left").select(*KEYS, box.alias("bbox"), F.array("width", "height").cast("array<int>").alias("page_size"), "fell_back", F.coalesce("detections", F.array().cast("array<array<string>>")).alias("detections"))
    made = settle(made)
    best = zones.top_detections(detections, KEYS).groupBy(*KEYS).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "label"))), lambda x: x["label"]), ", ").alias("labels"))
    rows = made.join(best, KEYS, "left").select("filename", F.col("bbox").cast("string").alias("zone"), "fell_back", F.coalesce("labels", F.lit("")).alias("labels"))
    return made, folders.zone_documents(made), report.contact_sheets(rows)


def family_counts(detections: DataFrame) -> DataFrame:
    """(family, n): detections of each family."""
    return detections.groupBy(family("label").alias("family")).agg(F.count(F.lit(1)).alias("n"))


def embedded_unit(tokens: DataFrame, meta: dict, out: str, how: str = "mean", whiten: bool = False, clusters: int = 0, seed: int = 0) -> DataFrame:
    """Page vectors of tokens (image, window, pos, vec), written as one unit; gives (row, image, vec).

    <out>/matrix is parquet (row, image, vec), <out>/sidecar its fields and rows, and with ``how`` "vlad" <out>/codebook the centres that
    patch tokens were encoded by, named by the model in the sidecar.
    """
    n_class = int(meta.get("num_class_tokens", 1))
    patches = tokens.where(F.col("pos") >= n_class)
    windows = tokens.groupBy("image").agg(F.count_distinct("window").cast("int").alias("n_windows"))
    more = {}
    if how == "vlad":
        named = patches.withColumn("_id", F.xxhash64("image", "window", "pos"))
        book = settle(codebook.fitted_codebook(named, "_id", "vec", clusters, seed))
        book.withColumn("model_id", F.lit(meta["model_id"])).write.mode("overwrite").parquet(f"{out}/codebook")
        vectors = codebook.vlad(patches, book, "image", "vec")
        more = {"vlad_clusters": clusters, "vlad_seed": seed, "codebook": f"{out}/codebook"}
    else:
        vectors = pooling.pooled(tokens, how, "image", "window", "pos", "vec", n_class).select("image", "vec")
    if whiten:
        vectors = linalg.whitened(vectors, "vec", "_w").select("image", F.col("_w").alias("vec"))
    from vellum.operators.skew import balanced_positions

    rows = balanced_positions(vectors.join(windows, "image").withColumn("_all", F.lit(0)), "_all", ["image"], None, "row", None).select("row", "image", F.col("vec").cast("array<float>").alias("vec"), "n_windows")
    rows = settle(rows)
    rows.select("row", "image", "vec").write.mode("overwrite").parquet(f"{out}/matrix")
    dim = rows.agg(F.max(F.size("vec"))).first()[0]
    matrices.write_sidecar(rows, {**meta, "pooling": how, "whiten": whiten, "embed_dim": dim, **more}, "row", "image", "n_windows", f"{out}/sidecar")
    return rows.select("row", "image", "vec")


def read_unit(spark: SparkSession, out: str) -> tuple[DataFrame, DataFrame]:
    """(rows (row, image, vec, n_windows), the sidecar's fields) of what :func:`embedded_unit` wrote; images by the sidecar where both have them."""
    fields, listed = matrices.read_sidecar(spark, f"{out}/sidecar")
    held = spark.read.parquet(f"{out}/matrix").withColumnRenamed("image", "_image")
    return held.join(listed, "row", "left").select("row", F.coalesce("image", "_image").alias("image"), "vec", "n_windows"), fields


def scatter_view(rows: DataFrame, image: str = "image", vec: str = "vec", pattern: str | None = None, method: str = "auto") -> DataFrame:
    """(page, html): vectors in the plane, coloured by group 1 of the pattern in the image's name, or by its folder."""
    spots = linalg.scaled_to_canvas(linalg.plane(rows.select(image, vec), vec, method), "px", "py")
    kind = regex_category(image, pattern) if pattern else parent_name(image)
    return report.scatter_pages(spots.withColumn("kind", kind), "cx", "cy", "kind")


def evaluated(registry: DataFrame, model: str, vectors: DataFrame, row: str, vec: str, label: str) -> DataFrame:
    """The registry with the model's entry anew: map, top1 and top5 of its vectors in eval_scores, other scores kept.

    The new row is the model's latest, by a loaded_at just after its last. An unknown model is an error.
    """
    ranks = settle(retrieval.relevant_ranks(vectors, row, vec, label))
    best = ranks.groupBy("qid").agg(F.min("rank").alias("r"))
    share = lambda k: F.avg(F.when(F.col("r") < k, 100.0).otherwise(0.0))
    scores = retrieval.average_precision(ranks).join(best, "qid").agg(F.avg("ap").alias("map"), share(1).alias("top1"), share(5).alias("top5"))
    entry = lineage.shown_model(registry, model)
    if not entry.limit(1).count():
        raise ValueError(f"no model {model!r} in the registry")
    made = F.map_from_entries(F.array(*[F.struct(F.lit(n).alias("key"), F.col(n).alias("value")) for n in ("map", "top1", "top5")]))
    kept = F.map_filter(F.coalesce("eval_scores", F.create_map().cast("map<string,double>")), lambda k, _: ~k.isin("map", "top1", "top5"))
    new = entry.join(F.broadcast(scores), F.lit(True)).withColumns({"eval_scores": F.map_concat(kept, made), "loaded_at": F.col("loaded_at") + F.expr("interval 1 second")})
    return registry.unionByName(new.select(*registry.columns))


def listed_images(rows: DataFrame, image: str = "image") -> DataFrame:
    """(dataset, filename) of image names."""
    return rows.select(parent_name(image).alias("dataset"), base_name(image).alias("filename"))
