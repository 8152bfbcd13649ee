"""Image folders, label files and zone documents as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions.text import IMAGE_SUFFIXES, base_name, is_image, parent_name

LABEL_SCHEMA = "filename string, hand_id string, confidence string, source string, notes string"
ZONE_ENTRY = "struct<bbox:array<int>,size:array<int>,fell_back:boolean,detections:array<array<string>>>"


def image_listing(spark: SparkSession, root: str, suffixes: tuple[str, ...] = IMAGE_SUFFIXES) -> DataFrame:
    """(dataset, filename, path, length): image files of the root itself and of its immediate subfolders.

    Only names and sizes are read. A missing folder is an error.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    inside = F.regexp_replace("path", "^file:/*", "/")
    depth = F.size(F.split(inside, "/")) - F.size(F.split(F.lit("/" + root.rstrip("/").removeprefix("file://").lstrip("/")), "/"))
    return files.where((depth <= 2) & is_image(base_name("path"), suffixes)).select(parent_name("path").alias("dataset"), base_name("path").alias("filename"), "path", "length")


def discovered_datasets(images: DataFrame) -> DataFrame:
    """(dataset, n_images)."""
    return images.groupBy("dataset").agg(F.count_distinct("filename").alias("n_images"))


def label_rows(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Rows of labels.csv files: (dataset, line, filename, hand_id, confidence, source, notes).

    dataset is the file's folder; columns are found by header name, absent ones are null; line orders the rows of a file.
    """
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", "UTF-8").csv(paths)
    have = {c.strip(): c for c in raw.columns}
    wanted = [x.split()[0] for x in LABEL_SCHEMA.split(", ")]
    cells = [F.col(f"`{have[n]}`").alias(n) if n in have else F.lit(None).cast("string").alias(n) for n in wanted]
    return raw.select(parent_name(F.col("_metadata.file_path")).alias("dataset"), F.monotonically_increasing_id().alias("line"), *cells).withColumn("confidence", F.col("confidence").try_cast("double"))


def zone_entries(documents: DataFrame, text: str = "value") -> DataFrame:
    """Entries of zones.json texts: (filename, bbox, size, fell_back, detections); absent keys take their defaults."""
    parsed = F.from_json(F.col(text), f"struct<images:map<string,{ZONE_ENTRY}>>")
    rows = documents.select(*[c for c in documents.columns if c != text], F.explode(parsed["images"]).alias("filename", "e"))
    return rows.select(
        *[c for c in documents.columns if c != text], "filename", F.col("e.bbox").alias("bbox"), F.coalesce("e.size", F.array(F.lit(0), F.lit(0))).alias("size"), F.coalesce("e.fell_back", F.col("e.bbox").isNull()).alias("fell_back"),
        F.coalesce("e.detections", F.array().cast("array<array<string>>")).alias("detections"),
    )


def read_zones(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return zone_entries(spark.read.text(paths, wholetext=True).select("value"))


def zone_documents(zones: DataFrame, dataset: str = "dataset") -> DataFrame:
    """(dataset, value): a zones.json text for each folder."""
    entry = F.struct("bbox", F.col("page_size").alias("size"), "fell_back", "detections")
    return zones.groupBy(dataset).agg(F.to_json(F.struct(F.map_from_entries(F.array_sort(F.collect_list(F.struct("filename", entry.alias("e"))))).alias("images"))).alias("value"))


def known_size(zone_size: str, width: str, height: str) -> tuple:
    """Page size from the zone entry, else the image; 0 x 0 counts as unknown."""
    w, h = F.try_element_at(zone_size, F.lit(1)), F.try_element_at(zone_size, F.lit(2))
    good = (w > 0) & (h > 0)
    return F.when(good, w).otherwise(F.col(width)), F.when(good, h).otherwise(F.col(height))


def read_pixels(spark: SparkSession, path: str) -> DataFrame:
    """Decoded images (origin, width, height, nChannels, mode, data); files that are no images are dropped."""
    return spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")
