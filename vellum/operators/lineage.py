"""Model lineage: the registry as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.functions.text import folded_name, stripped


def current_entries(registry: DataFrame) -> DataFrame:
    """The entry of each model_id with the latest loaded_at; of equal ones any."""
    fields = [c for c in registry.columns if c != "model_id"]
    return registry.groupBy("model_id").agg(F.max_by(F.struct(*fields), "loaded_at").alias("e")).select("model_id", *[F.col(f"e.`{c}`").alias(c) for c in fields])


def shown_model(registry: DataFrame, model: str) -> DataFrame:
    return current_entries(registry.where(F.col("model_id") == model))


def used_folders(registry: DataFrame) -> DataFrame:
    """(model_id, name) for every folder in dataset_manifests, folded, once each."""
    return current_entries(registry).select("model_id", F.explode("dataset_manifests").alias("n")).select("model_id", folded_name("n").alias("name")).where("name <> ''").distinct()


def scores(registry: DataFrame) -> DataFrame:
    """(model_id, metric, score) from eval_scores; null and NaN scores are left out."""
    rows = current_entries(registry).select("model_id", F.explode(F.map_entries("eval_scores")).alias("s"))
    return rows.select("model_id", stripped("s.key").alias("metric"), F.col("s.value").alias("score")).where("score is not null and not isnan(score)")
