"""Embedding matrices, their sidecars, codebooks, run manifests and logs."""

from __future__ import annotations

import json
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions.vectors import doubles

MOST_MATRIX_VALUES = 50_000_000  # a .npy file is written by the driver


def wide(rows: DataFrame, image: str, vec: str, dim: int) -> DataFrame:
    """(image, d0 .. dN FLOAT)."""
    return rows.select(image, *[F.try_element_at(vec, F.lit(i + 1)).cast("float").alias(f"d{i}") for i in range(dim)])


def narrow(rows: DataFrame, image: str) -> DataFrame:
    """(image, vec) from the wide form."""
    dims = sorted((c for c in rows.columns if c[:1] == "d" and c[1:].isdigit()), key=lambda c: int(c[1:]))
    return rows.select(image, F.array(*dims).alias("vec"))


def model_id(arch: Column, config_hash: Column, step: Column) -> Column:
    return F.concat(arch, F.lit("@"), F.substring(config_hash, 1, 8), F.lit("+step"), step.cast("string"))


def sidecar(rows: DataFrame, meta: dict, row: str, image: str, n_windows: str) -> tuple[DataFrame, DataFrame]:
    """(fields, listed): one row with the sidecar's fields and n_rows, and a JSON line for each of its rows; of any size."""
    fields = rows.agg(F.count(F.lit(1)).alias("n_rows")).select(*[F.lit(v).alias(k) for k, v in meta.items()], "n_rows", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("created"))
    return fields, rows.select(F.to_json(F.struct(F.col(row).alias("row"), F.col(image).alias("image"), F.col(n_windows).alias("n_windows"))).alias("value"))


def listed_rows(lines: DataFrame, text: str = "value") -> DataFrame:
    """(row, image, n_windows) from the JSON lines of a sidecar."""
    return lines.select(F.from_json(text, "struct<row:bigint,image:string,n_windows:int>").alias("r")).select("r.*")


def write_sidecar(rows: DataFrame, meta: dict, row: str, image: str, n_windows: str, path: str) -> None:
    """<path>/fields as JSON and <path>/rows as JSON lines."""
    fields, listed = sidecar(rows, meta, row, image, n_windows)
    fields.write.mode("overwrite").json(f"{path}/fields")
    listed.write.mode("overwrite").text(f"{path}/rows")


def read_sidecar(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.json(f"{path}/fields"), listed_rows(spark.read.text(f"{path}/rows"))


def prior_start(folder: str) -> str | None:
    """What the run before in this folder was started from, by its manifest."""
    at = Path(folder) / "run_manifest.json"
    return json.loads(at.read_text()).get("init_from") if at.exists() else None


def mismatched_sidecars(sidecars: DataFrame, model: str) -> DataFrame:
    """Sidecars written by another model."""
    return sidecars.where(~F.col("model_id").eqNullSafe(F.lit(model)))


def read_sidecars(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.option("pathGlobFilter", "*.mapping.json").option("multiLine", True).json(folder)


def write_npy(rows: DataFrame, order: str, vec: str, path: str) -> str:
    """Matrix file of float32 by ascending ``order``; a suffix other than .npy becomes .npy. Bounded: see MOST_MATRIX_VALUES."""
    to = Path(path).with_suffix(".npy")
    n, dim = rows.agg(F.count(F.lit(1)), F.max(F.size(vec))).first()
    if n * (dim or 0) > MOST_MATRIX_VALUES:
        raise ValueError("too large for one file; write parquet")
    np.save(to, np.array([r[0] for r in rows.orderBy(order).select(doubles(vec)).collect()], np.float32).reshape(n, dim or 0))
    return str(to)


def read_npy(spark: SparkSession, path: str, names: list[str] | None = None) -> DataFrame:
    """(row, image, vec); image names by position where there are none or their number differs."""
    x = np.load(path)
    named = names if names is not None and len(names) == len(x) else [str(i) for i in range(len(x))]
    return spark.createDataFrame([(i, n, v.tolist()) for i, (n, v) in enumerate(zip(named, x, strict=True))], "row int, image string, vec array<float>")


def append_log(rows: DataFrame, path: str) -> None:
    """Epoch or scalar rows appended as JSON lines."""
    rows.write.mode("append").json(path)


def write_run_manifest(folder: str, manifest: dict, config: dict) -> None:
    Path(folder).mkdir(parents=True, exist_ok=True)
    (Path(folder) / "run_manifest.json").write_text(json.dumps(manifest, indent=2))
    (Path(folder) / "config.json").write_text(json.dumps(config, indent=2))


def resumable(folder: str) -> str | None:
    """The rolling checkpoint of a run folder, if there is one."""
    at = Path(folder) / "checkpoint.pth"
    return str(at) if at.exists() else None
