"""Principal components, whitening and plane projections."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.functions.vectors import doubles, l2_normalized
from vellum.runtime import settle, shared

MOST_WIDTH = 4096  # side of the greatest matrix that the driver decomposes: a covariance, or of wider vectors the products of their rows
BLOCK_COLUMNS = 512


def _moments(rows: DataFrame, vec: str) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, mean and scatter matrix: one distributed pass each, the driver holds width x width numbers."""
    lean = rows.where(F.col(vec).isNotNull()).select(doubles(vec).alias("v"))
    stat = lean.agg(Summarizer.metrics("count", "mean").summary(array_to_vector("v")).alias("s")).select("s.count", vector_to_array("s.mean").alias("m")).first()
    n, mean = int(stat[0]), np.array(stat[1])
    if len(mean) > MOST_WIDTH:
        raise ValueError("vectors too wide for a covariance on the driver")
    width = len(mean)

    def scatter(batches):
        total = np.zeros((width, width))
        for b in batches:
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width) - mean
            total += x.T @ x
        yield pa.record_batch([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], names=["g"])

    # one matrix a partition, added up as vectors within the JVM
    parts = lean.mapInArrow(scatter, "g array<double>").agg(Summarizer.sum(array_to_vector("g")).alias("g"))
    gram = np.array(parts.select(vector_to_array("g")).first()[0]).reshape(width, width)
    return n, mean, gram


def _projected(rows: DataFrame, vec: str, mean: np.ndarray, axes: np.ndarray, out: str) -> DataFrame:
    """vec centred and multiplied with the columns of ``axes``: one matrix product a batch, the axes broadcast once."""
    frame = shared(rows.sparkSession, (mean, axes))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, a = frame()
        for b in batches:
            at = b.schema.names.index("_c")
            x = b.column(at).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(m)) - m
            y = x @ a
            ends = pa.array(np.arange(len(y) + 1, dtype=np.int32) * y.shape[1])
            kept = [i for i in range(b.num_columns) if i != at]
            yield pa.record_batch([*[b.column(i) for i in kept], pa.ListArray.from_arrays(ends, pa.array(y.ravel()))], names=[*[b.schema.names[i] for i in kept], out])

    return rows.withColumn("_c", doubles(vec)).mapInArrow(run, f"{schema}, `{out}` array<double>")


def _row_products(known: DataFrame, vec: str, width: int) -> tuple[np.ndarray, list, DataFrame]:
    """(centred rows times themselves, their numbers, the numbered rows): for few wide rows, added up over blocks of columns."""
    from vellum.operators.skew import balanced_positions

    numbered = settle(balanced_positions(known.withColumns({"_one": F.lit(0), "_h": F.xxhash64(vec)}), "_one", ["_h"], None, "_row", None).drop("_one", "_h"))
    n = numbered.count()
    blocks = -(-width // BLOCK_COLUMNS)
    cut = numbered.select("_row", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), doubles(vec).alias("v")).select("_row", "block", F.slice("v", F.col("block") * BLOCK_COLUMNS + 1, BLOCK_COLUMNS).alias("v"))

    def product(t: pa.Table) -> pa.Table:
        t = t.sort_by("_row")
        x = t["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(t), -1)
        x = x - x.mean(0)
        return pa.table({"g": pa.array([(x @ x.T).ravel().tolist()], pa.list_(pa.float64()))})

    g = cut.groupBy("block").applyInArrow(product, "g array<double>").agg(Summarizer.sum(array_to_vector("g")).alias("g"))
    return np.array(g.select(vector_to_array("g")).first()[0]).reshape(n, n), list(range(n)), numbered


def pca_scores(rows: DataFrame, vec: str, k: int, out: str = "scores") -> DataFrame:
    """Scores on the k first principal axes; the sign of an axis is arbitrary."""
    _, mean, gram = _moments(rows, vec)
    values, vectors = np.linalg.eigh(gram)
    return _projected(rows.where(F.col(vec).isNotNull()), vec, mean, vectors[:, np.argsort(-values)[:k]], out)


def _unit(rows: DataFrame, out: str, unit: bool) -> DataFrame:
    return rows.withColumn(out, l2_normalized(F.col(out))) if unit else rows


def moments(rows: DataFrame, vec: str) -> DataFrame:
    """(i, j, mean_i, cov): covariance of the elements, over n - 1."""
    n, mean, gram = _moments(rows, vec)
    cells = [(i, j, float(mean[i]), float(gram[i, j]) / max(n - 1, 1)) for i in range(len(mean)) for j in range(len(mean))]
    return rows.sparkSession.createDataFrame(cells, "i int, j int, mean_i double, cov double")


def whitened(rows: DataFrame, vec: str, out: str = "white", unit: bool = True) -> DataFrame:
    """U * sqrt(n - 1) of the centred rows, axes with singular value above 1e-6 of the greatest kept, then unit length if ``unit``.

    A single row has no spread: its vector has no elements. Vectors wider than MOST_WIDTH (VLAD's) are whitened through
    the products of their rows, of which there may then be MOST_WIDTH; more of both is an error.
    """
    n, width = rows.where(F.col(vec).isNotNull()).agg(F.count(F.lit(1)), F.max(F.size(vec))).first()
    if (width or 0) > MOST_WIDTH and n <= MOST_WIDTH:
        return _unit(_whitened_wide(rows.where(F.col(vec).isNotNull()), vec, width, out), out, unit)
    n, mean, gram = _moments(rows, vec)
    values, vectors = np.linalg.eigh(gram)
    s = np.sqrt(np.maximum(values, 0))
    kept = s > 1e-6 * s.max() if s.max() > 0 else np.zeros(len(s), bool)
    known = rows.where(F.col(vec).isNotNull())
    if not kept.any():
        return known.withColumn(out, F.array().cast("array<double>"))
    axes = vectors[:, kept] / s[kept] * np.sqrt(max(n - 1, 1))
    return _unit(_projected(known, vec, mean, axes, out), out, unit)


def _whitened_wide(known: DataFrame, vec: str, width: int, out: str) -> DataFrame:
    g, names, numbered = _row_products(known, vec, width)
    values, vectors = np.linalg.eigh(g)
    s = np.sqrt(np.maximum(values, 0))
    kept = s > 1e-6 * s.max() if s.max() > 0 else np.zeros(len(s), bool)
    u = vectors[:, kept] * np.sqrt(max(len(g) - 1, 1))
    made = known.sparkSession.createDataFrame(pa.table({"_row": pa.array(names, pa.int64()), out: pa.array(u.tolist(), pa.list_(pa.float64()))}))
    return numbered.join(made, "_row").drop("_row")


def covariance_pca(rows: DataFrame, vec: str, dim: int, power: float = 0.5, out: str = "scores") -> DataFrame:
    """The older PCA: eigenvalues of the covariance clamped at 1e-5 of the greatest, axes scaled by value ** -power."""
    n, mean, gram = _moments(rows, vec)
    values, vectors = np.linalg.eigh(gram / max(n, 1))
    values = np.maximum(values, 1e-5 * values.max())
    top = np.argsort(-values)[:dim]
    return _projected(rows.where(F.col(vec).isNotNull()), vec, mean, vectors[:, top] * values[top] ** -power, out)


def plane(rows: DataFrame, vec: str, method: str = "auto") -> DataFrame:
    """Columns px, py: coordinates in the plane. Only "pca" (and "auto", which falls back to it) is available."""
    if method not in ("auto", "pca"):
        raise ValueError(f"projection {method!r} is not available; use pca")
    return pca_scores(rows, vec, 2, "_s").withColumns({"px": F.element_at("_s", 1), "py": F.element_at("_s", 2)}).drop("_s")


def scaled_to_canvas(rows: DataFrame, x: str, y: str, low: float = 44.0, high: float = 856.0) -> DataFrame:
    """px and py min-max scaled to the canvas, y flipped; a constant axis is scaled to its low end."""
    span = rows.agg(F.min(x).alias("_x0"), F.max(x).alias("_x1"), F.min(y).alias("_y0"), F.max(y).alias("_y1"))
    one = lambda a, b: F.coalesce(F.nullif(F.col(b) - F.col(a), F.lit(0.0)), F.lit(1.0))
    joined = rows.join(F.broadcast(span), F.lit(True))
    left = low + (F.col(x) - F.col("_x0")) / one("_x0", "_x1") * (high - low)
    up = high - (F.col(y) - F.col("_y0")) / one("_y0", "_y1") * (high - low)
    return joined.withColumns({"cx": left, "cy": up}).drop("_x0", "_x1", "_y0", "_y1")
