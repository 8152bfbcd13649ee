"""Codebooks and VLAD encoding."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.functions.vectors import doubles, l2_normalized, signed_sqrt
from vellum.runtime import shared

MOST_CENTRE_BYTES = 1 << 29  # a codebook is broadcast to the executors
MOST_DESCRIPTORS = 200_000  # sample on which a codebook is fitted


def sampled_descriptors(descriptors: DataFrame, row: str, vec: str, seed: int, most: int) -> DataFrame:
    """(row, v): the ``most`` rows of least hash; a threshold on the hash leaves little more than these to be sorted."""
    n = descriptors.count()
    draw = F.xxhash64(F.lit(seed), row)
    lean = descriptors.select(F.col(row).alias("row"), doubles(vec).alias("v"), draw.alias("draw"))
    if n > most:
        # six deviations above the expected count, so that fewer than ``most`` hardly ever pass
        share = min(1.0, (most + 6 * most**0.5 + 50) / n)
        lean = lean.where(F.col("draw") < int(-(2**63) + share * (2**64 - 1)))
    return lean.orderBy("draw", "row").limit(most).select("row", "v")


def fitted_codebook(descriptors: DataFrame, row: str, vec: str, clusters: int, seed: int = 0, max_iter: int = 100, most: int = MOST_DESCRIPTORS) -> DataFrame:
    """(cluster_id, center) by k-means on at most ``most`` descriptors, drawn by hash; min(clusters, descriptors) centres.

    One sorted partition makes the fit the same whatever the layout of the input; its size is bounded by ``most``.
    """
    from pyspark.ml.clustering import KMeans

    some = sampled_descriptors(descriptors.where(F.col(vec).isNotNull()), row, vec, seed, most)
    points = some.repartition(1).sortWithinPartitions("row").select(array_to_vector("v").alias("features")).persist()
    try:
        n = points.count()
        model = KMeans(k=max(2, min(clusters, n)), seed=seed, maxIter=max_iter, initMode="k-means||").fit(points)
        centres = [(i, c.tolist()) for i, c in enumerate(model.clusterCenters())]
    finally:
        points.unpersist()
    return descriptors.sparkSession.createDataFrame(centres, "cluster_id int, center array<double>")


def reservoir_codebook(descriptors: DataFrame, page: str, row: str, vec: str, clusters: int, a_page: int, seed: int = 0, most: int = 500_000) -> DataFrame:
    """(cluster_id, center) as the older extraction fits it: at most ``a_page`` descriptors of a page, of these at most ``most``, drawn by hash."""
    from pyspark.sql import Window

    w = Window.partitionBy(page).orderBy(F.xxhash64(F.lit(seed), row), row)
    some = descriptors.where(F.col(vec).isNotNull()).withColumn("_at", F.row_number().over(w)).where(F.col("_at") <= a_page).drop("_at")
    return fitted_codebook(some, row, vec, clusters, seed, most=most)


def label_codebook(rows: DataFrame, label: str, vec: str) -> DataFrame:
    """A given codebook: the centroid of each label, its elements rounded to 9 digits."""
    mean = rows.groupBy(F.col(label).alias("cluster_id")).agg(Summarizer.mean(array_to_vector(doubles(vec))).alias("m"))
    return mean.select("cluster_id", F.transform(vector_to_array("m"), lambda x: F.round(x, 9)).alias("center"))


def nearest_centres(descriptors: DataFrame, codebook: DataFrame, vec: str) -> DataFrame:
    """``descriptors`` with cluster_id, the nearest centre by squared Euclidean distance (equal to 9 digits: the lower id), and residual.

    Distances come from one matrix product a batch. Null vectors are left out.
    """
    n, dim = codebook.agg(F.count(F.lit(1)), F.max(F.size("center"))).first()
    if n * (dim or 0) * 8 > MOST_CENTRE_BYTES:
        raise ValueError("codebook too large to be broadcast")
    rows = codebook.orderBy("cluster_id").collect()
    kind = codebook.schema["cluster_id"].dataType.simpleString()
    book = shared(descriptors.sparkSession, ([r[0] for r in rows], np.array([r[1] for r in rows], np.float64)))
    pa_kind = {"int": pa.int32(), "bigint": pa.int64()}[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, centres = book()
        names, squares = pa.array(ids, pa_kind), (centres * centres).sum(1)
        step = max(1, (1 << 22) // max(1, len(centres)))
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                b = whole.slice(at, step)
                x = b.column("_v").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                d = (x * x).sum(1)[:, None] + squares[None] - 2 * (x @ centres.T)
                best = np.round(d, 9).argmin(1)
                gap = x - centres[best]
                ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1])
                cols = [c for c, n in zip(b.columns, b.schema.names, strict=True) if n != "_v"]
                yield pa.record_batch([*cols, names.take(pa.array(best)), pa.ListArray.from_arrays(ends, pa.array(gap.ravel()))], names=[*[n for n in b.schema.names if n != "_v"], "cluster_id", "residual"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in descriptors.schema)
    return descriptors.where(F.col(vec).isNotNull()).withColumn("_v", doubles(vec)).mapInArrow(run, f"{schema}, cluster_id {kind}, residual array<double>")


def vlad(descriptors: DataFrame, codebook: DataFrame, page: str, vec: str, intra: bool = True, power: bool = True) -> DataFrame:
    """(page, vec): residual sums by cluster, each at unit length if ``intra``, end to end by cluster id, signed root if ``power``, unit length.

    Clusters without descriptors are zeros.
    """
    sums = nearest_centres(descriptors, codebook, vec).groupBy(page, "cluster_id").agg(Summarizer.sum(array_to_vector("residual")).alias("s"))
    part = vector_to_array("s")
    parts = sums.select(page, "cluster_id", (l2_normalized(part) if intra else part).alias("part"))
    layout = codebook.agg(F.array_sort(F.collect_list("cluster_id")).alias("ids"), F.max(F.size("center")).alias("dim"))
    held = parts.groupBy(page).agg(F.map_from_entries(F.collect_list(F.struct("cluster_id", "part"))).alias("m"))
    zeros = F.array_repeat(F.lit(0.0), F.col("dim"))
    flat = F.flatten(F.transform("ids", lambda i: F.coalesce(F.try_element_at("m", i), zeros)))
    out = held.join(F.broadcast(layout), F.lit(True)).select(page, flat.alias("flat"))
    if power:
        out = out.select(page, signed_sqrt(F.col("flat")).alias("flat"))
    return out.select(page, l2_normalized(F.col("flat")).alias("vec"))
