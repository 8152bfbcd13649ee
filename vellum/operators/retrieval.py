"""Retrieval quality: ranks of the relevant rows of every query, average precision, precision and accuracy at k.

The similarity matrix is never a table. A first pass keeps the similarities of the relevant pairs, which lie within labels, a
hot label being cut into blocks; a second multiplies blocks of queries with blocks of the gallery and counts for each
relevant pair the gallery rows ranked before it. The counts of the blocks add up to exact ranks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions.vectors import doubles
from vellum.runtime import settle

BLOCK = 4096
DIGITS = 6  # similarities are rounded before they are ordered; equal ones by id


def _matrix(col) -> np.ndarray:
    held = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    x = held.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), -1)
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)


def _blocks(queries: DataFrame, gallery: DataFrame, n: int) -> DataFrame:
    """Every block of queries beside every block of the gallery: rows (qb, gb, is_query, ...)."""
    g = gallery.withColumn("gb", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("is_query", F.lit(False))
    q = queries.withColumn("qb", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")).withColumn("gb", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("is_query", F.lit(True))
    return g.unionByName(q, allowMissingColumns=True)


def _label_blocks(lean: DataFrame, rows_in_all: int) -> DataFrame:
    """Rows (grp, lb, qb, gb, is_query, ...): labels dealt into buckets, each bucket's blocks of queries beside its blocks of the gallery.

    A label lies in one bucket, so all its pairs meet; a bucket that a hot label makes large is cut.
    """
    dealt = lean.withColumn("lb", F.pmod(F.xxhash64("label"), F.lit(max(1, -(-rows_in_all // BLOCK)))).cast("int"))
    cuts = dealt.groupBy("grp", "lb").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("cuts"))
    held = dealt.join(cuts, ["grp", "lb"]).withColumn("own", F.pmod(F.xxhash64("id"), F.col("cuts")).cast("int"))
    all_ = F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))
    g = held.withColumn("qb", all_).withColumn("gb", F.col("own")).withColumn("is_query", F.lit(False))
    q = held.withColumn("gb", all_).withColumn("qb", F.col("own")).withColumn("is_query", F.lit(True))
    return g.unionByName(q).drop("own", "cuts")


def _relevant(t: pa.Table) -> pa.Table:
    q, g = t.filter(t["is_query"]), t.filter(pa.array(~t["is_query"].to_numpy()))
    qi, gi = q["id"].to_numpy(), g["id"].to_numpy()
    s = np.round(_matrix(q["vec"]) @ _matrix(g["vec"]).T, DIGITS) if len(q) and len(g) else np.zeros((len(q), len(g)))
    ql, gl = np.array(q["label"].to_pylist()), np.array(g["label"].to_pylist())
    hit = (ql[:, None] == gl[None]) & (qi[:, None] != gi[None]) & ~g["junk"].to_numpy()[None] if s.size else np.zeros(s.shape, bool)
    a, b = np.nonzero(hit)
    return pa.table({"qid": pa.array(qi[a], pa.int64()), "gid": pa.array(gi[b], pa.int64()), "sim": pa.array(s[a, b], pa.float64())})


def _ahead(t: pa.Table) -> pa.Table:
    q, g = t.filter(t["is_query"]), t.filter(pa.array(~t["is_query"].to_numpy()))
    out = {"qid": [], "gid": [], "ahead": [], "junk_ahead": []}
    if len(q) and len(g):
        gi, junk = g["id"].to_numpy(), g["junk"].to_numpy()
        s = np.round(_matrix(q["vec"]) @ _matrix(g["vec"]).T, DIGITS)
        marks = q["marks"].combine_chunks()
        ends = np.append(0, np.cumsum(marks.value_lengths().to_numpy()))
        flat = marks.flatten()
        gids, sims = flat.field("gid").to_numpy(), flat.field("sim").to_numpy()
        for row, me in enumerate(q["id"].to_numpy()):
            order = np.lexsort((gi, -s[row]))
            order = order[gi[order] != me]
            key, ids = -s[row][order], gi[order]
            dirty = np.concatenate([[0], np.cumsum(junk[order])])
            gid, sim = gids[ends[row] : ends[row + 1]], -sims[ends[row] : ends[row + 1]]
            lo, hi = np.searchsorted(key, sim, "left"), np.searchsorted(key, sim, "right")
            n = lo.copy()
            for i in np.flatnonzero(hi > lo):
                # equal similarities are few: the ids before the mark's among them
                n[i] += ids[lo[i]] < gid[i] if hi[i] - lo[i] == 1 else np.searchsorted(ids[lo[i] : hi[i]], gid[i])
            for name, values in zip(out, (np.full(len(gid), me), gid, n, dirty[n]), strict=True):
                out[name].append(values)
    return pa.table({k: pa.array(np.concatenate(v) if v else [], pa.int64()) for k, v in out.items()})


def relevant_ranks(rows: DataFrame, row: str, vec: str, label: str, junk: Column | None = None, group: str | None = None) -> DataFrame:
    """(qid, gid, sim, rank, n_relevant): the 0-based rank of every relevant row of every query.

    Every labelled row queries all other labelled rows by cosine (rounded to 6 digits, equal ones by id); relevant
    are those with its label. Junk rows query, but are neither relevant nor counted in ranks. Null labels or vectors take no part.
    ``group`` restricts a query's gallery to the rows of its own group when given.
    """
    lean = rows.where(F.col(label).isNotNull() & F.col(vec).isNotNull()).select(F.col(row).cast("long").alias("id"), doubles(vec).alias("vec"), F.col(label).cast("string").alias("label"), (F.coalesce(junk, F.lit(False)) if junk is not None else F.lit(False)).alias("junk"), (F.col(group).cast("string") if group else F.lit("")).alias("grp"))
    lean = settle(lean)
    rows_in_all = lean.count()
    # blocks small enough for memory, and pairs of blocks enough for the cores
    n = max(1, -(-rows_in_all // BLOCK), min(-(-rows_in_all // 256), math.ceil(math.sqrt(2 * rows.sparkSession.sparkContext.defaultParallelism))))
    pairs = settle(_label_blocks(lean, rows_in_all).groupBy("grp", "lb", "qb", "gb").applyInArrow(_relevant, "qid long, gid long, sim double"))
    marks = pairs.groupBy(F.col("qid").alias("id")).agg(F.collect_list(F.struct("gid", "sim")).alias("marks"))
    asking = lean.join(marks, "id")
    counts = _blocks(asking, lean, n).groupBy("grp", "qb", "gb").applyInArrow(_ahead, "qid long, gid long, ahead long, junk_ahead long")
    ranks = counts.groupBy("qid", "gid").agg((F.sum("ahead") - F.sum("junk_ahead")).alias("rank"))
    return pairs.join(ranks, ["qid", "gid"]).select("qid", "gid", "sim", "rank", F.count(F.lit(1)).over(Window.partitionBy("qid")).alias("n_relevant"))


def top_k(rows: DataFrame, row: str, vec: str, k: int) -> DataFrame:
    """(qid, gid, rank, sim): the k other rows of greatest cosine (rounded to 6 digits, equal ones by id) of every row; exact, by blocks."""
    lean = settle(rows.where(F.col(vec).isNotNull()).select(F.col(row).cast("long").alias("id"), doubles(vec).alias("vec")))
    n = max(1, -(-lean.count() // BLOCK))

    def near(t: pa.Table) -> pa.Table:
        q, g = t.filter(t["is_query"]), t.filter(pa.array(~t["is_query"].to_numpy()))
        if not len(q) or not len(g):
            return pa.table({"qid": pa.array([], pa.int64()), "gid": pa.array([], pa.int64()), "sim": pa.array([], pa.float64())})
        g = g.sort_by("id")
        qi, gi = q["id"].to_numpy(), g["id"].to_numpy()
        sim = np.round(_matrix(q["vec"]) @ _matrix(g["vec"]).T, DIGITS)
        sim[qi[:, None] == gi[None]] = -9
        # a stable sort keeps equal similarities by id
        top = np.argsort(-sim, axis=1, kind="stable")[:, :k]
        value = np.take_along_axis(sim, top, 1)
        a, b = np.nonzero(value > -9)
        return pa.table({"qid": pa.array(qi[a]), "gid": pa.array(gi[top[a, b]]), "sim": pa.array(value[a, b])})

    found = _blocks(lean, lean, n).groupBy("qb", "gb").applyInArrow(near, "qid long, gid long, sim double")
    w = Window.partitionBy("qid").orderBy(F.desc("sim"), "gid")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("qid", "gid", "rank", "sim")


def average_precision(ranks: DataFrame) -> DataFrame:
    """(qid, n_relevant, ap): trapezoid AP; the jth relevant row at rank r adds ((j / r, 1 at r = 0) + (j + 1) / (r + 1)) / 2n."""
    j = F.row_number().over(Window.partitionBy("qid").orderBy("rank")) - 1
    step = ranks.withColumn("j", j)
    before = F.when(F.col("rank") == 0, F.lit(1.0)).otherwise(F.try_divide(F.col("j").cast("double"), F.col("rank")))
    part = (before + (F.col("j") + 1) / (F.col("rank") + 1)) / (2 * F.col("n_relevant"))
    return step.groupBy("qid").agg(F.first("n_relevant").alias("n_relevant"), F.sum(part).alias("ap"))


def precision_at(ranks: DataFrame, k: int) -> DataFrame:
    """(qid, p_at_k): relevant rows within the first kq = min(last relevant position, k), over kq."""
    last = ranks.groupBy("qid").agg(F.least(F.max(F.col("rank") + 1), F.lit(k)).alias("kq"), F.count(F.when(F.col("rank") < k, 1)).alias("_n"), F.collect_list("rank").alias("_r"))
    hits = F.size(F.filter("_r", lambda r: r + 1 <= F.col("kq")))
    return last.select("qid", (hits / F.col("kq")).alias("p_at_k"))


def accuracy_at(ranks: DataFrame, k: int) -> DataFrame:
    """(qid, hit): whether any relevant row is among the first k."""
    return ranks.groupBy("qid").agg((F.min("rank") < k).alias("hit"))
