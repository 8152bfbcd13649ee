"""Most similar vectors for every vector: vantage-point trees per shard, pruned by a relaxed triangle inequality.

A routing (see routing.py) gives every distinct vector one shard; each shard builds its own tree over all its rows. A
query first searches its home shard, whose kth distance bounds its reach, and then only the shards that its
ball of that reach, shrunk by ``factor``, still touches. Factor one is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.routing import OVER, routed, sampled
from vellum.llm.vectors import VantageTree, decoded, distance, folded_copies, from_binary, unit_vectors
from vellum.runtime import settle

SHARD_ROWS = 1 << 13  # rows of a shard that the routing aims at
PAIR_SHARD_ROWS = 1 << 16  # the same for pairs, where a row is a fourth as large; larger shards are visited less
QUERY_ROWS = 1 << 15  # queries that one task searches in a shard at most
PAIR_QUERY_ROWS = 1 << 19  # the same for pairs
FACTOR = 0.25  # measured: recall 1.0 of pairs with cosine >= 0.975, see README


def _search(dim: int, k: int, factor: float, leaf_rows: int, seed: int):
    def run(t: pa.Table) -> pa.Table:
        here, asks = t["here"].to_numpy(), t["asks"].to_numpy()
        points, queries = t.filter(pa.array(here)), t.filter(pa.array(asks))
        out = {"qid": [], "nid": [], "cos": []}
        if len(points) and len(queries):
            order = np.argsort(points["id"].to_numpy())
            x, ids = from_binary(points["vec"], dim)[order], points["id"].to_numpy()[order]
            q, own = from_binary(queries["vec"], dim), queries["id"].to_numpy()
            tree = VantageTree(x, leaf_rows, seed)
            cos, near = tree.nearest(q, k, queries["reach"].to_numpy(), factor, ids, own)
            r, c = np.nonzero(near >= 0)
            # float64 for the value that is reported
            at = np.searchsorted(ids, near[r, c])
            exact = np.einsum("ij,ij->i", q[r].astype(np.float64), x[at].astype(np.float64)) if len(r) else np.zeros(0)
            out = {"qid": own[r], "nid": near[r, c], "cos": exact}
        return pa.table([pa.array(out["qid"], pa.int64()), pa.array(out["nid"], pa.int64()), pa.array(out["cos"], pa.float64())], names=["qid", "nid", "cos"])

    return run


def _in_shards(points: DataFrame, visits: DataFrame | None, dim: int, k: int, factor: float, shard_rows: int, leaf_rows: int = 128, seed: int = 11) -> DataFrame:
    """points (id, vec, shard, reach, null where the point doesn't ask) and visitors (id, vec, reach, shard): (qid, nid, cos).

    A shard with many queries is searched by several tasks, each with a copy of the shard's bounded rows, a point
    asking in one of them. A shard that routing could not divide is cut by hash, and its queries visit every cut.
    """
    asking = points.where("reach is not null").select("shard")
    asking = asking if visits is None else asking.unionByName(visits.select("shard"))
    loads = asking.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / QUERY_ROWS).cast("int").alias("q_cuts"))
    sizes = points.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / (OVER * shard_rows)).cast("int").alias("p_cuts"))
    cuts = settle(loads.join(sizes, "shard"))  # a row a shard
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    dealt = lambda d: d.join(cuts, "shard").withColumn("own", F.pmod(F.xxhash64(F.lit(1), "id"), F.col("q_cuts")).cast("int"))
    held = dealt(points).withColumn("home", F.pmod(F.xxhash64("id"), F.col("p_cuts")).cast("int")).withColumn("qc", upto("q_cuts"))
    # a point of a shard that is cut asks in the other cuts as a visitor
    whole = held.select("shard", F.col("home").alias("pc"), "qc", "id", "vec", F.coalesce("reach", F.lit(0.0)).alias("reach"), F.lit(True).alias("here"), (F.col("reach").isNotNull() & (F.col("qc") == F.col("own"))).alias("asks"))
    others = held.where("p_cuts > 1 and reach is not null and qc = own").withColumn("pc", upto("p_cuts")).where("pc <> home")
    whole = whole.unionByName(others.select("shard", "pc", "qc", "id", "vec", "reach", F.lit(False).alias("here"), F.lit(True).alias("asks")))
    if visits is not None:
        met = dealt(visits).withColumn("pc", upto("p_cuts"))
        whole = whole.unionByName(met.select("shard", "pc", F.col("own").alias("qc"), "id", "vec", "reach", F.lit(False).alias("here"), F.lit(True).alias("asks")))
    return whole.groupBy("shard", "pc", "qc").applyInArrow(_search(dim, k, factor, leaf_rows, seed), "qid long, nid long, cos double")


def _best(pairs: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("qid").orderBy(F.desc("cos"), "nid")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def most_similar(df: DataFrame, row_id: str, vec: str, dim: int, k: int, queries: str | None = None, least_cosine: float = -1.0, factor: float = FACTOR, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(row_id, neighbour_id, cosine, rank): for every query row the k other rows with the greatest cosine.

    ``queries`` is a predicate on ``row_id`` that states the query set (all usable rows if None), searched against
    all usable rows. Only neighbours with cosine >= ``least_cosine`` are given, so a row may have fewer than k. Equal cosines are
    ordered by neighbour_id. Unusable vectors (null, other length, a null, NaN or infinite element, all zero) neither
    ask nor answer. Exact copies are searched once and count as neighbours of each other with cosine 1. Empty tables
    give no rows; extra columns are pruned. With ``factor`` one the result is exact.
    """
    spark = df.sparkSession
    units = unit_vectors(df, row_id, vec, dim)
    reps, rows = folded_copies(units)
    n = reps.count()
    schema = f"`{row_id}` long, neighbour_id long, cosine double, rank int"
    if not n:
        return spark.createDataFrame([], schema)
    points, routing = routed(reps.withColumnRenamed("rep", "id"), n, dim, shard_rows, 7)
    asked = rows if queries is None else rows.where(queries.replace(row_id, "id"))
    ask = points if queries is None else points.join(asked.select(F.col("rep").alias("id")).distinct(), "id", "left_semi")

    furthest = distance(least_cosine) + 1e-6
    reach = F.lit(furthest)
    if queries is None:
        asking = points.withColumn("reach", reach)
    else:
        asking = points.join(ask.select("id", F.lit(True).alias("_asks")), "id", "left").select("id", "vec", "shard", F.when(F.col("_asks"), reach).alias("reach"))
    if least_cosine > 0:
        # the bound on the distance is close enough to route by at once
        visits = routing.visits(ask.select("id", "vec", reach.alias("reach"), F.col("shard").alias("home")), factor)
        found = _in_shards(asking, visits, dim, k, factor, shard_rows)
    else:
        near = settle(_in_shards(asking, None, dim, k, factor, shard_rows))
        kth = near.groupBy(F.col("qid").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.min("cos").alias("c"))
        bound = F.when(F.col("n") >= k, F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("c")))).otherwise(reach)
        again = ask.join(kth, "id", "left").select("id", "vec", F.coalesce(bound, reach).alias("reach"), F.col("shard").alias("home"))
        visits = routing.visits(again, factor)
        found = near.unionByName(_in_shards(points.withColumn("reach", F.lit(None).cast("double")), visits, dim, k, factor, shard_rows))
    close = _best(found.where(F.col("cos") >= least_cosine), k).select("qid", "nid", "cos")

    # back from distinct vectors to rows: of the copies of a vector the k + 1 smallest ids can matter
    front = rows.withColumn("at", F.row_number().over(Window.partitionBy("rep").orderBy("id"))).where(F.col("at") <= k + 1).select(F.col("rep").alias("nid"), F.col("id").alias("neighbour_id"))
    near_reps = close.unionByName(asked.select(F.col("rep").alias("qid")).distinct().select("qid", F.col("qid").alias("nid"), F.lit(1.0).alias("cos")))
    offers = near_reps.join(front, "nid").select("qid", "neighbour_id", "cos")
    short = offers.withColumn("at", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("cos"), "neighbour_id"))).where(F.col("at") <= k + 1).drop("at")
    expanded = asked.join(short, F.col("rep") == F.col("qid")).where("id <> neighbour_id")
    ranked = expanded.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("cos"), "neighbour_id"))).where(F.col("rank") <= k)
    return ranked.select(F.col("id").alias(row_id), "neighbour_id", F.col("cos").alias("cosine"), F.col("rank").cast("int").alias("rank"))


def _close(dim: int, least: float, factor: float, leaf_rows: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        points, queries = t.filter(t["answers"]).sort_by("id"), t.filter(t["asks"])
        if not len(points) or not len(queries):
            return
        x, off = decoded(points["code"], dim)
        ids, off, tree = points["id"].to_numpy(), off.max(), VantageTree(x, leaf_rows, seed)
        for at in range(0, len(queries), 1 << 14):
            asked = queries.slice(at, 1 << 14)
            q, far = decoded(asked["code"], dim)
            own, here = asked["id"].to_numpy(), asked["here"].to_numpy()
            # what the bytes leave open is left to the exact comparison
            short = far + off
            for r, c in tree.within(q, (least - short - 1e-6).astype(np.float32), distance(least) + short, factor):
                # two rows of one shard both ask
                kept = (own[r] < ids[c]) | (~here[r] & (own[r] != ids[c]))
                a, b = own[r[kept]], ids[c[kept]]
                yield pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["row_a", "row_b"])

    return run


def _cosines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 2000):
            part = b.slice(at, 2000)
            x, y = (np.asarray(part.column(n).flatten(), np.float64).reshape(part.num_rows, -1) for n in ("vec_a", "vec_b"))
            cos = (x * y).sum(1) / np.sqrt((x * x).sum(1) * (y * y).sum(1))
            yield pa.record_batch([part.column("row_a"), part.column("row_b"), pa.array(cos)], names=["row_a", "row_b", "cosine"])


def close_pairs(df: DataFrame, row_id: str, vec: str, dim: int, least_cosine: float, factor: float = FACTOR, shard_rows: int = PAIR_SHARD_ROWS) -> DataFrame:
    """(row_a, row_b, cosine), row_a < row_b: every pair of rows with cosine >= ``least_cosine`` (above 0), each once, copies too.

    Shards are visited as in :func:`most_similar`, but a visitor is a byte an element, and a shard's pairs are those that
    the bytes don't rule out; these few are compared by their vectors. The vectors themselves are read from ``df`` as
    often as they are needed and neither written nor shuffled, but those of the few pairs. Unusable vectors and rows without an id have
    no pairs; ids are taken to be unique. With ``factor`` one the result is exact.
    """
    spark = df.sparkSession
    units = unit_vectors(df, row_id, vec, dim)
    n = df.where(F.col(f"`{row_id}`").isNotNull() & (F.size(f"`{vec}`") == dim)).count()
    if not n:
        return spark.createDataFrame([], "row_a long, row_b long, cosine double")
    seed = 7
    _, routing = routed(units, n, dim, shard_rows, seed, draw=lambda share: unit_vectors(sampled(df, seed, share, row_id), row_id, vec, dim))
    reach = distance(least_cosine) + 1e-6

    loads = routing.spread(units, reach, factor, bare=True).groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.count_if("here").alias("n_here"))
    # a row a shard, of shards that have rows of their own
    cuts = settle(loads.where("n_here > 0").select("shard", F.ceil(F.col("n") / PAIR_QUERY_ROWS).cast("int").alias("q_cuts"), F.ceil(F.col("n_here") / (OVER * shard_rows)).cast("int").alias("p_cuts")))
    upto = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    dealt = routing.spread(units, reach, factor).join(cuts, "shard").withColumn("own", F.pmod(F.xxhash64(F.lit(1), "id"), F.col("q_cuts")).cast("int"))
    home = F.when(F.col("here"), F.pmod(F.xxhash64("id"), F.col("p_cuts")).cast("int"))
    # a row asks in every cut of a shard, and answers all that ask in its own
    placed = dealt.withColumn("home", home).withColumn("pc", F.explode(upto("p_cuts")))
    answers = F.coalesce(F.col("home") == F.col("pc"), F.lit(False))
    placed = placed.withColumn("answers", answers).withColumn("qc", F.explode(F.when(F.col("answers"), upto("q_cuts")).otherwise(F.array("own"))))
    cells = placed.select("shard", "pc", "qc", "id", "code", "here", "answers", (F.col("qc") == F.col("own")).alias("asks"))
    maybe = settle(cells.groupBy("shard", "pc", "qc").applyInArrow(_close(dim, least_cosine, factor, 128, 11), "row_a long, row_b long").distinct())

    named = maybe.select(F.explode(F.array("row_a", "row_b")).alias("id")).distinct()
    vectors = df.select(F.col(f"`{row_id}`").cast("long").alias("id"), F.col(f"`{vec}`").cast("array<float>").alias("v")).join(named, "id", "left_semi")
    both = maybe.join(vectors.select(F.col("id").alias("row_a"), F.col("v").alias("vec_a")), "row_a").join(vectors.select(F.col("id").alias("row_b"), F.col("v").alias("vec_b")), "row_b")
    return both.select("row_a", "row_b", "vec_a", "vec_b").mapInArrow(_cosines, "row_a long, row_b long, cosine double").where(F.col("cosine") >= least_cosine)
