"""Shards of like vectors: vantage-point trees that send every vector to one shard, level by level.

The first tree is fitted on a bounded sample drawn by hash. A shard that stays too large for its rows to meet in one
task gets a tree of its own, fitted on its own bounded sample in a task of its own, and so on; no level's trees but
the first pass through the driver. So shards keep their size whatever the number of vectors.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.vectors import VantageTree, coded, from_binary, to_binary
from vellum.runtime import settle, shared

SAMPLE_A_SHARD = 256
MOST_SAMPLE = 1 << 16  # rows on which one tree is fitted, at most; so a tree has at most 256 leaves
SLOTS = 512  # a shard's number is written in this base, a digit (from 1) a level
MOST_LEVELS = 5
PIECE_ROWS = 1 << 16  # rows of a shard that one task sends down a tree
OVER = 4  # a shard is divided again when it holds so many times the rows aimed at


def _fitted(x: np.ndarray, n: int, rows_a_shard: int, seed: int) -> VantageTree:
    shards = max(1, min(-(-n // rows_a_shard), SLOTS // 2))
    return VantageTree(x, max(1, -(-len(x) // shards)), seed).for_routing()


def sampled(rows: DataFrame, seed: int, share, key: str = "id") -> DataFrame:
    return rows.where(F.pmod(F.xxhash64(F.lit(seed), F.col(f"`{key}`").cast("long")), F.lit(1 << 20)) < F.floor(share * (1 << 20)) + 1)


class Routing:
    """The trees of one routing: the first as it is, of each later level a table (shard, tree, n)."""

    def __init__(self, spark, dim: int, first: VantageTree, levels: list[DataFrame]):
        self.dim, self.levels = dim, levels
        self.first = shared(spark, first)

    def homes(self, rows: DataFrame) -> DataFrame:
        """rows (id, vec) with the shard they fall into in the first tree."""
        dim, first = self.dim, self.first

        def run(batches):
            for b in batches:
                at = first().home(from_binary(b.column("vec"), dim)).astype(np.int64) + 1
                yield pa.record_batch([b.column("id"), b.column("vec"), pa.array(at)], names=["id", "vec", "shard"])

        return rows.select("id", "vec").mapInArrow(run, "id long, vec binary, shard long")

    def visits(self, asking: DataFrame, factor: float) -> DataFrame:
        """asking (id, vec, reach, home): a row with each shard but ``home`` that the ball of the reach, its margin shrunk by ``factor``, touches."""
        dim, first, kind = self.dim, self.first, "id long, vec binary, reach double, home long, shard long"
        plain = ["id", "vec", "reach", "home"]

        def near(t: pa.Table, tree: VantageTree, base: int) -> pa.Table:
            rows, leaves = tree.near_leaves(from_binary(t["vec"], dim), t["reach"].to_numpy(), factor)
            return t.select(plain).take(pa.array(rows)).append_column("shard", pa.array(base + leaves.astype(np.int64) + 1))

        last = not self.levels

        def run(batches):
            for whole in batches:
                for at in range(0, whole.num_rows, 2000):
                    met = near(pa.Table.from_batches([whole.slice(at, 2000)]), first(), 0)
                    if last:
                        met = met.filter(pc.not_equal(met["shard"], met["home"]))
                    yield from met.to_batches()

        met = asking.select(*plain).mapInArrow(run, kind)
        for trees in self.levels:
            inner = _down(met, trees, near, kind)
            met = met.join(trees.select("shard"), "shard", "left_anti").select(*plain, "shard").unionByName(inner)
        return met.where("shard <> home").drop("home")


    def spread(self, points: DataFrame, reach: float, factor: float, bare: bool = False) -> DataFrame:
        """points (id, vec): (id, code, shard, here), a row with each shard that the ball of the reach, its margin shrunk by ``factor``, touches.

        One of a point's rows is ``here``, that of its own shard. code is what :func:`coded` makes of the vector, a fourth of its
        size; with ``bare`` it is empty where no later level needs the vector.
        """
        dim, first, kind = self.dim, self.first, "id long, vec binary, shard long, here boolean"
        last = not self.levels

        def bytes_of(x: np.ndarray) -> np.ndarray:
            return np.zeros((len(x), 0), np.uint8) if bare else coded(x)

        def touched(ids, x: np.ndarray, here: np.ndarray, tree: VantageTree, base: int, sent: np.ndarray) -> pa.Table:
            rows, leaves = tree.near_leaves(x, np.full(len(x), reach), factor, flat=True)
            own = here[rows] & (leaves == tree.home(x)[rows])
            return pa.table([ids.take(pa.array(rows)), to_binary(sent[rows]), pa.array(base + leaves.astype(np.int64) + 1), pa.array(own)], names=["id", "vec", "shard", "here"])

        def run(batches):
            for whole in batches:
                for at in range(0, whole.num_rows, 2000):
                    b = whole.slice(at, 2000)
                    x = from_binary(b.column("vec"), dim)
                    yield from touched(b.column("id"), x, np.ones(len(x), bool), first(), 0, bytes_of(x) if last else x).to_batches()

        def deeper(t: pa.Table, tree: VantageTree, base: int) -> pa.Table:
            x = from_binary(t["vec"], dim)
            return touched(t["id"], x, t["here"].to_numpy(), tree, base, x)

        def coding(batches):
            for b in batches:
                yield pa.record_batch([b.column(0), to_binary(bytes_of(from_binary(b.column(1), dim))), *b.columns[2:]], names=b.schema.names)

        met = points.select("id", "vec").mapInArrow(run, kind)
        for trees in self.levels:
            inner = _down(met, trees, deeper, kind)
            met = met.join(trees.select("shard"), "shard", "left_anti").select("id", "vec", "shard", "here").unionByName(inner)
        return (met if last else met.mapInArrow(coding, kind)).withColumnRenamed("vec", "code")


def _down(rows: DataFrame, trees: DataFrame, step, kind: str) -> DataFrame:
    """rows whose shard has a tree go through ``step`` (table, tree, base of its leaves' numbers), in pieces of bounded size."""
    sizes = rows.join(trees.select("shard"), "shard", "left_semi").groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / PIECE_ROWS).alias("pieces"))
    sizes = settle(sizes)
    cut = rows.join(sizes, "shard").withColumn("piece", F.pmod(F.xxhash64("id"), F.col("pieces"))).drop("pieces")
    held = trees.join(sizes, "shard").select("shard", "tree", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)).alias("piece"))

    def meet(t: pa.Table, tree: pa.Table) -> pa.Table:
        names = [x.split()[0] for x in kind.split(", ")]
        if not len(t) or not len(tree):
            return pa.table({n: pa.array([], {"long": pa.int64(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_()}[x.split()[1]]) for n, x in zip(names, kind.split(", "), strict=True)})
        return step(t, VantageTree.of_root(*pickle.loads(tree["tree"][0].as_py())), t["shard"][0].as_py() * SLOTS).select(names)  # noqa: S301

    return cut.groupBy("shard", "piece").cogroup(held.groupBy("shard", "piece")).applyInArrow(meet, kind)


def _fit(dim: int, rows_a_shard: int, seed: int):
    """The tree of a shard from the rows sampled of it; its seed hangs on the shard alone."""

    def run(t: pa.Table) -> pa.Table:
        x = from_binary(t["vec"], dim)[np.argsort(t["id"].to_numpy())]
        tree = _fitted(x, t["n"][0].as_py(), rows_a_shard, seed)
        return pa.table({"shard": t["shard"].slice(0, 1), "tree": pa.array([pickle.dumps((tree.root, len(tree.leaves)))], pa.binary()), "leaves": pa.array([len(tree.leaves)], pa.int32())})

    return run


def routed(points: DataFrame, n: int, dim: int, rows_a_shard: int, seed: int, most_sample: int = MOST_SAMPLE, draw: Callable[[Column], DataFrame] | None = None) -> tuple[DataFrame, Routing]:
    """((id, vec, shard), routing) of ``points`` (id, vec), n rows: shards of about ``rows_a_shard`` rows.

    A shard stays larger than OVER times that only if no boundary divides it, that is if its vectors all but coincide.
    Where ``points`` are soon read again ``draw`` gives a share of them, and they are written to disk only if a second level is needed.
    """
    spark = points.sparkSession
    want = min(most_sample, n, max(1, -(-n // rows_a_shard)) * SAMPLE_A_SHARD)
    # in hash order, so that the same rows give the same tree whatever their layout
    share = F.lit(min(1.0, 1.3 * want / max(1, n)))
    some = (draw(share) if draw else sampled(points, seed, share)).orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(want)
    first = _fitted(from_binary(some.select("vec").toArrow()["vec"], dim), n, rows_a_shard, seed)
    routing = Routing(spark, dim, first, [])
    homed = routing.homes(points)
    if not draw:
        homed = settle(homed)
    for level in range(1, MOST_LEVELS):
        over = settle(homed.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > OVER * rows_a_shard))
        if not over.limit(1).count():
            break

        if draw and level == 1:
            homed = settle(homed)
        share = F.least(F.lit(1.0), F.least(F.lit(most_sample), F.ceil(F.col("n") / rows_a_shard) * SAMPLE_A_SHARD) / F.col("n"))
        drawn = sampled(homed.join(over, "shard"), seed + level, share).select("shard", "id", "vec", "n")
        trees = settle(drawn.groupBy("shard").applyInArrow(_fit(dim, rows_a_shard, seed + level), "shard long, tree binary, leaves int").where("leaves > 1").select("shard", "tree"))
        if not trees.limit(1).count():
            break

        def go(t: pa.Table, tree, base: int) -> pa.Table:
            at = tree.home(from_binary(t["vec"], dim)).astype(np.int64) + base + 1
            return pa.table({"id": t["id"], "vec": t["vec"], "shard": pa.array(at)})

        inner = _down(homed, trees, go, "id long, vec binary, shard long")
        homed = settle(homed.join(trees.select("shard"), "shard", "left_anti").select("id", "vec", "shard").unionByName(inner))
        routing.levels.append(trees)
    return homed, routing
