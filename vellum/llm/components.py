"""Connected components by hash-to-min: clusters are kept as rows, never as one array."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.runtime import discard, settle

MOST_ROUNDS = 200


def hash_to_min(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node in columns ``a`` and ``b``; component is its smallest node.

    Each node v holds a cluster C(v), at first itself and its neighbours. In a round v sends C(v) to the least node of
    C(v), and that least node to every other member. The rounds end when no row changes, after a number
    logarithmic in the nodes. A link of a node with itself (or a null on one side) makes it known without joining it to
    another. The cluster of a component's least node may hold the whole component: it is a set of rows (v, u) that
    AQE may split, and the two messages of a row need no more than the row and the least node of v.
    """
    ends = links.select(F.col(a).alias("v"), F.col(b).alias("u"))
    both = ends.unionByName(ends.select(F.col("u").alias("v"), F.col("v").alias("u")))
    selves = ends.select("v").unionByName(ends.select(F.col("u").alias("v"))).select("v", F.col("v").alias("u"))
    held = settle(both.unionByName(selves).where("v is not null and u is not null").distinct())
    mark = None
    for _ in range(MOST_ROUNDS):
        least = held.groupBy("v").agg(F.min("u").alias("m"))
        sent = held.join(least, "v").select(F.explode(F.array(F.struct(F.col("m").alias("v"), F.col("u").alias("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u")))).alias("x"))
        nxt = settle(sent.select("x.v", "x.u").distinct())
        discard(held)
        held = nxt
        now = held.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("v", "u"))).first()
        if mark == now:
            return held.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("component"))
        mark = now
    raise RuntimeError("components did not settle")
