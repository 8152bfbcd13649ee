"""Splits that keep related records together: components of linked entities, placed by weighted rendezvous hashing.

Hashing keeps proportions only over many small components. The few that hold a noticeable part of all records are
placed first, the largest first, each in the split that lacks most; the others are hashed with what is then still lacking as weights.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.components import hash_to_min
from vellum.runtime import settle

SPLITS = {"train": 0.8, "validation": 0.1, "test": 0.1}
LARGE_SHARE = 1000


def linked_entities(df: DataFrame, entity: str, record: list[str]) -> DataFrame:
    """(node, component): entities that occur on one record are linked, directly or through a chain.

    A record's entities are tied to the least of them, so a record with many gives as many links, not pairs. Rows with
    a null entity or a null in ``record`` are left out. An entity without a link is a component of its own.
    """
    c = lambda x: F.col(f"`{x}`")
    known = df.select(c(entity).alias("e"), F.struct(*[c(x) for x in record]).alias("r"), *[c(x).alias(f"k{i}") for i, x in enumerate(record)])
    known = known.where(" and ".join(["e is not null", *[f"k{i} is not null" for i in range(len(record))]])).select("e", "r").distinct()
    least = known.groupBy("r").agg(F.min("e").alias("m"))
    return hash_to_min(known.join(least, "r").select("e", "m").distinct(), "e", "m")


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) from the parts' texts, the same in every engine that has md5."""
    digits = F.substring(F.md5(F.concat_ws("|", *parts)), 1, 12)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(16**12)


def rendezvous(key: Column, weights: dict[str, Column], seed: str) -> Column:
    """The split with the greatest score: -weight / ln(u), u uniform by split and key; at least one weight must be above 0.

    A change of one weight moves only the keys that this split gains or loses.
    """
    # the better score comes first in the array's order, equal ones by name
    offers = F.array(*[F.struct((w / F.log(uniform(F.lit(seed), F.lit(s), key))).alias("score"), F.lit(s).alias("split")) for s, w in weights.items()])
    return F.array_min(offers)["split"]


def placed_components(sizes: DataFrame, weights: dict[str, float], seed: str) -> DataFrame:
    """(component, split) for ``sizes`` (component, n).

    Components of more than 1 / LARGE_SHARE of all records, of which there can be no more than LARGE_SHARE, are placed by falling
    size (equal ones by name), each in the split that lacks most records (equal ones: the first). All others go by
    weighted rendezvous hashing, the weights being what the splits then lack; if none lacks any, the given ones.
    """
    live = {s: float(w) for s, w in weights.items() if w > 0}
    if not live:
        raise ValueError("no split has a positive weight")
    names, shares = F.array(*map(F.lit, live)), F.array(*[F.lit(w / sum(live.values())) for w in live.values()])
    whole = sizes.agg(F.sum("n").alias("n_all"))
    large = sizes.join(F.broadcast(whole), F.col("n") * LARGE_SHARE > F.col("n_all")).select(F.struct((-F.col("n")).alias("m"), "component").alias("x"))
    listed = whole.join(large.agg(F.array_sort(F.collect_list("x")).alias("xs")), F.lit(True))
    start = F.struct(F.transform(shares, lambda w: w * F.col("n_all")).alias("lacks"), F.array().cast("array<int>").alias("put"))

    def place(state, x):
        best = F.array_position(state["lacks"], F.array_max(state["lacks"])).cast("int")
        lacks = F.transform(state["lacks"], lambda v, i: F.when(i == best - 1, v + x["m"]).otherwise(v))
        return F.struct(lacks.alias("lacks"), F.concat(state["put"], F.array(best)).alias("put"))

    settled = settle(listed.select("xs", F.aggregate("xs", start, place).alias("s")))
    put = settled.select(F.explode(F.arrays_zip(F.col("xs.component").alias("component"), F.col("s.put").alias("put"))).alias("p")).select("p.component", F.element_at(names, F.col("p.put")).alias("large_split"))
    lack = lambda i: F.greatest(F.element_at("s.lacks", F.lit(i + 1)), F.lit(0.0))
    left = sum((lack(i) for i in range(len(live))), F.lit(0.0))
    needs = settled.select(*[F.when(left > 0, lack(i)).otherwise(F.lit(w)).alias(f"need{i}") for i, w in enumerate(live.values())])
    hashed = rendezvous(F.col("component").cast("string"), {s: F.col(f"need{i}") for i, s in enumerate(live)}, seed)
    # at most LARGE_SHARE rows, and one
    return sizes.select("component").join(F.broadcast(put), "component", "left").join(F.broadcast(needs), F.lit(True)).select("component", F.coalesce("large_split", hashed).alias("split"))


def grouped_splits(df: DataFrame, entity: str, record: list[str], weights: dict[str, float] | None = None, seed: str = "splits") -> DataFrame:
    """(entity, component, split): every entity with the split in which all its component's records land.

    See :func:`linked_entities` for nulls and :func:`placed_components` for the proportions, which are of distinct records. A
    component is never cut, so where one is larger than a split's share the reached shares, which are for the caller
    to report, can't all be the given ones. Repeated rows change nothing; an empty table gives no rows.
    """
    tied = settle(linked_entities(df, entity, record))
    c = lambda x: F.col(f"`{x}`")
    known = df.where(" and ".join(f"`{x}` is not null" for x in [entity, *record])).select(c(entity).alias("node"), F.struct(*map(c, record)).alias("r"))
    # a record's entities are of one component, so its least one stands for it
    sizes = known.groupBy("r").agg(F.min("node").alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n")).join(tied, "node").groupBy("component").agg(F.sum("n").alias("n"))
    put = placed_components(settle(sizes), weights or SPLITS, seed)
    return tied.join(put, "component").select(F.col("node").alias(entity), "component", "split")


def linked_pairs(components: DataFrame) -> DataFrame:
    """(a, b), a < b, of every two nodes of one component: a result of as many rows as pairs.

    The scale form of the same result is (node, component), which :func:`linked_entities` gives in as many rows as nodes; pairs are
    for components known to be small. A component's nodes meet in a join that AQE splits where one component is hot.
    """
    many = settle(components)
    l, r = many.alias("l"), many.alias("r")  # noqa: E741
    return l.join(r, (F.col("l.component") == F.col("r.component")) & (F.col("l.node") < F.col("r.node"))).select(F.col("l.node").alias("a"), F.col("r.node").alias("b"))
