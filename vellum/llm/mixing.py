"""Mixing sources to target weights by min-cost flow over membership patterns.

Records are counted by membership pattern, the set of sources that hold them. For each entry a flow carries the patterns'
units to the entry's source quotas; the nth use of a unit costs n - 1, so repetition is spread and least. As the
only costs sit on the arcs that leave the flow's source and grow with the use, the cheapest augmenting path is
always one of the lowest open use level: levels are filled one after the other, each by breadth-first augmentation.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.operators.skew import balanced_positions
from vellum.runtime import settle

TOTAL = 1000
MAX_USES = 3
BUCKET_UNITS = 1024
SEPARATOR = "\x1f"
SLACK = 1e-7  # flow amounts below this are rounding


def min_cost_flow(quotas: list[float], patterns: list[tuple[list[int], float]], max_uses: int) -> list[dict[int, float]]:
    """For each pattern (the sources it belongs to, its units) what it sends to which source."""
    need = list(quotas)
    sent: list[dict[int, float]] = [{} for _ in patterns]
    for _ in range(max_uses):
        room = [units for _, units in patterns]
        open_ = True
        while open_:
            open_ = False
            for p in range(len(patterns)):
                while room[p] > SLACK:
                    # breadth first: pattern -> source -> pattern that could free it -> ...
                    came: dict[int, tuple[int, int]] = {}  # source: (pattern it is reached from, source before that)
                    queue = []
                    for s in patterns[p][0]:
                        if s not in came:
                            came[s] = (p, -1)
                            queue.append(s)
                    end = -1
                    for s in queue:
                        if need[s] > SLACK:
                            end = s
                            break
                        for other, gave in enumerate(sent):
                            if gave.get(s, 0) > SLACK:
                                for t in patterns[other][0]:
                                    if t not in came:
                                        came[t] = (other, s)
                                        queue.append(t)
                    if end < 0:
                        break
                    path, s = [], end
                    while s >= 0:
                        via, before = came[s]
                        path.append((via, s, before))
                        s = before
                    amount = min(room[p], need[end], *[sent[via][before] for via, _, before in path if before >= 0])
                    for via, to, before in path:
                        sent[via][to] = sent[via].get(to, 0) + amount
                        if before >= 0:
                            sent[via][before] -= amount
                    room[p] -= amount
                    need[end] -= amount
                    open_ = True
    return sent


def whole_quotas(shares: list[float], total: int) -> list[float]:
    """Whole numbers that add up to ``total``: the largest remainders are rounded up, equal ones in order."""
    down = [int(s * total) for s in shares]
    left = total - sum(down)
    for i in sorted(range(len(shares)), key=lambda i: (down[i] - shares[i] * total, i))[: max(0, left)]:
        down[i] += 1
    return [float(x) for x in down]


def _route(total: int, max_uses: int, whole: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = {k: [] for k in ("entry", "source", "share", "quota", "filled", "pattern", "starts", "ends")}
            for entry, wanted, supply in zip(b.column("entry").to_pylist(), b.column("wanted").to_pylist(), b.column("supply").to_pylist(), strict=True):
                wanted = sorted(wanted, key=lambda w: w["source"])
                at = {w["source"]: i for i, w in enumerate(wanted)}
                shares = [w["share"] for w in wanted]
                quotas = whole_quotas(shares, total) if whole else [s * total for s in shares]
                supply = sorted(supply or [], key=lambda s: s["pattern"])
                sent = min_cost_flow(quotas, [(sorted(at[s] for s in p["sources"]), float(p["units"])) for p in supply], max_uses)
                for s, i in at.items():
                    got = sum(x.get(i, 0.0) for x in sent)
                    for k, v in zip(out, (entry, s, shares[i], quotas[i], got, None, None, None), strict=True):
                        out[k].append(v)
                if whole:
                    for p, x in zip(supply, sent, strict=True):
                        here = 0.0
                        for i, amount in sorted(x.items()):
                            if amount > SLACK:
                                for k, v in zip(out, (entry, wanted[i]["source"], shares[i], quotas[i], amount, p["pattern"], int(round(here)), int(round(here + amount))), strict=True):
                                    out[k].append(v)
                                here += amount
            types = (b.schema.field("entry").type, pa.string(), pa.float64(), pa.float64(), pa.float64(), pa.string(), pa.int64(), pa.int64())
            yield pa.record_batch([pa.array(v, t) for v, t in zip(out.values(), types, strict=True)], names=list(out))

    return run


def shares_of(weights: DataFrame, entry: str, source: str, weight: str) -> DataFrame:
    """(entry, source, share): weights that are null, NaN, infinite or not above 0 are left out, equal names add up."""
    c = lambda x: F.col(f"`{x}`")
    w = c(weight).cast("double")
    good = weights.where(c(entry).isNotNull() & c(source).isNotNull() & w.isNotNull() & ~F.isnan(w) & (w > 0) & (w < float("inf")))
    summed = good.groupBy(c(entry).alias("entry"), c(source).alias("source")).agg(F.sum(w).alias("w"))
    return summed.select("entry", "source", (F.col("w") / F.sum("w").over(Window.partitionBy("entry"))).alias("share"))


def _supplied(shares: DataFrame, patterns: DataFrame) -> DataFrame:
    """(entry, fold, mine, pattern, units): each entry's patterns, ``mine`` being the sources of the pattern that the entry asks for."""
    supply = patterns.where("units > 0").select("pattern", F.col("units").cast("long").alias("units"), F.explode("sources").alias("source"))
    met = shares.select("entry", "source").join(supply, "source").groupBy("entry", "pattern").agg(F.array_sort(F.collect_set("source")).alias("mine"), F.max("units").alias("units"))
    return met.select("entry", F.array_join("mine", SEPARATOR).alias("fold"), "mine", "pattern", "units")


def mixture_plan(shares: DataFrame, patterns: DataFrame, total: int = TOTAL, max_uses: int = MAX_USES, whole: bool = False) -> DataFrame:
    """Flow of every entry: (entry, source, share, quota, filled, pattern, starts, ends).

    ``shares`` is (entry, source, share) with shares adding up to 1; ``patterns`` is (pattern, sources ARRAY, units), a
    unit being usable ``max_uses`` times in all. For each entry and source one row without a pattern says how much
    of the quota share * total was filled; with ``whole`` quotas are whole numbers, and rows with a pattern say
    which stretch [starts, ends) of uses (all first uses, then all second ones, ...) goes to the source. That pattern is a
    fold: all patterns that have the same of the entry's sources are one to it, however many other sources hold their
    records. A source in no pattern is filled 0. Null or negative units count 0. Empty shares give no rows.
    """
    kind = shares.schema["entry"].dataType.simpleString()
    folds = _supplied(shares, patterns).groupBy("entry", "fold").agg(F.first("mine").alias("sources"), F.sum("units").alias("units"))
    supplied = folds.groupBy("entry").agg(F.collect_list(F.struct(F.col("fold").alias("pattern"), "sources", "units")).alias("supply"))
    # both lists hang on the entry's own list of sources alone
    asked = shares.groupBy("entry").agg(F.collect_list(F.struct("source", "share")).alias("wanted"))
    rows = asked.join(supplied, "entry", "left").select("entry", "wanted", "supply")
    return rows.mapInArrow(_route(total, max_uses, whole), f"entry {kind}, source string, share double, quota double, filled double, pattern string, starts long, ends long")


def membership_patterns(members: DataFrame, record: list[str], source: str, size: str | None = None) -> DataFrame:
    """(record columns, pattern, sources, size): every distinct record with the sorted set of sources that hold it."""
    c = lambda x: F.col(f"`{x}`")
    amount = F.lit(1).cast("long") if size is None else F.coalesce(c(size).cast("long"), F.lit(0).cast("long"))
    known = members.where(c(source).isNotNull()).groupBy(*map(c, record)).agg(F.array_sort(F.collect_set(c(source))).alias("sources"), F.max(amount).alias("size"))
    return known.where("size > 0").withColumn("pattern", F.array_join("sources", SEPARATOR))


def drawn_mixture(members: DataFrame, record: list[str], source: str, shares: DataFrame, size: str | None = None, total: int = TOTAL, max_uses: int = MAX_USES, seed: int = 5) -> DataFrame:
    """(entry, source, record columns, uses): the records drawn for each entry, at most ``max_uses`` uses each.

    ``members`` has a row for each record and source that holds it; repeated rows count once, null sources and records of
    no size are left out. Records of a pattern stand in one seeded order, of which each entry takes stretches
    from a place of its own; a record is drawn where its first unit lies, so with sizes other than 1 a quota is met to
    within one record. Positions in a hot pattern are counted by range partitions, and an entry meets only the
    buckets of records that it takes from. Empty tables give no rows.
    """
    c = lambda x: F.col(f"`{x}`")
    known = membership_patterns(members, record, source, size).withColumn("draw", F.xxhash64(F.lit(seed), *map(c, record)))
    placed = settle(balanced_positions(known, "pattern", ["draw", *record], "size", "place", "units").withColumn("bucket", F.floor(F.col("place") / BUCKET_UNITS)))
    patterns = settle(placed.groupBy("pattern").agg(F.any_value("sources").alias("sources"), F.max("units").alias("units")))
    flows = mixture_plan(shares, patterns, total, max_uses, whole=True).where("pattern is not null").withColumnRenamed("pattern", "fold")
    # a fold's patterns stand one behind the other
    parts = _supplied(shares, patterns).withColumn("ef", F.concat_ws(SEPARATOR, F.col("entry").cast("string"), "fold"))
    parts = balanced_positions(parts, "ef", ["pattern"], "units", "offset", "fold_units").drop("ef", "mine")
    aimed = flows.select("entry", "source", "fold", "starts", "ends").join(parts, ["entry", "fold"])
    aimed = aimed.withColumn("turn", F.pmod(F.xxhash64(F.lit(seed), "entry", "fold"), F.col("fold_units")))
    begin, length = F.pmod(F.col("starts") - F.col("turn"), F.col("fold_units")), F.least(F.col("ends") - F.col("starts"), F.col("fold_units"))

    def buckets(back: Column) -> Column:
        """Buckets of the pattern in which the stretch, on its first or second way around the fold, takes records."""
        lo, hi = F.greatest(F.lit(0).cast("long"), begin - back - F.col("offset")), F.least(F.col("units"), begin + length - back - F.col("offset"))
        return F.when(lo < hi, F.sequence(F.floor(lo / BUCKET_UNITS), F.floor((hi - 1) / BUCKET_UNITS))).otherwise(F.array().cast("array<bigint>"))

    met = aimed.withColumn("bucket", F.explode(F.array_union(buckets(F.lit(0).cast("long")), buckets(F.col("fold_units")))))
    held = placed.drop("units", "sources")
    at = F.pmod(F.col("offset") + F.col("place") + F.col("turn"), F.col("fold_units"))
    uses = F.floor((F.col("ends") - 1 - at) / F.col("fold_units")) - F.floor((F.col("starts") - 1 - at) / F.col("fold_units"))
    return met.join(held, ["pattern", "bucket"]).select("entry", met["source"], *map(c, record), uses.alias("uses")).where("uses > 0")
