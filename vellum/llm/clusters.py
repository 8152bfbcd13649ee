"""Similarity clusters: a neighbour graph by neighbour descent, communities by modularity, described by their centre.

The graph starts from exact neighbours within the shards of differently seeded vantage-point routings, so that
the lists cross shard borders; rounds of neighbour descent then compare the neighbours of every vector with
each other until few lists change. Communities grow by local moves of greatest modularity gain until none gains,
over as many levels of the graph as still merge.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.components import hash_to_min
from vellum.llm.routing import OVER, routed
from vellum.llm.vectors import folded_copies, from_binary, to_binary, unit_vectors
from vellum.runtime import discard, fan_out, settle

NEIGHBOURS = 8
NEAR = 0.5  # least cosine of an entry of a neighbour list: what is further leads to no link
SHARD_ROWS = 4096
ROUTINGS = 4
MOST_ROUNDS = 50  # rounds never reach this; it ends in an error
FEW = 0.001  # the descent ends when fewer than this share of the lists' entries are new
LINK = 0.8
STAR = 3.0  # no cosine: marks a row's tie to the least row that a shard's links join it to
MOVES = 4
MOST_TURNS = 1000  # turns never reach this; it ends in an error
GAIN = 1e-9  # of a node's degree: gains below it are rounding
LOCAL_LINKS = 1 << 18  # a component of more links is settled by turns of all tasks
HALF_ERROR = 0.004  # float16 cosines are off by far less; links this near the threshold are measured again


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of the component of each of n nodes."""
    root = np.arange(n)
    while True:
        low = root.copy()
        least = np.minimum(root[a], root[b])
        np.minimum.at(low, root[a], least)
        np.minimum.at(low, root[b], least)
        while (low[low] != low).any():
            low = low[low]
        if (low == root).all():
            return root
        root = low


def _met(x: np.ndarray, ids: np.ndarray, y: np.ndarray, others: np.ndarray, k: int, least: float, same: bool) -> list[np.ndarray]:
    """[v, u, cos]: for rows of x the k nearest of y with cosine NEAR or more, and a link for every two groups of rows that
    only links beyond these lists join; ``same`` if y is x: then also, at the cosine STAR, each row with the least row that links join it to."""
    n, shift = len(x), 0 if same else len(x)
    vs, us, cs = [], [], []

    def blocks():
        for a in range(0, n, 512):
            c = x[a : a + 512] @ y.T
            if same:
                c[np.arange(len(c)), np.arange(a, a + len(c))] = -2
            yield a, c

    for a, c in blocks():
        m = min(k, c.shape[1])
        if np.count_nonzero(c >= NEAR) > 4 * m * len(c):
            # a dense block: the greatest of each row without a sort of all that are near
            j = np.argpartition(-c, m - 1, axis=1)[:, :m].ravel()
            i = np.repeat(np.arange(len(c)), m)
            near = c[i, j] >= NEAR
            i, j = i[near], j[near]
        else:
            i, j = np.nonzero(c >= NEAR)
            order = np.lexsort((others[j], -c[i, j], i))
            i, j = i[order], j[order]
            near = np.arange(len(i)) - np.searchsorted(i, np.arange(len(c)))[i] < k
            i, j = i[near], j[near]
        vs.append(i + a)
        us.append(j)
        cs.append(c[i, j])
    v, u, w = np.concatenate(vs), np.concatenate(us), np.concatenate(cs)
    sure = w >= least + 1e-6
    root = _roots(shift + len(y), v[sure], u[sure] + shift)
    if len(np.unique(root)) > 1:
        # links beyond the lists, where they join what the lists leave apart
        for a, c in blocks():
            i, j = np.nonzero((c >= least + 1e-6) & (root[a : a + len(c), None] != root[None, shift:]))
            if len(i):
                p, q = root[i + a], root[j + shift]
                _, once = np.unique(np.stack([np.minimum(p, q), np.maximum(p, q)], 1), axis=0, return_index=True)
                v, u, w = np.append(v, i[once] + a), np.append(u, j[once]), np.append(w, c[i[once], j[once]])
    if same:
        sure = w >= least + 1e-6
        root = _roots(n, v[sure], u[sure])
        far = np.flatnonzero(root != np.arange(n))
        v, u, w = np.append(v, far), np.append(u, root[far]), np.append(w, np.full(len(far), STAR))
    return [ids[v], others[u], w.astype(np.float32)]


def _table(found: list[np.ndarray]) -> pa.Table:
    return pa.table([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64()), pa.array(found[2], pa.float32())], names=["v", "u", "cos"])


def _in_shard(dim: int, k: int, least: float):
    """Near rows and links within a shard."""

    def run(t: pa.Table) -> pa.Table:
        ids = t["id"].to_numpy()
        order = np.argsort(ids)
        x, ids = from_binary(t["vec"], dim)[order], ids[order]
        return _table(_met(x, ids, x, ids, k, least, True))

    return run


def _across(dim: int, k: int, least: float):
    """Near rows and links between two cuts of a shard, told from both sides."""

    def run(t: pa.Table, o: pa.Table) -> pa.Table:
        x, ids, y, others = from_binary(t["vec"], dim), t["id"].to_numpy(), from_binary(o["vec"], dim), o["id"].to_numpy()
        if not len(ids) or not len(others):
            return _table([np.zeros(0, np.int64)] * 2 + [np.zeros(0, np.float32)])
        one, two = _met(x, ids, y, others, k, least, False), _met(y, others, x, ids, k, least, False)
        return _table([np.append(p, q) for p, q in zip(one, two, strict=True)])

    return run


def _near_in_shards(homed: DataFrame, dim: int, k: int, least: float, shard_rows: int) -> DataFrame:
    """(v, u, cos, across) within the shards of homed (id, vec, shard). A shard that routing could not divide, its vectors all but
    coinciding, is cut by hash, and every two of its cuts meet too, across."""
    cuts = settle(homed.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / (OVER * shard_rows)).cast("int").alias("cuts")))
    dealt = homed.join(cuts, "shard").withColumn("cut", F.pmod(F.xxhash64("id"), F.col("cuts")).cast("int"))
    inside = dealt.groupBy("shard", "cut").applyInArrow(_in_shard(dim, k, least), "v long, u long, cos float").withColumn("across", F.lit(False))
    if not cuts.where("cuts > 1").limit(1).count():
        return inside
    hard = dealt.where("cuts > 1")
    first = hard.withColumn("j", F.explode(F.sequence(F.col("cut"), F.col("cuts") - 1))).where("j > cut").select("shard", F.col("cut").alias("i"), "j", "id", "vec")
    second = hard.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("cut")))).where("i < cut").select("shard", "i", F.col("cut").alias("j"), "id", "vec")
    return inside.unionByName(first.groupBy("shard", "i", "j").cogroup(second.groupBy("shard", "i", "j")).applyInArrow(_across(dim, k, least), "v long, u long, cos float").withColumn("across", F.lit(True)))


def _best(edges: DataFrame, k: int) -> DataFrame:
    """The k nearest entries of each list; an entry has the routings (bits of ``tag``) whose shards hold both, and is ``fresh`` if new."""
    w = Window.partitionBy("v").orderBy(F.desc("cos"), "u")
    once = edges.groupBy("v", "u").agg(F.max("cos").alias("cos"), F.bit_or("tag").alias("tag"), F.min("fresh").alias("fresh"))
    return once.withColumn("at", F.row_number().over(w)).where(F.col("at") <= k).drop("at")


def _narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x = from_binary(b.column("vec"), len(b.column("vec")[0].as_py()) // 4) if b.num_rows else np.zeros((0, 1), np.float32)
        yield pa.record_batch([b.column("id"), to_binary(x.astype(np.float16))], names=["id", "half"])


def _local_join(dim: int, width: int, least: float):
    """Rows (v, u, tag, fresh, half, kth) sorted by v: better neighbours, and links, among the members of each v that never met."""

    def groups(v: np.ndarray, u: np.ndarray, tag: np.ndarray, fresh: np.ndarray, x: np.ndarray, kth: np.ndarray) -> pa.RecordBatch:
        first = np.flatnonzero(np.append(True, v[1:] != v[:-1]))
        size = np.diff(np.append(first, len(v)))
        slot = np.arange(len(v)) - np.repeat(first, size)
        g = np.repeat(np.arange(len(first)), size)
        wide = int(size.max())
        grid = lambda fill, kind: np.full((len(first), wide), fill, kind)
        xs = np.zeros((len(first), wide, dim), np.float32)
        us, ks, ts, fs = grid(-1, np.int64), grid(9, np.float32), grid(-1, np.int32), grid(False, bool)
        xs[g, slot], us[g, slot], ks[g, slot], ts[g, slot], fs[g, slot] = x, u, kth, tag, fresh
        c = xs @ xs.transpose(0, 2, 1)
        # a better entry of the list of the first, or a link
        good = (c > np.minimum(np.maximum(ks, NEAR), least - HALF_ERROR)[:, :, None]) & (us[:, None, :] >= 0) & (us[:, :, None] >= 0) & (us[:, :, None] != us[:, None, :])
        good &= (ts[:, :, None] & ts[:, None, :] == 0) & (fs[:, :, None] | fs[:, None, :])
        a, i, j = np.nonzero(good)
        # two neighbours can meet at several v: each pair is told once here
        pair = np.unique(np.stack([us[a, i], us[a, j]], 1), axis=0, return_index=True)[1] if len(a) else np.zeros(0, int)
        a, i, j = a[pair], i[pair], j[pair]
        return pa.record_batch([pa.array(us[a, i]), pa.array(us[a, j]), pa.array(c[a, i, j].astype(np.float32))], names=["v", "u", "cos"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []

        def parts(b):
            plain = [b.column(n).to_numpy(zero_copy_only=False) for n in ("v", "u", "tag", "fresh")]
            return *plain, from_binary(b.column("half"), dim, np.float16).astype(np.float32), b.column("kth").to_numpy(zero_copy_only=False)

        for b in batches:
            if not b.num_rows:
                continue
            now = parts(b)
            if held:
                now = tuple(np.concatenate([p, q]) for p, q in zip(held, now, strict=True))
            # the last v may go on in the next batch; a v has no more than a few dozen members
            cut = int(np.searchsorted(now[0], now[0][-1]))
            held = [p[cut:] for p in now]
            if cut:
                ends = np.flatnonzero(np.append(now[0][1:cut] != now[0][: cut - 1], True)) + 1
                a = 0
                for e in [*ends[width - 1 :: width].tolist(), cut]:
                    if e > a:
                        yield groups(*[p[a:e] for p in now])
                        a = e
        if held and len(held[0]):
            yield groups(*held)

    return run


def neighbour_graph(reps: DataFrame, dim: int, k: int = NEIGHBOURS, least: float = LINK, shard_rows: int = SHARD_ROWS, routings: int = ROUTINGS) -> tuple[DataFrame, list[DataFrame], DataFrame]:
    """(edges, stars, links) of the distinct vectors ``reps`` (rep, vec): edges (v, u, cos) are the lists of near neighbours; stars, one
    (v, u) a routing, tie each vector to the least that links of ``least`` or more join it to within its shard; links (v, u, cos) are the other
    pairs that were met and, by their float16 vectors, may be links.

    Each of several routings puts like vectors into one shard, within which all pairs meet: the k nearest of each row are
    its list, and where links beyond the lists join what the lists leave apart, one of them is kept. Neighbour descent
    then lets two entries of a list meet, if they shared no shard and one of them is new, until few entries are new.
    """
    spark = reps.sparkSession
    points = reps.withColumnRenamed("rep", "id")
    n = reps.count()
    met, stars = None, []
    for r in range(routings):
        homed, _ = routed(points, n, dim, shard_rows, 3 + r)
        made = settle(_near_in_shards(homed, dim, k, least, shard_rows).withColumn("tag", F.lit(1 << r)))
        discard(homed)
        stars.append(made.where(F.col("cos") == STAR).select("v", "u"))
        near = made.where(F.col("cos") < STAR)
        met = near if met is None else met.unionByName(near)
    edges = settle(_best(met.drop("across").withColumn("fresh", F.lit(True)), k))
    links = met.where((F.col("cos") >= least - HALF_ERROR) & F.col("across")).select("v", "u", "cos")
    halves = settle(points.mapInArrow(_narrow, "id long, half binary"))
    for turn in range(MOST_ROUNDS):
        kth = edges.groupBy(F.col("v").alias("u")).agg(F.when(F.count(F.lit(1)) >= k, F.min("cos")).otherwise(-1.0).cast("float").alias("kth"))
        back = edges.select(F.col("u").alias("v"), F.col("v").alias("u"), "tag", "fresh")
        back = back.withColumn("at", F.row_number().over(Window.partitionBy("v").orderBy(F.desc("fresh"), F.xxhash64(F.lit(turn), "u")))).where(F.col("at") <= k).drop("at")
        members = settle(edges.select("v", "u", "tag", "fresh").unionByName(back).groupBy("v", "u").agg(F.bit_or("tag").alias("tag"), F.max("fresh").alias("fresh")))
        # entries that all share a shard have met
        open_ = members.groupBy("v").agg(F.bit_and("tag").alias("all"), F.max("fresh").alias("any")).where("all = 0 and any").select("v")
        asked = members.join(open_, "v").join(kth, "u", "left").withColumn("kth", F.coalesce("kth", F.lit(-1.0).cast("float")))
        held = asked.join(halves.withColumnRenamed("id", "u"), "u").select("v", "u", "tag", "fresh", "half", "kth").repartition(fan_out(spark) * 2, "v").sortWithinPartitions("v")
        better = settle(held.mapInArrow(_local_join(dim, 1024, least), "v long, u long, cos float"))
        found = better.where(F.col("cos") >= least - HALF_ERROR)
        links = links.unionByName(found)
        old = edges.withColumn("fresh", F.lit(False)).unionByName(better.withColumns({"tag": F.lit(0), "fresh": F.lit(True)}))
        nxt = settle(_best(old, k))
        discard(edges)
        discard(members)
        edges = nxt
        total, new = edges.agg(F.count(F.lit(1)), F.count_if("fresh")).first()
        if new <= FEW * total:
            break
    else:
        raise RuntimeError("neighbour descent did not settle")
    discard(halves)
    return edges.select("v", "u", "cos"), stars, links


def links_above(edges: DataFrame, reps: DataFrame, dim: int, least: float = LINK) -> DataFrame:
    """(a, b, w), a < b: the graph's pairs with cosine >= ``least``; those near it are measured anew in float64."""
    pairs = edges.where(F.col("cos") >= least - HALF_ERROR).select(F.least("v", "u").alias("a"), F.greatest("v", "u").alias("b"), F.col("cos").cast("double").alias("w"))
    pairs = settle(pairs.groupBy("a", "b").agg(F.max("w").alias("w")))
    doubt = pairs.where(F.abs(F.col("w") - least) < HALF_ERROR)
    x, y = reps.select(F.col("rep").alias("a"), F.col("vec").alias("va")), reps.select(F.col("rep").alias("b"), F.col("vec").alias("vb"))

    def measure(batches):
        for b in batches:
            p, q = from_binary(b.column("va"), dim).astype(np.float64), from_binary(b.column("vb"), dim).astype(np.float64)
            yield pa.record_batch([b.column("a"), b.column("b"), pa.array((p * q).sum(1))], names=["a", "b", "w"])

    exact = doubt.join(x, "a").join(y, "b").select("a", "b", "va", "vb").mapInArrow(measure, "a long, b long, w double").where(F.col("w") >= least)
    return settle(pairs.where(F.col("w") >= least + HALF_ERROR).unionByName(exact))


def _settled_communities(a: np.ndarray, b: np.ndarray, w: np.ndarray, m2: float) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, communities) of one component: one node moves at a time, until none gains and no community merges."""
    names, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    place, p, q = np.arange(len(names)), ends[: len(a)], ends[len(a) :]
    while True:
        n = int(place.max()) + 1
        near: list[list] = [[] for _ in range(n)]
        degree = [0.0] * n
        for u, v, x in zip(p.tolist(), q.tolist(), w.tolist(), strict=True):
            degree[u] += x
            degree[v] += x
            if u != v:
                near[u].append((v, x))
                near[v].append((u, x))
        c, total, moved = list(range(n)), degree.copy(), True
        while moved:
            moved = False
            for u in range(n):
                held: dict[int, float] = {}
                for v, x in near[u]:
                    held[c[v]] = held.get(c[v], 0.0) + x
                here, d = c[u], degree[u]
                total[here] -= d
                best, most = here, held.get(here, 0.0) - d * total[here] / m2 + GAIN * d
                for other, k in held.items():
                    gain = k - d * total[other] / m2
                    if other != here and gain > most:
                        best, most = other, gain
                total[best] += d
                moved |= best != here
                c[u] = best
        kept, c = np.unique(c, return_inverse=True)
        place = c[place]
        if len(kept) == n:
            break
        p, q = np.minimum(c[p], c[q]), np.maximum(c[p], c[q])
        pairs, at = np.unique(p * len(kept) + q, return_inverse=True)
        p, q, w = pairs // len(kept), pairs % len(kept), np.bincount(at, w)
    least = np.full(int(place.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, place, names)
    return names, least[place]


def communities(links: DataFrame, moves: int = MOVES) -> DataFrame:
    """(node, community) of every node of ``links`` (a, b, w): local moves that raise modularity, until none does.

    A community has the name of its least node. Components (which no community crosses) of up to LOCAL_LINKS links
    are settled in one task each; larger ones by turns over all their nodes.
    """
    m2 = links.agg(F.sum(2 * F.col("w"))).first()[0]
    if not m2:
        return links.select(F.col("a").alias("node"), F.col("a").alias("community")).limit(0)
    parts = hash_to_min(links, "a", "b").withColumnRenamed("node", "a")
    held = settle(links.join(parts, "a"))
    sizes = held.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    large = settle(sizes.where(F.col("n") > LOCAL_LINKS).select("component"))

    def settled(t: pa.Table) -> pa.Table:
        nodes, found = _settled_communities(t["a"].to_numpy(), t["b"].to_numpy(), t["w"].to_numpy(), m2)
        return pa.table([pa.array(nodes), pa.array(found)], names=["node", "community"])

    found = held.join(large, "component", "left_anti").groupBy("component").applyInArrow(settled, "node long, community long")
    if large.limit(1).count():
        found = found.unionByName(_communities_by_turns(held.join(large, "component", "left_semi").select("a", "b", "w"), m2, moves))
    return settle(found)


def _communities_by_turns(links: DataFrame, m2: float, moves: int) -> DataFrame:
    """The communities by turns in which many nodes move.

    In the first ``moves`` turns of a level half of the nodes that gain move, drawn anew; moves that meet in a community may
    spoil each other's gain. Thereafter a move is made only if it gains more than all others that touch one of its two
    communities, so that modularity rises in every turn and the turns end when no node gains.
    """
    graph, placed = links, None
    while True:
        both = graph.select(F.col("a").alias("u"), F.col("b").alias("v"), "w").unionByName(graph.where("a <> b").select(F.col("b").alias("u"), F.col("a").alias("v"), "w"))
        # a loop stands for the links inside a node of a higher level, both their ends
        adjacent = settle(both)
        degree = adjacent.groupBy("u").agg(F.sum(F.when(F.col("u") == F.col("v"), 2 * F.col("w")).otherwise(F.col("w"))).alias("d"))
        state = settle(degree.select("u", F.col("u").alias("c"), "d"))
        for turn in range(MOST_TURNS):
            totals = state.groupBy("c").agg(F.sum("d").alias("t"))
            own = state.join(totals, "c").select("u", F.col("c").alias("c0"), "d", F.col("t").alias("t0"))
            near = adjacent.where("u <> v").join(state.select(F.col("u").alias("v"), "c"), "v").groupBy("u", "c").agg(F.sum("w").alias("k"))
            rated = near.join(totals, "c").join(own, "u")
            gain = F.col("k") - F.col("d") * (F.col("t") - F.when(F.col("c") == F.col("c0"), F.col("d")).otherwise(F.lit(0.0))) / F.lit(m2)
            best = rated.select("u", F.struct(gain.alias("g"), (-F.col("c")).alias("n")).alias("o"), (F.col("c") == F.col("c0")).alias("here"), gain.alias("g")).groupBy("u").agg(F.max("o").alias("o"), F.max(F.when(F.col("here"), F.col("g"))).alias("stay"))
            more = F.col("o.g") - F.coalesce("stay", -F.col("d") * (F.col("t0") - F.col("d")) / F.lit(m2))
            wished = settle(own.join(best, "u", "left").select("u", "d", "c0", F.when(more > GAIN * F.col("d"), -F.col("o.n")).alias("c1"), more.alias("more")))
            gaining = wished.where("c1 is not null and c1 <> c0")
            if not gaining.limit(1).count():
                break
            if turn < moves:
                going = gaining.where(F.pmod(F.xxhash64(F.lit(turn), "u"), F.lit(2)) == 0).select("u", "c1")
            else:
                ends = gaining.select("u", "c1", F.struct("more", "u").alias("rank"), F.explode(F.array("c0", "c1")).alias("c"))
                first = ends.groupBy("c").agg(F.max("rank").alias("rank")).select("c", F.col("rank.u").alias("u"))
                going = ends.select("u", "c", "c1").join(first, ["c", "u"]).groupBy("u", "c1").agg(F.count(F.lit(1)).alias("n")).where("n = 2").select("u", "c1")
            nxt = settle(wished.select("u", "d", "c0").join(going, "u", "left").select("u", F.coalesce("c1", "c0").alias("c"), "d"))
            discard(state)
            discard(wished)
            state = nxt
        else:
            raise RuntimeError("communities did not settle")
        # the least node names a community
        step = state.join(state.groupBy("c").agg(F.min("u").alias("name")), "c").select("u", F.col("name").alias("c"))
        step = settle(step)
        placed = settle(step.select(F.col("u").alias("node"), F.col("c").alias("community")) if placed is None else placed.join(step, F.col("community") == F.col("u")).select("node", F.col("c").alias("community")))
        if not step.where("u <> c").limit(1).count():
            return placed
        joined = graph.join(step.select(F.col("u").alias("a"), F.col("c").alias("ca")), "a").join(step.select(F.col("u").alias("b"), F.col("c").alias("cb")), "b")
        graph = settle(joined.groupBy(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).agg(F.sum("w").alias("w")))


def _components(reps: DataFrame, stars: list[DataFrame], pairs: DataFrame) -> DataFrame:
    """(rep, component): what the stars and pairs (a, b) join, named by its least rep. The first routing's stars contract the rest."""
    first = stars[0]
    for other in stars[1:]:
        pairs = pairs.unionByName(other.select(F.col("v").alias("a"), F.col("u").alias("b")))
    head = lambda c, to: first.select(F.col("v").alias(c), F.col("u").alias(to))
    met = pairs.join(head("a", "p"), "a", "left").join(head("b", "q"), "b", "left").select(F.coalesce("p", "a").alias("p"), F.coalesce("q", "b").alias("q"))
    joined = hash_to_min(met.where("p <> q").select(F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q")).distinct(), "p", "q").withColumnRenamed("node", "h")
    return reps.select("rep").join(head("rep", "h"), "rep", "left").select("rep", F.coalesce("h", "rep").alias("h")).join(joined, "h", "left").select("rep", F.coalesce("component", "h").alias("component"))


def _clustered(df: DataFrame, row_id: str, vec: str, dim: int, least: float):
    """(rows (row_id, rep, cluster_id), representatives, edges, verified links) or None for a table without usable vectors."""
    reps, copies = folded_copies(unit_vectors(df, row_id, vec, dim))
    copies = settle(copies)
    if not copies.limit(1).count():
        return None
    edges, stars, links = neighbour_graph(reps, dim, NEIGHBOURS, least, SHARD_ROWS, ROUTINGS)
    links = links_above(links, reps, dim, least)
    named = _components(reps, stars, links.select("a", "b"))
    # a component is named by its least node, and a node by its least copy
    return copies.join(named, "rep").select(F.col("id").alias(row_id), "rep", F.col("component").alias("cluster_id")), reps, edges, links


def linked_clusters(df: DataFrame, row_id: str, vec: str, dim: int, least: float = LINK) -> DataFrame:
    """(row_id, rep, cluster_id), rep being the least of a row's copies.

    A cluster is all that links of cosine >= ``least`` join, directly or through others; cluster_id is its smallest row_id.
    The links are those that the neighbour graph met; README has the measured recall. Exact copies are one node of
    the graph and share everything. Unusable vectors (null, other length, a null, NaN or infinite element,
    all zero) are left out; repeated ids stand as they are; an empty table gives no rows; extra columns are pruned.
    """
    made = _clustered(df, row_id, vec, dim, least)
    return made[0] if made else df.sparkSession.createDataFrame([], f"`{row_id}` long, rep long, cluster_id long")


def similarity_clusters(df: DataFrame, row_id: str, vec: str, dim: int, least: float = LINK) -> tuple[DataFrame, DataFrame]:
    """The rows of :func:`linked_clusters` with their community too (their own rep where they have no link), and the graph's
    links (a, b, w) of ``least`` or more between representatives."""
    made = _clustered(df, row_id, vec, dim, least)
    if not made:
        s = df.sparkSession
        return s.createDataFrame([], f"`{row_id}` long, rep long, community long, cluster_id long"), s.createDataFrame([], "a long, b long, w double")
    rows, reps, edges, more = made
    links = links_above(edges.where(F.col("cos") >= least - HALF_ERROR), reps, dim, least)
    links = settle(links.unionByName(more).groupBy("a", "b").agg(F.max("w").alias("w")))
    rows = settle(rows)
    found = communities(links).withColumnRenamed("node", "rep")
    return rows.join(found, "rep", "left").select(row_id, "rep", F.coalesce("community", "rep").alias("community"), "cluster_id"), links


def described_communities(rows: DataFrame, links: DataFrame, row_id: str, typical: int = 3) -> DataFrame:
    """(community, size, n_distinct, typical_rep, rank, internal_degree): the ``typical`` nodes of greatest internal weighted degree.

    A community's typical members come as one row each, by falling internal degree, equal ones by id.
    """
    place = rows.select("rep", "community").distinct()
    sizes = rows.groupBy("community").agg(F.count(F.lit(1)).alias("size"), F.count_distinct("rep").alias("n_distinct"))
    both = links.select(F.col("a").alias("rep"), F.col("b").alias("other"), "w").unionByName(links.select(F.col("b").alias("rep"), F.col("a").alias("other"), "w"))
    inside = both.join(place, "rep").join(place.select(F.col("rep").alias("other"), F.col("community").alias("c2")), "other").where("community = c2")
    degree = inside.groupBy("rep").agg(F.sum("w").alias("d"))
    rated = place.join(degree, "rep", "left").select("rep", "community", F.coalesce("d", F.lit(0.0)).alias("d"))
    top = rated.withColumn("rank", F.row_number().over(Window.partitionBy("community").orderBy(F.desc("d"), "rep"))).where(F.col("rank") <= typical)
    return top.join(sizes, "community").select("community", "size", "n_distinct", F.col("rep").alias("typical_rep"), F.col("rank").cast("int").alias("rank"), F.col("d").alias("internal_degree"))
