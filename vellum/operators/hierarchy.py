"""Parent-child links to full hierarchies by tree contraction.

Each round rakes all leaves and compresses an independent third or so of the nodes with one child, recording for
every removed node the ancestor it hung from and the steps between. The forest is gone after a number of rounds
logarithmic in its size, however deep it is. The records, themselves links at most one a round deep, are
then undone by pointer doubling. A cycle never rakes away: it compresses to a node that is its own
parent, and such nonterminating cores are the loops.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.runtime import discard, settle

MOST_ROUNDS = 400  # a guard against a bug, far above what any input needs


def _contract(links: DataFrame) -> tuple[list[DataFrame], DataFrame | None, int]:
    """Tables of records (id, up, seg), the cores left at the end, and the number of rounds.

    seg holds the ids from below ``up`` down to ``id`` itself.
    """
    live = links.select("id", "up", F.array("id").alias("seg"))
    records: list[DataFrame] = []
    for turn in range(MOST_ROUNDS):
        rank = lambda x, t=turn: F.xxhash64(F.lit(t), x)
        kids = live.where("up is not null").groupBy(F.col("up").alias("kid_of")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("only"))
        seen = live.join(kids, F.col("id") == F.col("kid_of"), "left").select("id", "up", "seg", F.coalesce("n", F.lit(0)).alias("n"), "only")
        unary = (F.col("n") == 1) & F.col("up").isNotNull() & (F.col("up") != F.col("id"))
        # the highest of three neighbours in a chain goes: two adjacent nodes can't both be
        squeezed = unary & (rank(F.col("id")) > rank(F.col("up"))) & (rank(F.col("id")) > rank(F.col("only")))
        marked = seen.withColumn("fate", F.when(F.col("n") == 0, "raked").when(squeezed, "squeezed").otherwise("stays"))
        gone = marked.where("fate = 'squeezed'").select(F.col("id").alias("v"), F.col("up").alias("v_up"), F.col("seg").alias("v_seg"))
        moved = marked.where("fate <> 'squeezed'").join(gone, F.col("up") == F.col("v"), "left").select(
            "id", F.when(F.col("v").isNotNull(), F.col("v_up")).otherwise(F.col("up")).alias("up"), F.when(F.col("v").isNotNull(), F.concat("v_seg", "seg")).otherwise(F.col("seg")).alias("seg"), "fate"
        )
        table = settle(moved.unionByName(marked.where("fate = 'squeezed'").select("id", "up", "seg", "fate")))
        left = {r["fate"]: r["count"] for r in table.groupBy("fate").count().collect()}
        if left.get("raked", 0) + left.get("squeezed", 0) == 0:
            discard(table)
            return records, (live if left.get("stays") else None), turn
        records.append(table.where("fate <> 'stays'").select("id", "up", "seg"))
        live = table.where("fate = 'stays'").select("id", "up", "seg")
    raise RuntimeError("tree contraction did not end")


def hierarchies(nodes: DataFrame, node_id: str, parent_id: str) -> DataFrame:
    """One row for each node: (node_id, parent_id, root_id, depth, path, loop_id, on_loop).

    ``nodes`` has one row for each id; rows with a null id are left out, and of several rows with one id the one with
    the smallest parent counts. A null parent, or one that is no node, ends the chain: depth 0 there, root_id is
    the node itself, path the array of ids from root to node. A node on a loop or below one has null root, depth
    and path; loop_id is the smallest id on that loop (by code point) and on_loop tells whether the node is on it. A node that is its own
    parent is a loop of one. An empty table gives no rows. Extra columns are ignored.
    """
    given = nodes.where(F.col(f"`{node_id}`").isNotNull()).groupBy(F.col(f"`{node_id}`").alias("id")).agg(F.min(f"`{parent_id}`").alias("given"))
    known = given.select(F.col("id").alias("known"))
    links = settle(given.join(known, F.col("given") == F.col("known"), "left").select("id", "given", F.col("known").alias("up")))
    records, cores, rounds = _contract(links.select("id", "up"))

    whole = None
    for t in records:
        whole = t if whole is None else whole.unionByName(t)
    if cores is not None:
        ends = cores.select("id", F.lit(None).cast("string").alias("up"), F.array("id").alias("seg"))
        whole = ends if whole is None else whole.unionByName(ends)
    if whole is None:
        whole = links.select("id", "up", F.array("id").alias("seg")).limit(0)
    # a record's ancestor was removed in its own round or a later one: chains of records are at most 2*rounds+1 long
    for _ in range(max(0, (2 * rounds + 1).bit_length())):
        a, b = whole.alias("a"), whole.alias("b")
        nxt = settle(a.join(b, F.col("a.up") == F.col("b.id"), "left").select("a.id", F.col("b.up").alias("up"), F.when(F.col("b.id").isNotNull(), F.concat("b.seg", "a.seg")).otherwise(F.col("a.seg")).alias("seg")))
        discard(whole)
        whole = nxt
        if not whole.where("up is not null").limit(1).count():
            break
    if cores is not None:
        loops = cores.select(F.col("id").alias("core"), F.array_min("seg").alias("loop_id"), F.col("seg").alias("ring"))
    else:
        loops = links.select(F.col("id").alias("core"), F.col("id").alias("loop_id"), F.array("id").alias("ring")).limit(0)
    root = F.element_at("seg", 1)
    done = whole.join(loops, root == F.col("core"), "left")
    free = F.col("core").isNull()
    return (
        done.join(links.select(F.col("id").alias("lid"), "given"), F.col("id") == F.col("lid"))
        .select(
            F.col("id").alias(node_id), F.col("given").alias(parent_id), F.when(free, root).alias("root_id"), F.when(free, F.size("seg") - 1).alias("depth"), F.when(free, F.col("seg")).alias("path"), "loop_id", F.coalesce(F.array_contains("ring", F.col("id")), F.lit(False)).alias("on_loop"),
        )
    )


def descendant_pairs(tree: DataFrame, node_id: str) -> DataFrame:
    """(ancestor_id, descendant_id, distance) for every node of :func:`hierarchies` that is on or below no loop.

    All descendants of a node as rows, never as one array: a root may stand above every other node.
    """
    steps = tree.where("path is not null").select(F.col(f"`{node_id}`").alias("descendant_id"), "depth", F.posexplode("path").alias("at", "ancestor_id"))
    return steps.where("at < depth").select("ancestor_id", "descendant_id", (F.col("depth") - F.col("at")).alias("distance"))
