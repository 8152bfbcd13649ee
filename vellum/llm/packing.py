"""Filling fixed-capacity containers with items: first-fit decreasing over a tournament tree, in random groups."""

from __future__ import annotations

import base64
import sys
import types
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.runtime import settle

CAPACITY = 2048
GROUP_TOKENS = 1 << 21  # tokens in a group on average: some thousand containers, one task's work
# Fixed value: the split pattern that belongs to the vocabulary of 50 k byte pairs.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _counter(ranks_file, pattern: str):
    def run(batches):
        import tiktoken

        kept = sys.modules.setdefault("_vellum_tokenizers", types.ModuleType("_vellum_tokenizers"))  # once a worker
        if not hasattr(kept, "encoding"):
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks_file.value.splitlines() if line)}
            kept.encoding = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        size = kept.encoding.encode_ordinary
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                yield pa.record_batch([part.column(0), pa.array([0 if not x else len(size(x)) for x in part.column(1).to_pylist()], pa.int64())], names=["id", "n_tokens"])

    return run


def token_sizes(df: DataFrame, item: str, text: str, vocabulary: str, pattern: str = PATTERN) -> DataFrame:
    """(id, n_tokens) of each row, over the whole text; null and empty texts have size 0.

    The vocabulary, under 1 MB, is read here and broadcast, so executors need no file.
    """
    ranks = df.sparkSession.sparkContext.broadcast(Path(vocabulary).read_bytes())
    kind = df.schema[item].dataType.simpleString()
    return df.select(F.col(f"`{item}`").alias("id"), F.col(f"`{text}`").alias("text")).mapInArrow(_counter(ranks, pattern), f"id {kind}, n_tokens long")


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """The bin of each item, items of falling size each in the first bin with room for it.

    A tournament tree holds the most room below each node; the leftmost bin with enough room is found by one descent.
    """
    width = 1
    while width < len(sizes):
        width *= 2
    room = [capacity] * (2 * width)
    out = []
    for s in sizes:
        at = 1
        while at < width:
            at *= 2
            if room[at] < s:
                at += 1
        out.append(at - width)
        room[at] -= s
        at >>= 1
        while at:
            most = room[2 * at] if room[2 * at] >= room[2 * at + 1] else room[2 * at + 1]
            if room[at] == most:
                break
            room[at] = most
            at >>= 1
    return out


def _pack(capacity: int):
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("n", "descending"), ("id", "ascending"), ("line", "ascending"), ("piece", "ascending")])
        bins = first_fit_decreasing(t["n"].to_pylist(), capacity)
        return pa.table([t["id"], t["line"], t["piece"], t["starts"], t["n"], t["bucket"], pa.array(bins, pa.int64())], names=["id", "line", "piece", "starts", "n", "bucket", "bin"])

    return run


def packed(items: DataFrame, item: str, size: str, capacity: int = CAPACITY, group_size: int = GROUP_TOKENS, seed: int = 1) -> DataFrame:
    """(item, piece, token_start, n_tokens, container_id): where each item, or piece of a too large one, goes.

    An item larger than ``capacity`` is split into pieces of ``capacity`` and a rest (the full pieces take
    a container each); no other item is split. Items are dealt at random (by hash) into groups of ``group_size`` in all on average,
    and each group is packed alone. Size 0, negative or null: one row with piece 0 and a null container_id. Each row
    is an item of its own, also if ids repeat or are null. An empty table gives no rows; extra columns are pruned.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    kind = items.schema[item].dataType.simpleString()
    rows = settle(items.select(F.col(f"`{item}`").alias("id"), F.coalesce(F.col(f"`{size}`").cast("long"), F.lit(0)).alias("n"), F.monotonically_increasing_id().alias("line")))
    whole = rows.agg(F.coalesce(F.sum(F.greatest("n", F.lit(0))), F.lit(0))).first()[0]
    groups = max(1, -(-whole // max(group_size, capacity)))
    nothing = rows.where("n <= 0").select("id", F.lit(0).cast("long").alias("piece"), F.lit(0).cast("long").alias("starts"), F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("container_id"))
    pieces = rows.where("n > 0").select("id", "line", F.col("n").alias("all"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / capacity))).alias("piece"))
    cut = pieces.select("id", "line", "piece", (F.col("piece") * capacity).alias("starts"), F.least(F.lit(capacity).cast("long"), F.col("all") - F.col("piece") * capacity).alias("n"), F.pmod(F.xxhash64(F.lit(seed), "id", "line", "piece"), F.lit(groups)).alias("bucket"))
    made = cut.groupBy("bucket").applyInArrow(_pack(capacity), f"id {kind}, line long, piece long, starts long, n long, bucket long, bin long")
    named = made.select("id", "piece", "starts", "n", F.shiftleft("bucket", 32).bitwiseOR(F.col("bin")).alias("container_id"))
    return named.unionByName(nothing).select(F.col("id").alias(item), "piece", F.col("starts").alias("token_start"), F.col("n").alias("n_tokens"), "container_id")
