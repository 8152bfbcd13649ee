"""Evaluation texts leaking into training text.

Both sides are compared as words of the consistent form, case folded. One pass over the corpus finds, in each document,
the items of which it has a whole window of words, and those of which an edited copy may score enough: an alignment
that reaches a share of a full match has a known number of word pairs of the item with at most one error between
them within a known length of text, so counting these pairs loses none. Those are aligned word by word (Smith-Waterman).
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.lookalikes import Tables, consistent, public_tables
from vellum.runtime import shared

WINDOW = 12  # consecutive words that make a leak
LEAST = 0.5  # share of a full match from which an edited copy counts
MOST_HITS = 1 << 22  # word pairs met with items that are held at once
BLOCK_WORDS = 2_000_000  # words of items in one pass at most; more items take more passes
WORD = re.compile(r"[^\W_]+")
MATCH, MISMATCH, GAP = 2, -1, -1
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None, known: Tables | None = None) -> list[str]:
    """Runs of letters and digits of the consistent form, case folded."""
    return WORD.findall(consistent(text, known=known)[0].casefold()) if text else []


def gram_keys(ids: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit key for each window of n word numbers; 0 where a word is unknown (number 0)."""
    if len(ids) < n:
        return np.zeros(0, np.int64)
    key = np.zeros(len(ids) - n + 1, np.uint64)
    known = np.ones(len(key), bool)
    for i in range(n):
        part = ids[i : len(ids) - n + 1 + i]
        known &= part > 0
        key = (key ^ part.astype(np.uint64)) * _MIX
        key ^= key >> np.uint64(29)
    key = key ^ np.uint64(n)
    key[~known] = 0
    return key.view(np.int64)


def align(items: list[list[int]], texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(Smith-Waterman scores of the best local alignments, lengths of the longest common runs) of pairs of word numbers.

    All pairs go forward together, a row of each matrix a step. Items hold no 0; unknown words of texts are 0.
    """
    n, wide, tall = len(items), max(map(len, texts)), max(map(len, items))
    a, b = np.full((n, tall), -1, np.int32), np.zeros((n, wide), np.int32)
    for i, (x, y) in enumerate(zip(items, texts, strict=True)):
        a[i, : len(x)], b[i, : len(y)] = x, y
    steps = np.arange(wide + 1, dtype=np.int32) * -GAP
    row, run = np.zeros((n, wide + 1), np.int32), np.zeros((n, wide + 1), np.int32)
    best, longest = np.zeros(n, np.int32), np.zeros(n, np.int32)
    for t in range(tall):
        same = b == a[:, t : t + 1]
        nxt = np.zeros_like(row)
        np.maximum(row[:, :-1] + np.where(same, MATCH, MISMATCH), row[:, 1:] + GAP, out=nxt[:, 1:])
        np.maximum(nxt, 0, out=nxt)
        # a gap along the text lowers the score by a step a word, so the running maximum of score + steps closes gaps of any length
        row = np.maximum.accumulate(nxt + steps, axis=1) - steps
        run[:, 1:] = np.where(same, run[:, :-1] + 1, 0)
        np.maximum(best, row.max(1), out=best)
        np.maximum(longest, run.max(1), out=longest)
    return best, longest


def _scores(pairs: list[tuple[list[int], np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(scores against a full match, longest common runs) of pairs of item and text."""
    score, longest = np.zeros(len(pairs)), np.zeros(len(pairs), np.int32)
    # texts of like length together, so that one long text makes no wide matrix for all
    order = sorted(range(len(pairs)), key=lambda i: len(pairs[i][1]))
    for lo in range(0, len(order), 16):
        some = order[lo : lo + 16]
        best, run = align([pairs[i][0] for i in some], [pairs[i][1] for i in some])
        score[some], longest[some] = best / np.array([MATCH * len(pairs[i][0]) for i in some]), run
    return score, longest


class _Sought:
    """What is looked for of a block of items (lists of word numbers): whole windows, and word pairs for edited copies."""

    def __init__(self, items: list[list[int]], window: int, edited: bool):
        self.items, self.edited = items, edited
        self.length = np.array([len(w) for w in items])
        runs: dict[int, list] = {}
        pairs = []
        for i, w in enumerate(items):
            ids, n = np.array(w, np.int64), min(window, len(w))
            runs.setdefault(n, []).extend((k, i) for k in set(gram_keys(ids, n).tolist()))
            if edited and len(w) > 2:
                pairs += [(k, i) for k in {*self._pair_keys(ids, 1).tolist(), *self._pair_keys(ids, 2).tolist()} if k]
            elif edited:
                # any word of one or two is half a match
                runs.setdefault(1, []).extend((k, i) for k in set(gram_keys(ids, 1).tolist()))
        self.runs = {n: self._index(set(r)) for n, r in runs.items()}
        self.pairs = self._index(pairs)
        # Of m matches and e errors, 2m - e reaching 2 * LEAST * length, at most m - LEAST * length neighbouring matches have
        # two errors or more between them, and the text that is used has at most m + e words.
        self.need = np.maximum(1, np.ceil(LEAST * self.length - 1 - 1e-9)).astype(np.int64)
        self.span = np.ceil((3 - 2 * LEAST) * self.length).astype(np.int64)

    @staticmethod
    def _pair_keys(ids: np.ndarray, apart: int) -> np.ndarray:
        """A key for each word and the one ``apart`` places on; 0 where one is unknown."""
        if len(ids) <= apart:
            return np.zeros(0, np.int64)
        x, y = ids[:-apart], ids[apart:]
        return np.where((x > 0) & (y > 0), (x << 32) | y, 0)

    @staticmethod
    def _index(found) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(keys, where the items of each begin, items)."""
        rows = np.array(sorted(found), np.int64).reshape(-1, 2)
        keys, first = np.unique(rows[:, 0], return_index=True)
        return keys, np.append(first, len(rows)), rows[:, 1]

    @staticmethod
    def _hits(index, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions in k, items) of keys that items have."""
        keys, first, who = index
        if not len(keys) or not len(k):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        spot = np.flatnonzero(k)
        place = np.minimum(np.searchsorted(keys, k[spot]), len(keys) - 1)
        same = keys[place] == k[spot]
        spot, place = spot[same], place[same]
        n = first[place + 1] - first[place]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[place], n)
        return np.repeat(spot, n), who[at]

    def whole(self, ids: np.ndarray) -> set[int]:
        """Items of which the text may have a window (or a word, of items of one or two)."""
        return {i for n, index in self.runs.items() for i in self._hits(index, gram_keys(ids, n))[1].tolist()}

    def regions(self, ids: np.ndarray):
        """(item, from, to): the stretches of the text that hold every alignment that scores enough."""
        step = max(1000, MOST_HITS // max(1, 2 * len(self.items)))
        reach = int(self.span.max())
        for base in range(0, len(ids), step):
            # texts longer than a step overlap by what an alignment can use
            part = ids[base : base + step + 2 * reach]
            found = [self._hits(self.pairs, self._pair_keys(part, apart)) for apart in (1, 2)]
            code = np.unique(np.concatenate([i * len(part) + p for p, i in found]))
            if not len(code):
                continue
            item, at = code // len(part), code % len(part)
            last = np.arange(len(code)) + self.need[item] - 1
            inside = last < len(code)
            ends = np.minimum(last, len(code) - 1)
            good = np.flatnonzero(inside & (item[ends] == item) & (at[ends] - at < self.span[item]))
            held = None
            for g in good.tolist():
                i, wide = int(item[g]), int(self.span[item[g]])
                lo, hi = base + max(0, int(at[g]) - wide), base + int(at[ends[g]]) + wide + 1
                if held and held[0] == i and lo <= held[2]:
                    held[2] = max(held[2], hi)
                    continue
                if held:
                    yield tuple(held)
                held = [i, lo, hi]
            if held:
                yield tuple(held)
            if base + len(part) >= len(ids):
                break


def _found(block, window: int):
    """(id, item, score, longest_run, is_leak) of the documents' leaks and edited copies."""

    def run(batches):
        vocabulary, sought, known = block()
        number = vocabulary.get
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                rows = []
                for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    words = words_of(text, known)
                    ids = np.fromiter((number(w, 0) for w in words), np.int64, len(words))
                    if not ids.any():
                        continue
                    sure = sought.whole(ids)
                    if sought.edited:
                        maybe = [r for r in sought.regions(ids) if r[0] not in sure]
                        share, _ = _scores([(sought.items[i], ids[lo:hi]) for i, lo, hi in maybe])
                        sure |= {r[0] for r, x in zip(maybe, share.tolist(), strict=True) if x >= LEAST}
                    rows += [(doc, i, ids) for i in sorted(sure)]
                score, longest = _scores([(sought.items[i], ids) for _, i, ids in rows])
                leak = longest >= np.minimum(window, sought.length[[r[1] for r in rows]]) if rows else np.zeros(0, bool)
                keep = np.flatnonzero(leak | (sought.edited & (score >= LEAST)))
                yield pa.record_batch([pa.array([rows[k][0] for k in keep], b.schema.field(0).type), pa.array([rows[k][1] for k in keep], pa.int32()), pa.array(score[keep]), pa.array(longest[keep]), pa.array(leak[keep])], names=["id", "item", "score", "longest_run", "is_leak"])

    return run


def _block(docs: DataFrame, kind: str, rows: list, item_kind: str, window: int, edited: bool) -> DataFrame | None:
    """One pass for a block of items."""
    spark = docs.sparkSession
    known = public_tables(spark)
    words = [words_of(r[1], known) for r in rows]
    kept = [(r[0], w) for r, w in zip(rows, words, strict=True) if w]
    if not kept:
        return None
    vocabulary: dict[str, int] = {}
    items = [[vocabulary.setdefault(x, len(vocabulary) + 1) for x in w] for _, w in kept]
    # bounded by BLOCK_WORDS, whatever the corpus
    block = shared(spark, (vocabulary, _Sought(items, window, edited), known))
    scored = docs.mapInArrow(_found(block, window), f"id {kind}, item int, score double, longest_run int, is_leak boolean")
    names = spark.createDataFrame(pa.table({"item": pa.array(range(len(kept)), pa.int32()), "item_key": pa.array([str(k[0]) for k in kept], pa.string())})).select("item", F.col("item_key").cast(item_kind).alias("item_key"))
    return scored.join(F.broadcast(names), "item").groupBy("id", "item_key").agg(F.max("score").alias("score"), F.max("longest_run").alias("longest_run"), F.max("is_leak").alias("is_leak"))


def leaked_passages(docs: DataFrame, doc: str, text: str, items: DataFrame, item: str, passage: str, window: int = WINDOW, edited: bool = True) -> DataFrame:
    """(doc, item, score, longest_run, is_leak) of each leak and, if ``edited``, each score of LEAST or more.

    is_leak: the text has ``window`` consecutive words of the passage, or all of a shorter one. score is that of the best local
    alignment against a full match, in [0, 1]; edited copies score high with a short longest_run. Null and
    empty texts and passages, and passages without words, take no part. Null ids are left out. Repeated rows of a
    document or item count once, the best values stand. Empty tables give no rows; extra columns are ignored.
    The items are a stated query set: they go through memory in blocks of BLOCK_WORDS words, each block one pass
    over the corpus, so any number of items works. Nothing of the corpus is collected.
    """
    c = lambda x: F.col(f"`{x}`")
    kind, item_kind = docs.schema[doc].dataType.simpleString(), items.schema[item].dataType.simpleString()
    lean = docs.where(c(doc).isNotNull() & c(text).isNotNull()).select(c(doc).alias("id"), c(text).alias("text"))
    asked = items.where(c(item).isNotNull() & c(passage).isNotNull()).select(c(item).alias("i"), c(passage).alias("p"))
    size = asked.agg(F.coalesce(F.sum(F.size(F.split("p", r"\s+"))), F.lit(0))).first()[0]
    blocks = -(-size // BLOCK_WORDS)
    out = None
    for n in range(blocks):
        part = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == n)
        made = _block(lean, kind, [tuple(r) for r in part.distinct().orderBy("i", "p").collect()], item_kind, window, edited)
        if made is not None:
            out = made if out is None else out.unionByName(made)
    if out is None:
        return docs.sparkSession.createDataFrame([], f"`{doc}` {kind}, `{item}` {item_kind}, score double, longest_run int, is_leak boolean")
    return out.select(c("id").alias(doc), F.col("item_key").alias(item), "score", "longest_run", "is_leak")
