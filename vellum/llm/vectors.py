"""Unit vectors as fixed-width binary, copies folded to one, and vantage-point trees over them."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _unit_rows(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, vecs = b.column(0), b.column(1)
            sizes = np.array([-1 if n is None else n for n in vecs.value_lengths().to_pylist()])
            ok = np.flatnonzero(sizes == dim)
            if not len(ok):
                continue
            took = vecs.take(pa.array(ok))
            x = took.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ok), dim)
            norm = np.sqrt((x * x).sum(1))
            good = np.isfinite(x).all(1) & np.isfinite(norm) & (norm > 0)
            unit = (x[good] / norm[good, None]).astype(np.float32)
            yield pa.record_batch([ids.take(pa.array(ok[good])), to_binary(unit)], names=["id", "vec"])

    return run


def to_binary(x: np.ndarray) -> pa.Array:
    n, width = len(x), x.shape[1] * x.dtype.itemsize
    ends = np.arange(n + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(np.ascontiguousarray(x).tobytes())])


def from_binary(col, dim: int, dtype=np.float32) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if isinstance(col, pa.ChunkedArray):
        return np.vstack([from_binary(c, dim, dtype) for c in col.chunks]) if col.num_chunks else np.zeros((0, dim), dtype)
    if not len(col):
        return np.zeros((0, dim), dtype)
    wide = 8 if pa.types.is_large_binary(col.type) else 4
    ends = np.frombuffer(col.buffers()[1], np.int64 if wide == 8 else np.int32)[col.offset : col.offset + len(col) + 1]
    return np.frombuffer(col.buffers()[2], dtype, (ends[-1] - ends[0]) // np.dtype(dtype).itemsize, ends[0]).reshape(len(col), dim)


def coded(x: np.ndarray) -> np.ndarray:
    """Unit rows as bytes: a byte an element, then the row's distance from the unit vector that these give, as float32."""
    k = np.rint(x * (127 / np.abs(x).max(1, keepdims=True))).astype(np.int8)
    err = np.linalg.norm(x.astype(np.float64) - _of_bytes(k), axis=1) + 1e-6
    return np.hstack([k.view(np.uint8), err.astype(np.float32)[:, None].view(np.uint8)])


def _of_bytes(k: np.ndarray) -> np.ndarray:
    k = k.astype(np.float32)
    k /= np.sqrt(np.einsum("ij,ij->i", k, k))[:, None]
    return k


def decoded(col, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(unit rows, their distance at most from the rows that :func:`coded` was given)."""
    raw = from_binary(col, dim + 4, np.uint8)
    return _of_bytes(raw[:, :dim].view(np.int8)), np.ascontiguousarray(raw[:, dim:]).view(np.float32)[:, 0]


def unit_vectors(df: DataFrame, row_id: str, vec: str, dim: int) -> DataFrame:
    """(id, vec BINARY): the usable vectors at unit length as float32 bytes.

    A vector is usable if it has ``dim`` elements, all finite and not all zero; rows with null or other vectors are
    left out, as are null ids. Repeated ids are the caller's matter.
    """
    lean = df.where(F.col(f"`{row_id}`").isNotNull() & F.col(f"`{vec}`").isNotNull() & (F.size(f"`{vec}`") == dim) & ~F.exists(f"`{vec}`", lambda x: x.isNull()))
    return lean.select(F.col(f"`{row_id}`").cast("long").alias("id"), F.col(f"`{vec}`").cast("array<float>").alias("v")).mapInArrow(_unit_rows(dim), "id long, vec binary")


def folded_copies(units: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(distinct vectors (rep, vec), rows (id, rep)): exact copies share the smallest id of them as rep."""
    from vellum.runtime import settle

    keyed = settle(units.withColumn("key", F.md5("vec")))
    reps = settle(keyed.groupBy("key").agg(F.min("id").alias("rep"), F.any_value("vec").alias("vec")))
    # AQE splits the rows of a hot vector, and its one rep meets each part
    rows = keyed.select("id", "key").join(reps.select("key", "rep"), "key").select("id", "rep")
    return reps.select("rep", "vec"), rows


def distance(cosine: float) -> float:
    return math.sqrt(max(0.0, 2.0 - 2.0 * cosine))


BLOCK = 1 << 21  # products that are held at once


class VantageTree:
    """Vantage-point tree over rows of a matrix of unit vectors; Euclidean distance.

    With ``factor`` one the triangle inequality alone prunes and the search is exact; a smaller factor
    shrinks the margin within which both sides of a ball's boundary are visited.
    """

    SLACK = 1e-3  # rounding of distances near zero

    def __init__(self, x: np.ndarray, leaf_rows: int, seed: int = 0, tries: int = 8):
        self.x = x
        self.rng = np.random.default_rng(seed)
        self.tries = tries
        self.leaves: list[np.ndarray] = []
        self.root = self._grow(np.arange(len(x)), leaf_rows)

    def _grow(self, rows: np.ndarray, leaf_rows: int):
        if len(rows) > leaf_rows:
            # of a few candidates, the point whose distances spread most makes the sharpest boundary
            some = rows if len(rows) <= 256 else self.rng.choice(rows, 256, replace=False)
            tried = self.rng.choice(rows, min(self.tries, len(rows)), replace=False)
            spread = np.sqrt(np.maximum(0, 2 - 2 * self.x[tried] @ self.x[some].T)).std(1)
            vp = self.x[tried[int(spread.argmax())]]
            d = np.sqrt(np.maximum(0, 2 - 2 * self.x[rows] @ vp))
            mu = self._boundary(d)
            inside = d <= mu
            if inside.any() and not inside.all():
                return (vp, mu, self._grow(rows[inside], leaf_rows), self._grow(rows[~inside], leaf_rows))
        self.leaves.append(rows)
        return len(self.leaves) - 1

    def for_routing(self) -> VantageTree:
        """Without the rows: the boundaries alone, small enough to travel with a task."""
        self.x, self.leaves = None, [None] * len(self.leaves)
        return self

    @classmethod
    def of_root(cls, root, n_leaves: int) -> VantageTree:
        """The tree :meth:`for_routing` with the boundaries ``root``."""
        tree = cls.__new__(cls)
        tree.root, tree.x, tree.leaves = root, None, [None] * n_leaves
        return tree

    @staticmethod
    def _boundary(d: np.ndarray) -> float:
        """The widest gap in distances within the middle half, so that boundaries fall between clusters."""
        s = np.sort(d)
        lo, hi = len(s) // 4, max(len(s) // 4 + 1, 3 * len(s) // 4)
        gaps = s[lo + 1 : hi + 1] - s[lo:hi]
        at = lo + int(gaps.argmax())
        mid = len(s) // 2
        # only a true gap is worth an uneven split
        if s[at + 1] - s[at] < 0.05 and mid + 1 < len(s):
            at = mid
        return float((s[at] + s[min(at + 1, len(s) - 1)]) / 2)

    def home(self, q: np.ndarray) -> np.ndarray:
        """The leaf into which each row of q falls."""
        out = np.zeros(len(q), np.int32)

        def go(node, at):
            if not len(at):
                return
            if isinstance(node, int):
                out[at] = node
                return
            vp, mu, left, right = node
            inside = np.sqrt(np.maximum(0, 2 - 2 * q[at] @ vp)) <= mu
            go(left, at[inside])
            go(right, at[~inside])

        go(self.root, np.arange(len(q)))
        return out

    @staticmethod
    def _sides(q: np.ndarray, vp: np.ndarray, mu: float, margin: np.ndarray, flat: bool) -> tuple[np.ndarray, np.ndarray]:
        """Which rows must look inside the boundary, and which outside."""
        d = np.sqrt(np.maximum(0, 2 - 2 * q @ vp))
        inner, outer = d - margin <= mu, d + margin >= mu
        if flat:
            past = (mu * mu - d * d) / 2
            inner, outer = inner & (past >= -margin), outer & (past <= margin)
        return inner, outer

    def near_leaves(self, q: np.ndarray, reach: np.ndarray, factor: float, flat: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (row of q, leaf) not pruned for balls of radius ``reach``.

        With ``flat`` products with the vantage point prune too: rows no further apart than the reach differ by no more in them either.
        """
        rows, leaves = [], []

        def go(node, at):
            if not len(at):
                return
            if isinstance(node, int):
                rows.append(at)
                leaves.append(np.full(len(at), node, np.int32))
                return
            vp, mu, left, right = node
            inner, outer = self._sides(q[at], vp, mu, factor * reach[at] + self.SLACK, flat)
            go(left, at[inner])
            go(right, at[outer])

        go(self.root, np.arange(len(q)))
        return (np.concatenate(rows), np.concatenate(leaves)) if rows else (np.zeros(0, int), np.zeros(0, np.int32))

    def within(self, q: np.ndarray, least: np.ndarray, reach: np.ndarray, factor: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (row of q, row of the tree) whose product is at least that of ``least`` for the row of q, a block of a leaf at a time.

        Balls of radius ``reach`` prune, as in :meth:`near_leaves`.
        """
        stack = [(self.root, np.arange(len(q)))]
        while stack:
            node, at = stack.pop()
            if not len(at):
                continue
            if not isinstance(node, int):
                vp, mu, left, right = node
                inner, outer = self._sides(q[at], vp, mu, factor * reach[at] + self.SLACK, True)
                stack += [(right, at[outer]), (left, at[inner])]
                continue
            rows = self.leaves[node]
            step = max(1, BLOCK // len(rows))
            for b in range(0, len(at), step):
                a = at[b : b + step]
                r, c = np.nonzero(q[a] @ self.x[rows].T >= least[a, None])
                if len(r):
                    yield a[r], rows[c]

    def nearest(self, q: np.ndarray, k: int, reach: np.ndarray, factor: float, ids: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cosines, ids) of the k nearest rows of each row of q within ``reach``, -2 and -1 where there are fewer.

        ``ids`` names the tree's rows; a row whose id is q's ``own`` is passed over. Equal cosines: the smaller id.
        """
        m = len(q)
        cos, idx, tau = np.full((m, k), -2.0, np.float32), np.full((m, k), -1, np.int64), reach.astype(np.float64).copy()

        def leaf(rows, at):
            for b in range(0, len(at), 2048):
                a = at[b : b + 2048]
                c = q[a] @ self.x[rows].T
                c[own[a][:, None] == ids[rows][None, :]] = -2
                least = 1 - np.minimum(tau[a] + self.SLACK, 2.0) ** 2 / 2
                hit = (c >= least[:, None]).any(1)
                if not hit.any():
                    continue
                a, c = a[hit], c[hit]
                names = np.broadcast_to(ids[rows], c.shape)
                if c.shape[1] > k + 8:
                    # those above the kth value and a few more; where that cuts ties of the kth value, all are kept
                    top = np.argpartition(-c, k + 7, axis=1)[:, : k + 8]
                    few = np.take_along_axis(c, top, 1)
                    if (few.min(1) < np.partition(few, -k, axis=1)[:, -k]).all():
                        c, names = few, ids[rows][top]
                both = np.hstack([cos[a], c])
                name = np.hstack([idx[a], names])
                order = np.lexsort((name, -both), axis=1)[:, :k]
                cos[a], idx[a] = np.take_along_axis(both, order, 1), np.take_along_axis(name, order, 1)
                full = cos[a][:, -1] > -2
                tau[a[full]] = np.minimum(tau[a[full]], np.sqrt(np.maximum(0, 2 - 2 * cos[a[full], -1].astype(np.float64))))

        def go(node, at):
            if not len(at):
                return
            if isinstance(node, int):
                leaf(self.leaves[node], at)
                return
            vp, mu, left, right = node
            d = np.sqrt(np.maximum(0, 2 - 2 * q[at] @ vp))
            inside = d <= mu
            go(left, at[inside])
            go(right, at[~inside])
            margin = factor * tau[at] + self.SLACK
            go(right, at[inside & (d + margin >= mu)])
            go(left, at[~inside & (d - margin <= mu)])

        go(self.root, np.arange(m))
        least = 1 - (reach + self.SLACK) ** 2 / 2
        miss = cos < least[:, None]
        cos[miss], idx[miss] = -2, -1
        return cos, idx
