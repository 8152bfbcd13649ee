"""Contracts for detectors and embedders: functions over Arrow batches, chosen by name or passed in."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

DETECTION = "array<struct<label:string,score:double,x0:int,y0:int,x1:int,y1:int>>"
Detector = Callable[[np.ndarray], list[tuple[str, float, int, int, int, int]]]


def largest_component(ink: np.ndarray) -> tuple[int, int, int, int, int] | None:
    """(x0, y0, x1, y1, pixels) of the largest 4-connected blob, by union of row runs; None without ink."""
    parent: list[int] = []

    def find(a: int) -> int:
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    runs: list[tuple[int, int, int]] = []  # row, start, end
    before: list[int] = []
    for y in range(len(ink)):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], ink[y].astype(np.int8), [0]])))
        now = []
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            i = len(runs)
            runs.append((y, a, b))
            parent.append(i)
            now.append(i)
            for j in before:
                if runs[j][1] < b and a < runs[j][2]:
                    parent[max(find(i), find(j))] = min(find(i), find(j))
        before = now
    boxes: dict[int, list[int]] = {}
    for i, (y, a, b) in enumerate(runs):
        box = boxes.setdefault(find(i), [a, y, b, y + 1, 0])
        box[:] = [min(box[0], a), min(box[1], y), max(box[2], b), max(box[3], y + 1), box[4] + b - a]
    return tuple(max(boxes.values(), key=lambda b: b[4])) if boxes else None


def ink_detector(offset: float = 10.0, side: int = 31, least_share: float = 0.001) -> Detector:
    """The stand-in detector: pixels darker than their local mean, the largest blob as one Text zone."""

    def detect(gray: np.ndarray):
        h, w = gray.shape
        total = np.zeros((h + 1, w + 1))
        total[1:, 1:] = gray.cumsum(0).cumsum(1)
        r = side // 2
        y0, y1 = np.maximum(np.arange(h) - r, 0), np.minimum(np.arange(h) + r + 1, h)
        x0, x1 = np.maximum(np.arange(w) - r, 0), np.minimum(np.arange(w) + r + 1, w)
        area = (y1 - y0)[:, None] * (x1 - x0)[None]
        mean = (total[y1][:, x1] - total[y0][:, x1] - total[y1][:, x0] + total[y0][:, x0]) / area
        found = largest_component(gray < mean - offset)
        if found is None or found[4] < least_share * h * w:
            return []
        return [("Text", found[4] / ((found[2] - found[0]) * (found[3] - found[1])), *found[:4])]

    return detect


DETECTORS: dict[str, Callable[[], Detector]] = {"heuristic": ink_detector}


def detector(name: str) -> Detector:
    if name not in DETECTORS:
        raise ValueError(f"no detector {name!r}; known: {sorted(DETECTORS)}")
    return DETECTORS[name]()


def detected(pixels: DataFrame, chosen: Detector, keys: list[str]) -> DataFrame:
    """pixels (keys, width, height, gray BINARY, a byte a pixel): (keys, detections); a null or empty page has none."""
    kinds = ", ".join(f"`{k}` {pixels.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("label", pa.string()), ("score", pa.float64()), ("x0", pa.int32()), ("y0", pa.int32()), ("x1", pa.int32()), ("y1", pa.int32())]))
        names = ("label", "score", "x0", "y0", "x1", "y1")
        for b in batches:
            made = []
            for w, h, data in zip(b.column("width").to_pylist(), b.column("height").to_pylist(), b.column("gray").to_pylist(), strict=True):
                if not data:
                    made.append([])
                    continue
                page = np.frombuffer(data, np.uint8).reshape(h, w).astype(np.float64)
                made.append([dict(zip(names, d, strict=True)) for d in chosen(page)])
            yield pa.record_batch([*[b.column(k) for k in keys], pa.array(made, kind)], names=[*keys, "detections"])

    return pixels.select(*keys, "width", "height", "gray").mapInArrow(run, f"{kinds}, detections {DETECTION}")


def embedded(rows: DataFrame, model: Callable[[list[bytes]], np.ndarray], keys: list[str], content: str) -> DataFrame:
    """(keys, vec): a model over batches of contents; it gets a list of bytes and gives a matrix."""
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                x = np.asarray(model(b.column(content).to_pylist()), np.float32)
                ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1])
                yield pa.record_batch([*[b.column(k) for k in keys], pa.ListArray.from_arrays(ends, pa.array(x.ravel()))], names=[*keys, "vec"])

    return rows.select(*keys, content).where(f"`{content}` is not null").mapInArrow(run, f"{kinds}, vec array<float>")
