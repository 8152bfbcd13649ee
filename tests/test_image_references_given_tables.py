from pathlib import PurePosixPath

import pyarrow.parquet as pq

from vellum.plans.problems import p4_found, p4_report

IMAGES = {".png", ".jpg", ".jpeg", ".tif", ".tiff", ".bmp", ".webp"}


def read(folder, name, *columns):
    return zip(*(c.to_pylist() for c in pq.read_table(f"{folder}/{name}.parquet", columns=list(columns)).select(columns).columns), strict=True)


def orphans(folder):
    """The rule row by row, with Python's own strip, lower and suffix, as the reference reads a folder."""
    stays = {}
    for dataset, name, arrived, removed in read(folder, "images", "dataset", "filename", "arrived_at", "removed_at"):
        if PurePosixPath(name).suffix.lower() in IMAGES:
            stays.setdefault((dataset, name), []).append((arrived, removed))
    refs = [("labels", k, d, f, at) for k, d, f, h, at in read(folder, "labels", "label_id", "dataset", "filename", "hand_id", "labeled_at") if (h or "").strip()]
    refs += [("zones", k, d, f, at) for k, d, f, box, at in read(folder, "zones", "zone_id", "dataset", "filename", "bbox", "detected_at") if box is not None]
    refs += [("dataset_manifest", k, (n or "").strip().lower(), f, at) for k, n, names, at in read(folder, "dataset_manifest", "manifest_id", "name", "orphan_rows", "scanned_at") for f in names or []]
    named = [(t, k, d, (f or "").strip(), at) for t, k, d, f, at in refs]
    return {(t, k, f) for t, k, d, f, at in named if f and not any(a <= at and (r is None or r > at) for a, r in stays.get((d, f), []))}


def test_given_tables_lose_no_orphan(spark, folder):
    want, rows = orphans(folder), [tuple(r) for r in p4_found(spark, folder).collect()]
    assert len(rows) == len(want)
    assert set(rows) == want
    assert sum(r["n_orphans"] for r in p4_report(spark, folder).collect()) == len(want)
