from datetime import datetime

import pyarrow as pa
import pyarrow.parquet as pq

from vellum.plans.problems import p4_found

T0, T1, T2 = datetime(2024, 1, 1), datetime(2024, 2, 1), datetime(2024, 3, 1)
STAMP = pa.timestamp("us", tz="UTC")


def write(folder, name, fields, rows):
    schema = pa.schema(fields)
    pq.write_table(pa.Table.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema), f"{folder}/{name}.parquet")


def test_a_name_that_is_no_image_is_an_orphan_even_if_the_file_is_there(spark, tmp_path):
    key = [("dataset", pa.string()), ("filename", pa.string())]
    there = [("d", f, T0, None) for f in ("a.png", "b.TIFF", "c.pdf", "d.jpg.part")]
    write(tmp_path, "images", [*key, ("arrived_at", STAMP), ("removed_at", STAMP)], [*there, there[0], ("d", "e.pdf", T0, T1)])
    labels = [(1, "d", "a.png", "h", T1), (2, "d", " c.pdf ", "h", T1), (3, "d", "e.pdf", "h", T2), (4, "d", "b", "h", T1), (5, "d", "c.pdf", " ", T1), (6, "d", " ", "h", T1)]
    write(tmp_path, "labels", [("label_id", pa.int64()), *key, ("hand_id", pa.string()), ("labeled_at", STAMP)], labels)
    zones = [(1, "d", "b.TIFF", [0, 0, 1, 1], T1), (2, "d", "d.jpg.part", [0, 0, 1, 1], T1), (3, "d", "d.jpg.part", None, T1), (4, "d", None, [0, 0, 1, 1], T1)]
    write(tmp_path, "zones", [("zone_id", pa.int64()), *key, ("bbox", pa.list_(pa.int32())), ("detected_at", STAMP)], zones)
    manifests = [(1, " D ", ["a.png", "c.pdf", "c.pdf ", "a", "", None], T1)]
    write(tmp_path, "dataset_manifest", [("manifest_id", pa.int64()), ("name", pa.string()), ("orphan_rows", pa.list_(pa.string())), ("scanned_at", STAMP)], manifests)
    got = sorted(tuple(r) for r in p4_found(spark, str(tmp_path)).collect())
    assert got == [("dataset_manifest", 1, "a"), ("dataset_manifest", 1, "c.pdf"), ("labels", 2, "c.pdf"), ("labels", 3, "e.pdf"), ("labels", 4, "b"), ("zones", 2, "d.jpg.part")]
