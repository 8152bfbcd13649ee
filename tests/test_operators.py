import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.functions import vectors as V
from vellum.operators import codebook, labels, linalg, meters, reconcile, report, retrieval, training_math, windows, zones


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_strip_is_unicode_and_byte_exact_inside(spark):
    df = spark.createDataFrame([("   a b\t\r\n　",), ("",), (None,), ("  ",)], "x string")
    assert [r[0] for r in df.select(T.stripped("x")).collect()] == ["a b", "", None, ""]
    assert [r[0] for r in df.select(T.filled("x")).collect()] == [True, False, False, False]


def test_suffixes(spark):
    names = ["A.PNG", "b.tiff", "c.pdf", "png", None, "d.jpeg ", "e.jpg\n"]
    df = spark.createDataFrame([(n,) for n in names], "x string")
    assert [r[0] for r in df.select(T.is_image("x")).collect()] == [True, True, False, False, False, False, False]


def test_later_label_keeps_earlier_confidence(spark):
    rows = spark.createDataFrame([(1, "d", "a.png", "h1", 0.5, "s", None), (2, "d", " a.png", "h2 ", None, "", " "), (3, "d", "  ", "h3", 1.0, None, None), (4, "d", "zz.png", "h4", 1.0, None, None), (5, "d", "a.png", None, 1.0, None, None)], "n int, dataset string, filename string, hand_id string, confidence double, source string, notes string")
    images = spark.createDataFrame([("d", "a.png"), ("d", "a.png"), ("e", "q.png")], "dataset string, filename string")
    got = labels.label_table(rows, images, ["n"]).collect()
    assert [tuple(r) for r in got] == [("d", "a.png", "h2", 0.5, "s", "")]
    assert [r["n"] for r in labels.label_orphans(rows, images).collect()] == [4]
    assert sorted(map(tuple, labels.coverage(images, labels.label_table(rows, images, ["n"])).collect())) == [("d", 1, 1, 1, 1.0), ("e", 1, 0, 0, 0.0)]
    assert labels.label_table(rows.limit(0), images, ["n"]).count() == 0


def grid(w, h, size, overlap, bounds=None):
    stride = max(1, round(size * (1 - overlap)))
    x0, y0, x1, y1 = bounds or (0, 0, w, h)
    x0, y0, x1, y1 = min(max(0, x0), w), min(max(0, y0), h), max(min(w, x1), 0), max(min(h, y1), 0)

    def axis(a, b):
        return [a] if b - a <= size else list(range(a, b - size + 1, stride))

    return [(x, y) for y in axis(y0, y1) for x in axis(x0, x1)]


def test_window_grid_against_a_model(spark):
    rnd = random.Random(0)
    pages = [(i, rnd.randrange(1, 2200), rnd.randrange(1, 2200), *(rnd.choice([None, rnd.randrange(-50, 2300)]) for _ in range(4))) for i in range(150)]
    df = spark.createDataFrame(pages, "i int, width int, height int, x0 int, y0 int, x1 int, y1 int")
    got = {}
    for r in windows.window_grid(df, 512, 0.7).collect():
        got.setdefault(r["i"], []).append((r["x"], r["y"]))
    for i, w, h, *b in pages:
        full = [0 if b[0] is None else b[0], 0 if b[1] is None else b[1], w if b[2] is None else b[2], h if b[3] is None else b[3]]
        assert sorted(got[i]) == sorted(grid(w, h, 512, 0.7, full))


def test_window_edges(spark):
    pages = spark.createDataFrame([(1, 300, 300), (2, 1023, 300), (3, 1024, 300), (4, None, 5)], "i int, width int, height int")
    got = {}
    for r in windows.window_grid(pages).collect():
        got.setdefault(r["i"], []).append(r["x"])
    assert got == {1: [0], 2: [0, 256], 3: [0, 256, 512]}
    assert sorted({r["x"] for r in windows.legacy_grid_a(spark.createDataFrame([(1024, 1024)], "width int, height int"), 512, 0.5).collect()}) == [0, 256]
    assert windows.stride_of(512, 0.7) == 154
    with pytest.raises(ValueError):
        windows.stride_of(512, 1.0)


def test_zone_falls_back(spark):
    pages = spark.createDataFrame([(1, 100, 100), (2, 100, 100)], "p int, width int, height int")
    boxes = spark.createDataFrame([(1, "Text_Main", 0.9, 5, 5, 99, 50), (1, "Text", 0.1, 20, 1, 30, 60), (2, "text_Main", 0.9, 1, 1, 2, 2)], "p int, label string, score double, x0 int, y0 int, x1 int, y1 int")
    got = {r["p"]: r for r in zones.main_zones(pages, boxes, ["p"], 10).collect()}
    assert (got[1]["x0"], got[1]["y0"], got[1]["x1"], got[1]["y1"], got[1]["fell_back"]) == (0, 0, 100, 70, False)
    assert got[2]["fell_back"] and got[2]["x0"] is None


def test_vlad_and_zero_vectors(spark):
    book = spark.createDataFrame([(0, [0.0, 0.0]), (1, [9.0, 9.0]), (2, [-9.0, 0.0])], "cluster_id int, center array<double>")
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (1, [8.0, 9.0]), (2, [0.0, 0.0])], "page int, v array<double>")
    got = {r["page"]: r["vec"] for r in codebook.vlad(rows, book, "page", "v").collect()}
    assert got[1] == pytest.approx([1 / math.sqrt(2), 0, -1 / math.sqrt(2), 0, 0, 0]) and got[2] == [0.0] * 6
    fitted = codebook.fitted_codebook(rows.withColumn("i", F.monotonically_increasing_id()), "i", "v", 10)
    assert fitted.count() <= 3


def test_whitening_invariants(spark):
    x = np.random.default_rng(0).normal(size=(40, 5))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "i int, v array<double>")
    got = np.array([r["white"] for r in linalg.whitened(df, "v").orderBy("i").collect()])
    u = np.linalg.svd(x - x.mean(0), full_matrices=False)[0] * np.sqrt(39)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    assert np.allclose(got @ got.T, u @ u.T)
    assert linalg.whitened(df.limit(1), "v").first()["white"] == []
    s = np.array([r["scores"] for r in linalg.pca_scores(df, "v", 2).orderBy("i").collect()])
    c = x - x.mean(0)
    want = c @ np.linalg.svd(c, full_matrices=False)[2][:2].T
    assert np.allclose(np.abs(s), np.abs(want))
    with pytest.raises(ValueError):
        linalg.plane(df, "v", "tsne")


def test_average_precision_formula(spark):
    ranks = spark.createDataFrame([(1, 10, 0.9, 0, 2), (1, 11, 0.5, 2, 2)], "qid long, gid long, sim double, rank long, n_relevant long")
    assert retrieval.average_precision(ranks).first()["ap"] == pytest.approx(0.791667, abs=1e-6)


def test_ranks_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "BLOCK", 16)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 4))
    lab = rng.integers(0, 5, 60)
    df = spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, lab, strict=True))] + [(99, None, 1)], "id long, v array<double>, c int")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(u @ u.T, 6)
    want = {}
    for q in range(60):
        order = sorted((g for g in range(60) if g != q), key=lambda g: (-s[q, g], g))
        clean = [g for g in order if g % 7]
        for r, g in enumerate(clean):
            if lab[g] == lab[q]:
                want[q, g] = r
    got = {(r["qid"], r["gid"]): r["rank"] for r in retrieval.relevant_ranks(df, "id", "v", "c", junk=F.col("id") % 7 == 0).collect()}
    assert got == want


def test_meters(spark):
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate([5, 1, 4, 2])], "n string, s int, v double")
    got = meters.trailing_meter(df, "n", "s", "v", 2).orderBy("s").collect()
    assert [r["median"] for r in got] == [5, 1, 1, 2] and [r["max"] for r in got] == [5, 5, 4, 4]
    assert [r["global_avg"] for r in got] == [5, 3, 10 / 3, 3]
    bad = spark.createDataFrame([(float("nan"),), (float("-inf"),), (1.0,), (None,)], "v double")
    assert [r[0] for r in bad.select(meters.diverged(F.col("v"))).collect()] == [True, True, False, False]


def test_schedules(spark):
    with pytest.raises(ValueError):
        training_math.cosine_schedule(spark, 1.0, 0.0, 5, 6)
    got = [r["value"] for r in training_math.cosine_schedule(spark, 1.0, 0.0, 6, 3).orderBy("step").collect()]
    assert got[:4] == [0.0, 0.5, 1.0, 1.0] and got[-1] == pytest.approx(0.25)


def test_masks_and_losses(spark):
    a = F.array(*map(F.lit, [0.1, 0.9, 0.9, 0.2]))
    assert one(spark, training_math.top_mask(a, 0.5)) == [False, True, True, False]
    assert one(spark, training_math.top_mask(a, 0.25, lowest=True)) == [True, False, False, False]
    assert sum(one(spark, training_math.hinted_mask(a, 0.5, 0.5, F.lit(1)))) == 1
    assert sum(one(spark, training_math.seeded_mask(10, 0.3, F.lit(1)))) == 3
    assert one(spark, V.softmax(F.array(F.lit(1000.0), F.lit(1000.0)))) == [0.5, 0.5]
    assert one(spark, training_math.masked_mean(F.array(F.lit(2.0)), F.array(F.lit(False)))) == 0.0


def test_reconcile(spark):
    a = spark.createDataFrame([("x", [1]), ("y", [2]), ("masked_embed", [1])], "name string, shape array<int>")
    b = spark.createDataFrame([("x", [1]), ("y", [3]), ("z", [1])], "name string, shape array<int>")
    report_ = reconcile.reconciled(a, b)
    assert {r["name"]: r["status"] for r in report_.collect()} == {"x": "loaded", "y": "shape_mismatch", "z": "unexpected", "masked_embed": "missing"}
    assert [r["name"] for r in reconcile.gaps(report_).collect()] == ["y"]
    keys = spark.createDataFrame([("module.backbone.a",), ("head.w",), ("backbone.head.w",), ("module.fc.b",)], "name string")
    assert sorted(r[0] for r in reconcile.backbone_keys(keys, "name").collect()) == ["a", "head.w"]


def test_reports(spark):
    df = spark.createDataFrame([(1.0, 2.0, "<a>"), (1.0, 3.0, "b")], "x double, y double, c string")
    scaled = linalg.scaled_to_canvas(df, "x", "y")
    assert {r["cx"] for r in scaled.collect()} == {44.0}
    sheets = report.scatter_pages(scaled, "cx", "cy", "c", most=1).collect()
    assert len(sheets) == scaled.count() and any("&lt;a&gt;" in r["html"] for r in sheets)
    assert [r[0] for r in df.select(T.regex_category("c", "z(.)")).collect()] == ["—", "—"]
