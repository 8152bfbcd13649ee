import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.operators import codebook, labels, linalg, meters, presets, reconcile, skew, training_math
from vellum.plans import pipelines


def test_prepared_pages(spark):
    pages = spark.createDataFrame([("d", f"p{i}.png", 100, 80) for i in range(4)], "dataset string, filename string, width int, height int")
    found = [("d", "p0.png", i, "Text_Main" if i % 2 else "Seal", 0.12345 + i / 100, 10, 5 + i, 60, 40 + i) for i in range(12)] + [("d", "p1.png", 0, "Seal", 0.5, 1, 1, 2, 2)]
    rows = spark.createDataFrame(found, "dataset string, filename string, pos int, label string, score double, x0 int, y0 int, x1 int, y1 int")
    made, documents, sheets = pipelines.prepared(pages, rows, 8)
    got = {r["filename"]: r for r in made.collect()}
    assert got["p0.png"]["bbox"] == [2, 0, 68, 59] and not got["p0.png"]["fell_back"] and got["p0.png"]["detections"][0][1] == "0.123"
    assert [got[f"p{i}.png"]["bbox"] for i in (1, 2, 3)] == [None] * 3 and got["p3.png"]["detections"] == []
    assert documents.count() == 1 and "p2.png" in documents.first()["value"]
    page = sheets.first()["html"]
    assert "4 pages, 3 without a zone" in page and page.count("Text_Main") == 4  # of the best eight of twelve
    assert {r["family"]: r["n"] for r in pipelines.family_counts(rows).collect()} == {"Text": 6, "Seal": 7}


@pytest.mark.parametrize("how", ["mean", "cls", "vlad"])
def test_embedding_unit_and_view(spark, tmp_path, how):
    rnd = np.random.default_rng(1)
    tokens = [(f"f{p % 3}/i{p}", w, t, rnd.normal(size=6).tolist()) for p in range(20) for w in range(2) for t in range(5)]
    df = spark.createDataFrame(tokens, "image string, window int, pos int, vec array<double>")
    made = pipelines.embedded_unit(df, {"model_id": "m@1+step1", "num_class_tokens": 1}, str(tmp_path / "u"), how, whiten=how == "mean", clusters=3)
    rows, fields = pipelines.read_unit(spark, str(tmp_path / "u"))
    assert [(r["row"], r["image"]) for r in rows.orderBy("row").collect()] == list(enumerate(sorted({t[0] for t in tokens})))
    told = fields.first()
    assert told["n_rows"] == 20 and told["pooling"] == how and told["embed_dim"] == {"mean": 6, "cls": 6, "vlad": 18}[how]
    assert (how == "vlad") == (tmp_path / "u" / "codebook").exists()
    assert all(abs(np.linalg.norm(r["vec"]) - 1) < 1e-5 for r in made.collect())
    sheet = pipelines.scatter_view(rows).collect()
    assert len(sheet) == 1 and sheet[0]["html"].count("<circle") == 20 and "f1 (7)" in sheet[0]["html"]


def test_evaluation_is_written_back(spark):
    registry = spark.createDataFrame([("m", 1, {"map": 0.1, "loss": 2.0}), ("n", 1, None)], "model_id string, seed int, eval_scores map<string,double>").withColumn("loaded_at", F.timestamp_seconds("seed"))
    vectors = spark.createDataFrame([(i, [1.0, i % 2 * 5.0], i % 2) for i in range(8)], "id long, vec array<double>, hand int")
    after = pipelines.evaluated(registry, "m", vectors, "id", "vec", "hand")
    from vellum.operators.lineage import shown_model

    assert shown_model(after, "m").first()["eval_scores"] == {"loss": 2.0, "map": 1.0, "top1": 100.0, "top5": 100.0}
    assert after.count() == 3
    with pytest.raises(ValueError):
        pipelines.evaluated(registry, "zz", vectors, "id", "vec", "hand")


def test_whitening_of_wide_vectors_equals_that_of_narrow_ones(spark, monkeypatch):
    x = np.random.default_rng(3).normal(size=(30, 50))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i int, v array<double>")
    monkeypatch.setattr(linalg, "MOST_WIDTH", 40)
    monkeypatch.setattr(linalg, "BLOCK_COLUMNS", 7)
    w = np.array([r["white"] for r in linalg.whitened(df, "v").orderBy("i").collect()])
    c = x - x.mean(0)
    u, s, _ = np.linalg.svd(c, full_matrices=False)
    kept = u[:, s > 1e-6 * s.max()]
    want = kept / np.linalg.norm(kept, axis=1, keepdims=True)
    assert w.shape == want.shape and np.allclose(w @ w.T, want @ want.T, atol=1e-6)
    monkeypatch.setattr(linalg, "MOST_WIDTH", 20)
    with pytest.raises(ValueError):
        linalg.whitened(df, "v")


def test_principal_axes_are_those_of_the_covariance(spark):
    x = np.random.default_rng(4).normal(size=(60, 5)) * [5, 3, 2, 1, 0.5]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i int, v array<double>")
    got = np.array([r["s"] for r in linalg.pca_scores(df, "v", 2, "s").orderBy("i").collect()])
    u, s, _ = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert np.allclose(np.abs(got), np.abs(u[:, :2] * s[:2]), atol=1e-8)


def test_hot_series_in_pieces(spark):
    rows = [("hot", i, float(i * 7 % 13)) for i in range(2000)] + [("a", i, float(i)) for i in range(5)] + [(None, 1, 1.0), (None, 2, 2.0)]
    df = spark.createDataFrame(rows, "name string, step int, value double").repartition(7)
    got = {(r["name"], r["step"]): r for r in meters.trailing_meter(df, "name", "step", "value").collect()}
    hot = [v for n, _, v in rows if n == "hot"]
    for i in range(0, 2000, 17):
        last = hot[max(0, i - 19) : i + 1]
        r = got["hot", i]
        assert r["median"] == sorted(last)[(len(last) - 1) // 2] and abs(r["avg"] - np.mean(last)) < 1e-9 and abs(r["global_avg"] - np.mean(hot[: i + 1])) < 1e-9
    assert len(got) == len(rows) and got[None, 2]["global_avg"] == 1.5
    placed = {(r["name"], r["step"]): (r["position"], r["total"]) for r in skew.balanced_positions(df, "name", ["step"], None).collect()}
    assert placed["hot", 1999] == (1999, 2000) and placed["a", 3] == (3, 5) and placed[None, 1] == (0, 2)
    runs = meters.run_lengths(df.withColumn("same", F.floor(F.col("step") / 500)), "name", "step", "same").where("name = 'hot'").orderBy("run").collect()
    assert [(r["n"], r["ends"]) for r in runs] == [(500, 500), (500, 1000), (500, 1500), (500, 2000)]
    assert meters.full_batches(df, "name", "step", 64).where("name = 'hot'").count() == 1984
    assert meters.trailing_meter(df.limit(0), "name", "step", "value").count() == 0
    ema = {r["name"]: r["value"] for r in training_math.exponential_average(df, "name", "step", "value", 0.9).collect()}
    c = 0.0
    for v in hot:
        c = 0.9 * c + 0.1 * v
    assert abs(ema["hot"] - c) < 1e-9


def test_codebook_sample_is_bounded_and_seeded(spark):
    df = spark.range(5000).select("id", F.array(F.col("id").cast("double")).alias("v"))
    some = codebook.sampled_descriptors(df, "id", "v", 3, 200)
    ids = [r["row"] for r in some.collect()]
    draws = dict(df.select("id", F.xxhash64(F.lit(3), "id")).collect())
    assert sorted(ids) == sorted(sorted(draws, key=lambda i: draws[i])[:200])
    pages = df.withColumn("page", F.col("id") % 3)
    assert codebook.reservoir_codebook(pages, "page", "id", "v", 2, 10).count() == 2


def test_checkpoints_and_presets():
    shapes = {"module.backbone.cls_token": (1, 1, 384), "module.backbone.patch_embed.proj.weight": (384, 3, 16, 16), "module.head.x": (3,)} | {f"module.backbone.blocks.{i}.w": (2,) for i in range(12)}
    told = reconcile.normalized_checkpoint({"teacher": shapes})
    assert told["config"] == {"arch": "vit_small", "patch_size": 16} and told["foreign"] and "cls_token" in told["backbone"] and "head.x" not in told["backbone"]
    own = reconcile.normalized_checkpoint({"student": {"a": (1,)}, "config": {"arch": "vit_tiny"}, "global_step": 7})
    assert own["config"]["arch"] == "vit_tiny" and own["global_step"] == 7 and not own["foreign"]
    with pytest.raises(ValueError):
        reconcile.normalized_checkpoint({"teacher": {"a": (1,)}})
    with pytest.raises(ValueError):
        reconcile.architecture_of(7, 7)
    assert presets.preset("mild", local_crops_number=9)["local_crops_number"] == 9 and presets.preset()["jpeg_quality"] == (35, 95)
    for bad in (lambda: presets.preset("zz"), lambda: presets.preset(zz=1)):
        with pytest.raises(ValueError):
            bad()
    assert training_math.token_count(224, 16) == 196


def test_triplets_and_first_rows(spark):
    df = spark.createDataFrame([(i, "hot" if i % 3 else f"h{i}") for i in range(90)] + [(99, None)], "id long, hand string")
    hand = {r["id"]: r["hand"] for r in df.collect()}
    got = labels.triplets(df, "hand", "id", 4, 1).collect()
    assert len(got) == 360
    for r in got:
        assert hand[r["negative"]] != hand[r["anchor"]]
        assert (r["positive"] is None) == (hand[r["anchor"]] != "hot") and (r["positive"] is None or (r["positive"] != r["anchor"] and hand[r["positive"]] == "hot"))
    assert labels.triplets(df.limit(0), "hand", "id", 4, 1).count() == 0
    with pytest.raises(ValueError):
        labels.first_k(df, "hand", "id", 2, full=True)
