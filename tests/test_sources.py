import json

import numpy as np
import pytest

from vellum.sources import config, folders, matrices, plugins


def test_image_listing(spark, tmp_path):
    for p in ("a.PNG", "x.txt", "sub/b.tif", "sub/deep/c.png", "other/d.webp"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(b"1")
    rows = folders.image_listing(spark, str(tmp_path))
    assert sorted((r["dataset"], r["filename"]) for r in rows.collect()) == sorted([(tmp_path.name, "a.PNG"), ("sub", "b.tif"), ("other", "d.webp")])
    assert folders.discovered_datasets(rows).count() == 3


def test_label_csv(spark, tmp_path):
    (tmp_path / "set").mkdir()
    (tmp_path / "set" / "labels.csv").write_text('filename,hand_id,confidence\n"a ""q"".png",h1,0.5\nb.png,h2,high\n', encoding="utf-8")
    got = [tuple(r) for r in folders.label_rows(spark, str(tmp_path / "set" / "labels.csv")).orderBy("line").drop("line").collect()]
    assert got == [("set", 'a "q".png', "h1", 0.5, None, None), ("set", "b.png", "h2", None, None, None)]


def test_zone_documents(spark, tmp_path):
    text = json.dumps({"meta": {}, "images": {"a": {"bbox": [1, 2, 3, 4], "size": [9, 9], "fell_back": False, "detections": [["Text", 0.5, 1, 2, 3, 4]]}, "b": {"bbox": None}}})
    (tmp_path / "zones.json").write_text(text)
    got = {r["filename"]: r for r in folders.read_zones(spark, str(tmp_path / "zones.json")).collect()}
    assert got["a"]["detections"] == [["Text", "0.5", "1", "2", "3", "4"]]
    assert got["b"]["bbox"] is None and got["b"]["fell_back"] and got["b"]["size"] == [0, 0] and got["b"]["detections"] == []


def test_matrices(spark, tmp_path):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (0, [3.0, 4.0])], "row int, v array<double>")
    path = matrices.write_npy(df, "row", "v", str(tmp_path / "m.bin"))
    assert path.endswith("m.npy") and np.load(path).tolist() == [[3, 4], [1, 2]]
    assert [r["image"] for r in matrices.read_npy(spark, path, ["a"]).orderBy("row").collect()] == ["0", "1"]
    assert matrices.narrow(matrices.wide(df.selectExpr("cast(row as string) i", "v"), "i", "v", 2), "i").count() == 2
    matrices.append_log(df.select("row"), str(tmp_path / "log"))
    matrices.append_log(df.select("row"), str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 4
    matrices.write_run_manifest(str(tmp_path / "run"), {"a": 1}, {})
    assert matrices.resumable(str(tmp_path / "run")) is None


def test_config():
    base = {"data": {"overlap": 0.5}, "x": 1}
    assert config.overridden(base, ["data.overlap=1e-5", "n.k=true"]) == {"data": {"overlap": 1e-5}, "x": 1, "n": {"k": True}}
    with pytest.raises(ValueError):
        config.overridden(base, ["x.y=1"])
    assert config.config_hash({"b": 1, "a": 2}) == config.config_hash({"a": 2, "b": 1})
    assert config.embed_settings({}, {"data.overlap": 0.1}) == {"overlap": 0.1}
    with pytest.raises(ValueError):
        config.embed_settings({}, {"lr": 1})


def test_detector(spark):
    page = np.full((40, 60), 250, np.uint8)
    page[10:20, 15:30] = 10
    page[2, 2] = 0
    df = spark.createDataFrame([("p", 60, 40, bytearray(page.tobytes())), ("q", 60, 40, bytearray(np.full((40, 60), 250, np.uint8).tobytes()))], "name string, width int, height int, gray binary")
    got = {r["name"]: r["detections"] for r in plugins.detected(df, plugins.detector("heuristic"), ["name"]).collect()}
    d = got["p"][0]
    assert (d["x0"], d["y0"], d["x1"], d["y1"]) == (15, 10, 30, 20) and got["q"] == []
    with pytest.raises(ValueError):
        plugins.detector("none")


def test_streaming_meters(spark, tmp_path):
    from vellum.streaming import meters

    spark.createDataFrame([("a", i, float(v), f"2024-01-01 00:0{i}:00") for i, v in enumerate([5, 1, 4])] + [("b", 9, None, "2024-01-01 00:00:00")], "name string, step long, value double, t string").selectExpr("name", "step", "value", "cast(t as timestamp) at").write.parquet(str(tmp_path / "in"))
    schema = "name string, step long, value double, at timestamp"
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = meters.trailing_meters(stream, "name", "step", "value").writeStream.outputMode("update").format("memory").queryName("trail").start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("trail").collect()
    assert [(r["name"], r["n"], r["median"], r["max"]) for r in got] == [("a", 3, 4.0, 5.0)]
    q = meters.windowed_means(stream, "at", "name", "value").writeStream.outputMode("complete").format("memory").queryName("means").start()
    q.processAllAvailable()
    q.stop()
    assert {(r["name"], r["n"]) for r in spark.table("means").collect()} == {("a", 3), ("b", 0)}
