"""Page vectors of whole windows, detections of whole bodies."""

import numpy as np

from vellum.operators import pooling
from vellum.plans import reference


def test_projector_keeps_all_tokens_of_drawn_windows(spark):
    rng = np.random.default_rng(1)
    tokens = [(page, win, rng.normal(size=3).tolist()) for page, n in ((1, 2), (2, 7)) for win in range(n) for _ in range(5)]
    got = {r["page"]: np.array(r["vec"]) for r in pooling.projector_vectors(spark.createDataFrame(tokens, "page long, win long, v array<double>"), "page", "win", "v", 2).collect()}
    mean = lambda page, wins: np.mean([v for p, w, v in tokens if p == page and w in wins], axis=0)
    unit = lambda x: x / np.linalg.norm(x)
    assert np.allclose(got[1], unit(mean(1, {0, 1})))
    from itertools import combinations

    assert sum(np.allclose(got[2], unit(mean(2, set(c)))) for c in combinations(range(7), 4)) == 1


def test_every_body_gives_a_row(spark, tmp_path):
    dark = bytearray([200] * 32 * 100)
    for y in range(80, 90):
        dark[32 * y + 4 : 32 * y + 20] = bytes(16)
    rows = [(1, None), (2, bytearray()), (3, bytearray(b"short")), (4, dark), (5, dark + bytearray(b"\xc8" * 5))]
    spark.createDataFrame(rows, "doc_id long, body binary").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["detections"] for r in reference.detector_udf_contract(spark, str(tmp_path)).collect()}
    assert set(got) == {1, 2, 3, 4, 5} and got[1] == got[2] == []
    for doc in (4, 5):
        assert [(z["x0"], z["y0"], z["x1"], z["y1"]) for z in got[doc]] == [(4, 80, 20, 90)]
