import random
from datetime import datetime, timedelta

from vellum.operators.skew import balanced_key_results, balanced_positions

T0 = datetime(2024, 1, 1)


def frame(spark, rows):
    return spark.createDataFrame([(k, None if t is None else T0 + timedelta(seconds=t), i, g, v, i) for i, (k, t, g, v) in enumerate(rows)], "k string, at timestamp, i long, tag string, v double, part int")


def brute(rows):
    out = {}
    keys = {k for k, *_ in rows if k is not None}
    for k in keys:
        mine = sorted((t, i, g or "", v) for i, (kk, t, g, v) in enumerate(rows) if kk == k)
        vs = [v for *_, v in mine if v is not None and v == v and abs(v) != float("inf")]
        out[k] = (len(mine), sum(a[2] != b[2] for a, b in zip(mine, mine[1:], strict=False)), float(max([b[0] - a[0] for a, b in zip(mine, mine[1:], strict=False)], default=0)), round(sum(vs) / len(vs), 9) if vs else None)
    return out


def test_against_brute_force_with_a_key_of_a_third(spark):
    rnd = random.Random(1)
    rows = [("hot" if i % 3 == 0 else f"k{rnd.randrange(200)}", rnd.randrange(5000), rnd.choice(["a", "b", None]), rnd.choice([None, float("nan"), float("inf"), rnd.random()])) for i in range(6000)]
    rows += [(None, 1, "a", 1.0)] * 5
    got = {r["k"]: (r["n_rows"], r["n_switches"], r["longest_gap_s"], None if r["mean_value"] is None else round(r["mean_value"], 9)) for r in balanced_key_results(frame(spark, rows), "k", "at", "i", "tag", "v", 7).collect()}
    assert got == brute(rows)


def test_hot_key_is_cut_over_partitions(spark):
    from pyspark.sql import functions as F

    rows = frame(spark, [("hot", i, "a", 1.0) for i in range(4000)])
    parts = rows.repartitionByRange(8, "k", "at", "i").groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) == 8 and max(r["count"] for r in parts) < 1500


def test_nulls_ties_repeats_and_empty(spark):
    rows = [("a", None, None, None), ("a", 5, "x", 1.0), ("a", 5, "x", 1.0), ("b", None, None, None)]
    got = {r["k"]: r.asDict() for r in balanced_key_results(frame(spark, rows), "k", "at", "i", "tag", "v").collect()}
    assert got["a"]["n_rows"] == 3 and got["a"]["n_switches"] == 1 and got["a"]["mean_value"] == 1.0
    assert got["b"]["n_rows"] == 1 and got["b"]["mean_value"] is None
    assert balanced_key_results(frame(spark, []), "k", "at", "i", "tag", "v").count() == 0


def test_positions(spark):
    rnd = random.Random(2)
    rows = [("hot" if i % 2 else f"k{i % 5}", i, rnd.choice([None, 1, 3])) for i in range(900)]
    df = spark.createDataFrame(rows, "k string, i long, _size long")
    got = {(r["k"], r["i"]): (r["position"], r["total"]) for r in balanced_positions(df, "k", ["i"], "_size").collect()}
    for k in {r[0] for r in rows}:
        at, mine = 0, [r for r in rows if r[0] == k]
        for _, i, s in mine:
            assert got[k, i] == (at, sum(x[2] or 0 for x in mine))
            at += s or 0
    assert balanced_positions(df.limit(0), "k", ["i"], None).count() == 0
