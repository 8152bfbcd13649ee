import random

import pytest

from vellum.llm import mixing


def brute_fill(quotas, patterns, uses):
    """Greatest total fill by the condition on every set of sources (max-flow min-cut)."""
    n = len(quotas)
    best = float("inf")
    for cut in range(1 << n):
        inside = {i for i in range(n) if cut >> i & 1}
        best = min(best, sum(quotas[i] for i in range(n) if i not in inside) + sum(uses * u for s, u in patterns if inside & set(s)))
    return best


def test_flow_is_greatest_and_repeats_least():
    rnd = random.Random(4)
    for _ in range(150):
        n = rnd.randrange(1, 5)
        quotas = [float(rnd.randrange(0, 40)) for _ in range(n)]
        patterns = [(sorted(rnd.sample(range(n), rnd.randrange(1, n + 1))), float(rnd.randrange(0, 15))) for _ in range(rnd.randrange(1, 5))]
        fills = []
        for uses in (1, 2, 3):
            sent = mixing.min_cost_flow(quotas, patterns, uses)
            for i in range(n):
                assert sum(x.get(i, 0) for x in sent) <= quotas[i] + 1e-6
            for (s, u), x in zip(patterns, sent, strict=True):
                assert sum(x.values()) <= uses * u + 1e-6 and set(x) <= set(s) and min(x.values(), default=0) > -1e-6
            fills.append(sum(sum(x.values()) for x in sent))
            assert fills[-1] == pytest.approx(brute_fill(quotas, patterns, uses))
        # first uses alone fill as much as they can before any second use is taken
        assert sum(min(sum(x.values()), u) for (_, u), x in zip(patterns, mixing.min_cost_flow(quotas, patterns, 3), strict=True)) >= fills[0] - 1e-6


def test_whole_quotas():
    assert mixing.whole_quotas([1 / 3, 1 / 3, 1 / 3], 100) == [34.0, 33.0, 33.0]


def shares(spark, rows):
    return mixing.shares_of(spark.createDataFrame(rows, "e string, s string, w double, source int"), "e", "s", "w")


def test_weights(spark):
    rows = [("a", "x", 1.0, 1), ("a", "x", 1.0, 1), ("a", "y", 2.0, 1), ("a", "z", None, 1), ("a", "u", float("nan"), 1), ("a", "v", -1.0, 1), ("a", "w", 0.0, 1), (None, "x", 1.0, 1), ("a", None, 1.0, 1)]
    assert sorted(map(tuple, shares(spark, rows).collect())) == [("a", "x", 0.5), ("a", "y", 0.5)]


def draw(spark, members, rows, size=None, **k):
    df = spark.createDataFrame(members, "r int, s string, n long, pattern int")
    return mixing.drawn_mixture(df, ["r"], "s", shares(spark, rows), size, **k).collect()


def test_draw_meets_whole_quotas_with_overlap_and_cap(spark):
    members = [(i, "x", 1, 0) for i in range(60)] + [(i, "y", 1, 0) for i in range(40, 70)] + [(0, "x", 1, 0), (5, None, 1, 0), (1, "small", 1, 0)]
    got = draw(spark, members, [("a", "x", 0.5, 0), ("a", "y", 0.5, 0), ("b", "small", 1.0, 0), ("c", "gone", 1.0, 0)], total=80)
    by, uses = {}, {}
    for r in got:
        by[r["entry"], r["source"]] = by.get((r["entry"], r["source"]), 0) + r["uses"]
        uses[r["entry"], r["r"]] = uses.get((r["entry"], r["r"]), 0) + r["uses"]
    assert by == {("a", "x"): 40, ("a", "y"): 40, ("b", "small"): 3}
    assert max(uses.values()) == 3 and max(v for (e, _), v in uses.items() if e == "a") == 2


def test_sizes_many_buckets_and_empty(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_UNITS", 16)
    members = [(i, "x", 1 + i % 5, 0) for i in range(200)] + [(900, "x", 0, 0), (901, "x", None, 0)]
    got = draw(spark, members, [(f"e{j}", "x", 1.0, 0) for j in range(20)], "n", total=700, max_uses=3)
    whole = sum(m[2] or 0 for m in members)
    for j in range(20):
        mine = {r["r"]: r["uses"] for r in got if r["entry"] == f"e{j}"}
        size = sum((1 + r % 5) * u for r, u in mine.items())
        assert abs(size - 700) <= 5 and max(mine.values()) <= -(-700 // whole) and not {900, 901} & set(mine)
    assert draw(spark, [], [("a", "x", 1.0, 0)]) == [] and draw(spark, members, []) == []
