import random

from vellum.llm import components, splits


def brute(links):
    par = {}

    def find(a):
        par.setdefault(a, a)
        while par[a] != a:
            a = par[a]
        return a

    for a, b in links:
        x, y = find(a), find(b)
        if x != y:
            par[max(x, y)] = min(x, y)
    return {a: find(a) for a in par}


def test_components(spark):
    rnd = random.Random(8)
    links = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(250)] + [(1000 + i, 1001 + i) for i in range(120)] + [(2000, 2000 + i) for i in range(200)] + [(5, 5)]
    df = spark.createDataFrame(links + [(None, 1), (2, None)], "a long, b long")
    got = {r["node"]: r["component"] for r in components.hash_to_min(df, "a", "b").collect()}
    want = brute([*links, (1, 1), (2, 2)])
    assert got == want
    assert components.hash_to_min(df.limit(0), "a", "b").count() == 0


def test_splits_keep_components_whole(spark):
    rows = [("p1", "a"), ("p1", "b"), ("p2", "b"), ("p2", "c"), ("p3", "d"), ("p3", "d"), ("p3", None), (None, "e")]
    df = spark.createDataFrame([(p, h, "x", 0) for p, h in rows], "page string, hand string, split string, component int")
    got = {r["hand"]: (r["component"], r["split"]) for r in splits.grouped_splits(df, "hand", ["page"]).collect()}
    assert set(got) == {"a", "b", "c", "d"} and len({got[h] for h in "abc"}) == 1 and got["d"][0] == "d"


def test_proportions_and_stability(spark):
    df = spark.createDataFrame([(f"p{i}", f"h{i}") for i in range(3000)], "page string, hand string")
    place = lambda w: {r["hand"]: r["split"] for r in splits.grouped_splits(df, "hand", ["page"], w).collect()}
    a, b = place({"train": 0.8, "validation": 0.1, "test": 0.1}), place({"train": 0.8, "validation": 0.1, "test": 0.2})
    assert abs(sum(v == "train" for v in a.values()) / 3000 - 0.8) < 0.03
    # more weight for one split only moves hands into it
    assert all(a[h] == b[h] or b[h] == "test" for h in a)


def test_large_components_fill_the_proportions(spark):
    # one hand holds a fifth of the pages, some hold much, the rest little
    sizes = [400, 150, 90, 60, 40, 30, 20, 10] + [1] * 1200
    rows = [(f"h{i}", f"p{i}-{j}") for i, n in enumerate(sizes) for j in range(n)]
    df = spark.createDataFrame(rows, "hand string, page string")
    got = {r["hand"]: r["split"] for r in splits.grouped_splits(df, "hand", ["page"]).collect()}
    for s, w in splits.SPLITS.items():
        assert abs(sum(n for i, n in enumerate(sizes) if got[f"h{i}"] == s) / sum(sizes) - w) < 0.02
    assert splits.grouped_splits(df.limit(0), "hand", ["page"]).count() == 0
