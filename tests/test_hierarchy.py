import random

from vellum.operators.hierarchy import descendant_pairs, hierarchies


def run(spark, links):
    df = spark.createDataFrame([(a, b, "x") for a, b in links], "model_id string, parent_id string, root_id string")
    return {r["model_id"]: r for r in hierarchies(df, "model_id", "parent_id").collect()}


def brute(links):
    par = {a: b for a, b in links if a is not None}
    out = {}
    for a in par:
        chain, at = [a], par[a]
        while at in par and at not in chain:
            chain.append(at)
            at = par[at]
        if at in chain:
            out[a] = (None, None, None, min(chain[chain.index(at) :]), a in chain[chain.index(at) :])
        else:
            out[a] = (chain[-1], len(chain) - 1, chain[::-1], None, False)
    return out


def check(spark, links):
    got = {k: (r["root_id"], r["depth"], r["path"], r["loop_id"], r["on_loop"]) for k, r in run(spark, links).items()}
    assert got == brute(links)


def test_random_forests_chains_stars_and_loops(spark):
    rnd = random.Random(5)
    links = [(f"n{i:04d}", f"n{rnd.randrange(max(1, i)):04d}" if i % 9 else None) for i in range(300)]
    links += [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(150)]  # a deep chain that ends outside
    links += [(f"s{i:03d}", "n0001") for i in range(150)]  # a node with many children
    links += [(f"r{i}", f"r{(i + 1) % 7}") for i in range(7)] + [(f"t{i}", f"r{i % 7}") for i in range(20)] + [(f"u{i}", f"t{i}") for i in range(20)]
    links += [("self", "self"), ("under", "self"), ("pair1", "pair2"), ("pair2", "pair1")]
    check(spark, links)


def test_nulls_repeats_and_empty(spark):
    assert run(spark, []) == {}
    got = run(spark, [("a", None), ("a", None), ("b", "a"), (None, "a"), ("c", "gone")])
    assert {k: (r["root_id"], r["depth"]) for k, r in got.items()} == {"a": ("a", 0), "b": ("a", 1), "c": ("c", 0)}
    assert got["c"]["parent_id"] == "gone"


def test_descendants(spark):
    tree = hierarchies(spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("x", "x")], "id string, up string"), "id", "up")
    assert sorted(map(tuple, descendant_pairs(tree, "id").collect())) == [("a", "b", 1), ("a", "c", 2), ("b", "c", 1)]
