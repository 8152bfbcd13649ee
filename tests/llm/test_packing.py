import random

import pytest

from vellum.llm import packing
from vellum.llm.queries import VOCABULARY


def naive(sizes, capacity):
    room, out = [], []
    for s in sizes:
        at = next((i for i, r in enumerate(room) if r >= s), len(room))
        if at == len(room):
            room.append(capacity)
        room[at] -= s
        out.append(at)
    return out


def test_tree_equals_a_plain_scan():
    rnd = random.Random(6)
    for n in (0, 1, 2, 7, 200):
        sizes = sorted((rnd.randrange(1, 101) for _ in range(n)), reverse=True)
        assert packing.first_fit_decreasing(sizes, 100) == naive(sizes, 100)


def test_nothing_is_lost_split_or_overfilled(spark):
    rnd = random.Random(7)
    sizes = [rnd.randrange(1, 60) for _ in range(400)] + [100, 101, 350, 0, None, -3]
    df = spark.createDataFrame([(i // 2 if i < 10 else i, s, 5, "b") for i, s in enumerate(sizes)], "doc long, n long, piece int, bucket string")
    got = packing.packed(df, "doc", "n", 100, 2000).collect()
    held, total = {}, {}
    for r in got:
        total[r["doc"]] = total.get(r["doc"], 0) + r["n_tokens"]
        if r["container_id"] is not None:
            held[r["container_id"]] = held.get(r["container_id"], 0) + r["n_tokens"]
    want = {}
    for i, s in enumerate(sizes):
        d = i // 2 if i < 10 else i
        want[d] = want.get(d, 0) + max(0, s or 0)
    assert total == want and max(held.values()) <= 100
    assert len(held) <= 1.1 * sum(want.values()) / 100 + 6
    assert sorted((r["piece"], r["token_start"], r["n_tokens"]) for r in got if r["doc"] == 402) == [(0, 0, 100), (1, 100, 100), (2, 200, 100), (3, 300, 50)]
    assert sum(r["container_id"] is None for r in got) == 3
    assert packing.packed(df.limit(0), "doc", "n").count() == 0
    with pytest.raises(ValueError):
        packing.packed(df, "doc", "n", 0)


def test_token_sizes(spark):
    long = "word " * 30000
    df = spark.createDataFrame([(1, "hello world"), (2, ""), (3, None), (4, long), (4, long), (None, "x")], "id long, text string")
    got = [tuple(r) for r in packing.token_sizes(df, "id", "text", VOCABULARY).collect()]
    assert sorted(got, key=str) == sorted([(1, 2), (2, 0), (3, 0), (4, 30001), (4, 30001), (None, 1)], key=str)
