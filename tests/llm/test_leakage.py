import random

import numpy as np

from vellum.llm import leakage

WORDS = [f"w{i}" for i in range(400)]


def smith_waterman(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    r = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    best = run = 0
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if x == y else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
            r[i][j] = r[i - 1][j - 1] + 1 if x == y else 0
            best, run = max(best, h[i][j]), max(run, r[i][j])
    return best, run


def test_alignment_against_the_plain_recurrence():
    rnd = random.Random(1)
    items = [[rnd.randrange(1, 6) for _ in range(rnd.randrange(1, 20))] for _ in range(60)]
    texts = [np.array([rnd.randrange(0, 6) for _ in range(rnd.randrange(1, 40))]) for _ in range(60)]
    best, run = leakage.align(items, texts)
    assert [(int(a), int(b)) for a, b in zip(best, run, strict=True)] == [smith_waterman(x, y.tolist()) for x, y in zip(items, texts, strict=True)]


def run(spark, docs, items, **k):
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, item int")
    e = spark.createDataFrame([(i, p, "x") for i, p in items], "item_id long, passage string, words string")
    return {(r["doc_id"], r["item_id"]): r for r in leakage.leaked_passages(d, "doc_id", "text", e, "item_id", "passage", **k).collect()}


def test_exact_short_disguised_and_edited(spark):
    rnd = random.Random(2)
    filler = lambda n: [rnd.choice(WORDS) for _ in range(n)]
    passage = [f"p{i}" for i in range(30)]
    short = [f"s{i}" for i in range(8)]
    tiny = ["Zyx", "Wvu"]
    edited = [w if i % 7 else "changed" for i, w in enumerate(passage)]
    docs = [
        (1, " ".join(filler(50) + passage[3:15] + filler(50))),
        (2, " ".join(filler(50) + passage[3:14] + filler(50))),
        (3, ", ".join(filler(5) + [w.upper() for w in passage] + filler(9000))),
        (4, " ".join(filler(20) + short)),
        (5, " ".join(filler(20) + short[:7])),
        (6, "zyx - wvu"),
        (7, " ".join(w.replace("p", "р") + "​" for w in passage)),
        (8, " ".join(filler(30) + edited)),
        (9, None),
        (10, ""),
        (1, " ".join(filler(50) + passage[3:15])),
    ]
    items = [(1, " ".join(passage)), (2, " ".join(short)), (3, " ".join(tiny)), (4, None), (5, " ?! "), (1, " ".join(passage)), (None, "a b c")]
    got = run(spark, docs, items)
    # "р7" with a Cyrillic letter alone before a digit is no mixed run of letters, so document 7 stays foreign
    assert {k for k, r in got.items() if r["is_leak"]} == {(1, 1), (3, 1), (4, 2), (6, 3)}
    assert got[8, 1]["score"] > 0.6 and got[8, 1]["longest_run"] == 6
    assert run(spark, [], items) == {} and run(spark, docs, []) == {}


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    rnd = random.Random(3)
    items = [(i, " ".join(rnd.choice(WORDS) for _ in range(rnd.randrange(3, 40)))) for i in range(40)]
    docs = []
    for d in range(60):
        w = items[rnd.randrange(40)][1].split()
        a = rnd.randrange(len(w))
        docs.append((d, " ".join([rnd.choice(WORDS) for _ in range(20)] + w[a : a + rnd.randrange(5, 30)] + [rnd.choice(WORDS) for _ in range(20)])))
    want = set()
    for d, t in docs:
        w = t.split()
        for i, p in items:
            p = p.split()
            n = min(12, len(p))
            spans = {tuple(p[k : k + n]) for k in range(len(p) - n + 1)}
            if any(tuple(w[k : k + n]) in spans for k in range(len(w) - n + 1)):
                want.add((d, i))
    assert {k for k, r in run(spark, docs, items).items() if r["is_leak"]} == want
    monkeypatch.setattr(leakage, "BLOCK_WORDS", 150)
    assert {k for k, r in run(spark, docs, items).items() if r["is_leak"]} == want


def test_every_edited_copy_is_found(spark):
    """All pairs of half a full match by the plain recurrence: dense edits, short passages, passages that share their words."""
    rnd = random.Random(4)
    few = [f"v{i}" for i in range(60)]
    items = [[rnd.choice(few) for _ in range(rnd.choice([1, 2, 3, 5, 9, 20, 30]))] for _ in range(40)]
    items += [items[5] + [f"t{i}" for i in range(4)], [f"q{i}" for i in range(9)]]
    docs = [["x"] * 5 + [f"q{i}" if i != 4 else "other" for i in range(9)] + ["x"] * 5]
    for _ in range(80):
        copy = []
        for w in items[rnd.randrange(len(items))]:
            copy += rnd.choices([[w], ["new"], [], [w, "new"]], [6, 2, 1, 1])[0]
        docs.append([rnd.choice([*few, "a", "b"]) for _ in range(rnd.randrange(40))] + copy + ["end"] * 5)
    got = run(spark, [(i, " ".join(w)) for i, w in enumerate(docs)], [(i, " ".join(w)) for i, w in enumerate(items)])
    want = {}
    for d, text in enumerate(docs):
        for i, item in enumerate(items):
            best, longest = smith_waterman(item, text)
            if best >= len(item) or longest >= min(12, len(item)):
                want[d, i] = (best / (2 * len(item)), longest)
    assert (0, 41) in want and {k: (r["score"], r["longest_run"]) for k, r in got.items()} == want
