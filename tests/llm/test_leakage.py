import random

import numpy as np
import pytest

from quillmill.llm import leakage as L

WORDS = [f"w{i}" for i in range(40)]


def brute(docs, items, n):
    out = set()
    for d, t in docs:
        w = L.plain_words(t)
        grams = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
        for k, x in items:
            v = L.plain_words(x)
            if any(tuple(v[i : i + n]) in grams for i in range(len(v) - n + 1)):
                out.add((d, k))
    return out


def test_index_finds_all_occurrences():
    r = np.random.default_rng(0)
    t = r.integers(1, 5, 3000)
    index = L.FMIndex.of(t)
    pat = np.array([t[i : i + 6] for i in range(0, 2900, 37)] + [[4, 4, 4, 4, 4, 9]])
    lo, hi = index.search(pat)
    for p, a, b in zip(pat, lo, hi):
        want = [i for i in range(len(t) - 5) if (t[i : i + 6] == p).all()]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


@pytest.mark.parametrize("kind", ["random", "periodic", "equal"])
def test_suffix_array(kind):
    r = np.random.default_rng(1)
    t = {"random": r.integers(1, 4, 700), "periodic": np.tile([1, 2, 3, 1, 2], 100), "equal": np.ones(300, dtype=int)}[kind]
    t = np.append(t, 0)
    assert L.suffix_array(t).tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())


def test_an_index_serves_other_items(spark):
    """Small shards, a text longer than a shard, copies; the second set of items is searched in the written index."""
    r = random.Random(6)
    docs = [(d, " ".join(r.choice(WORDS[:6]) for _ in range(r.randrange(1, 50)))) for d in range(60)] + [(100, " ".join(WORDS * 10)), (101, " ".join(WORDS * 10)), (None, " ".join(WORDS))]
    x = spark.createDataFrame(docs, "doc_id long, text string")
    index = L.build(x, shard_symbols=100).cache()
    assert index.count() > 10
    for seed in (1, 2):
        r = random.Random(seed)
        items = [(k, " ".join(r.choice(WORDS[:6]) for _ in range(9))) for k in range(40)] + [(77, " ".join(WORDS[3:20]))]
        y = spark.createDataFrame(items, "item_id long, item_text string")
        got = {(a.doc_id, a.item_id) for a in L.search(index, y, 4, block_chars=300).collect()}
        assert got == brute(docs, items, 4) and {(100, 77), (101, 77), (None, 77)} <= got


def test_against_brute_force(spark):
    r = random.Random(5)
    items = [(k, " ".join(r.choice(WORDS) for _ in range(r.randrange(3, 40)))) for k in range(30)]
    docs = []
    for d in range(120):
        w = [r.choice([*WORDS, "zz"]) for _ in range(r.randrange(0, 60))]
        if r.random() < 0.6:
            v = r.choice(items)[1].split()
            a = r.randrange(len(v))
            w += v[a : a + r.randrange(5, 20)]
        docs.append((d, " ".join(w)))
    docs += [(500, None), (501, ""), (502, docs[0][1]), (503, docs[3][1])]
    items += [(90, None), (91, "too short"), (92, items[0][1])]
    x = spark.createDataFrame([(d, t, "e") for d, t in docs], "doc_id long, text string, item_id string")
    y = spark.createDataFrame(items, "item_id long, item_text string")
    got = {(a.doc_id, a.item_id) for a in L.leaks(x, y, 6).collect()}
    assert got == brute([d for d in docs if d[1]], [i for i in items if i[1]], 6) and got


def test_forms_that_look_alike(spark):
    item = "One Two three four five six seven eight nine ten eleven twelve thirteen"
    docs = [
        (1, "x ONE, two; three\nfour five six — seven eight nine ten eleven twelve."), (2, "Оne twо three four five six seven eight nine ten еleven twelve"),
        (3, "One Two three four five six changed eight nine ten eleven twelve thirteen"), (4, "two​ three four “five” six seven eight nine ten eleven twelve thirteen"),
    ]
    x = spark.createDataFrame(docs, "doc_id long, text string")
    hits = L.leaks(x, spark.createDataFrame([(7, item)], "item_id long, item_text string"))
    assert {r.doc_id for r in hits.collect()} == {1, 2, 4}
    spans = {r.doc_id: docs[r.doc_id - 1][1][r.start : r.end] for r in L.removal_spans(x, hits).collect()}
    assert spans[1] == "ONE, two; three\nfour five six — seven eight nine ten eleven twelve." and spans[4].startswith("two")


def test_empty(spark):
    x = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    y = spark.createDataFrame([], "item_id long, item_text string")
    assert L.leaks(x, y).count() == 0 and L.leaks(x.where("false"), y).count() == 0
