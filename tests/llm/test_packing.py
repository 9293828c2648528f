import os
import random

import numpy as np
import pytest

from quillmill.llm import packing as P

needs = pytest.mark.skipif(not os.path.exists(P.TOKENIZER), reason="no tokenizer files")


@needs
def test_pattern_is_the_public_one():
    import public_tokenizers

    assert public_tokenizers.PATTERN == P.PATTERN


@needs
def test_counting_by_words_is_exact(sf):
    import pandas as pd

    enc, count = P.encoder(P.TOKENIZER), P.token_counter(P.TOKENIZER)
    texts = pd.read_parquet(f"{sf}/documents.parquet").text.tolist()
    r = random.Random(1)
    texts += ["".join(r.choice(["a", " ", "  ", "\n", "\n\n", " \n", "\t", "12", "Ж", "。", "'s", "!", " ", "é"]) for _ in range(60)) for _ in range(400)] + ["", " ", "\n", "a ", " a", "x" * 50_000]
    for t in texts:
        assert count(t) == len(enc.encode_ordinary(t)), repr(t[:80])


def brute(sizes, cap):
    fills, out = [], []
    for s in sizes:
        n = np.bincount([f for f in fills if 0 < f < cap], minlength=cap + 1)
        best = min(range(cap - s + 1), key=lambda h: (P.cost(n, h, s, cap), -h)) if s < cap else 0
        if best:
            k = max(i for i, f in enumerate(fills) if f == best)
            fills[k] += s
        else:
            fills.append(s)
        out.append(fills[-1] if not best else fills[k])
    return sorted(fills), out


def test_each_placement_minimises_the_sum_of_squares():
    r = random.Random(3)
    sizes = [r.randrange(1, 21) for _ in range(300)]
    got = P.pack_shard(np.array(sizes), 20)
    fills = np.bincount(got, weights=sizes)
    assert fills.max() <= 20 and sorted(fills) == brute(sizes, 20)[0]


def test_frame(spark):
    x = spark.createDataFrame([(1, 5000, "s"), (2, 2048, "s"), (3, 0, "s"), (4, None, "s"), (5, 7, "s"), (5, 7, "s"), (6, 2041, "s")], "item_id long, tokens long, shard string")
    got = P.pack(x.select("item_id", "tokens"), 6).collect()
    assert sorted((r.item_id, r.piece, r.tokens, r.token_start) for r in got) == [(1, 0, 2048, 0), (1, 1, 2048, 2048), (1, 2, 904, 4096), (2, 0, 2048, 0), (5, 0, 7, 0), (6, 0, 2041, 0)]
    fill = {}
    for r in got:
        fill[r.container] = fill.get(r.container, 0) + r.tokens
    assert max(fill.values()) == 2048
    assert P.pack(x.select("item_id", "tokens").where("false"), 0).count() == 0


@needs
def test_null_texts(spark):
    x = spark.createDataFrame([(1, None), (2, ""), (3, "hello world")], "doc_id long, text string")
    assert {r.item_id: r.tokens for r in P.count_tokens(x, "doc_id", "text").collect()} == {1: 0, 2: 0, 3: len(P.encoder(P.TOKENIZER).encode_ordinary("hello world"))}


def test_many_small_items_fill_well():
    r = np.random.default_rng(0)
    sizes = np.minimum(2048, r.lognormal(5.8, 0.7, 20_000).astype(int) + 1)
    n = P.pack_shard(sizes, 2048).max() + 1
    assert sizes.sum() / (n * 2048) > 0.99


def test_two_texts_of_one_id_and_size_are_both_packed(spark):
    x = spark.createDataFrame([(1, "hello world"), (1, "world hello"), (1, "hello world")], "doc_id long, text string")
    got = P.pack(P.count_tokens(x, "doc_id", "text"), 3).collect()
    assert len(got) == 2 and {r.item_id for r in got} == {1}
