import random

import pytest

from quillmill.llm import chunking as C


def check(text, limit=C.LIMIT, overlap=C.OVERLAP):
    ps = C.pieces(text, limit, overlap)
    assert "".join(text[s:e] for s, e, _, _ in ps) == text
    assert all(e - s + o <= limit for s, e, o, _ in ps) and all(o <= overlap for _, _, o, _ in ps)
    assert ps[0][:1] == (0,) and ps[0][2] == 0
    assert all(s - o >= p[0] for p, (s, _, o, _) in zip(ps, ps[1:]))
    return ps


@pytest.mark.parametrize("seed", range(6))
def test_random_texts(seed):
    r = random.Random(seed)
    text = "".join(r.choice(["word ", "Sentence end. ", "x" * r.randrange(1, 400), "\n", "\n\n", "， 中文。", "é", "👩‍👩‍👧 "]) for _ in range(1500))
    ps = check(text)
    assert len(ps) >= len(text) // C.LIMIT


def test_strong_boundaries_are_kept():
    para = "Some words in a sentence. " * 30
    ps = check((para.strip() + "\n\n") * 8)
    assert {g for _, _, _, g in ps[1:]} == {5}
    assert all(o > 0 for _, _, o, _ in ps[1:])


def test_no_natural_place():
    ps = check("a" * 9000)
    assert all(g == 0 for _, _, _, g in ps[1:]) and len(ps) == 5
    check("é" * 4000)
    check("👩‍👩‍👧" * 900)
    check("á" + "́" * 5000)


def test_few_pieces():
    n = [len(check("word " * k)) for k in (401, 800, 2000)]
    assert n[0] == 2 and n[1] <= 3 and n[2] <= 8


def test_frame(spark):
    rows = [("a", "x" * 2000, 1), ("b", "y " * 1500, 1), ("b", "y " * 1500, 1), ("c", None, 1), ("d", "", 1), (None, "z " * 1500, 1)]
    x = spark.createDataFrame(rows, "block_id string, text string, piece int")
    got = C.split_oversized(x, "block_id", "text").collect()
    assert {r.item_id for r in got} == {"b", None} and sum(r.item_id == "b" for r in got) == 2
    assert C.split_oversized(x.where("false"), "block_id", "text").count() == 0
    with pytest.raises(ValueError):
        C.split_oversized(x, "block_id", "text", 10, 10)
