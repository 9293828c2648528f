import pytest

from quillmill.llm import lookalike as K

R = K.universal(False)
SAME = [
    ("file", "ﬁle"), ("Abc1", "Ａｂｃ１"), ("café", "café"), ("a b", "a b"), ("a b", "a b"), ("ab", "a​b"), ("ab", "a­b"), ("сос", "coc"), ("Віддiл", "Вiдділ"), ("ё", "ë"), ("й", "й"),
    ("がく", "がく"), ("ガ", "ｶﾞ"), ("لا", "ﻻ"), ("小", "⼩"), ("각", "각"), ("a\nb", "a\r\nb"), ("όχι", "óχι"),
]
OTHER = [("Abc", "abc"), ("cafe", "café"), ("x2", "x²"), ("a b", "a\nb"), ("10", "1O"), ("word", "ward"), ("0l", "01"), ("", "a"), ("a b", "a  b")]


@pytest.mark.parametrize(("a", "b"), SAME)
def test_same_look(a, b):
    assert R(a) == R(b)


@pytest.mark.parametrize(("a", "b"), OTHER)
def test_visible_differences_stay(a, b):
    assert R(a) != R(b)


def test_letters_of_other_scripts():
    for a, b in (("ᎪᏢᏢ", "APP"), ("ⲞK", "OK"), ("հօս", "hou"), ("Ꭺ", "А")):
        assert R(a) == R(b)
    for group in " ".join(K.SAME_SHAPE_ELSEWHERE.values()).split():
        assert len(group) == 2 and group[0].isascii() and group[0].isupper() == group[1].isupper() or "CHEROKEE" in __import__("unicodedata").name(group[1])


def test_null_and_rewriting_again():
    assert R(None) is None and R("") == ""
    for a, b in SAME:
        assert R(R(b)) == R(b)


def test_representative_is_the_most_frequent():
    t = K.look_alikes({"a": 5, "а": 90, " ": 100, " ": 1})
    assert t["a"] == "а" and t[" "] == " " and "а" not in t


def test_pairs(spark):
    rows = [("1", "a b"), ("2", "a b"), ("3", "a b"), ("4", "other"), ("5", "other"), ("6", None), ("7", "​"), ("8", ""), (None, "a b"), ("2", "a b"), ("9", "x" * 100_000), ("A", "x" * 99_999 + "х")]
    x = spark.createDataFrame([(i, t, "c") for i, t in rows], "source_element_id string, original_text string, look string")
    table = K.learn(x, "original_text")
    got = {tuple(r) for r in K.pairs_of(K.looks(x, "source_element_id", "original_text", table)).collect()}
    assert got == {("1", "2"), ("2", "3"), ("9", "A")}
    n = {r[0]: r[1] for r in K.normalised(x, "source_element_id", ["original_text"], table).collect()}
    assert n["1"] == n["2"] and n["6"] is None and n["7"] == n["8"] == ""


def test_empty(spark):
    x = spark.createDataFrame([], "source_element_id string, original_text string")
    table = K.learn(x, "original_text")
    assert K.pairs_of(K.looks(x, "source_element_id", "original_text", table)).count() == 0


def test_classes_say_what_pairs_say(spark):
    from collections import Counter

    from pyspark.sql import functions as F

    forms = ["one two", "one\u00a0two", "one  two", "оne two", "three", "three", "thr\u200bee", "four", None, ""]
    x = spark.createDataFrame([(f"e{i:02}", forms[i % len(forms)], "z") for i in range(40)], "source_element_id string, original_text string, look string")
    looks = K.looks(x, "source_element_id", "original_text", K.learn(x, "original_text"))
    pairs = [tuple(r) for r in K.pairs_of(looks).collect()]
    got = K.classes_of(looks).collect()
    assert {r.id: r.links for r in got} == Counter(e for p in pairs for e in p) and pairs
    cls = {r.id: r.class_id for r in got}
    assert all(cls[a] == cls[b] for a, b in pairs) and len(set(cls.values())) == 2
    assert K.classes_of(looks.where(F.lit(False))).count() == 0
