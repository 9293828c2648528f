import random

import pytest

from quillmill.llm import langid as L

LEX = {
    "en": "the register keeps signed originals before every nightly run and our desk forwards them to the owner".split(),
    "de": "die Registratur verwahrt alle unterschriebenen Originale vor dem nächtlichen Lauf und übergibt sie dem Eigentümer".split(),
    "ru": "реестр хранит подписанные оригиналы перед ночным запуском и передаёт сводку владельцу по запросу службы".split(),
    "kk": "шарттар тізілімі қол қойылған түпнұсқаларды сақтайды және әрбір филиал қорытындыны иесіне жібереді".split(),
}


def say(r, lang, n=9):
    w = [r.choice(LEX[lang]) for _ in range(n)]
    return " ".join([w[0].capitalize(), *w[1:]]) + "."


@pytest.fixture(scope="module")
def model():
    r = random.Random(0)
    texts, labels = [], []
    for i in range(800):
        lang = r.choice(list(LEX))
        texts.append(L.words(say(r, lang)))
        labels.append(lang if i % 8 else r.choice(list(LEX)))  # an eighth of the labels is noise
    return L.fit(texts, labels)


def test_held_out_accuracy(model):
    r = random.Random(1)
    cases = [(lang, L.words(say(r, lang))) for lang in LEX for _ in range(100)]
    p, _ = model.scorer().probabilities([w for _, w in cases])
    right = [model.langs[i] == lang for (lang, _), i in zip(cases, p.argmax(1))]
    assert sum(right) / len(right) > 0.98


@pytest.mark.parametrize(("hint", "want"), [("EN", "en"), ("en-GB", "en"), ("ru_KZ", "ru"), ("Kazakh", "kk"), ("kaz", "kk"), ("und", None), ("", None), (None, None), ("??", None), ("unknown", None), (" de ", "de")])
def test_hints(spark, hint, want):
    from pyspark.sql import functions as F

    assert L.hint_language(hint) == want
    assert spark.createDataFrame([(hint,)], "h string").select(L.hint_column(F.col("h"))).first()[0] == want


@pytest.mark.parametrize(("text", "want"), [("12", True), ("S. 11", True), ("Page 3 of 9", True), ("xiv-бет / 19", True), ("xx-бет", True), ("– xii –", True), ("AX-1234", True), ("стр. 9", True), ("Delivery terms", False), ("2 인도 조건", False), ("1.1 Saklama süreleri", False), ("", True)])
def test_wordless(text, want):
    assert L.wordless(text) is want


def test_segments(spark, model):
    r = random.Random(2)
    en, ru = say(r, "en"), say(r, "ru")
    rows = [("1", f"{en} {ru}", "x"), ("2", en, "x"), ("3", None, "x"), ("4", " ", "x"), ("5", "123", "x"), ("6", f"{ru} {say(r, 'ru')} {ru}", "x"), (None, en, "x"), ("2", en, "x"), ("7", " ".join(say(r, "de") for _ in range(3000)), "x")]
    x = spark.createDataFrame(rows, "source_element_id string, normalized_text string, lang string")
    got = L.segments(x, "source_element_id", "normalized_text", None, model).distinct().orderBy("id", "segment").collect()
    assert [(s.id, s.lang) for s in got] == [(None, "en"), ("1", "en"), ("1", "ru"), ("2", "en"), ("6", "ru"), ("7", "de")]
    a = [s for s in got if s.id == "1"]
    assert rows[0][1][a[0].start : a[0].end] == en and rows[0][1][a[1].start : a[1].end] == ru and all(0 < s.confidence <= 1 for s in got)


def test_without_labels(spark):
    x = spark.createDataFrame([("1", "some words here", None)], "k string, t string, h string")
    m = L.train(x, "k", "t", "h")
    assert [r.lang for r in L.segments(x, "k", "t", "h", m).collect()] == ["und"]
    assert L.segments(x.where("false"), "k", "t", "h", m).count() == 0


@pytest.mark.parametrize(("word", "want"), [("register", 1), ("审计", 1), ("审计小组逐行比较两个版本", 6), ("受付窓口は", 2.5), ("реестр", 1)])
def test_evidence_of_scripts_without_blanks(word, want):
    assert L.evidence(word) == want


def test_short_dense_sentences_make_a_second_language():
    r = random.Random(3)
    zh = ["审计小组逐行比较两个版本。", "收件窗口标出缺少的附件。", "登记小组保存已签字的原件。", "档案室检查收到的文件。"]
    texts = [(say(r, "ru"), "ru") if i % 2 else (r.choice(zh), "zh") for i in range(400)]
    m = L.fit([L.words(t) for t, _ in texts], [lang for _, lang in texts])
    ru = "Реестр хранит подписанные оригиналы перед ночным запуском."
    got = L.label(["1", "2"], [f"{ru} {zh[0]} {zh[1]}", f"{ru} 审计。"], m.scorer(), 3)
    assert [x[:5] for x in got] == [("1", 0, 0, len(ru), "ru"), ("1", 1, len(ru) + 1, len(ru) + 2 + len(zh[0]) + len(zh[1]), "zh"), ("2", 0, 0, len(ru) + 4, "ru")]


@pytest.mark.parametrize("rows", [100, 10**6, 10**9, 10**12])
def test_the_sample_keeps_its_size(spark, rows):
    """The share of a simulated count, applied to the hashes of as many keys as give 500 expected rows."""
    from pyspark.sql import functions as F

    share = L.shares({"en": rows, "de": 10}, 1400)
    assert share["de"] == 1.0 and share["en"] * min(rows, 700 / share["en"]) == pytest.approx(min(rows, 700))
    # Hashes below the share, as a fraction of the keys, for a share as small as the one for a million rows.
    if rows == 10**6:
        n = spark.range(10**6).where(L.sampled(F.col("id").cast("string"), F.lit("en"), share)).count()
        assert 600 < n < 800
    # The threshold is told apart from zero and from its neighbours in 62 bits of hash.
    assert int(share["en"] * (1 << 62)) > 1 << 30


def test_training_words_come_from_anywhere_in_the_text():
    ws = [f"{a}{b}{c}" for a in "abcd" for b in "efghi" for c in "jklmno"]
    starts = []
    for k in range(200):
        got = L.drawn(" ".join([*ws[k % 7 :], *ws[: k % 7], f"x{k}".translate(str.maketrans("0123456789", "abcdefghij"))]))
        assert len(got) == L.TRAIN_WORDS
        starts.append(got[0])
    assert len(set(starts)) > 40
    assert L.drawn("one two") == ["one", "two"] and L.drawn("") == []


def test_train_on_a_table(spark):
    r = random.Random(3)
    rows = [(str(i), say(r, lang := r.choice(list(LEX))), lang) for i in range(600)]
    rows += [rows[0], ("x", None, "en"), (None, say(r, "en"), "en"), ("y", " ", "en"), ("z", say(r, "de"), None)]
    x = spark.createDataFrame(rows, "k string, t string, lang string")
    m = L.train(x, "k", "t", "lang")
    p, _ = m.scorer().probabilities([L.words(say(r, k)) for k in m.langs])
    assert sorted(m.langs) == sorted(LEX) and list(p.argmax(1)) == [0, 1, 2, 3]
    assert L.train(x.where("false"), "k", "t", "lang").langs == ["und"] and L.train(x.where("k = 'x'"), "k", "t", "lang").langs == ["und"]
