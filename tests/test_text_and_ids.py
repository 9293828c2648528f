import hashlib
import json
import unicodedata

import pytest
from pyspark.sql import functions as F

from quillmill.functions import ids, segment
from quillmill.functions import text as T
from quillmill.functions.register import register
from quillmill.operators import normalize


def one(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expr(F.col("v"))).first()[0]


@pytest.mark.parametrize("s", ["  a ", "\t\x1fa\x85", None, "", "   "])
def test_strip_is_that_of_python(spark, s):
    assert one(spark, T.strip, s) == (None if s is None else s.strip())


@pytest.mark.parametrize("s", ["é", "plain", None, "각", "ﬁ"])
def test_nfc_and_casefold(spark, s):
    assert one(spark, T.nfc, s) == (None if s is None else unicodedata.normalize("NFC", s))
    assert one(spark, T.casefold, s) == (None if s is None else s.casefold())


def test_dehyphenation_keeps_protected_tokens():
    assert normalize.dehyphenate("inter-\nnational") == ("international", 1)
    assert normalize.dehyphenate("see https://a.example/x-\ny now") == ("see https://a.example/x-\ny now", 0)
    assert normalize.dehyphenate("a-\nb c-\nd") == ("ab cd", 2)


def test_normalisation_modes(spark):
    x = spark.createDataFrame(
        [("PARAGRAPH", None, "a\r\n b ­c\x07"), ("PARAGRAPH", "OCR_TEXT", "a\n\n\n\nb "), ("CODE_BLOCK", None, "  x\t\ty\r"), ("OTHER", None, None), ("LIST", None, "")],
        "element_type string, element_role string, original_text string",
    )
    got = {(r.element_type, r.element_role): (r.n_text, r.n_controls, r.n_joins) for r in normalize.normalized(x).collect()}
    assert got == {("PARAGRAPH", None): ("a b c", 1, 1), ("PARAGRAPH", "OCR_TEXT"): ("a\n\nb", 0, 0), ("CODE_BLOCK", None): ("  x\t\ty\n", 0, 0), ("OTHER", None): (None, 0, 0), ("LIST", None): ("", 0, 0)}


def test_hyphen_evidence(spark):
    x = spark.createDataFrame([("PARAGRAPH", "OCR_TEXT", "inter-\nnational text", True)], "element_type string, element_role string, original_text string, ev boolean")
    r = normalize.normalized(x, hyphen_evidence=F.col("ev")).first()
    assert (r.n_text, r.n_dehyphenated) == ("international text", 1)


def test_similarity(spark):
    x = spark.createDataFrame([("a b c", "a b c"), ("a b c d", "b c"), ("a b c", "b c d"), ("", "a")], "a string, b string")
    assert [r[0] for r in x.select(T.similarity(F.col("a"), F.col("b"))).collect()] == [1.0, 1.0, 0.5, 0.0]


def test_canonical_json_and_hashes(spark):
    assert ids.canonical_json({"b": 1, "a": "é", "c": None}) == '{"a":"é","b":1,"c":null}'
    block = {"block_id": "b", "block_type": 3, "text": "t", "order_index": 0}
    want = '[{"block_id":"b","block_type":3,"metadata":{},"order_index":0,"parent_block_id":"","source_links":[],"source_location":{},"text":"t"}]'
    assert ids.batch_hash([block]) == hashlib.sha256(want.encode()).hexdigest()
    with pytest.raises(ValueError):
        ids.batch_hash([])
    with pytest.raises(ValueError):
        ids.canonical_block({**block, "source_location": {"page_start": -1}})
    assert one(spark, ids.canonical_json_of, '{"b": 1, "a": [1.5]}') == '{"a":[1.5],"b":1}'
    assert one(spark, ids.canonical_json_of, "{") is None
    h = "A" * 64
    assert one(spark, ids.normalise_sha256, f" sha256:{h} ") == h.lower()
    assert one(spark, ids.normalise_sha256, f"SHA256:{h}") is None


def test_backoff_is_bounded_and_repeatable(spark):
    def py(job, gen, n):
        raw = min(900, 5 * 2 ** max(n - 1, 0))
        u = int.from_bytes(hashlib.sha256(f"{job}:{gen}:{n}".encode()).digest()[:8], "big") / float(2**64 - 1)
        return max(0, min(900, int(round(raw * (1 + (u * 2 - 1) * 0.2)))))

    x = spark.createDataFrame([(f"j{i}", i % 4, i % 12) for i in range(60)], "j string, g long, n int")
    got = x.select("*", ids.backoff_seconds(F.col("j"), F.col("g"), F.col("n")).alias("s")).collect()
    assert all(r.s == py(r.j, r.g, r.n) for r in got)


CASES = [
    ("en", "Dr. Smith left. He came back.", 2), ("en", "See e.g. Fig. 3 here. Done.", 2), ("ru", "Он жил в 1990 г. Потом уехал.", 1), ("ru", "Яблоки и т.д. Груши.", 1), ("en", "Wait... what? No.", 2),
    ("en", "He said \"Stop!\" and left. Then.", 2), ("ja", "「はい。」と言った。次。", 2), ("zh", "你好。再见！", 2), ("el", "Τι κάνεις; Καλά.", 2), ("en", "Version 1.2.3 is out. Use a.b.c() now.", 2),
    ("en", "one\n\ntwo", 2), ("hi", "यह है। वह है।", 2), (None, "   ", 0), ("de", "Es gilt z.B. Art. 3 hier. Ende.", 2),
]


@pytest.mark.parametrize(("hint", "s", "n"), CASES)
def test_sentences_by_hint(hint, s, n):
    got = segment.sentences(s, hint)
    assert len(got) == n, got
    assert len(segment.boundary_offsets(s, got)) == max(0, n - 1)


def test_words():
    assert segment.words("one two, 10.152.3.4 l'eau") == (3, True)
    assert segment.words("漢字")[1] is False and segment.words(None) == (0, True)
    with pytest.raises(ValueError, match="SPLITTER_ICU_UNAVAILABLE"):
        segment.sentences("a", backend="icu")


def test_registered_functions(spark):
    register(spark)
    r = spark.sql("select split_sentences('One two. Three four.', 'en') s, count_words('a b').words w, size(grapheme_clusters('éx')) g, match_key('A, b!') k, nfc('é') n").first()
    assert (list(r.s), r.w, r.g, r.k, r.n) == (["One two.", "Three four."], 2, 2, "a b", "é")
    assert json.loads(spark.sql("""select canonical_json('{"b":2,"a":1}')""").first()[0]) == {"a": 1, "b": 2}
