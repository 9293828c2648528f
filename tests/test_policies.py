"""Small decisions as expressions: recognition, quality, ranges, immutable objects, links."""

import pytest
from pyspark.sql import functions as F

from quillmill.operators import artifacts, checks, normalize, parse, recognition


def say(spark, schema, rows, column):
    return [r[0] for r in spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], f"{schema}, at int").orderBy("at").select(column).collect()]


def test_candidate_decision(spark):
    rows = [
        ("AUTO", "PAGE", "NATIVE_TEXT", "other", "GOOD"), ("AUTO", "PAGE", "NATIVE_TEXT", "low_native_text", "GOOD"), ("FORCE", "PAGE", "NATIVE_TEXT", "other", "GOOD"), ("AUTO", "LINE", "MIXED", None, "GOOD"),
        ("DISABLED", "EMBEDDED_IMAGE", "MIXED", None, "GOOD"), ("DISABLED", "PAGE", "SCANNED_IMAGE", None, "OCR_REQUIRED"), ("AUTO", "REGION", None, None, None), ("AUTO", None, None, None, None),
    ]
    c = recognition.candidate_decision(*[F.col(x) for x in ("mode", "scope", "page_mode", "reason", "quality")])
    assert say(spark, "mode string, scope string, page_mode string, reason string, quality string", rows, c) == ["NOT_REQUIRED", "REQUIRED", "REQUIRED", "INVALID_SCOPE", "NOT_REQUIRED", "REQUIRED_BUT_DISABLED", "REQUIRED", "INVALID_SCOPE"]


def test_by_confidence(spark):
    x = spark.createDataFrame([("a", 0.9), ("b", 0.59), ("c", 0.29), ("d", 1.1), (" ", 0.9), (None, 0.9), ("e", None), ("f", 0.3), ("g", 0.6)], "text string, confidence double")
    got = {r.text: r.status for r in recognition.by_confidence(x).collect()}
    assert got == {"a": "ACCEPTED", "b": "LOW_CONFIDENCE", "f": "LOW_CONFIDENCE", "g": "ACCEPTED"}


def test_unit_geometry(spark):
    box = "g struct<x0:double,y0:double,x1:double,y1:double,coordinate_space:string>, w double, h double"
    c = recognition.unit_geometry(F.col("g"), F.col("w"), F.col("h"))
    got = say(spark, box, [((50.0, -20.0, 150.0, 100.0, "pixels"), 100.0, 200.0), ((0.5, 0.2, 1.5, 1.0, "normalized-0-1"), 100.0, 200.0)], c)
    assert [tuple(r)[:4] for r in got] == [(0.5, 0.0, 1.0, 0.5), (0.5, 0.2, 1.0, 1.0)] and {r.coordinate_space for r in got} == {"normalized-0-1"}


def test_final_status(spark):
    c = recognition.final_status(F.col("n"), F.col("u"), F.col("a"))
    assert say(spark, "n int, u int, a int", [(0, 0, 0), (2, 1, 1), (2, 0, 1), (2, 0, 0)], c) == ["NOT_REQUIRED", "PARTIAL", "COMPLETED", "NO_TEXT"]


def test_settled_quality(spark):
    rows = [("OCR_REQUIRED", 90, ["NATIVE_TEXT"], []), ("OCR_REQUIRED", 90, ["MIXED", "SCANNED_IMAGE"], []), ("OCR_REQUIRED", 0, ["NATIVE_TEXT"], []), ("GOOD", 9, [], ["RTF_STRUCTURE_PARTIAL"]), ("GOOD", 9, [], ["OTHER"])]
    c = parse.settled_quality(F.col("s"), F.col("n"), F.col("m"), F.col("w"))
    assert say(spark, "s string, n int, m array<string>, w array<string>", rows, c) == ["GOOD", "OCR_REQUIRED", "OCR_REQUIRED", "PARTIAL", "GOOD"]


def test_ranges(spark):
    rows = [("0",), ("-1",), ("4294967295",), ("4294967296",), ("18446744073709551615",), ("18446744073709551616",), ("x",), (None,)]
    n = F.expr("try_cast(v as decimal(38,0))")
    assert say(spark, "v string", rows, checks.in_range(n, checks.UINT32)) == [True, False, True, False, False, False, False, False]
    assert say(spark, "v string", rows, checks.in_range(n, checks.UINT64))[4:6] == [True, False]
    assert say(spark, "v string", rows, checks.in_range(n, checks.UINT32, 1))[0] is False


@pytest.mark.parametrize(
    ("url", "code"),
    [
        ("https://a.example/b?x=1", None), ("https://u:p@a.example/", "LINK_USERINFO"), ("https://a.example/?Bearer=1", "LINK_SECRET_PARAMETER"), ("https://a.example/?x-api-key=1", "LINK_SECRET_PARAMETER"),
        ("https://a.example/?y=1&X_Amz.Credential=1", "LINK_SECRET_PARAMETER"), ("https://a.example/?key=1&sig=2&pwd=3", None), ("https://a.example/?my_token=1", "LINK_SECRET_PARAMETER"), ("https://a.example/?h=Bearer%20abc", "LINK_BEARER_VALUE"),
        ("https://a.example/?h=+bearer+abc", "LINK_BEARER_VALUE"), ("https://a.example/?acc%65ss_token=", "LINK_SECRET_PARAMETER"), ("https://a.example/token=1", None), ("", None), (None, None),
    ],
)
def test_links(spark, url, code):
    assert say(spark, "u string", [(url,)], checks.link_credentials(F.col("u"))) == [code]


def test_immutable_put():
    assert [artifacts.put_decision(*x) for x in ((False, False), (True, True), (True, False))] == ["WRITE", "UNCHANGED", "CONFLICT"]


@pytest.mark.parametrize(
    ("text", "want", "n"),
    [
        ("regis-\nter", "register", 1), ("a-\nb c-\nd", "ab cd", 2), ("see https://a.example/x-\ny z-\nw", "see https://a.example/x-\ny zw", 1), ("first-\nname@a.example", "firstname@a.example", 1), ("x -\n y", "x -\n y", 0), ("", "", 0), ("no-\n", "no-\n", 0),
    ],
)
def test_dehyphenation_leaves_tokens_that_hold_the_hyphen(text, want, n):
    assert normalize.dehyphenate(text) == (want, n)


@pytest.mark.parametrize(
    ("name", "token"),
    [("link", "http://a.example/b?c"), ("mail", "a.b+c@d-e.example"), ("address", "10.0.0.1"), ("uuid", "3f2504e0-4f89-11d3-9a0c-0305e82c3301"), ("version", "v1.2.3"), ("digest", "0123456789abcdef" * 2), ("year", "2024"), ("dotted name", "a_b.$c.run()")],
)
def test_kept_tokens(name, token):
    import regex

    assert regex.fullmatch(normalize.KEPT_TOKENS[name], token) and not regex.fullmatch(normalize.KEPT_TOKENS[name], "register")


def test_grids(spark):
    rows = [([["a\u00a0 b", None], None, [], ["e\u0301", "x\x07\n\n\n y "]],), ([],), (None,)]
    got = say(spark, "g array<array<string>>", rows, normalize.normalized_grid(F.col("g")))
    assert (got[0].rows, got[0].row_count, got[0].column_count, got[0].invalid) == ([["a b", ""], [], ["\u00e9", "x\n\ny"]], 3, 2, 1)
    assert (got[1].rows, got[1].row_count, got[1].column_count, got[1].invalid) == ([], 0, 0, 0) and got[2] is None
