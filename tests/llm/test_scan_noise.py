import random

import pytest
from pyspark.sql import functions as F

from quillmill.llm import scan_noise as N

VOCAB = {w: 500 for w in "the register keeps signed originals incoming files before nightly run line-by-line контрольную сумму each page жолма-жол".split()}


def counts(spark, frequent, scanned=(), plain=(), joined=None):
    """Words of the corpus: `frequent` with their counts, `scanned` once in scanned text, `plain` once elsewhere."""
    rows = [(w, n, 0, 0) for w, n in frequent.items()] + [(w, 1, 1, (joined or {}).get(w, 0)) for w in scanned] + [(w, 1, 0, 0) for w in plain]
    return spark.createDataFrame(rows, "word string, n long, scanned long, joined long").groupBy("word").agg(*[F.sum(c).alias(c) for c in ("n", "scanned", "joined")])


def intended(spark, frequent, raws):
    """Of each token the word it was misread from, or nothing."""
    own = {raw: N.forms(raw) for raw in raws}
    c = counts(spark, frequent, [N.token(f) for raw in raws for f in own[raw][-1:] if N.token(f) not in frequent])
    found = {r.form: r.intended for r in N.misreadings(c, N.MISREAD).collect()}
    return {raw: next((found[f] for f in own[raw] if f in found), "") for raw in raws}


def test_misread(spark):
    want = {"inc0ming": "incoming", "fi1es,": "files", "rcgisfer": "register", "коптрольную": "контрольную", "incoming": "", "Zalquin": "", "AX-1234": "", "10.2.3.4": "", "run": "", "signecl": "signed"}
    assert intended(spark, VOCAB, want) == want


def test_misread_against_all_pairs(spark):
    r = random.Random(5)
    words = ["".join(r.choice("oeclitnmrdhu") for _ in range(r.randrange(3, 8))) for _ in range(300)]
    frequent = {w: r.choice((3, 20, 500)) for w in words[:60]}
    rare = [w for w in dict.fromkeys(words[60:]) if w not in frequent]
    got = {x.form: x.intended for x in N.misreadings(counts(spark, frequent, rare), N.MISREAD).collect()}
    want = {}
    for w in rare:
        best = min(((k, -n, v) for v, n in frequent.items() if n >= N.RATIO and (k := brute_steps(w, v))), default=None)
        if best:
            want[w] = best[2]
    assert got == want and want


def brute_steps(read, whole):
    """Confusions undone at all places side by side, with an unchanged character as a part of its own."""
    todo, k = {(0, 0, 0)}, None
    while todo:
        i, j, n = todo.pop()
        if (i, j) == (len(read), len(whole)):
            k = n if k is None else min(k, n)
            continue
        if i < len(read) and j < len(whole) and read[i] == whole[j]:
            todo.add((i + 1, j + 1, n))
        if n < 2:
            todo |= {(i + len(r), j + len(w), n + 1) for w, r in N.MISREAD if read.startswith(r, i) and whole.startswith(w, j)}
    return k


def test_verdicts_do_not_change_when_the_corpus_grows(spark):
    """'com' 20 times beside 'corn' 30 times is a word of its own, 'rcgister' once isn't; 1,000 times as many other words
    change nothing. The same goes for a hyphened word."""
    for other in (1, 1_000_000_000):
        c = counts(spark, {"corn": 30, "register": 40, "filler": other, "well-known": 6, "known": 9})
        c = c.unionByName(spark.createDataFrame([("com", 20, 20, 0), ("rcgister", 1, 1, 0), ("wellknown", 3, 3, 3)], c.schema))
        assert {tuple(r) for r in N.misreadings(c, N.MISREAD).collect()} == {("rcgister", "register")}
        s = spark.createDataFrame([("split", [N.split_form("Well", "-", "known"), N.split_form("reg", "-", "ister")])], "what string, forms array<string>")
        assert [r.form for r in N.broken_forms(s, c).collect()] == ["reg - ister"]


def test_what_stands_in_other_text_is_no_misreading(spark):
    c = counts(spark, {"торцал": 500}, ["тордал"])
    assert N.misreadings(c, N.MISREAD).count() == 1
    assert N.misreadings(counts(spark, {"торцал": 500}, ["тордал"], ["тордал"]), N.MISREAD).count() == 0


@pytest.mark.parametrize(("text", "n"), [("regis-\nter", 1), ("regis¬\nter", 1), ("AX-\n1234", 0), ("Knowing-\nNothing", 0), ("line-by-\nline", 1), ("regis-ter", 0), ("", 0)])
def test_breaks(text, n):
    assert len(list(N.breaks(text))) == n


def test_broken(spark):
    c = counts(spark, {"жолма-жол": 500, "line-by-line": 500, "register": 500}, joined={})
    s = spark.createDataFrame([("split", list(N.breaks("жолма-\nжол by-\nline regis-\nter жолма¬\nжол")))], "what string, forms array<string>")
    assert {r.form for r in N.broken_forms(s, c).collect()} == {"by - line", "regis - ter", "жолма ¬ жол"}


@pytest.mark.parametrize(("line", "want"), [("- 42 -", True), ("Page 3 of 9", True), ("9-бет / 12", True), ("[xii]", True), ("Rules of the depot, issue 61   – 41 –", True), ("Rules of the depot, issue 61", False), ("Annex 12 of the file", False), ("7", True), ("", False)])
def test_page_numbers(line, want):
    assert (N.page_value(line) is not None) is want


def test_page_values():
    assert [N.page_value(x) for x in ("- 42 -", "17", "[xii]", "Page 3 of 9", "Rules, issue 61   – 41 –")] == [(42, True), (17, False), (12, True), (3, True), (41, True)]


SCHEMA = "source_element_id string, document_id string, document_version long, element_type string, element_role string, geometry struct<page_number:int,y0:double,page_height:double>, original_text string, id string, line int"


def table(spark):
    body = "the register keeps signed originals before each nightly run"
    rows = [("h", "HEADING", None, (1, 100.0, 800.0), "Rules of Pelcor")]
    for p, first in enumerate(("incoming", "files", "each", "page"), 1):
        rows += [(f"t{p}", "PARAGRAPH", None, (p, 20.0, 800.0), "Rules of Pelcor" if p % 2 else "Chapter four"), (f"b{p}", "PARAGRAPH", "OCR_TEXT", (p, 90.0, 800.0), f"{first} {body}\n{first} {first} {body}"), (f"f{p}", "OTHER", None, (p, 780.0, 800.0), f"- {p} -")]
    rows += [
        ("x1", "PARAGRAPH", "OCR_TEXT", (5, 90.0, 800.0), f"Rules of Pelcor   12\n{body} of the inc0ming regis-\nter"), ("x2", "PARAGRAPH", None, (5, 300.0, 800.0), "17"), ("n1", "PARAGRAPH", "OCR_TEXT", None, None),
        ("n2", "PARAGRAPH", "OCR_TEXT", (9, None, None), ""), ("v", "PARAGRAPH", "OCR_TEXT", (9, 90.0, 800.0), " ".join(["incoming register"] * 3000)), ("c", "CODE_BLOCK", None, (1, 20.0, 800.0), "- 3 -"),
    ]
    rows += rows[-6:-5]
    return spark.createDataFrame([(i, "d", 1, k, r, g, t, "q", 1) for i, k, r, g, t in rows], SCHEMA)


def test_noise(spark):
    got = {tuple(r) for r in N.noise(table(spark)).collect()}
    assert got == {
        *((f"t{p}", "running_header") for p in range(1, 5)), *((f"f{p}", "page_number") for p in range(1, 5)), ("x1", "running_header"), ("x1", "page_number"), ("x1", "misread"), ("x1", "split_word"),
    }


def test_paragraphs(spark):
    r = {x.id: x for x in N.paragraphs(table(spark)).collect()}
    assert r["x1"].paragraph == "the register keeps signed originals before each nightly run of the incoming register"
    assert (r["x1"].dehyphenations, r["x1"].corrections, r["x1"].furniture_lines) == (1, 1, 1)
    assert r["t1"].paragraph == "" and r["c"].paragraph == "- 3 -" and r["h"].paragraph == "Rules of Pelcor" and r["n2"].paragraph == "" and "n1" not in r


def test_empty(spark):
    assert N.noise(table(spark).where("false")).count() == 0
    assert N.paragraphs(table(spark).where("false")).count() == 0


KAZAKH = {w: 500 for w in "инженер бақылау сақтайды кезеңі беттің сақтайтын".split()}


def test_letters_read_as_two_characters(spark):
    want = {"инзкенер": "инженер", "бак,ылау": "бақылау", "Сак,тайды.": "сақтайды", "кезен,і": "кезеңі", "беттін,": "беттің", "сақтайтын,": "", "бақылау,": ""}
    assert intended(spark, KAZAKH, want) == want


def test_comma_of_a_letter_goes_with_it():
    words = {"беттін,": "беттің", "бак,ылау": "бақылау"}
    assert N.repaired("Беттін, бак,ылау, сақтайтын, беттің,", "PARAGRAPH", True, (), words)[0] == "Беттің бақылау, сақтайтын, беттің,"


def test_unlisted_confusions(spark):
    """'ķ' for 'h' is in no list. It is learned from scanned words; 'x' for 't' also stands in other text."""
    frequent = "register originals keeps signed harbour hangar shelter holiday tables stones".split()
    rows = [(" ".join(frequent), None)] * 40 + [("ķarbour and ķangar sķelter ķoliday xables", "OCR_TEXT"), ("sxones xables regisxer", None), ("ķolidays", "OCR_TEXT"), ("stoncs tablcs hangarcs", "OCR_TEXT"), ("stone table hangare " * 40, None)]
    x = spark.createDataFrame([(str(i), "d", 1, "PARAGRAPH", r, None, t, "q", 1) for i, (t, r) in enumerate(rows)], SCHEMA)
    c = N.word_counts(N.scan(x))
    assert N.confusions(c, N.misreadings(c, N.MISREAD)) == (("h", "ķ"),)
    assert {tuple(r) for r in N.noise(x).collect()} == {("40", "misread"), ("43", "misread")}


def test_long_words(spark):
    want = {"idcntificafion": "identification", "fclecommunication": "telecommunication", "il" * 5000: ""}
    assert intended(spark, {"identification": 500, "telecommunication": 500}, want) == want


def header_table(spark, rows):
    return spark.createDataFrame([(i, d, 1, k, r, (p, 90.0, 800.0), t, "q", 1) for i, d, k, r, p, t in rows], SCHEMA)


BODY = "the register keeps signed originals before each nightly run\nand forwards them"


def test_headings_of_other_documents_give_no_title(spark):
    rows = [("h", "a", "HEADING", None, 1, "Rules of Pelcor"), ("x", "a", "PARAGRAPH", "OCR_TEXT", 2, f"Rules of Pelcor\n{BODY}"), ("y", "b", "PARAGRAPH", "OCR_TEXT", 2, f"Rules of Pelcor\n{BODY}")]
    assert {tuple(r) for r in N.noise(header_table(spark, rows)).collect()} == {("x", "running_header")}


def test_first_lines_repeat_on_neighbouring_pages_and_may_be_misread(spark):
    rows = [(f"p{p}", "a", "PARAGRAPH", "OCR_TEXT", p, f"Duties of the chief reviewer\n{p} {BODY}") for p in (1, 3, 5)]
    rows += [("z", "a", "PARAGRAPH", "OCR_TEXT", 7, f"Duties of the ehief revicwcr\n7 {BODY}"), ("w", "a", "PARAGRAPH", "OCR_TEXT", 9, f"Duties of the chxef reviewer\n9 {BODY}")]
    rows += [(f"f{p}", "a", "PARAGRAPH", "OCR_TEXT", p, f"The archive keeps the originals\n{p} {BODY}") for p in (100, 300, 500)]
    assert {r.id for r in N.noise(header_table(spark, rows)).where("noise_kind = 'running_header'").collect()} == {"p1", "p3", "p5", "z", "w"}


def test_bare_numbers_need_a_run(spark):
    def foot(i, d, p, t):
        return (i, d, 1, "OTHER", None, (p, 790.0, 800.0), t, "q", 1)

    rows = [foot("a", "d", 5, "17"), foot("b", "d", 6, "18"), foot("c", "d", 9, "700"), foot("e", "e", 3, "Page 12"), foot("f", "e", 4, "4"), foot("g", "g", None, "8")]
    got = {r.id for r in N.noise(spark.createDataFrame(rows, SCHEMA)).where("noise_kind = 'page_number'").collect()}
    assert got == {"a", "b", "e", "f", "g"}


def test_rare_words_keep_their_own_count(spark):
    """'тордал' four times beside 'торцал' twelve times is a word of its own; 'rcgister' once beside 40 'register' isn't."""
    rows = [("register", None)] * 40 + [("торцал", None)] * 12 + [("тордал", "OCR_TEXT")] * 4 + [("rcgister", "OCR_TEXT")]
    x = spark.createDataFrame([(str(i), "d", 1, "PARAGRAPH", r, None, t, "q", 1) for i, (t, r) in enumerate(rows)], SCHEMA)
    assert {tuple(r) for r in N.noise(x).collect()} == {("56", "misread")}
