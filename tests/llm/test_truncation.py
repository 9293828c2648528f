import numpy as np
import pytest

from quillmill.llm import truncation as T


@pytest.mark.parametrize(
    ("line", "kind"),
    [
        ("It ended.", "complete"), ("Он сказал: «Да».", "complete"), ("Ended?", "complete"), ("Είναι;", "complete"), ("它结束了。", "complete"), ("It was cut in the midd", "open"), ("它被", "open"), ("It was cut…", "mark"),
        ("It was cut [...]", "mark"), ("It was cut...", "mark"), ("| a | 1 |", "structured"), ("- AX-12", "structured"), ("— Name —", "structured"), ("Name, 2031-01-02", "structured"), ("Name / Other", "structured"),
        ("[12]", "structured"), ("https://a.example/b", "structured"), ("AX/12-345", "structured"), ("- a whole item of a list", "list"), ("Signed by Dr.", "dangling"), ("as in sec.", "dangling"), ("", "blank"),
        ("ทะเบียนสัญญา", "unstopped"), ("in room 25.", "complete"), ("и т. д.", "abbreviated"), ("Mr. A. B.", "dangling"), ("at 5 p.m.", "abbreviated"), ("see e.g.", "dangling"),
    ],
)
def test_endings(line, kind):
    assert T.ending(line) == kind


def test_a_limit_is_found_and_the_fit_corrected():
    r = np.random.default_rng(1)
    x = r.lognormal(6.5, 0.6, 4000).astype(int)
    n, c = np.unique(np.minimum(x, 1000), return_counts=True)
    mu, sigma, lim = T.fit_source(n, c)
    assert set(lim) == {1000} and lim[1000][1] > 0.99 and abs(mu - 6.5) < 0.05 and abs(sigma - 0.6) < 0.05
    n, c = np.unique(x, return_counts=True)
    assert T.fit_source(n, c)[2] == {}
    assert T.fit_source(np.array([]), np.array([]))[2] == {}


def test_frame(spark):
    r = np.random.default_rng(2)
    sent = "This is a sentence of a text. "
    rows = []
    for i, n in enumerate(r.lognormal(5, 0.7, 600).astype(int)):
        t = (sent * 100)[: max(1, n)].strip()
        t = t if t.endswith(".") else t.rsplit(".", 1)[0] + "." if "." in t else "End."
        rows.append((i, "free", t, "x"))
    base = [("lim", (f"Item {i} " + sent * 50)[:200].rstrip("."), "x") for i in range(40)]
    rows += [(1000 + i, *b) for i, b in enumerate(base)]
    rows += [(2000, None, "Ends here", "x"), (2001, None, None, "x"), (2002, "free", "  ", "x"), (2003, "free", "", "x"), (2004, "free", "word " * 50_000, "x"), (2004, "free", "word " * 50_000, "x")]
    x = spark.createDataFrame(rows, "doc_id long, source string, text string, ending string")
    j = T.judged(x, "doc_id", "source", "text")
    cut = {a.id for a in j.where("cut").collect()}
    assert cut >= {*range(1000, 1040), 2000, 2004} and not cut & {*range(600), 2001, 2002, 2003}
    rates = {a.source: a.n_cut for a in T.rates(j).collect()}
    assert rates["lim"] == 40 and rates[None] == 1
    assert T.judged(x.where("false"), "doc_id", "source", "text").count() == 0


def test_a_limit_in_bytes_leaves_values_below_it():
    r = np.random.default_rng(3)
    x = np.minimum(r.lognormal(6.5, 0.6, 4000).astype(int), 1000 - r.integers(0, 3, 4000))
    n, c = np.unique(x, return_counts=True)
    assert set(T.fit_source(n, c, 3)[2]) == {1000}


OPEN, COMPLETE = T.KINDS.index("open"), T.KINDS.index("complete")
SIM = np.full(len(T.KINDS), 0.003)
SIM[OPEN], SIM[COMPLETE] = 0.95, 0.02
WHOLE = np.full(len(T.KINDS), 1e-4)
WHOLE[COMPLETE] = 0.99


def odds(at_open, at_complete, off_open, off_complete, prior=0.99):
    n = np.zeros((2, len(T.KINDS)))
    n[0, OPEN], n[0, COMPLETE], n[1, OPEN], n[1, COMPLETE] = at_open, at_complete, off_open, off_complete
    return T.source_odds(n, np.array([prior, 0.01]), np.array([0.01, 0.01]), SIM, WHOLE)


def test_the_limit_decides_for_whole_sentences_and_open_endings():
    """A whole sentence at a limit is cut where few end there, not where many do. An open ending away from limits is cut
    in a source that seldom ends so, not in one whose texts do, where it is cut at the limit only."""
    few, many = odds(200, 1, 0, 300), odds(150, 50, 0, 300)
    assert few[0, COMPLETE] > 0 > few[1, COMPLETE] and many[0, COMPLETE] < 0
    seldom, natural = odds(50, 0, 40, 300), odds(50, 0, 400, 20)
    assert seldom[1, OPEN] > 0 and natural[1, OPEN] < 0 < natural[0, OPEN]


def test_marks_are_learned_at_limits(spark):
    """Texts of one source end in a mark at its limit: without the fit a mark says nothing."""
    r = np.random.default_rng(4)
    sent = "This is a sentence of a text. "
    whole = [(sent * 60)[: 30 * max(1, int(n) // 30)].strip() for n in r.lognormal(5, 0.7, 600)]
    rows = [(i, "s" if i % 2 else "t", t) for i, t in enumerate(whole) if len(t) < 300] + [(1000 + i, "s", (f"{i} " + sent * 20)[:299] + "…") for i in range(40)]
    x = spark.createDataFrame(rows, "doc_id long, source string, text string")
    with_fit, without = (({a.id for a in T.judged(x, "doc_id", "source", "text", u).where("cut").collect()}) for u in (True, False))
    assert with_fit == set(range(1000, 1040)) and not without


def test_scripts_without_full_stops(spark):
    whole = "ฝ่ายเก็บเอกสารตรวจแฟ้มที่ส่งเข้ามา ทีมทะเบียนของเราเก็บต้นฉบับที่ลงนามแล้ว "
    rows = [(i, "s", (whole * (i % 3 + 1)).strip()) for i in range(6)] + [(10, "s", whole + "ฝ่ายเก็บเอกสารตรวจแฟ้")]
    j = T.judged(spark.createDataFrame(rows, "doc_id long, source string, text string"), "doc_id", "source", "text")
    assert {r.id for r in j.where("cut").collect()} == {10}
