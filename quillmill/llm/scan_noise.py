"""Noise in text from scanned pages: page furniture, misread characters, words broken over line ends.

One pass over the texts writes what is needed of them: partial word counts, lines at page edges, number lines, the
distinct words of scanned elements and the words broken over their line ends. Everything else is joins on that.

Headers and footers are found by fuzzy repetition: lines at page edges (one-line elements in the top or bottom margin,
first and last lines of scanned elements) are folded to a key in which characters that are taken for one another are
equal. A key is a title of its document if a heading of that document gives it, if one-line elements at page edges show it
on two pages, or if first lines show it on REPEATS pages of a stretch of NEAR pages; a key that differs from a title of
its document in a few characters is taken for it. Page numbers are number lines, or number parts of such lines, whose
distance to the number of their page is the same on two pages of the document, or that say so themselves (by a word, a total, brackets).

Words are compared with the exact counts of the whole corpus by a join: a word of scanned text is misread if undoing one
or two confusions gives a word RATIO times as frequent, and if hardly any of its occurrences are in text that wasn't
scanned. To meet, the one side applies one confusion backward and the other none or one forward, so the work is linear in the
length of a word. A hyphen at a line end is removed unless the corpus holds the word more often with its hyphen than without
it. Confusions are the listed ones and those the corpus shows (confusions()).

Nothing depends on the size of the corpus but the counts themselves, and nothing that grows with it is sent to all tasks
unless the join finds it small.

Defined results: null and empty texts have no noise and an empty paragraph text; headings are never furniture; code and
tables are left as they are; a line that is furniture as a whole is removed, one line element of furniture becomes empty.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterable, Iterator
from math import log
from os.path import commonprefix

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.runtime import fresh_dir, written

RATIO = 15
SCANNED = 0.75  # of a misread word's occurrences are in scanned text
PAIR_WORDS = 3
SURE = 1e-6  # how unlikely it must be that the words of a learned confusion stand in scanned text by chance
KEPT = 3  # characters that a word and the one it was misread from must share for a confusion to be learned from them
CACHED_WORDS = 300_000
TOP, BOTTOM, FIRST = 0.08, 0.92, 0.15
REPEATS, NEAR = 3, 12
NOISE = "id string, noise_kind string"
#: What is read instead of what, as scanners of Latin and Cyrillic text do it.
MISREAD = (
    ("o", "0"), ("о", "0"), ("s", "5"), ("g", "9"), ("l", "1"), ("i", "1"), ("i", "l"), ("l", "i"), ("e", "c"), ("c", "e"), ("t", "f"), ("f", "t"), ("h", "b"), ("b", "h"),
    ("d", "cl"), ("m", "rn"), ("rn", "m"), ("ri", "n"), ("u", "ii"), ("w", "vv"), ("n", "u"), ("u", "n"), ("b", "6"), ("b", "8"), ("z", "2"), ("a", "4"), ("q", "9"), ("li", "h"), ("in", "m"), ("ni", "m"),
    ("е", "с"), ("с", "е"), ("т", "г"), ("г", "т"), ("л", "п"), ("п", "л"), ("н", "п"), ("п", "н"), ("и", "н"), ("н", "и"), ("ы", "ьі"), ("ы", "ьi"), ("м", "лі"), ("м", "лi"), ("в", "й"), ("з", "3"), ("ш", "щ"),
    ("щ", "ш"), ("ц", "д"), ("д", "ц"), ("б", "6"), ("ч", "4"), ("о", "о̂"), ("ь", "ъ"), ("ю", "іо"), ("ж", "лс"), ("в", "8"), ("э", "з"),
    ("ж", "зк"), ("қ", "к,"), ("ң", "н,"),
)
#: Words that go with the number of a page.
PAGE_WORDS = "page|pages|pg|pp?|of|sur|seiten?|von|blatt|s|лист|из|стр|страница|с|бет|беті|sayfa|pág|página|de|folio|σελ|από|หน้า|第|页|頁|쪽|पृष्ठ|पृ|صفحة|ص|من|сторінка|арк|з|n|no|№"
_WITH_COMMA = tuple({read[0] for _, read in MISREAD if read[-1] == ","})

_NUMBER = r"(?:\d{1,6}|[ivxlc]{1,9})"
_PAGE = regex.compile(rf"[\s\[(–—-]*(?:(?:{PAGE_WORDS})\.?\s*)?{_NUMBER}(?:[\s-]*(?:{PAGE_WORDS})\.?)?(?:\s*(?:/|(?:{PAGE_WORDS})\.?)\s*{_NUMBER})?[\s\])–—-]*", regex.I)
_VALUE = regex.compile(rf"(?<!\p{{L}}){_NUMBER}(?!\p{{L}})")
_PART = regex.compile(r"\s{2,}|\t")
_BREAK = regex.compile(r"([\p{L}\p{M}’']+)[-‐‑¬­][ \t]*\r?\n[ \t]*([\p{Ll}\p{Lo}\p{M}][\p{L}\p{M}’']*)")
_HYPHENED = regex.compile(r"([\p{L}\p{M}\p{N}’']+)([-‐‑¬­])[ \t]*\r?\n[ \t]*([\p{L}\p{M}\p{N}’'-]+)")
_TRIM = regex.compile(r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}\p{M}]+$")
_CODE = regex.compile(r"\p{Lu}{1,3}[-/]?\d[\d/-]*|[\d.,:/%-]+|.*[@/].*|v\d.*|\d+[-‐]\p{L}+", regex.I)
_NUMBERING = regex.compile(r"^\s*(?:\d+(?:\.\d+)*\.?\s+)|\s+\p{Lu}{1,2}[-/]?\d[\d/-]*\s*$")
_FOLD = str.maketrans({"0": "o", "о": "o", "5": "s", "9": "g", "1": "i", "l": "i", "c": "e", "с": "e", "е": "e", "f": "t", "г": "т", "п": "н", "л": "н", "и": "н", "3": "з", "щ": "ш", "6": "б", "b": "h", "й": "в"})


def page_value(line: str) -> tuple[int, bool] | None:
    """The number of the page that a line, or a part of it set off by wide blanks, gives, and whether more than the bare
    number says that it is one (a word, a total, brackets or dashes, a title beside it)."""
    parts = [p for p in _PART.split(line.strip()) if p]
    for p in parts:
        if _PAGE.fullmatch(p) is not None and (m := _VALUE.search(p.lower())):
            return int(m[0]) if m[0].isdecimal() else roman(m[0]), len(parts) > 1 or len(p.strip()) > len(m[0])
    return None


def roman(s: str) -> int:
    """Of a number in Roman numerals, however written."""
    v = [{"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}[c] for c in s]
    return sum(-a if a < b else a for a, b in zip(v, [*v[1:], 0]))


def titles(line: str) -> list[str]:
    """Parts of a line that could be a title, as fuzzy keys."""
    return [fold(p) for p in _PART.split(line.strip()) if p and _PAGE.fullmatch(p) is None and len(p) >= 4]


def fold(s: str) -> str:
    s = regex.sub(r"[\s\p{P}\p{Cf}]+", " ", s.lower()).strip()
    for whole, read in (("м", "лі"), ("ы", "ьі"), ("d", "cl"), ("m", "rn"), ("u", "ii"), ("w", "vv")):
        s = s.replace(read, whole)
    return s.translate(_FOLD)


def heading_keys(text: str) -> list[str]:
    """A heading with and without its numbering and code."""
    return list(dict.fromkeys(k for k in (fold(text), fold(_NUMBERING.sub("", _NUMBERING.sub("", text)))) if len(k) >= 4))


def edge_lines(text: str, rel: float | None, scanned: bool) -> list[tuple[int, str, bool]]:
    """Lines of an element that lie at a page edge, and whether at the top of a scanned page; rel: top of the element as a
    share of the page's height."""
    lines = text.split("\n")
    if len(lines) == 1:
        return [(0, lines[0], False)] if rel is not None and (rel < TOP or rel > BOTTOM) else []
    if not scanned:
        return []
    got = [(len(lines) - 1, lines[-1], False)]
    if rel is None or rel < FIRST or _PAGE.fullmatch(lines[0].strip()):
        got = [(0, lines[0], True), (1, lines[1], True)] + (got if len(lines) > 2 else [])
    return [(i, x.rstrip("\r"), t) for i, x, t in got]


def rejoin(text: str) -> str:
    return _BREAK.sub(lambda m: m[1] + m[2], text) if "\n" in text else text


def token(raw: str) -> str:
    """The word of a token as it is counted; empty for codes, numbers and addresses."""
    w = _TRIM.sub("", raw)
    if not w or _CODE.fullmatch(w):
        return ""
    w = regex.sub(r"\p{Cf}", "", w)
    return w.lower()


def comma_read(raw: str) -> bool:
    """Whether a comma follows a last letter that may have been read with it."""
    core = _TRIM.sub("", raw)
    return core[-1:].lower() in _WITH_COMMA and raw[raw.find(core) + len(core) :][:1] == ","


def forms(raw: str) -> list[str]:
    """What of a token may be misread: its word with the comma of its last letter, and its word."""
    w = token(raw)
    if len(w) < 3 or not any(c.isalpha() for c in w):
        return []
    return [f"{w},", w] if comma_read(raw) else [w]


def breaks(text: str) -> Iterator[str]:
    """Words broken over line ends as 'a mark b', without those in which the hyphen can't be a break."""
    if "\n" not in text:
        return
    for m in _HYPHENED.finditer(text):
        a, b = m[1], m[3]
        if (b[0].islower() or b[0].isalpha() and not b[0].isupper()) and not (len(a) > 3 and any(c.isdigit() for c in a) and not any(c.isalpha() for c in a)):
            yield split_form(a, m[2], b)


def split_form(a: str, mark: str, b: str) -> str:
    return f"{a.lower()} {mark} {b.lower()}"


SCAN = "what string, id string, doc string, page long, line int, key string, single boolean, top boolean, n long, scanned long, joined long, forms array<string>"
_NAMES = [f.split(" ")[0] for f in SCAN.split(", ")]


def _elements(df: DataFrame) -> DataFrame:
    rel = F.col("geometry.y0") / F.col("geometry.page_height")
    return df.select(
        F.col("source_element_id").alias("id"), F.concat_ws("\x1f", "document_id", F.col("document_version").cast("string")).alias("doc"), "element_type", F.coalesce(F.col("element_role") == "OCR_TEXT", F.lit(False)).alias("scanned"),
        F.col("geometry.page_number").alias("page"), rel.alias("rel"), F.col("original_text").alias("t"),
    ).where("t is not null")


def scan(df: DataFrame) -> DataFrame:
    """SCAN, written in a folder for each `what`: 'word' (key, n, scanned, joined: how many were joined over a line end; partial
    sums), 'head' and 'edge' (id, doc, page, line, key, single, top), 'number' (id, doc, page, line, n: value less page), 'read'
    (id, forms: what may be misread) and 'split' (id, forms: words broken over line ends)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        raw: dict[bool, Counter[str]] = {False: Counter(), True: Counter()}
        joined: Counter[str] = Counter()
        known: dict[str, list[str]] = {}

        def flush() -> list[dict]:
            out: dict[str, list[int]] = {}
            for scanned, own in raw.items():
                for k, n in own.items():
                    if w := token(k):
                        x = out.setdefault(w, [0, 0, 0])
                        x[0] += n
                        x[1] += n * scanned
                own.clear()
            for k, n in joined.items():
                if w := token(k):
                    out.setdefault(w, [0, 0, 0])[2] += n
            joined.clear()
            return [{"what": "word", "key": w, "n": a, "scanned": b, "joined": c} for w, (a, b, c) in out.items()]

        for b in batches:
            rows: list[dict] = []
            for i, d, kind, scanned, page, rel, t in zip(b["id"], b["doc"], b["element_type"], b["scanned"], b["page"], b["rel"], b["t"]):
                if kind in ("CODE_BLOCK", "TABLE"):
                    continue
                page = None if pd.isna(page) else int(page)
                whole = rejoin(t).split()
                raw[bool(scanned)].update(whole)
                if len(raw[False]) + len(raw[True]) > CACHED_WORDS:
                    rows += flush()
                if kind == "HEADING":
                    rows += [{"what": "head", "id": i, "doc": d, "page": page, "line": -1, "key": k} for k in heading_keys(t)]
                    continue
                for n, x, top in edge_lines(t, None if pd.isna(rel) else rel, scanned):
                    rows += [{"what": "edge", "id": i, "doc": d, "page": page, "line": n, "key": k, "single": "\n" not in t, "top": top} for k in titles(x)]
                    if (v := page_value(x)) is not None:
                        rows.append({"what": "number", "id": i, "doc": d, "page": page, "line": n, "n": None if page is None else v[0] - page, "single": v[1]})
                if scanned:
                    if "\n" in t:
                        joined.update(m[1] + m[2] for m in _BREAK.finditer(t))
                    if len(known) > CACHED_WORDS:
                        known.clear()
                    own: dict[str, None] = {}
                    for w in whole:
                        got = known.get(w)
                        if got is None:
                            got = known[w] = forms(w)
                        own.update(dict.fromkeys(got))
                    rows.append({"what": "read", "id": i, "forms": list(own)})
                    if got := list(dict.fromkeys(breaks(t))):
                        rows.append({"what": "split", "id": i, "forms": got})
            yield _frame(rows)
        yield _frame(flush())

    spark = df.sparkSession
    path = fresh_dir(spark, "scan")
    _elements(df).mapInPandas(run, SCAN).write.partitionBy("what").parquet(path)
    return spark.read.schema(SCAN).parquet(path)


def _frame(rows: list[dict]) -> pd.DataFrame:
    kinds = {"page": "Int64", "n": "Int64", "scanned": "Int64", "joined": "Int64", "line": "Int32", "single": "boolean", "top": "boolean"}
    return pd.DataFrame({k: pd.Series([r.get(k) for r in rows], dtype=kinds.get(k, "object")) for k in _NAMES})


def word_counts(s: DataFrame) -> DataFrame:
    """word, n over all rows, scanned: n in scanned elements, joined: n joined over a line end."""
    x = s.where("what = 'word'").groupBy(F.col("key").alias("word")).agg(*[F.sum(c).alias(c) for c in ("n", "scanned", "joined")])
    return written(x, "words")


def changed(word: str, pairs: Iterable[tuple[str, str]]) -> set[str]:
    """The word with one part replaced by its counterpart."""
    return {word[:i] + new + word[i + len(old) :] for old, new in pairs for i in range(len(word)) if word.startswith(old, i)}


def steps(read: str, whole: str, pairs: tuple[tuple[str, str], ...], most: int = 2) -> int | None:
    """How many confusions side by side turn `whole` into `read`; None for more than `most`."""
    if read == whole:
        return 0
    if not most:
        return None
    p = len(commonprefix((read, whole)))
    got = []
    for w, r in pairs:
        for i in range(max(0, p - 2), p + 1):
            if i + max(len(w), len(r)) > p and read.startswith(r, i) and whole.startswith(w, i):
                k = steps(read[i + len(r) :], whole[i + len(w) :], pairs, most - 1)
                if k is not None:
                    got.append(k + 1)
    return min(got, default=None)


def _key(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def misreadings(counts: DataFrame, pairs: tuple[tuple[str, str], ...]) -> DataFrame:
    """form, intended: of the words of scanned text those that were misread, and the word each was. Of several the one
    with fewer confusions, then the more frequent one, then the first in the alphabet."""
    undone, done = [(r, w) for w, r in pairs], list(pairs)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for w, n in zip(b["word"], b["n"]):
                if len(w) >= 3 and any(c.isalpha() for c in w):
                    for f in (w, f"{w},") if w[-1] in _WITH_COMMA else (w,):
                        rows += [(_key(x), f, n) for x in changed(f, undone)]
            yield pd.DataFrame(rows, columns=["h", "form", "own"])

    def meant(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(_key(x), w, n) for w, n in zip(b["word"], b["n"]) for x in (w, *changed(w, done))]
            yield pd.DataFrame(rows, columns=["h", "intended", "most"])

    def proved(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(steps=pd.array([steps(f, v, pairs) for f, v in zip(b["form"], b["intended"])], dtype="Int32"))

    # Undoing a confusion takes at most one character away: longer words than this were misread from none.
    often = counts.where(F.col("n") >= RATIO)
    longest = often.agg(F.max(F.length("word"))).first()[0] or 0
    rare = counts.where((F.col("scanned") >= SCANNED * F.col("n")) & (F.col("scanned") > 0) & (F.length("word") <= longest + 2))
    x = rare.mapInPandas(read, "h long, form string, own long").join(often.mapInPandas(meant, "h long, intended string, most long"), "h")
    x = x.where(F.col("most") >= RATIO * F.col("own")).select("form", "intended", "most").distinct()
    x = x.mapInPandas(proved, "form string, intended string, most long, steps int").where("steps > 0")
    best = x.groupBy("form").agg(F.min(F.struct("steps", (-F.col("most")).alias("m"), "intended")).alias("b"))
    return best.select("form", F.col("b.intended").alias("intended"))


def gaps(word: str) -> list[tuple[str, str]]:
    """The word with one or two neighbouring characters taken out, the place marked, and what was taken out."""
    return [(f"{word[:i]}\0{word[i + n :]}", word[i : i + n]) for n in (1, 2) if len(word) >= n + KEPT for i in range(len(word) - n + 1)]


def confusions(counts: DataFrame, explained: DataFrame) -> tuple[tuple[str, str], ...]:
    """Unlisted pairs of what is read instead of what, as the corpus shows them: words that no listed confusion explains
    are joined to frequent ones that differ in one place. Chance pairs turn up in all text alike, confusions only where it
    was scanned: the words of a pair must be so many that chance would hardly put all of them there. At most as many pairs
    come back as there are pairs of one or two characters."""
    n, scanned = counts.agg(F.sum("n"), F.sum("scanned")).first()
    share = (scanned or 0) / n if n else 1.0
    if not 0 < share < 1:
        return ()
    least = max(PAIR_WORDS, log(SURE) / log(share))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, w, n, s, g) for w, n, s in zip(b["word"], b["n"], b["scanned"]) if any(c.isalpha() for c in w) for k, g in gaps(w)]
            yield pd.DataFrame(rows, columns=["key", "word", "n", "scanned", "part"])

    schema = "key string, word string, n long, scanned long, part string"
    often = counts.where(F.col("n") >= RATIO)
    longest = often.agg(F.max(F.length("word"))).first()[0] or 0
    often = often.mapInPandas(run, schema).select("key", F.col("n").alias("most"), F.col("part").alias("whole"))
    open_ = counts.where(F.length("word") <= longest + 2).join(explained.select(F.col("form").alias("word")), "word", "left_anti")
    x = open_.mapInPandas(run, schema).join(often, "key").where(F.col("most") >= RATIO * F.col("n"))
    x = x.where("left(part, 1) <> left(whole, 1) and right(part, 1) <> right(whole, 1) and whole rlike '^[\\\\p{L}\\\\p{M}]+$'")
    x = x.groupBy("whole", "part", "word").agg(F.max(F.col("scanned") >= SCANNED * F.col("n")).alias("scan")).groupBy("whole", "part")
    x = x.agg(F.count_if("scan").alias("yes"), F.count_if(~F.col("scan")).alias("no")).where((F.col("yes") >= least) & (F.col("yes") >= 5 * F.col("no")))
    listed = {(whole, r) for whole, read in MISREAD for r in (read, read.rstrip(","))}  # a last letter's comma isn't in the word
    return tuple(sorted(p for r in x.collect() if (p := (r.whole, r.part)) not in listed))


def misread_forms(counts: DataFrame) -> DataFrame:
    """form, intended, by the listed confusions and those the corpus shows."""
    found = written(misreadings(counts, MISREAD), "misread")
    more = confusions(counts, found)
    return written(misreadings(counts, MISREAD + more), "misread") if more else found


def broken_forms(s: DataFrame, counts: DataFrame) -> DataFrame:
    """form: words broken over line ends, of which the corpus doesn't hold the hyphen more often than the whole word. What is
    joined over line ends itself is no evidence of the whole word."""
    x = s.where("what = 'split'").select(F.explode("forms").alias("form")).distinct()
    part = F.split("form", " ")
    x = x.select("form", part[1].alias("mark"), F.concat_ws("-", part[0], part[2]).alias("hyphened"), F.concat(part[0], part[2]).alias("whole"))
    x = x.join(counts.select(F.col("word").alias("hyphened"), F.col("n").alias("with_hyphen")), "hyphened", "left")
    x = x.join(counts.select(F.col("word").alias("whole"), (F.col("n") - F.col("joined")).alias("without")), "whole", "left")
    kept = F.col("mark").isin(*"-‐‑") & F.col("with_hyphen").isNotNull() & (F.coalesce("without", F.lit(0)) < F.col("with_hyphen"))
    return x.where(~kept).select("form")


def running_titles(s: DataFrame) -> DataFrame:
    """id, line: lines that hold a running title."""
    lines = s.where("what = 'edge'").select("id", "doc", "page", "line", "key", "single", "top").distinct()
    heads = s.where("what = 'head'").select("doc", "key").distinct()
    single = lines.where("single").groupBy("doc", "key").agg(F.count_distinct("page").alias("k")).where("k >= 2").select("doc", "key")
    # Two ways of cutting the pages into stretches, so that neighbours share one.
    half = F.floor(F.col("page") / (NEAR // 2))
    near = lines.where("top and page is not null").select("doc", "key", "page", F.explode(F.array(F.floor(half / 2) * 2, F.floor((half + 1) / 2) * 2 + 1)).alias("stretch"))
    near = near.groupBy("doc", "key", "stretch").agg(F.count_distinct("page").alias("k")).where(F.col("k") >= REPEATS).select("doc", "key")
    known = written(heads.unionByName(single).unionByName(near).distinct(), "titles")
    same = lines.join(known, ["doc", "key"], "left_semi").select("id", "line")
    # Misread titles: what shares one half with a title of the document is compared with it. Both sides are distinct keys.
    halves = lambda c: F.array(F.concat(F.lit("a"), F.expr(f"left({c}, length({c}) div 2)")), F.concat(F.lit("b"), F.expr(f"right({c}, length({c}) div 2)")))
    other = lines.where("single or top").select("doc", "key").distinct().join(known, ["doc", "key"], "left_anti").where(F.length("key") >= 8)
    a = other.select("doc", "key", F.explode(halves("key")).alias("half"))
    b = known.where(F.length("key") >= 8).select("doc", F.col("key").alias("title"), F.explode(halves("key")).alias("half"))
    like = a.join(b, ["doc", "half"]).where(F.levenshtein("key", "title") <= F.ceil(F.length("title") / 12)).select("doc", "key").distinct()
    return same.unionByName(lines.where("single or top").join(like, ["doc", "key"], "left_semi").select("id", "line")).distinct()


def page_numbers(s: DataFrame) -> DataFrame:
    """id, line: number lines in a run, that is with the distance to their page that another page of the document has too,
    and lines that say themselves that they number a page. Where the page isn't known no run can be seen and the line counts."""
    x = s.where("what = 'number'").select("id", "doc", "line", "page", F.col("n").alias("off"), "single").distinct()
    runs = x.where("off is not null").groupBy("doc", "off").agg(F.count_distinct("page").alias("k")).where("k >= 2 or off = 0").select("doc", "off")
    sure = x.where("single or off is null").select("id", "line")
    return x.join(runs, ["doc", "off"], "left_semi").select("id", "line").unionByName(sure).distinct()


def noise(df: DataFrame) -> DataFrame:
    """NOISE: one row for each element and kind."""
    s = scan(df)
    counts = word_counts(s)
    of = lambda what: s.where(F.col("what") == what).select("id", F.explode("forms").alias("form"))
    found = (
        ("misread", of("read").join(misread_forms(counts), "form", "left_semi")), ("split_word", of("split").join(broken_forms(s, counts), "form", "left_semi")),
        ("running_header", running_titles(s)), ("page_number", page_numbers(s)),
    )
    out = None
    for kind, x in found:
        x = x.select("id", F.lit(kind).alias("noise_kind"))
        out = x if out is None else out.unionByName(x)
    return out.distinct()


PARAGRAPHS = "id string, paragraph string, dehyphenations int, corrections int, furniture_lines int"


def paragraphs(df: DataFrame) -> DataFrame:
    """PARAGRAPHS: the text of every element without furniture, with words corrected, rejoined and lines joined."""
    s = scan(df)
    counts = word_counts(s)
    of = lambda what: s.where(F.col("what") == what).select("id", F.explode("forms").alias("form"))
    no = F.lit(None)
    found = of("read").join(misread_forms(counts), "form").select("id", "form", "intended", no.cast("int").alias("line"))
    found = found.unionByName(of("split").join(broken_forms(s, counts), "form", "left_semi").select("id", "form", no.cast("string").alias("intended"), no.cast("int").alias("line")))
    lines = running_titles(s).unionByName(page_numbers(s)).select("id", no.cast("string").alias("form"), no.cast("string").alias("intended"), "line")
    # What an element's own text holds: as many entries as it has words at most.
    per = found.unionByName(lines).groupBy("id").agg(F.collect_set(F.when(F.col("form").isNotNull(), F.struct("form", "intended"))).alias("words"), F.collect_set("line").alias("drop"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, kind, scanned, t, words, drop in zip(b["id"], b["element_type"], b["scanned"], b["t"], b["words"], b["drop"]):
                words = {x["form"]: x["intended"] for x in words} if words is not None else {}
                rows.append((i, *repaired(t, kind, scanned, () if drop is None else drop, words)))
            yield pd.DataFrame(rows, columns=["id", "paragraph", "dehyphenations", "corrections", "furniture_lines"])

    return _elements(df).select("id", "element_type", "scanned", "t").distinct().join(per, "id", "left").mapInPandas(run, PARAGRAPHS)


def repaired(t: str, kind: str, scanned: bool, drop: Iterable[int], words: dict[str, str | None]) -> tuple[str, int, int, int]:
    """words: misread forms with the words they were, broken forms with None."""
    if kind in ("CODE_BLOCK", "TABLE", "HEADING"):
        return t, 0, 0, 0
    gone = {int(x) for x in drop}
    text = "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone)
    if not scanned:
        return text, 0, 0, len(gone)
    joins = 0

    def join(m: regex.Match) -> str:
        nonlocal joins
        if split_form(m[1], m[2], m[3]) in words:
            joins += 1
            return m[1] + m[3]
        return m[1] + m[2] + m[3]

    text = _HYPHENED.sub(join, text)
    fixed, out = 0, text.split()
    if any(words.values()):  # few elements have a misread word
        for k, w in enumerate(out):
            f = next((f for f in forms(w) if words.get(f)), None)
            if f:
                fixed += 1
                v, core = words[f], _TRIM.sub("", w)
                read = f"{core}," if f[-1] == "," else core
                v = v.upper() if core.isupper() and len(core) > 1 else v[0].upper() + v[1:] if core[0].isupper() else v
                out[k] = w.replace(read, v, 1)
    return " ".join(out), joins, fixed, len(gone)
