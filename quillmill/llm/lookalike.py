"""Visually identical text with different characters, brought to one form.

Relations say that two strings show the same: a character that doesn't show and the empty string, any blank and a
space, a wide or narrow form and its ordinary letter, a ligature and its letters, a composed character and its
decomposition, letters of the same shape in different scripts. Union-find over strings and code points makes them
transitive (a composed letter joins another one if their marks are equal and their base letters are in one class).
Of each class the most frequent member in the corpus is the representative, and a multi-pattern automaton over all
other members rewrites texts greedily, the longest match first.

Defined results: null stays null; the empty text stays empty; differences of letter case, accents, digits, raised
digits, wording and line breaks stay (a carriage return before a line feed doesn't show); the number of blanks stays.
Counting covers every row; its result has one row for each distinct code point, so the driver gathers at most the
size of Unicode.
"""

from __future__ import annotations

import functools
import hashlib
import unicodedata
from collections.abc import Callable, Iterable, Iterator

import ahocorasick
import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CACHED_WORDS = 200_000

#: Letters of the same shape in the Latin, Cyrillic and Greek scripts, each group one shape.
SAME_SHAPE = (
    "AАΑ BВΒ CСϹ EЕΕ FϜ GԌ HНΗ IІΙӀ JЈͿ KКΚ MМΜ NΝ OОΟ PРΡ QԚ SЅ TТΤ WԜ XХΧ YҮΥ ZΖ "
    "aаα cсϲ dԁ eе hһ iіι jјϳ oоο pрρ qԛ sѕ uυ vνѵ wԝ xх yу кκ ΓГ ПΠ ЛΛ ФΦ "
    "ӘƏ əә ӨƟ өɵ ӠƷ ЇÏΪ їï ЁËЀ̈"
)
#: Letters of other scripts with the shape of the first of each group, as the Unicode table of confusable
#: characters has them.
SAME_SHAPE_ELSEWHERE = {
    "Armenian": "oօ hհ uս nո gց qզ OՕ SՏ UՍ",
    "Cherokee": "AᎪ BᏴ CᏟ DᎠ EᎬ GᏀ HᎻ JᎫ KᏦ LᏞ MᎷ PᏢ RᎡ SᏚ TᎢ VᏙ WᎳ ZᏃ",
    "Coptic": "BⲂ CⲤ HⲎ IⲒ KⲔ MⲘ NⲚ OⲞ PⲢ TⲦ XⲬ YⲨ cⲥ oⲟ pⲣ",
}
#: Ordinary hyphens, and marks that only separate letters.
SAME_MARK = (("-", "\u2010"), ("-", "\u2011"), ("\r\n", "\n"), ("\u2028", "\n"), ("\u0085", "\n"))
#: Characters outside the category Cf that show nothing.
UNSEEN = "\u034f\u115f\u1160\u17b4\u17b5\u180b\u180c\u180d\u3164\uffa0"

_COMPAT = ("<wide>", "<narrow>", "<initial>", "<medial>", "<final>", "<isolated>")


_SAME_PRINT = regex.compile("LIGATURE|RADICAL|ROMAN NUMERAL")  # of the compatibility characters these print the same


class Classes:
    """Union-find over strings; roots are kept by path halving."""

    def __init__(self) -> None:
        self.up: dict[str, str] = {}

    def find(self, x: str) -> str:
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def union(self, a: str, b: str) -> None:
        ra, rb = self.find(a), self.find(b)
        if ra != rb:
            self.up[max(ra, rb)] = min(ra, rb)

    def groups(self) -> list[list[str]]:
        got: dict[str, list[str]] = {}
        for x in list(self.up):
            got.setdefault(self.find(x), []).append(x)
        return [sorted(g) for g in got.values() if len(g) > 1]


def unseen(ch: str) -> bool:
    c = ord(ch)
    return unicodedata.category(ch) == "Cf" or ch in UNSEEN or 0xFE00 <= c <= 0xFE0F or 0xE0100 <= c <= 0xE01EF or (c < 32 and ch not in "\t\n\r")


def relations(chars: Iterable[str], fold_case: bool = False) -> Iterator[tuple[str, str]]:
    """Direct ones of single characters, without those between composed letters."""
    for ch in chars:
        if unseen(ch):
            yield ch, ""
        elif ch == "\t" or unicodedata.category(ch) == "Zs":
            yield ch, " "
        else:
            kind, *codes = unicodedata.decomposition(ch).split() or [""]
            if kind in _COMPAT or kind == "<compat>" and _SAME_PRINT.search(unicodedata.name(ch, "")):
                yield ch, "".join(chr(int(c, 16)) for c in codes)
        if fold_case and (low := ch.casefold()) != ch:
            yield ch, low
    yield from SAME_MARK
    for group in " ".join((SAME_SHAPE, *SAME_SHAPE_ELSEWHERE.values())).split():
        g = regex.findall(r"\X", group)
        yield from ((g[0], x) for x in g[1:])


def look_alikes(counts: dict[str, int], fold_case: bool = False) -> dict[str, str]:
    """String -> representative, for every member of a class that isn't its own representative."""
    cls = Classes()
    for a, b in relations(counts, fold_case):
        cls.union(a, unicodedata.normalize("NFC", b))
    singles: dict[str, list[str]] = {}
    for x in list(cls.up):
        if len(x) == 1:
            singles.setdefault(cls.find(x), []).append(x)
    by_shape: dict[tuple[str, str], str] = {}
    letters = set(counts) | {x for x in cls.up if len(x) == 1}
    for ch in sorted(letters):
        d = unicodedata.normalize("NFD", ch)
        if len(d) < 2 or unicodedata.combining(d[0]):
            continue
        cls.union(ch, d)
        shape = (cls.find(d[0]) if d[0] in cls.up else d[0], d[1:])
        cls.union(ch, by_shape.setdefault(shape, ch))
        for other in singles.get(shape[0], ()):  # the same mark on a base letter of the same shape
            cls.union(ch, other + d[1:])
    out: dict[str, str] = {}
    for g in cls.groups():
        # A composed string is as frequent as its rarest part; what doesn't show has the empty string.
        freq = {x: min((counts.get(c, 0) for c in x), default=1 << 62) if x not in (" ", "\n", "-") else 1 << 61 for x in g}
        best = max(g, key=lambda x: (freq[x], -len(x), [-ord(c) for c in x]))
        out |= {x: best for x in g if x != best}
    return out


class Rewriter:
    """Greedy longest-match rewriting, remembered by word; a blank is never part of a longer pattern."""

    def __init__(self, table: dict[str, str]):
        self.table = table
        self.machine = ahocorasick.Automaton()
        for k, v in table.items():
            self.machine.add_word(k, (len(k), v))
        if table:
            self.machine.make_automaton()
        self.known: dict[str, str] = {}

    def word(self, w: str) -> str:
        """Composed before and after; once more, because what was rewritten may compose to a member of a class."""
        once = self._rewritten(w)
        return once if once == w else self._rewritten(once)

    def _rewritten(self, w: str) -> str:
        w = w if w.isascii() else unicodedata.normalize("NFC", w)
        if not self.table:
            return w
        out, at = [], 0
        for end, (n, to) in self.machine.iter_long(w):
            out += (w[at : end + 1 - n], to)
            at = end + 1
        out.append(w[at:])
        return unicodedata.normalize("NFC", "".join(out)) if at else w

    def __call__(self, text: str | None) -> str | None:
        if text is None:
            return None
        known, out = self.known, []
        for w in text.split(" "):
            x = known.get(w)
            if x is None:
                if len(known) > CACHED_WORDS:
                    known.clear()
                x = known[w] = self.word(w)
            out.append(x)
        return " ".join(out)


@functools.lru_cache(maxsize=2)
def universal(fold_case: bool) -> Rewriter:
    """Without a corpus: classes over the whole basic plane, each represented by its first member."""
    return Rewriter(look_alikes({chr(c): 0 for c in range(0x20, 0xFFFF) if not 0xD800 <= c < 0xE000 and not 0xAC00 <= c < 0xD7A4}, fold_case))


def code_point_counts(df: DataFrame, *texts: str) -> DataFrame:
    """cp int, n long, over all rows: each task sums one array, so the shuffle has a row for each task and code point."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(0x110000, dtype=np.int64)
        for b in batches:
            for c in b.columns:
                u = np.frombuffer("".join(b[c].dropna()).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
                if len(u):
                    n = np.bincount(u)
                    total[: len(n)] += n
        at = np.flatnonzero(total)
        yield pd.DataFrame({"cp": at.astype(np.int32), "n": total[at]})

    return df.select(*texts).mapInPandas(run, "cp int, n long").groupBy("cp").agg(F.sum("n").alias("n"))


def learn(df: DataFrame, *texts: str) -> dict[str, str]:
    """The rewriting table of a corpus. Bounded by the number of code points."""
    return look_alikes({chr(r.cp): r.n for r in code_point_counts(df, *texts).collect()})


def rewriting(table: dict[str, str]) -> Callable[[], Rewriter]:
    """One Rewriter for each Python worker's task."""
    return functools.cache(lambda: Rewriter(table))


def normalised(df: DataFrame, key: str, texts: list[str], table: dict[str, str]) -> DataFrame:
    """key and the rewritten texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rw = Rewriter(table)
        for b in batches:
            yield b.assign(**{c: [rw(t) if isinstance(t, str) else None for t in b[c]] for c in texts})

    x = df.select(F.col(key).cast("string").alias(key), *texts)
    return x.mapInPandas(run, ", ".join(f"`{c}` string" for c in [key, *texts]))


def _digest(s: str) -> bytes:
    return hashlib.blake2b(s.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def looks(df: DataFrame, key: str, text: str, table: dict[str, str]) -> DataFrame:
    """id, look, form: digests of how a text looks and of how it is written. Texts that show nothing have no row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rw = Rewriter(table)
        for b in batches:
            b = b[b["t"].notna()]
            seen = [rw(t) for t in b["t"]]
            yield pd.DataFrame({"id": b["id"], "look": [_digest(s) if s.strip() else None for s in seen], "form": [_digest(t) for t in b["t"]]})

    x = df.select(F.col(key).cast("string").alias("id"), F.col(text).alias("t")).where("id is not null and t is not null")
    return x.mapInPandas(run, "id string, look binary, form binary").where("look is not null")


def pairs_of(looks: DataFrame) -> DataFrame:
    """element_id_a, element_id_b: rows that look the same and are written with other characters.

    Only digests are shuffled. Looks with one way of writing, however many copies they have, leave before the join, and
    the join is between different ways of writing only, so copies alone make no pairs."""
    forms = looks.groupBy("look").agg(F.min("form").alias("a"), F.max("form").alias("b")).where("a <> b").select("look")
    y = looks.join(forms, "look", "left_semi").distinct()
    a = y.select("look", F.col("id").alias("element_id_a"), F.col("form").alias("form_a"))
    b = y.select("look", F.col("id").alias("element_id_b"), F.col("form").alias("form_b"))
    return a.join(b, "look").where("form_a <> form_b and element_id_a < element_id_b").select("element_id_a", "element_id_b").distinct()


def classes_of(looks: DataFrame) -> DataFrame:
    """id, class_id (digest of the look), links: of each row that looks like another one written with other characters, how many
    such rows there are. One row for each row: what pairs_of() says, without growing with the square of a class."""
    x = looks.distinct()
    forms = x.groupBy("look", "form").agg(F.count("*").alias("same"))
    total = forms.groupBy("look").agg(F.sum("same").alias("all"), F.count("*").alias("forms")).where("forms > 1")
    links = forms.join(total, "look").select("look", "form", (F.col("all") - F.col("same")).alias("links"))
    return x.join(links, ["look", "form"]).select("id", F.lower(F.hex("look")).alias("class_id"), "links")
