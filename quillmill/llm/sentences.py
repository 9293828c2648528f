"""Sentence boundaries across languages and scripts.

The rules are made of the standard sentence-break classes of characters: a run of terminators (ATerm, STerm, and the
ellipsis) and the closing marks after it may end a sentence; not if a continuation (SContinue) or a small letter follows.
A full stop ends one only if what precedes isn't an abbreviation, an initial, a number or a part of an address, and what
follows can begin a sentence. Abbreviations are those of the language of the sentence: its script leaves some languages,
letters and function words of the sentence leave fewer (languages()); where they don't tell, all languages of the script
count, because hints are unreliable. Added are quotations followed by their reporting clause, the Greek question mark,
scripts that end sentences with a blank (Thai, Lao), and sentences joined without a blank.

Defined results: null, empty and blank texts have no sentences; the units of a text are in order and, with the blanks
between them, cover it whole; a text without any terminator is one sentence; equal texts get equal sentences.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Abbreviations by language. 'name' stands before a name, 'number' before a number (a sentence may end with it
#: before anything else), 'inside' in the middle of a sentence, which goes on unless a capital follows, 'onward' points
#: onward, so that even a capital doesn't end the sentence.
ABBREVIATIONS = {
    "en": {"name": "mr mrs ms messrs dr prof st gen col lt rev hon", "number": "no nos p pp s ss sec sect art arts fig figs vol ch chap para cl ex approx ca tab", "inside": "etc ltd inc corp co a.m p.m", "onward": "e.g i.e cf vs"},
    "de": {"name": "hr fr dr prof st dipl-ing ing", "number": "nr nrn s abs art abb kap bd ziff tab pos ca", "inside": "u.a u.s.w usw bzw ggf evtl zzgl co", "onward": "z.b d.h vgl sog inkl"},
    "fr": {"name": "m mm mme mlle me mgr dr pr", "number": "art arts al fig p pp n nn ch chap vol par ex", "inside": "etc env", "onward": "cf"},
    "es": {"name": "sr sra srta dr dra drs prof ing", "number": "art arts núm num pág pag págs fig cap tel al ap no p", "inside": "etc ej", "onward": "p.ej cf"},
    "pt": {"name": "sr sra srta dr dra prof", "number": "art arts al fig cap pág pag págs núm n p", "inside": "etc ej", "onward": "p.ex cf"},
    "tr": {"name": "av doç müh yrd dr prof sn", "number": "md sf şek böl kıs no s", "inside": "vb vs", "onward": "örn bkz ör"},
    "ru": {"name": "д-р д-ра г-н проф акад инж тов ул пл просп им ред гр", "number": "п пп рис стр с ст гл разд табл вып т тт ч абз подп прил кв д корп оф изд около прибл", "inside": "т.д т.п др пр тыс млн млрд руб коп г гг в вв", "onward": "т.е т.к см ср напр"},
    "uk": {"name": "д-р проф акад інж вул пл ім гр", "number": "п пп рис мал стор с ст гл розд табл вип т ч абз арк", "inside": "т.д т.п ін тис млн млрд грн коп р рр", "onward": "див напр"},
    "kk": {"name": "мырза д-р проф инж", "number": "бет б сур тар ст т", "inside": "т.б т.с.с ж ғ мың млн тг", "onward": "мыс қар"},
    "el": {"name": "κ κα κος δρ", "number": "άρθ σελ αρ κεφ παρ εικ", "inside": "κ.λπ κ.ά", "onward": "βλ π.χ δηλ"},
    "hi": {"name": "डॉ श्री प्रो", "number": "क्र पृ सं", "inside": "बी", "onward": ""},
    "ar": {"name": "د أ م", "number": "ص ج م", "inside": "", "onward": ""},
    "th": {"name": "ดร นพ คุณ", "number": "", "inside": "", "onward": ""},
}
#: Function words of the languages that share the Latin script, and words that begin a sentence but no name.
FUNCTION_WORDS = {
    "en": "the of and to in is are was for on at with by that this it from not as be has an or",
    "de": "der die das und ist im den dem des ein eine mit für von zu auf nicht wird hat am",
    "fr": "le la les de des du et est un une dans pour par sur au aux que qui avec ce cette il",
    "es": "el la los las de del y es un una en para por con que se su lo",
    "pt": "o os as de do da dos das e é um uma em para por com que se ao não na",
    "tr": "ve bir bu için ile de da olarak olan her göre kadar",
}
STARTERS = {
    "en": "the this that these those it he she they we there if when our each every",
    "de": "der die das er sie es wir dieser diese dieses im am nach ein eine",
    "fr": "il elle ils elles nous ce cette ces un une notre chaque",
    "es": "el los las un una este esta nuestro nuestra cada",
    "pt": "o os as um uma este esta nosso nossa cada",
    "tr": "bu her bir",
    "ru": "он она они это этот мы каждый",
    "uk": "він вона вони це цей ми кожен",
    "kk": "ол олар бұл біз әр әрбір",
}
#: Words after which 'no' is the word.
NO_AFTER = set("is was be are say says said answer answered means with a".split())
#: Month names that follow an ordinal number with a full stop.
MONTHS = set(
    "januar jänner februar märz april mai juni juli august september oktober november dezember ocak şubat mart nisan mayıs haziran temmuz ağustos eylül ekim "
    "kasım aralık januari".split()
)
SCRIPTS = (("Cyrillic", ("ru", "uk", "kk")), ("Greek", ("el",)), ("Devanagari", ("hi",)), ("Arabic", ("ar",)), ("Thai", ("th",)), ("Latin", ("en", "de", "fr", "es", "pt", "tr")))


def _sets(kind: str, langs: tuple[str, ...]) -> frozenset[str]:
    return frozenset(w for k in langs for w in ABBREVIATIONS[k][kind].split())


_EVERY = tuple(ABBREVIATIONS)
BEFORE_NAME, BEFORE_NUMBER, ONWARD = (_sets(k, _EVERY) for k in ("name", "number", "onward"))
INSIDE = _sets("inside", _EVERY) | ONWARD
_WORDS_OF = {w: tuple(k for k, v in FUNCTION_WORDS.items() if w in v.split()) for v in FUNCTION_WORDS.values() for w in v.split()}
_SCRIPT = tuple((regex.compile(rf"\p{{{name}}}"), langs) for name, langs in SCRIPTS)
_KAZAKH, _UKRAINIAN, _RUSSIAN = regex.compile("[әғқңөұүһӘҒҚҢӨҰҮҺ]"), regex.compile("[їєґЇЄҐіІ]"), regex.compile("[ыэъёЫЭЪЁ]")
_ANY_WORD = regex.compile(r"\p{L}+")

_TERMINATOR = r"[\p{SB=ATerm}\p{SB=STerm}…;;]"
_CLOSE = r"[\p{Pe}\p{Pf}'\"]"
_OPENING = regex.compile(r"[\p{Ps}\p{Pi}\"'’¿¡¶§•*·]")
_DASH = regex.compile(r"\p{Pd}")
_OPEN_QUOTE = regex.compile(r"[\p{Pi}\"'„‚「『]")
_CONTINUES = regex.compile(r"[\p{SB=SContinue}--\p{Pd}]", regex.V1)
_QUOTE = regex.compile(r"[\p{Pi}\p{Pf}\"'„‚「」『』]")
_CANDIDATE = regex.compile(rf"(?:{_TERMINATOR}\p{{Cf}}*)+(?:\p{{Cf}}*(?:{_CLOSE}|(?<=\S)“)|(?<=[?!…;;.]\p{{Cf}}*)\s{{1,2}}»)*(?:[.。](?!\w))?")
_THAI_GAP = regex.compile(r"(?<=[\p{Thai}\p{Lao}]\p{Cf}*)\s+(?=(\S+))")
_HAS_THAI = regex.compile(r"[\p{Thai}\p{Lao}]")
_BLANK_LINE = regex.compile(r"\s*\n\s*\n\s*")
_TOKEN = regex.compile(r"[^\s\"“”„«»‹›「」『』()\[\]{}¿¡,:;!?…/]*\Z")
_GREEK = regex.compile(r"[\p{Greek}]")
_WORD = regex.compile(r"[\p{L}\p{M}\p{Cf}]+|\S")
_LAST_WORD = regex.compile(r"(\p{L}+)\P{L}*\Z")
_AFTER_NUMBER = regex.compile(r"\p{N}[\s\p{Cf}]*\Z")
_TWO_LETTERS = regex.compile(r"(?<![\p{L}\p{N}])(\p{L})\.[\s\p{Cf}]*\p{L}[\p{Cf}]*\Z")
_SKIP = regex.compile(r"[\p{Cf}\p{M}]")
#: No abbreviation is longer, so a longer token is none.
_LONGEST = 24


def languages(text: str, start: int, end: int, dot: int) -> tuple[str, ...]:
    """The languages that the abbreviation from `end` to `dot` in the sentence from `start` may be of, by its script and by the
    letters and function words of the sentence, or by those that follow if it has none."""
    part = text[start:end]
    for tail in (text[end:dot], part[-40:], text[dot : dot + 40]):
        n, langs = max((len(r.findall(tail)), langs) for r, langs in _SCRIPT)
        if n:
            break
    else:
        return _EVERY
    if "kk" in langs:
        if _KAZAKH.search(part):
            return ("kk",)
        return ("ru",) if _RUSSIAN.search(part) else ("uk",) if _UKRAINIAN.search(part) else langs
    if "tr" in langs:
        for p in (part, text[dot : dot + 60]):
            votes = dict.fromkeys(langs, 0)
            for w in _ANY_WORD.findall(p.lower()):
                for k in _WORDS_OF.get(w, ()):
                    votes[k] += 1
            if most := max(votes.values()):
                return tuple(k for k, v in votes.items() if v == most)
    return langs


def _clean(token: str) -> str:
    """A token before a full stop as it is compared: without invisible characters, in ordinary letters, lower case."""
    if not token.isascii():
        token = unicodedata.normalize("NFKC", _SKIP.sub(lambda m: "" if unicodedata.category(m[0]) == "Cf" else m[0], token))
    return token.lower()


def _next_visible(text: str, at: int) -> int:
    """Position of the first letter, digit or other mark that isn't a blank, invisible or an opening mark."""
    n = len(text)
    while at < n:
        c = text[at]
        if c.isspace() or _OPENING.match(c) or unicodedata.category(c) == "Cf":
            at += 1
        else:
            break
    return at


def _abbreviation(text: str, start: int, dot: int, nxt: str, follow: str) -> bool:
    """Whether the full stop at `dot` belongs to the token before it. nxt: what follows; follow: its word."""
    raw = _TOKEN.search(text, max(start, dot - _LONGEST), dot)[0]
    token = _clean(raw)
    if not token:
        return False
    upper, lower, digit = nxt.isupper() and not _capitals(text, start, dot), nxt.islower(), nxt.isdigit()
    if "@" in token or "://" in token:
        return lower or digit
    last = token.rsplit(".", 1)[-1]
    if token.isdigit():
        return upper and follow.lower() in MONTHS
    single = len(last) == 1 and last.isalpha()
    if not single and not {token, last} & (BEFORE_NAME | BEFORE_NUMBER | INSIDE):
        return False
    langs = languages(text, start, dot - len(raw), dot)
    begins = upper and any(follow in STARTERS.get(k, "").split() for k in langs)
    inside, onward = _sets("inside", langs), _sets("onward", langs)
    if single:
        if last in ("г", "р", "в", "ж") and not (start < dot - 1 and "." in token):
            before = text[max(start, dot - 6) : dot - 1].rstrip()
            return not (upper and before[-1:].isdigit())
        full = {_spaced(text, start, dot, last), token}
        if full & (inside | onward):
            return not upper or bool(full & onward)
        # A unit behind a number, or a letter that isn't an initial, before what begins a sentence.
        return not (raw[-1:].islower() and (begins or upper and len(token) == 1 and _AFTER_NUMBER.search(text, max(start, dot - 8), dot - 1)))
    if {token, last} & _sets("name", langs):
        return not begins
    if token in _sets("number", langs) and (digit or lower or follow[:1] in "№#§"):
        m = _LAST_WORD.search(text, max(start, dot - 40), dot - len(raw)) if token == "no" else None
        return not (m and _clean(m[1]) in NO_AFTER)
    if token in inside or token in onward:
        return not upper or token in onward
    return False


def _spaced(text: str, start: int, dot: int, last: str) -> str:
    """'т. е.' as 'т.е': joins a single letter with the one before it."""
    m = _TWO_LETTERS.search(text[max(start, dot - 8) : dot])
    return f"{_clean(m[1])}.{last}" if m else last


def spans(text: str) -> list[tuple[int, int]]:
    """[start, end) of each sentence without the blanks around it."""
    ends: list[int] = []
    start, n = 0, len(text)
    for m in _CANDIDATE.finditer(text):
        s, e = m.span()
        if "“" in m[0] and "„" not in text[start:s]:
            e = s + m[0].index("“")  # opens the next sentence
        while e > s and unicodedata.category(text[e - 1]) == "Cf":
            e -= 1
        if e < n and e > start and _ends(text, start, s, e):
            ends.append(e)
            start = e
    if _HAS_THAI.search(text):
        for m in _THAI_GAP.finditer(text):
            w = m[1]
            c = next((c for c in w if not _OPENING.match(c)), "")
            if c and (c.isalpha()) and c not in "ๆฯ" and not any(x.isdigit() for x in w):
                ends.append(m.start())
        ends = sorted(set(ends))
    if "\n" in text:
        ends = sorted(set(ends) | {m.start() for m in _BLANK_LINE.finditer(text) if m.start()})
    out, at = [], 0
    for e in [*ends, n]:
        while at < e and text[at].isspace():
            at += 1
        z = e
        while z > at and text[z - 1].isspace():
            z -= 1
        if z > at:
            out.append((at, z))
        at = e
    return out


def _ends(text: str, start: int, s: int, e: int) -> bool:
    """Whether the terminator and closing marks in [s, e) end the sentence that began at `start`."""
    n = len(text)
    after = e
    while after < n and unicodedata.category(text[after]) == "Cf":
        after += 1
    gap = after < n and text[after].isspace()
    at = _next_visible(text, after)
    if at >= n:
        return False
    nxt = text[at]
    first = text[s]
    closed = _QUOTE.search(text, s, e) is not None
    if not gap and _CONTINUES.match(nxt):
        return False
    if first in ";;":
        # A Greek question mark: Greek before it, and a capital or nothing Greek-like in lower case after it.
        return gap and not nxt.islower() and _GREEK.search(text, max(start, s - 60), s) is not None
    if _needs_no_blank(first):
        if closed and (nxt in "とっ" or _opened_at_start(text, start, s, e)):
            return False
        return True
    dash = _DASH.match(nxt) is not None
    if nxt.islower() or (dash and (gap or closed)):
        if dash:
            k = _next_visible(text, at + 1)
            return k < n and not text[k].islower() and not closed
        return False
    if closed and nxt.isalpha() and (not nxt.isupper() or _capitals(text, start, s)) and _opened_at_start(text, start, s, e):
        return False
    if first == ".":
        if e - s > 1 and text[s:e].startswith(".."):
            return gap
        if not gap and not closed:
            prev = text[s - 1] if s > start else ""
            if nxt.isdigit() or text[after] in "/@_&=#%+\\":
                return False
            if not (nxt.isupper() or (nxt.isalpha() and prev.isalpha() and _caseless(nxt) and _caseless(prev) and not _HAS_THAI.match(nxt))):
                return False
            if prev.isupper():
                return False
        if not closed:
            w = _WORD.match(text, at)
            if _abbreviation(text, start, s, nxt, _clean(w[0]) if w else ""):
                return False
        if _HAS_THAI.match(text[s - 1] if s > start else ""):
            return gap
        return True
    return gap or nxt.isalpha() or nxt.isdigit()


def _capitals(text: str, start: int, end: int) -> bool:
    """Written in capitals throughout, so that a capital says nothing."""
    part = text[start:end]
    return part.upper() == part and sum(c.isupper() for c in part) > 3


def _needs_no_blank(c: str) -> bool:
    """Terminators of scripts that put no blank behind them: wide ones, and the dandas."""
    return c != "…" and (unicodedata.east_asian_width(c) in "WFH" or "DANDA" in unicodedata.name(c, ""))


def _caseless(c: str) -> bool:
    return unicodedata.category(c) in ("Lo", "Lm")


def _opened_at_start(text: str, start: int, s: int, e: int) -> bool:
    """The quotation that closes here was opened where the sentence began: what follows is its reporting clause."""
    k = start
    while k < s and (text[k].isspace() or unicodedata.category(text[k]) == "Cf"):
        k += 1
    if not _OPEN_QUOTE.match(text[k]):
        return False
    return sum(c not in "'‘" and _OPEN_QUOTE.match(c) is not None for c in text[k:s]) == 1


def boundaries(text: str) -> list[int]:
    """Code points before and including the last character of each sentence but the last."""
    return [e for _, e in spans(text)[:-1]]


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))
def sentence_spans(s: pd.Series) -> pd.Series:
    return s.map(lambda t: [] if t is None else [{"start": a, "end": b} for a, b in spans(t)])


def sentence_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """id, sentence, start, end, sentence_text; ordered by `sentence`."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, k, s, e, t[s:e]) for i, t in zip(b["id"], b["t"]) for k, (s, e) in enumerate(spans(t))]
            yield pd.DataFrame(rows, columns=["id", "sentence", "start", "end", "sentence_text"])

    return _input(df, key, text).mapInPandas(run, "id string, sentence int, start int, end int, sentence_text string")


def boundary_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """id, boundary."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, e) for i, t in zip(b["id"], b["t"]) for e in boundaries(t)]
            yield pd.DataFrame(rows, columns=["id", "boundary"])

    return _input(df, key, text).mapInPandas(run, "id string, boundary int")


def _input(df: DataFrame, key: str, text: str) -> DataFrame:
    t: Column = F.col(text)
    return df.select(F.col(key).cast("string").alias("id"), t.alias("t")).where(F.length(F.trim(t)) > 0)
