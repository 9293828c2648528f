"""Evaluation texts leaking into training text: an FM-index for each shard of the corpus.

Words (divided by blanks) are compared without letter case, punctuation and look-alike characters; what has no letter or
digit is no word. build() indexes all words of all texts once: a task gathers the texts of its rows up to SHARD_SYMBOLS
words, gives the words of the shard codes of their own, builds suffix array, Burrows-Wheeler transform and wavelet matrix and
keeps the bit planes of the matrix, sampled suffix positions and the shard's words as one row of a table. Texts of the
same words are indexed once in a shard and found for each of their rows. search() takes any set of items to such a
table: every run of PHRASE consecutive words of an item is a phrase; phrases with a word that a shard doesn't have can't be
in it; the others are searched backward together through the ranks of the matrix, their occurrences located by the sampled
positions and merged to spans. An index serves any number of item sets.

Items reach the tasks in blocks of about BLOCK_CHARS characters, one pass over the index (not the texts) for each block, so what
is broadcast has a bound; only an item longer than that is sent in a larger one.

Defined results: null and empty texts hold nothing; items with fewer than PHRASE words can't leak; equal items leak
together; repeated documents are reported one by one; a null id stays null; empty tables give no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.llm import lookalike
from quillmill.runtime import written

PHRASE = 12
SAMPLE = 16
SHARD_SYMBOLS = 1_000_000
BLOCK_CHARS = 20_000_000
CACHED_WORDS = 400_000
HITS = "doc_id long, item_id long, start_word int, end_word int"
INDEX = (
    "symbols long, bits int, words binary, planes binary, marks binary, samples binary, starts binary, first_doc binary, docs array<string>"
)
SEPARATOR, FIRST_WORD = 1, 2

_NOT_WORD = regex.compile(r"[^\p{L}\p{N}\p{M}]+")


def plain_word(w: str) -> str:
    """The form in which words are compared; empty if it is no word."""
    return _NOT_WORD.sub("", lookalike.universal(True).word(w))


def plain_words(text: str | None) -> list[str]:
    return [x for w in (text or "").split() if (x := plain_word(w))]


class Phrases:
    """Of a block of items: their words, distinct phrases as rows of word numbers, and the items of each."""

    def __init__(self, items: list[tuple[int, str]], length: int = PHRASE):
        self.length = length
        number: dict[str, int] = {}
        owners: dict[tuple[int, ...], set[int]] = {}
        for item, text in items:
            words = [number.setdefault(w, len(number)) for w in plain_words(text)]
            for i in range(len(words) - length + 1):
                owners.setdefault(tuple(words[i : i + length]), set()).add(item)
        self.words = list(number)
        self.rows = np.array(list(owners), dtype=np.int64).reshape(-1, length)
        self.owners = [sorted(v) for v in owners.values()]


def _order(key: np.ndarray, bits: int) -> np.ndarray:
    """Like argsort; where key and place fit one number, sorting these is faster."""
    b = max(1, len(key).bit_length())
    if bits + b > 62:
        return np.argsort(key, kind="stable")
    return np.sort((key << b) | np.arange(len(key))) & ((1 << b) - 1)


def suffix_array(t: np.ndarray) -> np.ndarray:
    """By prefix doubling, in each round only within the groups that aren't told apart yet; t ends with a symbol that is
    smaller than all others and occurs once."""
    n = len(t)
    place = np.arange(n)
    sym, bits = int(t.max()).bit_length(), n.bit_length()
    key = (t.astype(np.int64) << sym) | np.append(t[1:], 0)
    sa = _order(key, 2 * sym)
    new = np.concatenate(([True], np.diff(key[sa]) != 0))
    rank = np.empty(n, dtype=np.int64)
    rank[sa] = np.maximum.accumulate(np.where(new, place, 0))
    k = 2
    while True:
        at = np.flatnonzero(~(new & np.append(new[1:], True)))
        if not len(at):
            return sa
        own = sa[at]
        key = (rank[own] << bits) | rank[own + k]
        o = _order(key, 2 * bits)
        sa[at], key = own[o], key[o]
        new[at] = np.concatenate(([True], np.diff(key) != 0))
        rank[sa[at]] = np.maximum.accumulate(np.where(new[at], at, 0))
        k *= 2


class WaveletMatrix:
    """rank and access over a sequence of small numbers, vectorised over queries. planes: of each bit, the highest first, the
    bits in the order of the matrix."""

    def __init__(self, planes: list[np.ndarray]):
        self.bits = len(planes)
        self.ones = [np.concatenate(([0], np.cumsum(b, dtype=np.int32))).astype(np.int32) for b in planes]
        self.zeros = [len(b) - int(c[-1]) for b, c in zip(planes, self.ones)]

    @staticmethod
    def planes(seq: np.ndarray) -> list[np.ndarray]:
        out = []
        s = seq.astype(np.int32)
        for b in range(max(1, int(seq.max()).bit_length()) - 1, -1, -1):
            bit = ((s >> b) & 1).astype(np.uint8)
            out.append(bit)
            s = np.concatenate((s[bit == 0], s[bit == 1]))
        return out

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each position."""
        lo, hi = np.zeros_like(at), at.copy()
        for k in range(self.bits):
            one = ((symbol >> (self.bits - 1 - k)) & 1).astype(bool)
            c, z = self.ones[k], self.zeros[k]
            lo, hi = np.where(one, z + c[lo], lo - c[lo]), np.where(one, z + c[hi], hi - c[hi])
        return hi - lo

    def access(self, at: np.ndarray) -> np.ndarray:
        sym, p = np.zeros_like(at), at.copy()
        for k in range(self.bits):
            c, z = self.ones[k], self.zeros[k]
            one = (c[p + 1] - c[p]).astype(bool)
            sym = (sym << 1) | one
            p = np.where(one, z + c[p], p - c[p])
        return sym


class FMIndex:
    """Over codes from 1 up, without a sentinel: FMIndex.of(codes)."""

    def __init__(self, planes: list[np.ndarray], marks: np.ndarray, samples: np.ndarray):
        self.n = len(marks)
        self.matrix = WaveletMatrix(planes)
        self.marks = np.concatenate(([0], np.cumsum(marks, dtype=np.int64)))
        self.samples = samples
        self.planes, self.marked = planes, marks
        top = 1 << len(planes)
        # How many symbols are smaller than each: what the ranks of all symbols at the end add up to.
        every = np.arange(top, dtype=np.int64)
        self.before = np.concatenate(([0], np.cumsum(self.matrix.rank(every, np.full(top, self.n, dtype=np.int64)))))

    @classmethod
    def of(cls, t: np.ndarray) -> FMIndex:
        t = np.concatenate((t, [0]))
        sa = suffix_array(t)
        marks = sa % SAMPLE == 0
        return cls(WaveletMatrix.planes(t[sa - 1]), marks, sa[marks])

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [lo, hi) of the suffix array for each phrase."""
        lo = np.zeros(len(phrases), dtype=np.int64)
        hi = np.full(len(phrases), self.n, dtype=np.int64)
        for j in range(phrases.shape[1] - 1, -1, -1):
            on = np.flatnonzero(hi > lo)
            sym = phrases[on, j]
            known = sym < len(self.before) - 1
            hi[on[~known]] = lo[on[~known]]
            on, sym = on[known], sym[known]
            base = self.before[sym]
            lo[on], hi[on] = base + self.matrix.rank(sym, lo[on]), base + self.matrix.rank(sym, hi[on])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions: steps back to the next sampled one."""
        at, out = rows.astype(np.int64).copy(), np.zeros(len(rows), dtype=np.int64)
        todo = np.arange(len(rows))
        for step in range(SAMPLE):
            p = at[todo]
            hit = (self.marks[p + 1] - self.marks[p]).astype(bool)
            out[todo[hit]] = self.samples[self.marks[p[hit]]] + step
            todo = todo[~hit]
            if not len(todo):
                break
            p = at[todo]
            sym = self.matrix.access(p)
            at[todo] = self.before[sym] + self.matrix.rank(sym, p)
        return out


class Shard:
    """Texts of one shard, as codes of its own words."""

    def __init__(self) -> None:
        self.code: dict[str, int] = {}
        self.docs: dict[bytes, list[str | None]] = {}
        self.size = 0

    def add(self, doc: str | None, words: list[str]) -> None:
        code = self.code
        t = np.fromiter((code.setdefault(w, len(code) + FIRST_WORD) for w in words), dtype=np.int32, count=len(words)).tobytes()
        if t in self.docs:
            self.docs[t].append(doc)
        else:
            self.docs[t] = [doc]
            self.size += len(words) + 1

    def row(self) -> tuple:
        texts = [np.frombuffer(t, dtype=np.int32) for t in self.docs]
        starts = np.cumsum([0] + [len(t) + 1 for t in texts])[:-1]
        index = FMIndex.of(np.concatenate([np.append(t, SEPARATOR) for t in texts]).astype(np.int64))
        first = np.cumsum([0] + [len(d) for d in self.docs.values()])
        return (
            index.n, len(index.planes), zlib.compress("\n".join(self.code).encode("utf-8", "surrogatepass"), 1), b"".join(np.packbits(b).tobytes() for b in index.planes), np.packbits(index.marked).tobytes(),
            index.samples.astype(np.int32).tobytes(), starts.astype(np.int32).tobytes(), first.astype(np.int32).tobytes(), [d for ds in self.docs.values() for d in ds],
        )


def build(docs: DataFrame, shard_symbols: int = SHARD_SYMBOLS) -> DataFrame:
    """docs: doc_id, text. INDEX, one row for each shard; write it to use it more than once. A text longer than a shard has one
    of its own."""
    names = [f.split(" ")[0] for f in INDEX.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        plain = _Plain()
        shard = Shard()
        for b in batches:
            for doc, text in zip(b["doc_id"], b["text"]):
                words = [x for w in text.split() if (x := plain[w])]
                if not words:
                    continue
                if shard.size and shard.size + len(words) > shard_symbols:
                    yield pd.DataFrame([shard.row()], columns=names)
                    shard = Shard()
                shard.add(doc, words)
        if shard.size:
            yield pd.DataFrame([shard.row()], columns=names)

    return docs.where("text is not null").select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(run, INDEX)


class _Plain(dict):
    """Raw word -> the form in which it is compared, remembered."""

    def __missing__(self, w: str) -> str:
        if len(self) > CACHED_WORDS:
            self.clear()
        x = self[w] = plain_word(w)
        return x


def _hits(r: pd.Series, ph: Phrases) -> list[tuple[str | None, int, int, int]]:
    """A row of INDEX -> (doc, item, start_word, end_word), spans of one item merged."""
    code = {w: i + FIRST_WORD for i, w in enumerate(zlib.decompress(r["words"]).decode("utf-8", "surrogatepass").split("\n"))}
    own = np.array([code.get(w, 0) for w in ph.words], dtype=np.int64)
    rows = own[ph.rows]
    can = np.flatnonzero((rows > 0).all(1))
    if not len(can):
        return []
    n = int(r["symbols"])
    size = -(-n // 8)
    planes = [np.unpackbits(np.frombuffer(r["planes"], dtype=np.uint8, count=size, offset=k * size))[:n] for k in range(int(r["bits"]))]
    index = FMIndex(planes, np.unpackbits(np.frombuffer(r["marks"], dtype=np.uint8))[:n], np.frombuffer(r["samples"], dtype=np.int32))
    starts, first = np.frombuffer(r["starts"], dtype=np.int32), np.frombuffer(r["first_doc"], dtype=np.int32)
    lo, hi = index.search(rows[can])
    found = np.flatnonzero(hi > lo)
    if not len(found):
        return []
    which = np.repeat(can[found], (hi - lo)[found])
    pos = index.locate(np.concatenate([np.arange(lo[f], hi[f]) for f in found]))
    text = np.searchsorted(starts, pos, "right") - 1
    spans: dict[tuple[int, int], list[int]] = {}
    for f, i, p in zip(which.tolist(), text.tolist(), (pos - starts[text]).tolist()):
        for item in ph.owners[f]:
            spans.setdefault((i, item), []).append(p)
    out = []
    for (i, item), at in spans.items():
        for a, z in _merged(sorted(at), ph.length):
            out += [(doc, item, a, z) for doc in r["docs"][first[i] : first[i + 1]]]
    return out


def _merged(at: list[int], length: int) -> list[tuple[int, int]]:
    """Spans of `length` from each place, joined where they touch."""
    out = [[at[0], at[0] + length]]
    for p in at[1:]:
        if p <= out[-1][1]:
            out[-1][1] = p + length
        else:
            out.append([p, p + length])
    return [(a, z) for a, z in out]


def search(index: DataFrame, items: DataFrame, length: int = PHRASE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """index: of build(), written; items: item_id, item_text. HITS: spans in words (those that have a letter or digit)."""
    x = items.select(F.col("item_id").cast("long").alias("item_id"), "item_text").where("item_text is not null")
    chars = x.agg(F.sum(F.length("item_text"))).first()[0] or 0
    blocks = max(1, -(-chars // block_chars))
    out = None
    for k in range(blocks):
        own = x.where(F.pmod(F.xxhash64("item_id", "item_text"), F.lit(blocks)) == k) if blocks > 1 else x
        ph = Phrases([(r[0], r[1]) for r in own.distinct().collect()], length)
        part = _search(index, ph)
        out = part if out is None else out.unionByName(part)
    return out


def _search(index: DataFrame, ph: Phrases) -> DataFrame:
    sent = index.sparkSession.sparkContext.broadcast(ph)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [h for _, r in b.iterrows() for h in _hits(r, sent.value)]
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "start_word", "end_word"])

    hits = index.mapInPandas(run, "doc_id string, item_id long, start_word int, end_word int")
    return hits.select(F.col("doc_id").cast("long").alias("doc_id"), "item_id", "start_word", "end_word")


def leaks(docs: DataFrame, items: DataFrame, length: int = PHRASE) -> DataFrame:
    """HITS of the items in the texts of docs, through an index of all of them that is written first."""
    return search(written(build(docs), "fm"), items, length)


def removal_spans(docs: DataFrame, hits: DataFrame) -> DataFrame:
    """doc_id, start, end in code points, spans of all items merged: what to take out of each document."""
    spans = hits.groupBy("doc_id").agg(F.collect_set(F.struct("start_word", "end_word")).alias("w"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc, text, w in zip(b["doc_id"], b["text"], b["w"]):
                at = [m.span() for m in regex.finditer(r"\S+", text) if plain_word(m.group())]
                merged: list[list[int]] = []
                for s, e in sorted((x["start_word"], x["end_word"]) for x in w):
                    if merged and s <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], e)
                    else:
                        merged.append([s, e])
                rows += [(doc, at[s][0], at[e - 1][1]) for s, e in merged]
            yield pd.DataFrame(rows, columns=["doc_id", "start", "end"])

    return docs.select("doc_id", "text").join(spans, "doc_id").mapInPandas(run, "doc_id long, start int, end int")
