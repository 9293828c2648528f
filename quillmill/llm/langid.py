"""Language of documents and of the stretches in them: averaged hashed subword embeddings with a linear softmax.

A text is the mean of the embeddings of its subwords (character n-grams of each word with its ends marked, hashed to
BINS rows); a linear layer and a softmax give the languages. Embeddings and layer are trained together by stochastic
gradient descent in numpy, on about SAMPLE_ROWS labelled rows (a documented bound: rows are taken by the hash of
their id over the whole table, about the same number of each language, and of each row TRAIN_WORDS words, at a place
anywhere in the text that its hash gives). One task of an executor trains; only the model reaches the driver. Labels are noisy, so after a
first training the rows whose label the model finds unlikely are left out and it is trained again. On held-out rows a temperature is fitted and, at PRECISION, the
confidence below which an answer is rejected as 'und'.

After training embedding and layer collapse to one row of scores for each word, which a task remembers, so applying the
model is a sum over words. Languages are decided by sentence; neighbouring sentences of one language make a segment.

Defined results: null, empty and wordless texts have no segments; a text whose sentences are all rejected is judged as
a whole, and if that is rejected too its language is 'und'; ties go to the language that is first in the alphabet.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.llm import sentences

BINS = 1 << 16
DIM = 16
SAMPLE_ROWS = 11_200  # the same number for each language the hints name
TRAIN_WORDS = 40  # of each sampled row, at a place anywhere in its text
EPOCHS = 10
BATCH = 128
RATE = 0.1
PRECISION = 0.995
CACHED_WORDS = 150_000
SEGMENTS = "id string, segment int, start int, end int, lang string, confidence double, hint string"

#: ISO 639 codes of two and three letters and English names of the languages that can be told apart.
NAMES = {
    "ar": "ara arabic", "de": "deu ger german", "el": "ell gre greek", "en": "eng english", "es": "spa spanish castilian", "fr": "fra fre french",
    "hi": "hin hindi", "ja": "jpn japanese", "kk": "kaz kazakh", "ko": "kor korean", "pt": "por portuguese", "ru": "rus russian", "th": "tha thai",
    "tr": "tur turkish", "uk": "ukr ukrainian", "zh": "zho chi chinese mandarin",
}
BY_NAME = {n: k for k, v in NAMES.items() for n in [k, *v.split()]}

#: Runs that are words: letters with their marks; scripts without blanks are cut to single characters by subwords().
_WORD = regex.compile(r"[\p{L}\p{M}][\p{L}\p{M}’'’-]*")
_CODE = re.compile(r"(?:\b[^\W\d_]{1,3}[-/_]?)?\d[\d/.,_-]*")
_ADDRESS = re.compile(r"\S+@\S+|\w+://\S+")
_MIXED = re.compile(r"[\d@]|://")
_DENSE = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]")
#: Words that go with the number of a page.
_PAGE_WORDS = set(
    "page pages pg p pp of sur from s seite seiten von blatt bl лист листа листов из стр страница с бет беті sayfa sf pág pag página hoja folio f σελ σελίδα "
    "από หน้า ที่ จาก 第 页 頁 頁中 共 쪽 면 페이지 पृष्ठ पृ का से صفحة ص من сторінка стор арк аркуш з n no № nr de do da".split()
)
_PARTS = re.compile("[-’']")
_ROMAN = regex.compile(r"[ivxlcdm]+")


def hint_language(hint: str | None) -> str | None:
    """The two-letter code a hint names: a code of two or three letters, with or without a region, or an English name."""
    if not isinstance(hint, str):
        return None
    h = hint.strip().lower()
    return BY_NAME.get(h) or BY_NAME.get(regex.split(r"[-_]", h)[0])


def hint_column(c: Column) -> Column:
    """The same inside the JVM."""
    low = F.lower(F.trim(c))
    table = F.create_map(*[F.lit(x) for kv in BY_NAME.items() for x in kv])
    return F.coalesce(F.try_element_at(table, low), F.try_element_at(table, F.regexp_extract(low, "^[^-_]*", 0)))


def subwords(word: str) -> list[int]:
    """Bins of the n-grams of 1 to 4 characters of a lower-case word; of dense scripts 1 and 2; and of its Unicode block."""
    dense = _DENSE.search(word) is not None
    w = word if dense else f"<{word}>"
    most = 2 if dense else 4
    grams = [w[i : i + n] for n in range(1, most + 1) for i in range(len(w) - n + 1)]
    if not dense:
        grams.append(f"<{word}>#")
    grams.append(f"block {ord(word[0]) >> 7}")
    return [zlib.crc32(g.encode("utf-8", "surrogatepass")) % BINS for g in grams]


def evidence(word: str) -> float:
    """Words that a run counts for where a number of words is asked for: of scripts without blanks, two characters make one."""
    return max(1.0, len(_DENSE.findall(word)) / 2)


def words(text: str) -> list[str]:
    """Lower-case words without codes, addresses and numbers; long runs of dense scripts are cut to eight characters."""
    low = text.lower()
    if (mixed := _MIXED.search(low)) and not _DENSE.search(low):
        if not mixed[0].isdigit() or "@" in low or "://" in low:
            low = _ADDRESS.sub(" ", low)
        low = _CODE.sub(" ", low)
    got = _WORD.findall(low)
    if got and max(map(len, got)) > 24 and _DENSE.search(low):
        got = [w[i : i + 8] for w in got for i in range(0, len(w), 8)]
    return got


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # BINS x languages: embedding times layer
    bias: np.ndarray
    temperature: float = 1.0
    reject: float = 0.5

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer:
    """Sums of score rows by word, remembered. The last two columns are the word's n-grams and its evidence."""

    def __init__(self, m: Model):
        self.m = m
        self.slot: dict[str, int] = {}
        self.rows = np.zeros((4096, len(m.langs) + 2), dtype=np.float32)

    def _slot(self, w: str) -> int:
        n = len(self.slot)
        if n >= len(self.rows):
            self.rows = np.concatenate((self.rows, np.zeros_like(self.rows)))
        ids = subwords(w)
        self.rows[n, :-2] = self.m.table[ids].sum(0)
        self.rows[n, -2:] = len(ids), evidence(w)
        self.slot[w] = n
        return n

    def probabilities(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Of each text, given as words: languages, and how many words it counts for (see evidence())."""
        if len(self.slot) > CACHED_WORDS:
            self.slot.clear()
        known, slot = self.slot, self._slot
        flat = [known[w] if w in known else slot(w) for ws in texts for w in ws]
        count = np.array([len(ws) for ws in texts], dtype=np.int64)
        out, weight = np.zeros((len(texts), len(self.m.langs))), np.zeros(len(texts))
        some = np.flatnonzero(count)
        if len(some):
            starts = np.concatenate(([0], np.cumsum(count[some])[:-1]))
            s = np.add.reduceat(self.rows[np.array(flat, dtype=np.int64)], starts, axis=0)
            z = (s[:, :-2] / s[:, -2:-1] + self.m.bias) / self.m.temperature
            e = np.exp(z - z.max(1, keepdims=True))
            out[some], weight[some] = e / e.sum(1, keepdims=True), s[:, -1]
        return out, weight


def _batches(n: int, size: int, rng: np.random.Generator) -> Iterator[np.ndarray]:
    order = rng.permutation(n)
    yield from (order[i : i + size] for i in range(0, n, size))


def fit(texts: list[list[str]], labels: list[str], seed: int = 7) -> Model:
    """texts as words. Trains, leaves out unlikely labels, trains again, calibrates on every tenth row."""
    langs = sorted(set(labels))
    y = np.array([langs.index(x) for x in labels], dtype=np.int64)
    cache: dict[str, list[int]] = {}
    feats = []
    for ws in texts:
        f: list[int] = []
        for w in ws:
            if w not in cache:
                cache[w] = subwords(w)
            f += cache[w]
        feats.append(np.array(f, dtype=np.int64))
    held = np.arange(len(y)) % 10 == 9
    use = np.flatnonzero(~held)
    m = _sgd([feats[i] for i in use], y[use], len(langs), seed, EPOCHS // 2)
    p = _apply(m, [feats[i] for i in use])
    trusted = p[np.arange(len(use)), y[use]] > 0.5 * p.max(1)
    use = use[trusted] if trusted.sum() > len(langs) else use
    table, bias = m = _sgd([feats[i] for i in use], y[use], len(langs), seed + 1)
    model = Model(langs, table, bias)
    if held.sum() > 50:
        z = np.log(_apply(m, [feats[i] for i in np.flatnonzero(held)]) + 1e-30)
        yh = y[held]
        ok = z[np.arange(len(yh)), yh] > z.max(1) + np.log(0.05)  # rows whose label is plainly wrong say nothing here
        z, yh = z[ok], yh[ok]
        best = min(np.geomspace(0.1, 4, 24), key=lambda t: -_log_softmax(z / t)[np.arange(len(yh)), yh].mean())
        model.temperature = float(best)
        q = np.exp(_log_softmax(z / best))
        conf, right = q.max(1), q.argmax(1) == yh
        order = np.argsort(-conf)
        good = np.flatnonzero(np.cumsum(right[order]) / np.arange(1, len(order) + 1) >= PRECISION)
        model.reject = float(np.clip(conf[order][good[-1]] if len(good) else 0.9, 0.3, 0.9))
    return model


def _log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(1, keepdims=True)
    return z - np.log(np.exp(z).sum(1, keepdims=True))


def _apply(m: tuple[np.ndarray, np.ndarray], feats: list[np.ndarray]) -> np.ndarray:
    z = np.stack([m[0][f].mean(0) + m[1] if len(f) else m[1] for f in feats])
    return np.exp(_log_softmax(z))


def _sgd(feats: list[np.ndarray], y: np.ndarray, k: int, seed: int, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """Mini-batches of BATCH rows; steps are scaled by the gradients so far of each embedding row and of the layer
    (Adagrad), because averaged features give rare subwords tiny gradients. Gives table and bias."""
    rng = np.random.default_rng(seed)
    emb = rng.uniform(-1 / DIM, 1 / DIM, (BINS, DIM)).astype(np.float32)
    emb_sq = np.full(BINS, 1e-10, dtype=np.float32)
    w = rng.normal(0, 0.1, (DIM, k)).astype(np.float32)
    w_sq = np.full((DIM, k), 1e-8, dtype=np.float32)
    bias = np.zeros(k, dtype=np.float32)
    size = np.array([len(f) for f in feats])
    good = np.flatnonzero(size)
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs)
        for part in _batches(len(good), BATCH, rng):
            rows = good[part]
            ids = np.concatenate([feats[i] for i in rows])
            n = size[rows]
            starts = np.concatenate(([0], np.cumsum(n)[:-1]))
            h = np.add.reduceat(emb[ids], starts, axis=0) / n[:, None]
            g = np.exp(_log_softmax(h @ w + bias))
            g[np.arange(len(rows)), y[rows]] -= 1
            g /= len(rows)
            dh = (g @ w.T) / n[:, None]
            dw = h.T @ g
            w_sq += dw * dw
            w -= rate * dw / np.sqrt(w_sq)
            bias -= rate * 0.1 * g.sum(0)
            seg = np.repeat(np.arange(len(rows)), n)
            u, inv = np.unique(ids, return_inverse=True)
            step = np.stack([np.bincount(inv, weights=dh[seg, d], minlength=len(u)) for d in range(DIM)], 1)
            emb_sq[u] += (step * step).mean(1)
            emb[u] -= rate * step / np.sqrt(emb_sq[u])[:, None]
    return emb @ w, bias


def shares(counts: dict[str, int], sample: int) -> dict[str, float]:
    """Of each language the share of its labelled rows that is sampled: an equal number of each, or all."""
    return {k: min(1.0, sample / len(counts) / n) for k, n in counts.items()}


def sampled(key: Column, lang: Column, share: dict[str, float]) -> Column:
    """Whether a row is in the sample: its hash, as a number in [0, 1), is below the share of its language."""
    place = F.pmod(F.xxhash64(key), F.lit(1 << 62)).cast("double") / float(1 << 62)
    return place < F.create_map(*[F.lit(x) for kv in share.items() for x in kv])[lang]


def drawn(text: str, most: int = TRAIN_WORDS) -> list[str]:
    """Words of a text to train on: all, or `most` neighbouring ones, which are more likely of one language, at a place
    that the hash of the text gives."""
    ws = words(text)
    if len(ws) <= most:
        return ws
    at = zlib.crc32(text.encode("utf-8", "surrogatepass")) % (len(ws) - most + 1)
    return ws[at : at + most]


def train(labelled: DataFrame, key: str, text: str, hint: str, sample: int = SAMPLE_ROWS) -> Model:
    """labelled: rows whose hint may name a language. About `sample` of them, as many of each language as there are up to
    an equal share, chosen over the whole table by the hash of the key, train the model in one task. The share is a double
    over 62 bits of hash, so the sample keeps its size whatever the number of rows; copies of a row count once."""
    x = labelled.select(F.col(key).cast("string").alias("k"), F.col(text).alias("t"), hint_column(F.col(hint)).alias("lang")).where("lang is not null")
    count = {r["lang"]: r["count"] for r in x.groupBy("lang").count().collect()}  # at most one row for each name known
    none = Model(["und"], np.zeros((BINS, 1), np.float32), np.zeros(1, np.float32))
    if not count:
        return none
    x = x.where(sampled(F.col("k"), F.col("lang"), shares(count, sample))).where("t is not null").distinct()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pdf = pd.concat([b for b in batches if len(b)] or [pd.DataFrame(columns=["k", "t", "lang"])]).sort_values(["k", "t", "lang"], kind="stable")
        ws = [drawn(t) for t in pdf["t"]]
        keep = [i for i, w in enumerate(ws) if w]
        langs = pdf["lang"].tolist()
        if keep:
            yield pd.DataFrame({"model": [pickle.dumps(fit([ws[i] for i in keep], [langs[i] for i in keep]))]})

    got = x.repartition(1).mapInPandas(run, "model binary").collect()
    return pickle.loads(bytes(got[0][0])) if got else none


def wordless(text: str) -> bool:
    """Bare numbers, codes and lines that only number a page."""
    t = text.strip()
    if len(t) >= 40:
        return False
    t = t.lower()
    # A word may stand next to its number: '9-бет', 'xiv-бет'.
    got = [x for w in _WORD.findall(t) for x in _PARTS.split(w) if x]
    if len(got) <= 4 and (any(c.isdigit() for c in t) or any(_ROMAN.fullmatch(x) for x in got)):
        return all(x in _PAGE_WORDS or _ROMAN.fullmatch(x) for x in got) or not words(t)
    return not words(t)


def segments(df: DataFrame, key: str, text: str, hint: str | None, model: Model, least_words: int = 3) -> DataFrame:
    """SEGMENTS of every text that has words. The hint is carried along as the code it names; it doesn't sway the language."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = sent.value.scorer()
        for b in batches:
            for lo in range(0, len(b), 2000):
                part = b.iloc[lo : lo + 2000]
                rows = label(range(len(part)), part["t"], scorer, least_words)
                out = pd.DataFrame(rows, columns=["id", "segment", "start", "end", "lang", "confidence"])
                at = out["id"].to_numpy(dtype=np.int64)
                yield out.assign(id=part["id"].to_numpy(dtype=object)[at], hint=part["hint"].to_numpy(dtype=object)[at])

    named = F.lit(None).cast("string") if hint is None else hint_column(F.col(hint))
    x = df.select(F.col(key).cast("string").alias("id"), F.col(text).alias("t"), named.alias("hint")).where(F.length(F.trim("t")) > 0)
    return x.mapInPandas(run, SEGMENTS)


def label(ids, texts, scorer: Scorer, least_words: int) -> list[tuple]:
    """Sentences of all texts are scored together."""
    spans: list[list[tuple[int, int]]] = []
    flat: list[list[str]] = []
    for t in texts:
        if wordless(t):
            spans.append([])
            continue
        sp = sentences.spans(t)
        spans.append(sp)
        flat += [words(t[s:e]) for s, e in sp]
    p, n = scorer.probabilities(flat)
    m = scorer.m
    best, conf = p.argmax(1) if len(p) else np.zeros(0, int), p.max(1) if len(p) else np.zeros(0)
    sure = (conf >= m.reject) & (n >= least_words)
    out: list[tuple] = []
    whole: list[tuple] = []
    at = 0
    for i, t, sp in zip(ids, texts, spans):
        k = len(sp)
        s, c, l, nn = sure[at : at + k], conf[at : at + k], best[at : at + k], n[at : at + k]
        if k and not nn.any():
            k0 = at
            at = k0 + k
            continue
        if k and not s.any():
            whole.append((i, sp[0][0], sp[-1][1], [w for x in flat[at : at + k] for w in x]))
        elif k:
            # Sentences that aren't sure follow the nearest sure one before, at the start the first one after.
            idx = np.flatnonzero(s)
            owner = idx[np.maximum(np.searchsorted(idx, np.arange(k), "right") - 1, 0)]
            lang = l[owner]
            edge = np.flatnonzero(np.concatenate(([True], lang[1:] != lang[:-1])))
            for j, (a, z) in enumerate(zip(edge, [*edge[1:], k])):
                sel = s[a:z]
                out.append((i, j, sp[a][0], sp[z - 1][1], m.langs[lang[a]], float(c[a:z][sel].mean())))
        at += k
    if whole:
        p, n = scorer.probabilities([w for *_, w in whole])
        for (i, s, e, w), q in zip(whole, p):
            c = float(q.max())
            out.append((i, 0, s, e, m.langs[int(q.argmax())] if c >= m.reject else "und", c))
    return out
