"""Text cut off by field limits or by transfers that stopped.

Per source a log-normal distribution of lengths is fitted by maximum likelihood to the histogram of its lengths, once in
code points and once in bytes of UTF-8, with the values at candidate limits right-censored (an EM iteration: a censored
value counts with its expected log length). Candidate limits are lengths that occur far more often than the fit allows
and above which hardly anything lies; a limit in bytes leaves values up to three bytes below it, where a character
didn't fit. The posterior that a value at a limit was censored is one minus the number expected there without a limit
over the number seen.

The ending of a text (a mark of omission, a running sentence, an abbreviation, a structured last line, a whole
sentence, ...) is evidence, and what it is worth is estimated, not set. Every text is also cut once at a place given by its
hash: how such cuts end is how cut texts end, but for the marks some fields add. An EM over the values at limits (prior:
the censoring posterior) and away from them settles the share of marks, which can only be learned at limits, how whole
texts end, and how many are cut away from limits. Each source then has its own mixture for each of its limits and for
the rest, drawn to the common one by PSEUDO rows: a limit at which many whole sentences end says less about a whole
sentence there than one without. The verdict is the sign of the posterior log odds.

Away from limits a source may lose at most MOST_OFF of its texts: one that ends openly more often (by more than a few
texts) has texts that end so, and of them only those at a limit can be cut.
In scripts that use no full stop a last stretch counts as complete if stretches inside the corpus end the same way.

Only length and last line (whole, however long) leave the scan; histograms have a row for each length of a source, the
endings one for each way a stretch ends. No text is gathered.

Defined results: null, empty and blank texts aren't cut; a null source is a source of its own; equal texts get equal
answers within a source; with no limit in the corpus the endings decide alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import erfc, sqrt

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.llm import sentences
from quillmill.runtime import written

#: Kinds of endings. What is blank is never cut.
KINDS = ("mark", "open", "dangling", "abbreviated", "list", "structured", "complete", "unstopped", "unstopped_open")
#: Lengths that fields limit, and how many units below its limit a cut value may end.
MEASURES = {"chars": 0, "bytes": 3}
MARK = KINDS.index("mark")
LEAST_AT_LIMIT = 4
ABOVE = 0.25  # of the values expected above a limit, so many may lie there (from before it was set)
ENDING_CHARS = 5
SIMULATED = "simulated"
PSEUDO = 20.0  # rows that a common estimate counts for beside a source's own
MARKED = 0.01  # of all cuts, the share that has got a mark before anything is known
LEAST_SHARE = 1e-5  # of an ending that no whole text shows
MOST_OFF = 0.5
ROUNDS = 60

_MARK = regex.compile(r"\s*(?:[\[(<{]\s*)?(?:…|\.\.\.+|(?<=[\[(<{]\s*)(?:truncated|cut|cut off|continued|more|snip))\s*(?:[\])>}])?\s*\Z", regex.I)
_STRUCTURED = regex.compile(
    r"""\s*(?:
      \|.*\|? | .*\w\s*\|\s*\S.*                                   # table
    | \S*\w+://\S+ | \S+@\S+\.\w+ | www\.\S+                         # link
    | [—–-]{1,2}\s*[\p{L}\p{M}.'’ -]{1,60}?\s*[—–-]{1,2} | [—–]\s*(?:[\p{Lu}\p{Lo}][\p{L}\p{M}.'’-]*\s*){1,3}   # signature after a dash
    | [\p{L}\p{M}.'’-]+(?:\s+[\p{L}\p{M}.'’-]+){0,2}\s*[,/]\s*(?:\d[\d./-]+|[\p{L}\p{M}.'’-]+(?:\s+[\p{L}\p{M}.'’-]+){0,2})   # name, date or name / name
    | [\[(]?\s*[\d\s.,:/-]+\s*[\])]?                                 # number
    | (?:[-*•·]\s+)?[\p{Lu}]{1,4}[-/]?\d[\d/-]*                      # code
    )\s*\Z""",
    regex.X,
)
_LIST = regex.compile(r"\s*(?:[-*•·‣]|\d{1,3}[.)]|\p{L}[.)])\s+\S")
_CLOSED = regex.compile(r"[\p{Sentence_Terminal};;:]\p{Cf}*[)\]}»”’'\"“›』」）］】》\p{Cf}]*(?:\s»)?[.。]?\s*\Z")
_UNSTOPPED = regex.compile(r"[\p{Thai}\p{Lao}]")
_GAP = r"(?<=[฀-໿])\s+(?=[^\s\dA-Z])"


def ending(line: str) -> str:
    """The kind of ending that a last line shows."""
    t = line.strip()
    if not t:
        return "blank"
    if _MARK.search(t):
        return "mark"
    if _STRUCTURED.match(t):
        return "structured"
    if _CLOSED.search(t):
        if t.endswith(".") and (k := _abbreviated(t)):
            return k
        return "list" if t.endswith(":") else "complete"
    if _UNSTOPPED.search(t[-12:]):
        return "unstopped"
    if _LIST.match(t):
        return "list"
    return "open"


def _abbreviated(t: str) -> str:
    """Of a text that ends with a full stop: 'dangling' after an abbreviation that calls for a name, a number or an explanation,
    or a single initial; 'abbreviated' after one that may also end a sentence; else empty."""
    token = sentences._TOKEN.search(t, max(0, len(t) - 25), len(t) - 1)[0]
    w = sentences._clean(token)
    last = w.rsplit(".", 1)[-1]
    if w.isdigit() or not last or last.isdigit():
        return ""
    full = sentences._spaced(t, 0, len(t) - 1, last) if len(last) == 1 else w
    if w in sentences.INSIDE or full in sentences.INSIDE:
        return "dangling" if w in sentences.ONWARD or full in sentences.ONWARD else "abbreviated"
    if last in ("г", "м", "m") and len(t) > 8 and t[-3:-2].isdigit():
        return "abbreviated"
    calls = len(last) == 1 and last.isalpha() and not sentences._caseless(last) or last in sentences.BEFORE_NAME or last in sentences.BEFORE_NUMBER
    return "dangling" if calls else ""


def fit_source(length: np.ndarray, count: np.ndarray, slack: int = 0) -> tuple[float, float, dict[int, tuple[int, float]]]:
    """mu and sigma of log lengths, and of each limit found the number of values at it and the posterior of censoring.
    slack: values up to so far below a limit are at it."""
    keep = length > 0
    order = np.argsort(length[keep], kind="stable")
    length, count = length[keep][order].astype(np.int64), count[keep][order].astype(float)
    if not len(length):
        return 0.0, 1.0, {}
    x, n, total = np.log(length), count.sum(), np.cumsum(count)
    # Values in the window that ends at each length.
    first = np.searchsorted(length, length - slack)
    seen = total - np.where(first > 0, total[np.maximum(first - 1, 0)], 0)
    high, low = np.log(length + 0.5), np.log(np.maximum(length - slack - 0.5, 0.5))
    at = np.zeros(len(length), dtype=bool)
    mu = (x * count).sum() / n
    sigma = max(0.05, float(np.sqrt((count * (x - mu) ** 2).sum() / n)))
    found: dict[int, tuple[int, float]] = {}
    for _ in range(12):
        above = _upper((high - mu) / sigma)
        expected = n * (_upper((low - mu) / sigma) - above)
        good = (seen >= LEAST_AT_LIMIT) & (seen > 6 * expected + 6 * np.sqrt(expected)) & (n - total <= ABOVE * n * above)
        ends = np.flatnonzero(good)
        # Of candidates whose windows overlap the longest is the limit.
        ends = [i for k, i in enumerate(ends) if k + 1 == len(ends) or length[ends[k + 1]] - length[i] > slack]
        new = np.zeros(len(length), dtype=bool)
        for i in ends:
            new[first[i] : i + 1] = True
        a = (x[new] - mu) / sigma
        haz = np.exp(-(a**2) / 2) / np.sqrt(2 * np.pi) / np.maximum(_upper(a), 1e-12)
        y, var = x.copy(), np.zeros(len(x))
        y[new] = mu + sigma * haz
        var[new] = sigma**2 * np.maximum(0, 1 + a * haz - haz**2)
        m2 = (y * count).sum() / n
        s2 = max(0.05, float(np.sqrt((count * ((y - m2) ** 2 + var)).sum() / n)))
        same = (new == at).all() and abs(m2 - mu) < 1e-6 and abs(s2 - sigma) < 1e-6
        at, mu, sigma = new, m2, s2
        found = {int(length[i]): (int(seen[i]), float(max(0.0, 1 - expected[i] / seen[i]))) for i in ends}
        if same:
            break
    return float(mu), float(sigma), found


def _upper(a: np.ndarray) -> np.ndarray:
    """Upper tail of the standard normal distribution."""
    return np.array([0.5 * erfc(v / sqrt(2)) for v in a])


def _lengths(text: str) -> dict[str, Column]:
    t = F.coalesce(F.col(text), F.lit(""))
    return {"chars": F.length(t).cast("long"), "bytes": F.octet_length(t).cast("long")}


def limits(df: DataFrame, source: str, text: str) -> DataFrame:
    """source, measure, mu, sigma, limit, lowest, at_limit, posterior: the limits found, one row each. Values from
    `lowest` to `limit` are at it."""
    size = _lengths(text)
    # Copies of one text are no sign of a limit.
    x = df.where(F.length(text) > 0).select(F.col(source).alias("source"), F.xxhash64(text).alias("h"), *[c.alias(m) for m, c in size.items()]).distinct()
    x = x.select("source", F.explode(F.create_map(*[v for m in size for v in (F.lit(m), F.col(m))])).alias("measure", "n"))
    h = x.groupBy("source", "measure", "n").agg(F.count("*").alias("count"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own, measure = pdf["source"].iloc[0], pdf["measure"].iloc[0]
        slack = MEASURES[measure]
        mu, sigma, found = fit_source(pdf["n"].to_numpy(), pdf["count"].to_numpy(), slack)
        rows = [(own, measure, mu, sigma, k, k - slack, c, p) for k, (c, p) in found.items()]
        return pd.DataFrame(rows, columns=["source", "measure", "mu", "sigma", "limit", "lowest", "at_limit", "posterior"])

    return h.groupBy("source", "measure").applyInPandas(run, "source string, measure string, mu double, sigma double, limit long, lowest long, at_limit long, posterior double")


def _endings(df: DataFrame, key: str, source: str, text: str) -> DataFrame:
    """id, source, chars, bytes, ending, sim (the ending of the text cut at a place given by its hash): one row for
    each row of df."""
    full = F.coalesce(F.col(text), F.lit(""))
    place = F.pmod(F.xxhash64(full), F.greatest(F.length(full) - 1, F.lit(1))).cast("int") + 1
    last = lambda t: F.substring_index(F.regexp_replace(t, r"[\s\p{Z}\p{Cf}]+$", ""), "\n", -1)
    x = df.select(F.col(key).alias("id"), F.col(source).alias("source"), *[c.alias(m) for m, c in _lengths(text).items()], last(full).alias("line"), last(F.substring(full, F.lit(1), place)).alias("cut_line"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            kind = [ending(s) for s in b["line"]]
            tail = [s.rstrip()[-ENDING_CHARS:] if k == "unstopped" else None for s, k in zip(b["line"], kind)]
            sim = ["unstopped_open" if (k := ending(s)) == "unstopped" else k for s in b["cut_line"]]
            yield pd.DataFrame({"id": b["id"], "source": b["source"], **{m: b[m] for m in MEASURES}, "ending": kind, "sim": sim, "tail": tail})

    e = written(x.mapInPandas(run, "id long, source string, chars long, bytes long, ending string, sim string, tail string"), "endings")
    # How stretches inside the texts of such scripts end, over the whole corpus.
    inside = df.where(F.col(text).rlike(_GAP)).select(F.explode(F.split(text, _GAP + r"|\n+")).alias("s"))
    inside = inside.where(F.col("s").rlike(r"[฀-໿]\s*$")).select(F.expr(f"right(rtrim(s), {ENDING_CHARS})").alias("tail"))
    ways = inside.groupBy("tail").count().where("count > 2").select("tail", F.lit(True).alias("known"))
    # Only what has a tail is joined: the rest would be one key.
    thai = e.where("tail is not null").join(ways, "tail", "left").withColumn("ending", F.when(F.col("known").isNull(), "unstopped_open").otherwise(F.col("ending")))
    return e.where("tail is null").drop("tail").unionByName(thai.drop("tail", "known"))


def _with_marks(sim: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Shares of the kinds among the cut values of each group, of which a share m has got a mark."""
    out = (1 - m)[:, None] * sim
    out[:, MARK] += m
    return out


def settle(at: np.ndarray, post: float, off: np.ndarray, sim: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Counts of KINDS at limits and away from them, the mean posterior of censoring at limits, and counts of the simulated
    cuts -> shares of the kinds among unmarked cuts and among whole values, the share of marked cuts at limits and away from
    them, and the share cut away from limits. The commonest ending of a cut is put down to cuts as far as MOST_OFF allows."""
    sim = (sim + 0.5) / (sim.sum() + 0.5 * len(sim))
    share = off / max(1.0, off.sum())
    top = int(sim.argmax())
    few = min(MOST_OFF, max(1e-4, float(share[top] / sim[top])))
    whole, least = _held(share, top, max(0.0, float(share[top] - few * sim[top])))
    w, m, n = np.array([post, few]), np.array([MARKED, MARKED]), np.stack((at, off))
    for _ in range(ROUNDS):
        a = _cut_share(n, w, sim, whole, m)
        whole, _ = _held((n - a).sum(0), top, least)
        m = (a[:, MARK] + PSEUDO * MARKED) / (a.sum(1) + PSEUDO)
        w = np.array([min(0.999, (a[0].sum() + PSEUDO * post) / (at.sum() + PSEUDO)), min(MOST_OFF, max(1e-4, a[1].sum() / max(1.0, off.sum())))])
    return sim, whole, m, float(w[1])


def _held(n: np.ndarray, top: int, least: float) -> tuple[np.ndarray, float]:
    """Shares of counts, none below LEAST_SHARE, that of `top` being `least`; and that share."""
    v = n / max(n.sum() - n[top], 1e-9) * (1 - least)
    v[top] = least
    v = np.maximum(v, LEAST_SHARE)
    return v / v.sum(), least


def _cut_share(n: np.ndarray, w: np.ndarray, sim: np.ndarray, whole: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Of the counts, how many are of cut values. Rows are groups, of which w are cut and m of those marked."""
    c = w[:, None] * _with_marks(sim, m)
    return n * c / (c + (1 - w[:, None]) * whole)


def source_odds(n: np.ndarray, prior: np.ndarray, marked: np.ndarray, sim: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Log odds of a cut for each group of a source (rows) and kind (columns). n: counts; prior, marked: of each group the share
    cut, and of those with a mark, before its endings are seen. The last group lies away from all limits.

    Where more than MOST_OFF of the texts away from limits end like cuts, that is how whole texts of the source end."""
    own, top = n[-1], int(sim.argmax())
    natural = own[top] > MOST_OFF * (own.sum() + PSEUDO)
    weight = np.full(len(n), PSEUDO)
    weight[-1] /= 4  # what is cut away from limits is a matter of the source
    v, w, m = (own + PSEUDO * whole) / (own.sum() + PSEUDO) if natural else whole, prior.copy(), marked
    for _ in range(ROUNDS):
        a = _cut_share(n, w, sim, v, m)
        left = (n - a).sum(0) + PSEUDO * whole
        v = left / left.sum() if natural else _held(left, top, float(whole[top]))[0]
        m = (a[:, MARK] + PSEUDO * marked) / (a.sum(1) + PSEUDO)
        w = np.clip((a.sum(1) + weight * prior) / (n.sum(1) + weight), 1e-4, 0.999)
        w[-1] = prior[-1] if natural else min(w[-1], MOST_OFF)
    return np.log(w[:, None] * _with_marks(sim, m)) - np.log((1 - w[:, None]) * v)


def judged(df: DataFrame, key: str, source: str, text: str, use_limits: bool = True) -> DataFrame:
    """id, source, n, ending, posterior, log_odds, cut: one row for each row of df. posterior: of censoring by the limit
    the value is at, 0 away from limits. use_limits=False leaves the fit out, to see what it decides."""
    e = _endings(df, key, source, text)
    lim = written(limits(df, source, text) if use_limits else limits(df, source, text).where("false"), "limits")
    for m in MEASURES:
        # A source has few limits, each a few lengths.
        x = lim.where(F.col("measure") == m).select(F.col("source").alias("s2"), F.explode(F.sequence("lowest", "limit")).alias("n2"), "limit", "posterior")
        x = x.groupBy("s2", "n2").agg(F.max(F.struct("posterior", "limit")).alias(f"lim_{m}"))
        e = e.join(x, F.col("source").eqNullSafe(F.col("s2")) & (F.col(m) == F.col("n2")), "left").drop("s2", "n2")
    top = F.greatest(*[F.when(F.col(f"lim_{m}").isNotNull(), F.struct(F.col(f"lim_{m}.posterior").alias("posterior"), F.lit(m).alias("measure"), F.col(f"lim_{m}.limit").alias("limit"))) for m in MEASURES])
    e = e.withColumn("lim", top).select("id", "source", F.col("chars").alias("n"), "ending", "sim", F.coalesce("lim.posterior", F.lit(0.0)).alias("posterior"), F.when(F.col("lim").isNotNull(), F.concat_ws(" ", "lim.measure", "lim.limit")).otherwise("").alias("place"))
    e = written(e, "placed")
    some = e.where("ending <> 'blank'")
    # One row for each place and kind; away from limits the number of sources sets the number of rows.
    counts = some.groupBy("source", "place", "ending").agg(F.count("*").alias("rows"), F.max("posterior").alias("posterior"))
    sims = some.where("sim <> 'blank'").groupBy("source", "sim").agg(F.count("*").alias("rows"))
    counts = written(counts.unionByName(sims.select("source", F.lit(SIMULATED).alias("place"), F.col("sim").alias("ending"), "rows", F.lit(0.0).alias("posterior"))), "counts")
    seen = {p: np.zeros(len(KINDS)) for p in ("at", "off", SIMULATED)}
    kind_of_place = F.when(F.col("place") == "", "off").when(F.col("place") == SIMULATED, SIMULATED).otherwise("at")
    post = 0.0
    for r in counts.groupBy(kind_of_place.alias("p"), "ending").agg(F.sum("rows").alias("n"), F.sum(F.col("rows") * F.col("posterior")).alias("post")).collect():
        seen[r["p"]][KINDS.index(r["ending"])] = r["n"]
        post += r["post"]
    at, off = seen["at"], seen["off"]
    sim, whole, marks, few = settle(at, post / at.sum() if at.sum() else 0.5, off, seen[SIMULATED])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        places = [p for p in sorted(set(pdf["place"])) if p not in ("", SIMULATED)] + [""]
        n, own_sim = np.zeros((len(places), len(KINDS))), np.zeros(len(KINDS))
        prior, marked = np.full(len(places), few), np.full(len(places), marks[0])
        marked[-1] = marks[1]
        for p, k, c, q in zip(pdf["place"], pdf["ending"], pdf["rows"], pdf["posterior"]):
            if p == SIMULATED:
                own_sim[KINDS.index(k)] = c
                continue
            n[places.index(p), KINDS.index(k)] = c
            if p:
                prior[places.index(p)] = min(0.999, max(0.001, q))
        own_sim = (own_sim + PSEUDO * sim) / (own_sim.sum() + PSEUDO)
        odds = source_odds(n, prior, marked, own_sim, whole)
        rows = [(pdf["source"].iloc[0], p, k, float(odds[i, j])) for i, p in enumerate(places) for j, k in enumerate(KINDS) if n[i, j]]
        return pd.DataFrame(rows, columns=["s2", "p2", "k2", "odds"])

    odds = counts.groupBy("source").applyInPandas(run, "s2 string, p2 string, k2 string, odds double")
    e = e.join(odds, F.col("source").eqNullSafe(F.col("s2")) & (F.col("place") == F.col("p2")) & (F.col("ending") == F.col("k2")), "left")
    e = e.withColumn("log_odds", F.round(F.coalesce("odds", F.lit(-9.0)), 4))
    return e.select("id", "source", "n", "ending", F.round("posterior", 4).alias("posterior"), "log_odds", (F.col("log_odds") > 0).alias("cut"))


def cut_inside(j: DataFrame) -> DataFrame:
    """Of judged(), the rows cut inside a sentence: a limit may also fall behind a whole one."""
    return j.where(F.col("cut") & (F.col("ending") != "complete"))


def rates(j: DataFrame) -> DataFrame:
    """Of each source: rows, how many of them are cut, and the share."""
    n = F.sum(F.col("cut").cast("long"))
    return j.groupBy("source").agg(F.count("*").alias("n_rows"), n.alias("n_cut"), F.round(n / F.count("*"), 6).alias("share_cut"))
