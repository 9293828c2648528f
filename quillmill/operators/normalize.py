"""Normalisation of element texts: expressions for all but protected dehyphenation, and page furniture by document.

Modes: code keeps its layout; a paragraph that isn't recognised text has its lines joined; anything else keeps lines.
Null text stays null and counts nothing.
"""

from __future__ import annotations

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from quillmill.functions import ids, text as T

#: The default profile, whose canonical JSON is part of fingerprints.
PROFILE = {
    "profile_id": "normalization-multilingual-v1", "version": "1", "unicode_form": "NFC", "normalize_nbsp": True, "remove_soft_hyphen": True,
    "collapse_horizontal_whitespace": True, "page_furniture_suppression": True, "furniture_min_pages": 3, "furniture_min_fraction": 0.60, "furniture_edge_fraction": 0.08,
}
REASON = "REPEATED_PAGE_FURNITURE"

#: Tokens in which a hyphen at a line end is kept, by what they are.
_HEX = "[0-9a-fA-F]"
KEPT_TOKENS = {
    "link": r"https?://\S+",
    "mail": r"[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}",
    "address": r"\b\d{1,3}(?:\.\d{1,3}){3}\b",
    "uuid": rf"\b{_HEX}{{8}}-{_HEX}{{4}}-[1-5]{_HEX}{{3}}-[89abAB]{_HEX}{{3}}-{_HEX}{{12}}\b",
    "version": r"\bv?\d+(?:\.\d+)+\b",
    "digest": rf"\b{_HEX}{{32,64}}\b",
    "year": r"\b\d{4}\b",
    "dotted name": r"[A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*(?:\(\))?)+",
}
_KEPT = regex.compile("|".join(f"(?:{x})" for x in KEPT_TOKENS.values()))
_WRAP = regex.compile(r"(?<=\w)-\n(?=\w)")


def dehyphenate(text: str) -> tuple[str, int]:
    """Line-end hyphens between word characters go, unless a kept token holds one."""
    wraps = [m.start() for m in _WRAP.finditer(text)]
    if not wraps:
        return text, 0
    kept = [m.span() for m in _KEPT.finditer(text)]
    gone, k = [], 0
    for w in wraps:
        while k < len(kept) and kept[k][1] <= w:
            k += 1
        if k == len(kept) or kept[k][0] >= w + 2:
            gone.append(w)
    parts = [text[a:b] for a, b in zip([0, *(w + 2 for w in gone)], [*gone, len(text)])]
    return "".join(parts), len(gone)


@F.pandas_udf(S.StructType([S.StructField("t", S.StringType()), S.StructField("n", S.IntegerType())]))
def _dehyphenate(s: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([(None, 0) if t is None else dehyphenate(t) for t in s], columns=["t", "n"])


def cleaned(c: Column) -> Column:
    """Newlines, composition, no-break spaces and soft hyphens; control characters are still there."""
    return T.plain_blanks(T.nfc(T.unify_newlines(c)))


def normalized(df: DataFrame, text: str = "original_text", kind: str = "element_type", role: str = "element_role", hyphen_evidence: Column | None = None) -> DataFrame:
    """Adds n_text, n_controls, n_runs, n_joins, n_dehyphenated. hyphen_evidence: rows whose line ends are known to be
    physical; only their texts go through the protected dehyphenation."""
    t = F.col(text)
    x = df.withColumn("_c", cleaned(t)).withColumn("_s", T.strip_controls(F.col("_c")))
    evidence = F.lit(False) if hyphen_evidence is None else F.coalesce(hyphen_evidence, F.lit(False))
    code = F.col(kind) == "CODE_BLOCK"
    if hyphen_evidence is not None:
        x = x.withColumn("_d", _dehyphenate(F.when(evidence & ~code & F.contains("_s", F.lit("-\n")), F.col("_s"))))
        x = x.withColumn("_s", F.coalesce("_d.t", "_s")).withColumn("n_dehyphenated", F.coalesce("_d.n", F.lit(0))).drop("_d")
    else:
        x = x.withColumn("n_dehyphenated", F.lit(0))
    join = evidence | ((F.col(kind) == "PARAGRAPH") & (F.upper(F.coalesce(F.col(role), F.lit(""))) != "OCR_TEXT"))
    x = x.withColumn("_l", T.stripped_lines(F.col("_s"))).withColumn("_j", join)
    filled = F.size(F.filter("_l", lambda v: v != ""))
    zero = F.lit(0)
    return x.withColumns(
        {
            "n_text": F.when(code, F.col("_s")).when(F.col("_j"), T.join_lines(F.col("_l"))).otherwise(T.compact_lines(F.col("_l"))),
            "n_controls": F.coalesce(F.length("_c") - F.length(T.strip_controls(F.col("_c"))), zero),
            "n_runs": F.when(code | t.isNull(), zero).otherwise(T.horizontal_runs(F.col("_s"))),
            "n_joins": F.when(~code & F.col("_j") & (filled > 1), filled - 1).otherwise(zero),
        }
    ).drop("_c", "_s", "_l", "_j")


def normalized_grid(grid: Column) -> Column:
    """rows (cells normalised, lines kept), row_count, column_count and invalid (rows that are null, left out) of a table's cells.
    A null cell is empty. The cells leave the JVM together, between separators that no cell has after controls are stripped."""
    rows = F.filter(grid, lambda r: r.isNotNull())
    plain = lambda c: T.strip_controls(T.unify_newlines(F.coalesce(c, F.lit(""))))
    joined = T.nfc(F.array_join(F.transform(rows, lambda r: F.array_join(F.transform(r, plain), "\x1f")), "\x1e"))
    cell = lambda c: T.compact_lines(T.stripped_lines(T.plain_blanks(c)))
    back = F.transform(F.split(joined, "\x1e"), lambda r: F.transform(F.split(r, "\x1f"), cell))
    none = F.array().cast("array<string>")
    out = F.when(F.size(rows) == 0, F.array().cast("array<array<string>>")).otherwise(F.zip_with(rows, back, lambda r, b: F.when(F.size(r) == 0, none).otherwise(b)))
    width = F.coalesce(F.array_max(F.transform(rows, F.size)), F.lit(0))
    made = F.struct(out.alias("rows"), F.size(rows).alias("row_count"), width.alias("column_count"), (F.size(grid) - F.size(rows)).alias("invalid"))
    return F.when(grid.isNotNull(), made)


def furniture(df: DataFrame, min_pages: int = 3, fraction: float = 0.60, edge: float = 0.08) -> DataFrame:
    """source_element_id of repeated page furniture. Pages count if they have any eligible element; all edge occurrences
    of a text on enough pages are suppressed, headings never. Two aggregations with partial sums, no group is gathered."""
    g = F.col("geometry")
    x = df.select(
        "source_element_id", "document_id", "document_version", "element_type", F.col("normalized_text").alias("t"),
        g["page_number"].alias("page"), g["y0"].alias("y0"), g["y1"].alias("y1"), g["page_height"].alias("h"),
    )
    x = x.where("t is not null and t <> '' and element_type <> 'HEADING' and page is not null and y0 is not null and y1 is not null and h is not null and h <> 0")
    doc = ["document_id", "document_version"]
    pages = x.groupBy(*doc).agg(F.count_distinct("page").alias("pages")).where(F.col("pages") >= min_pages)
    mid = (F.col("y0") + F.col("y1")) / 2 / F.col("h")
    key = F.trim(F.regexp_replace(T.casefold(F.col("t")), f"[{T.BLANK}]+", " "))
    near = x.where((mid <= edge) | (mid >= 1 - edge)).withColumn("key", key).where("key <> ''")
    often = near.groupBy(*doc, "key").agg(F.count_distinct("page").alias("n")).join(pages, doc)
    often = often.where(F.col("n") >= F.greatest(F.lit(min_pages), F.ceil(F.col("pages") * fraction))).select(*doc, "key")
    return near.join(often, [*doc, "key"], "left_semi").select("source_element_id").distinct()


def fingerprint(source_sha256: Column, parser: tuple[str, str, str], upstream: Column | None = None) -> Column:
    head = F.lit(ids.NO_UPSTREAM) if upstream is None else F.coalesce(upstream, F.lit(ids.NO_UPSTREAM))
    return ids.digest(head, source_sha256, *[F.lit(p) for p in parser], F.lit(PROFILE["profile_id"]), F.lit(PROFILE["version"]), F.lit(ids.profile_hash(PROFILE)))
