"""Page layout on a table of words: lines, reading order in one or two columns, kinds of lines, modes of pages, furniture.

words: doc, page, text, x0, x1, top, bottom, size, fontname. Groups are pages, which are bounded; folds stream by page.
"""

from __future__ import annotations

import statistics
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmill.operators.folding import ordered_fold

TOLERANCE = 3.0
LINES = "doc string, page long, line int, text string, x0 double, x1 double, top double, bottom double, font_size double, bold boolean, n_words int"


def lines(words: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Words in order of (top, x0); a line ends where the next word is farther from the median top than the tolerance."""

    def fold(key: tuple, rows: Iterator) -> Iterator[tuple]:
        group: list = []
        k = 0

        def line() -> tuple | None:
            g = sorted(group, key=lambda r: r.x0)
            text = " ".join(r.text or "" for r in g).strip()
            if not text:
                return None
            return (
                *key, k, text, min(r.x0 for r in g), max(r.x1 for r in g), min(r.top for r in g), max(r.bottom for r in g),
                float(statistics.median(r.size for r in g)), any("bold" in (r.fontname or "").lower() for r in g), len(g),
            )

        for r in rows:
            if group and abs(r.top - statistics.median(x.top for x in group)) > tolerance:
                if (t := line()) is not None:
                    yield t
                    k += 1
                group = []
            group.append(r)
        if group and (t := line()) is not None:
            yield t

    x = words.select("doc", "page", "text", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in ("x0", "x1", "top", "bottom", "size")], "fontname")
    return ordered_fold(x, ["doc", "page"], ["top", "x0"], fold, LINES)


def reading_order(ln: DataFrame, page_width: Column) -> DataFrame:
    """Adds reading_index. Full-width lines divide a page of two columns into bands; in a band the left column comes
    first, then the right one, then what lies between. All windows share one partitioning by page."""
    x0, x1, w = F.col("x0"), F.col("x1"), page_width
    full = ((x1 - x0) >= w * 0.62) | ((x0 <= w * 0.30) & (x1 >= w * 0.70))
    mid = (x0 + x1) / 2
    side = F.when(full, 9).when(mid < w * 0.46, 0).when(mid > w * 0.54, 1).otherwise(2)
    page = W.partitionBy("doc", "page")
    x = ln.withColumn("_side", side).withColumn("_two", (F.count("*").over(page) >= 4) & (F.count_if(F.col("_side") == 0).over(page) >= 2) & (F.count_if(F.col("_side") == 1).over(page) >= 2))
    before = page.orderBy("top", F.when(F.col("_side") == 9, 1).otherwise(0), "x0").rowsBetween(W.unboundedPreceding, -1)
    x = x.withColumn("_band", F.coalesce(F.count_if(F.col("_side") == 9).over(before), F.lit(0)))
    flat = F.when(F.col("_two"), F.col("_band")).otherwise(0)
    rank = F.when(F.col("_two"), F.col("_side")).otherwise(0)
    order = W.partitionBy("doc", "page").orderBy(flat, rank, "top", "x0", "line")
    return x.withColumn("reading_index", F.row_number().over(order) - 1).drop("_side", "_two", "_band")


LIST = r"^\s*(?:[-•*+] |\d+[.)]\s+)"
NUMBERED = r"^(?:\d+(?:\.\d+)*[.)]?|[A-ZА-ЯӘҒҚҢӨҰҮҺІ][.)])\s+\S+"
PAGE_NUMBER = r"(?i)^(?:page\s+)?\d+(?:\s+(?:of|/)\s+\d+)?$"


def line_kind(text: Column, size: Column, bold: Column, median: Column) -> Column:
    big = (median > 0) & (size >= median * 1.15) | bold & (size >= median) | text.rlike(NUMBERED)
    return F.when(text.rlike(LIST), "LIST_ITEM").when((F.length(text) <= 180) & F.coalesce(big, F.lit(False)), "HEADING").otherwise("PARAGRAPH")


def furniture_role(text: Column, top: Column, bottom: Column, height: Column) -> Column:
    edge = F.when(top <= height * 0.08, "PAGE_HEADER_CANDIDATE").when(bottom >= height * 0.92, "PAGE_FOOTER_CANDIDATE")
    return F.when(text.rlike(PAGE_NUMBER), "PAGE_NUMBER").otherwise(edge)


def page_mode(chars: Column, words: Column, images: Column, image_ratio: Column, good: int = 80, low: int = 20, scanned: float = 0.70) -> Column:
    return (
        F.when(chars >= good, F.when(images > 0, "MIXED").otherwise("NATIVE_TEXT"))
        .when((images > 0) & (F.least(image_ratio, F.lit(1.0)) >= scanned), "SCANNED_IMAGE")
        .when((chars <= low) & (words == 0) & (images == 0), "EMPTY")
        .otherwise("LOW_SIGNAL")
    )


def page_elements(words: DataFrame, pages: DataFrame) -> DataFrame:
    """words as above; pages: doc, page, width, height. Lines in reading order with kind, role, locator and geometry.

    Headings found by type size are all of level 1; the median size is that of the page's lines."""
    ln = lines(words).join(pages.select("doc", "page", "width", "height"), ["doc", "page"])
    median = ln.where("font_size > 0").groupBy("doc", "page").agg(F.median("font_size").alias("median"))
    x = reading_order(ln, F.col("width")).join(median, ["doc", "page"], "left").withColumn("median", F.coalesce("median", F.lit(0.0)))
    kind = line_kind(F.col("text"), F.col("font_size"), F.col("bold"), F.col("median"))
    box = F.struct(
        F.col("page").cast("int").alias("page_number"), "x0", F.col("top").alias("y0"), "x1", F.col("bottom").alias("y1"), F.col("width").alias("page_width"), F.col("height").alias("page_height"),
        F.lit("pdf-points-top-left").alias("coordinate_space"),
    )
    locator = F.concat(F.lit("page:"), F.col("page").cast("string"), F.lit(":line:"), F.col("reading_index").cast("string"))
    return x.select(
        "doc", "page", "reading_index", kind.alias("element_type"), "text", F.when(kind == "HEADING", 1).alias("heading_level"),
        furniture_role(F.col("text"), F.col("top"), F.col("bottom"), F.col("height")).alias("element_role"), locator.alias("locator"), box.alias("geometry"),
    )
