"""Recognised text against native text: candidate policy, similarity anti-join, first-wins dedup, ordered merge, geometry.

Recognition itself is a function given by the caller (see recognise()); everything around it is relational.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmill.functions import text as T

SIMILAR = 0.86
EMBEDDED = "EMBEDDED_IMAGE"


def candidate_decision(mode: Column, scope: Column, page_mode: Column, reason: Column, quality: Column) -> Column:
    native = (page_mode == "NATIVE_TEXT") & ~F.coalesce(reason.isin("standalone_image", "low_native_text"), F.lit(False))
    optional = (scope == EMBEDDED) & (quality != "OCR_REQUIRED")
    return (
        F.when(~F.coalesce(scope.isin("PAGE", "REGION", EMBEDDED), F.lit(False)), "INVALID_SCOPE")
        .when(mode == "FORCE", "REQUIRED")
        .when(F.coalesce(native, F.lit(False)), "NOT_REQUIRED")
        .when(mode == "DISABLED", F.when(optional, "NOT_REQUIRED").otherwise("REQUIRED_BUT_DISABLED"))
        .otherwise("REQUIRED")
    )


def by_confidence(obs: DataFrame, hard_floor: float = 0.30, least: float = 0.60) -> DataFrame:
    """Below the floor dropped, below `least` kept as LOW_CONFIDENCE; blank texts and confidences outside 0..1 dropped."""
    x = obs.where((F.length(T.strip(F.col("text"))) > 0) & F.col("confidence").between(hard_floor, 1.0))
    return x.withColumn("status", F.when(F.col("confidence") < least, "LOW_CONFIDENCE").otherwise("ACCEPTED"))


def not_native(obs: DataFrame, native: DataFrame, threshold: float = SIMILAR) -> DataFrame:
    """Observations (doc, page, text) without a native text (doc, page, text) of the same page that is as similar as the
    threshold. The join is on document and page, null pages matching each other; keys are computed once on each side."""
    a = obs.withColumn("_k", T.match_key(F.col("text")))
    b = native.select(F.col("doc").alias("_d"), F.col("page").alias("_p"), T.match_key(F.col("text")).alias("_n")).where("_n <> ''").distinct()
    on = (F.col("doc") == F.col("_d")) & F.col("page").eqNullSafe(F.col("_p")) & (T.similarity(F.col("_k"), F.col("_n")) >= threshold)
    return a.join(b, on, "left_anti").drop("_k")


def first_wins(obs: DataFrame, order: list[str]) -> DataFrame:
    """Of observations with one match key on a page the first stays; embedded images always stay, but what they show
    counts as seen."""
    w = W.partitionBy("doc", "page", T.match_key(F.col("text"))).orderBy(*order)
    return obs.withColumn("_rn", F.row_number().over(w)).where((F.col("_rn") == 1) | (F.col("scope") == EMBEDDED)).drop("_rn")


def merged_order(elements: DataFrame, accepted: DataFrame) -> DataFrame:
    """elements: doc, id, order_index; accepted: doc, id, parent_id, accept_pos. Accepted ones come right after their
    parent, those without one at the end; order_index is renumbered from 0."""
    e = elements.select("doc", "id", F.col("order_index").cast("long").alias("_a"), F.lit(0).alias("_b"), F.lit(0).cast("long").alias("_c"))
    at = elements.select(F.col("doc"), F.col("id").alias("parent_id"), F.col("order_index").cast("long").alias("_at"))
    o = accepted.join(at, ["doc", "parent_id"], "left")
    o = o.select("doc", "id", F.coalesce("_at", F.lit((1 << 62))).alias("_a"), F.lit(1).alias("_b"), F.col("accept_pos").cast("long").alias("_c"))
    w = W.partitionBy("doc").orderBy("_a", "_b", "_c", "id")
    return e.unionByName(o).select("doc", "id", (F.row_number().over(w) - 1).alias("order_index"))


def recognise(candidates: DataFrame, engine: Callable[[bytes], list[tuple[str, float]]]) -> DataFrame:
    """Each distinct image of a document once, the result joined back to every candidate that shows it.
    candidates: doc, candidate_id, image (binary). Gives doc, candidate_id, block, text, confidence."""
    c = candidates.withColumn("sha", F.sha2("image", 256))
    once = c.groupBy("doc", "sha").agg(F.first("image").alias("image"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(d, s, k, t, float(conf)) for d, s, i in zip(b["doc"], b["sha"], b["image"]) for k, (t, conf) in enumerate(engine(bytes(i)))]
            yield pd.DataFrame(rows, columns=["doc", "sha", "block", "text", "confidence"])

    got = once.mapInPandas(run, "doc string, sha string, block int, text string, confidence double")
    return c.select("doc", "candidate_id", "sha").join(got, ["doc", "sha"]).drop("sha")


def unit_geometry(g: Column, width: Column, height: Column) -> Column:
    """Boxes as shares of the image, clamped to 0..1. Boxes already tagged as normalised are only clamped."""

    def clamp(c: Column) -> Column:
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))

    done = F.coalesce(g["coordinate_space"].isin("normalized-0-1", "normalized-top-left"), F.lit(False))
    box = {k: clamp(F.when(done, g[k]).otherwise(g[k] / (width if k[0] == "x" else height))) for k in ("x0", "y0", "x1", "y1")}
    return F.struct(*[v.alias(k) for k, v in box.items()], F.lit("normalized-0-1").alias("coordinate_space"))


def final_status(n_candidates: Column, n_unresolved: Column, n_accepted: Column) -> Column:
    return F.when(n_candidates == 0, "NOT_REQUIRED").when(n_unresolved > 0, "PARTIAL").when(n_accepted > 0, "COMPLETED").otherwise("NO_TEXT")
