"""Predicted against gold sets: precision, recall and F1 by case and group, and gates on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def set_counts(gold: Column, predicted: Column) -> tuple[Column, Column, Column]:
    """True positives, false positives, false negatives of two arrays taken as sets."""
    tp = F.size(F.array_intersect(gold, predicted))
    return tp, F.size(F.array_except(predicted, gold)), F.size(F.array_except(gold, predicted))


def precision(tp: Column, fp: Column) -> Column:
    return F.when(tp + fp == 0, F.lit(1.0)).otherwise(tp / (tp + fp))


def recall(tp: Column, fn: Column) -> Column:
    return F.when(tp + fn == 0, F.lit(1.0)).otherwise(tp / (tp + fn))


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    """1 where there is nothing to find and nothing was found."""
    return F.when(2 * tp + fp + fn == 0, F.lit(1.0)).otherwise(2 * tp / (2 * tp + fp + fn))


def by_group(cases: DataFrame, *group: str) -> DataFrame:
    """cases: tp, fp, fn and the group columns."""
    g = cases.groupBy(*group).agg(F.count("*").alias("cases"), *[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    t, p, n = F.col("tp"), F.col("fp"), F.col("fn")
    return g.withColumns({"precision": F.round(precision(t, p), 6), "recall": F.round(recall(t, n), 6), "f1": F.round(f1(t, p, n), 6)})


def gates(groups: DataFrame, group: str, least_f1: float, core: list[str] | None = None, core_least: float = 1.0) -> DataFrame:
    """Rows that fail: a group below its F1, a core group below its precision or recall. Empty if all pass."""
    is_core = F.col(group).isin(core or [])
    code = (
        F.when(is_core & (F.col("precision") < core_least), "LINGUISTIC_CORE_PRECISION_REGRESSION")
        .when(is_core & (F.col("recall") < core_least), "LINGUISTIC_CORE_RECALL_REGRESSION")
        .when(F.col("f1") < least_f1, "LINGUISTIC_LANGUAGE_F1_REGRESSION")
    )
    return groups.withColumn("error_code", code).where("error_code is not null")
