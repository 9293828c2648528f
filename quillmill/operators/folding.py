"""Ordered folds: rows of one key arrive in order and in a stream, so a key with a third of all rows needs no more memory
than any other. They cost one shuffle on the key and a sort that spills."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

Rows = Iterator[tuple]


def ordered_fold(df: DataFrame, keys: list[str], order: list[str], fold: Callable[[tuple, Rows], Iterator[tuple]], schema: str, emit: int = 2000) -> DataFrame:
    """fold(key, rows) gets the rows of a key as namedtuples in order, lazily, and yields output tuples."""
    names = [f.split(" ")[0].strip("`") for f in _fields(schema)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (r for b in batches for r in b.itertuples(index=False))
        out: list[tuple] = []
        for key, group in itertools.groupby(rows, key=lambda r: tuple(getattr(r, k) for k in keys)):
            for t in fold(key, group):
                out.append(t)
                if len(out) >= emit:
                    yield pd.DataFrame(out, columns=names)
                    out = []
            for _ in group:
                pass
        yield pd.DataFrame(out, columns=names)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def _fields(schema: str) -> list[str]:
    """Top-level fields of a DDL schema."""
    out, depth, at = [], 0, 0
    for i, c in enumerate(schema):
        depth += c in "<(" or -(c in ">)")
        if c == "," and not depth:
            out.append(schema[at:i].strip())
            at = i + 1
    return [*out, schema[at:].strip()]
