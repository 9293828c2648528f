"""Every query of the core against its SQL, and those without SQL for whether they run, on the smallest tables."""

import glob
import math
import os

import duckdb
import pandas as pd
import pytest

from quillmill.plans import data_quality, pipeline

QUERIES = data_quality.QUERIES | pipeline.QUERIES
SQL = data_quality.SQL | pipeline.SQL


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and math.isnan(v):
        return None
    if hasattr(v, "item"):
        return plain(v.item())
    if isinstance(v, pd.Timestamp):
        return str(v.tz_localize(None) if v.tzinfo else v)
    return round(v, 6) if isinstance(v, float) else v


def rows(df):
    return sorted((tuple(plain(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False, name=None)), key=str)


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    got = QUERIES[name](spark, sf)
    if name not in SQL:
        assert got.count() >= 0
        return
    want = con.execute(SQL[name]).df()
    got = got.toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(1).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("missing", ["ahocorasick", "tiktoken", "quillmill.llm"])
def test_core_survives_a_missing_package(missing):
    import subprocess
    import sys

    code = f"import sys; sys.modules[{missing!r}] = None; import __spark_entry__ as e; q = e.queries(); assert 'p6_found' in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-W", "ignore", "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_core_does_without_the_text_subpackage():
    import pathlib

    import quillmill

    root = pathlib.Path(quillmill.__file__).parent
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "quillmill.llm" not in p.read_text(), p
