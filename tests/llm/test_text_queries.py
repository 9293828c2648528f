"""All queries of the subpackage run over the smallest tables and have stable columns."""

import duckdb
import pytest

from quillmill.llm import queries

FOUND = {
    "p1_found": ["source_element_id", "lang"], "p2_found": ["element_id_a", "element_id_b"], "p4_found": ["source_element_id", "boundary"], "p5_found": ["item_table", "item_id"],
    "p7_found": ["source_element_id", "noise_kind"], "p9_found": ["doc_id", "item_id"], "p10_found": ["doc_id"],
}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sf, name):
    df = queries.QUERIES[name](spark, sf)
    assert df.count() > 0 or name in ("p2_found", "p10_limits")
    if name in FOUND:
        assert df.columns == FOUND[name] and df.distinct().count() == df.count()


def test_oversized_items(spark, sf):
    c = duckdb.connect()
    for t in ("logical_block", "normalized_element"):
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = set(c.execute(queries.SQL["p5_found"]).fetchall())
    assert {tuple(r) for r in queries.QUERIES["p5_found"](spark, sf).collect()} == want
