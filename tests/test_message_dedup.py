from datetime import datetime

from quillmill.operators.message_dedup import MessageStore, canonical_uuid, dropped_rows, load_in_two
from quillmill.runtime import fresh_dir

A, B = "3f2504e0-4f89-11d3-9a0c-0305e82c3301", "11111111-2222-3333-4444-555555555555"
SCHEMA = "delivery_id long, received_at timestamp, producer_request_id string, document_id string, document_version long, _w string, part string"


def at(month, day=1):
    return datetime(2031, month, day)


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)


def brute(rows):
    best = {}
    for i, t, r, d, v in rows:
        r = (r or "").strip()
        if not r:
            continue
        norm = lambda u: u.strip().lower().removeprefix("urn:uuid:").strip("{}").replace("-", "")
        best.setdefault((norm(r), norm(d), v), []).append((t is None, t or datetime.max, i))
    return {x[2] for g in best.values() for x in g} - {min(g)[2] for g in best.values()}


def test_uuid_forms_are_one(spark):
    forms = [A, A.upper(), "{" + A + "}", "urn:uuid:" + A, A.replace("-", ""), f"  {A}\n"]
    got = spark.createDataFrame([(f,) for f in forms], "u string").select(canonical_uuid_col()).distinct().collect()
    assert [r[0] for r in got] == [A]


def canonical_uuid_col():
    from pyspark.sql import functions as F

    return canonical_uuid(F.col("u"))


ROWS = [
    (1, at(1), A, B, 1), (2, at(3), A.upper(), B, 1), (3, at(2), "{" + A + "}", B, 1), (4, at(1), A, B, 2), (5, at(3), B, A, 1), (6, at(3), B, A, 1), (7, at(2), None, A, 1), (8, at(2), "  ", A, 1),
    (9, None, B, A, 1), (10, at(3), "not-a-uuid", A, 1), (11, at(3), "NOT-A-UUID ", A, 1), (2, at(3), A.upper(), B, 1),
]


def test_earliest_stays_across_batches(spark):
    x = table(spark, ROWS)
    store = load_in_two(x, fresh_dir(spark, "t"), ["part"])
    assert {r[0] for r in dropped_rows(x, store).collect()} == brute(ROWS) == {2, 3, 6, 9, 11}


def test_late_copy_with_earlier_time_replaces_and_only_touched_partitions_change(spark):
    store = MessageStore(spark, fresh_dir(spark, "t"), [])
    store.merge(table(spark, [(1, at(2), A, B, 1), (2, at(1), B, B, 1), (3, at(4), A, A, 1)]))
    before = store.manifest()
    store.merge(table(spark, [(4, at(1), A.upper(), B, 1)]))
    after = store.manifest()
    assert after.version == before.version + 1
    assert after.parts["203104"] == before.parts["203104"], "an untouched partition keeps its folder"
    assert "203102" not in after.parts
    assert sorted(r[0] for r in store.rows().selectExpr("_rank.i").collect()) == [2, 3, 4]


def test_merging_again_changes_nothing(spark):
    store = MessageStore(spark, fresh_dir(spark, "t"), [])
    rows = [(1, at(1), A, B, 1), (2, at(2), A, B, 1)]
    store.merge(table(spark, rows))
    store.merge(table(spark, rows))
    assert [r[0] for r in store.rows().selectExpr("_rank.i").collect()] == [1]


def test_empty_table(spark):
    x = table(spark, ROWS).where("false")
    store = load_in_two(x, fresh_dir(spark, "t"), [])
    assert store.rows() is None and dropped_rows(x, store).count() == 0
