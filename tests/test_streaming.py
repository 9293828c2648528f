from datetime import datetime

from quillmill.operators.message_dedup import MessageStore
from quillmill.runtime import fresh_dir
from quillmill.streaming.incremental import each_batch, into_store

S = "delivery_id long, received_at timestamp, producer_request_id string, document_id string, document_version long"


def test_messages_stream_into_one_copy_each(spark):
    root = fresh_dir(spark, "stream")
    store = MessageStore(spark, f"{root}/store", [])
    for k, rows in enumerate([[(1, datetime(2031, 1, 2), "r1", "d", 1)], [(2, datetime(2031, 1, 1), "r1", "d", 1), (3, datetime(2031, 1, 3), "r2", "d", 1)]]):
        spark.createDataFrame(rows, S).coalesce(1).write.mode("append").parquet(f"{root}/in")
        into_store(spark, f"{root}/in", S, store, f"{root}/cp").awaitTermination()
        assert store.manifest().version == k + 1
    assert sorted(r[0] for r in store.rows().selectExpr("_rank.i").collect()) == [2, 3]


def test_batches_are_idempotent(spark):
    root = fresh_dir(spark, "stream")
    spark.range(5).write.parquet(f"{root}/in")
    for _ in range(2):
        each_batch(spark, f"{root}/in", "id long", f"{root}/out", f"{root}/cp", lambda d: d.selectExpr("id * 2 as x")).awaitTermination()
    assert sorted(r.x for r in spark.read.parquet(f"{root}/out").collect()) == [0, 2, 4, 6, 8]


def test_sweep_removes_what_was_written(spark):
    from quillmill import runtime

    runtime.sweep(spark)
    x = runtime.written(spark.range(5), "x")
    path = x.inputFiles()[0].rpartition("/")[0]
    fs, p = runtime.hadoop_fs(spark, path)
    assert x.count() == 5 and fs.exists(p) and runtime.sweep(spark) == 1 and not fs.exists(p) and runtime.sweep(spark) == 0
