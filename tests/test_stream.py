"""The stream's results equal the batch's."""

from pyspark.sql import functions as F

from tidelog.operators import stats, view
from tidelog.sources.oplog import events_log
from tidelog.streaming import upsert

DATA = "/root/testdata/sf0.001"


def parts(spark, tmp_path, order):
    """The events in five files, which the stream reads one by one."""
    events = spark.read.parquet(f"{DATA}/events.parquet")
    for i in range(5):
        events.where(order(F.col("event_id")) % 5 == i).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events")
    return f"{tmp_path}/events"


def test_latest_of_shuffled_stream_equals_batch(spark, tmp_path):
    path, seen = parts(spark, tmp_path, lambda i: i), {}

    def each(batch, number):
        seen.update({r.key: (r.seq, r.op, r.value) for r in batch.collect()})

    upsert.run_once(upsert.latest_versions(upsert.events_stream(spark, path, 1)), each, f"{tmp_path}/state")
    assert seen == {r.key: (r.seq, r.op, r.value) for r in view.latest(events_log(spark, DATA)).collect()}


def test_counters_in_order_equal_batch(spark, tmp_path):
    top = spark.read.parquet(f"{DATA}/events.parquet").agg(F.max("event_id")).first()[0]
    path, seen = parts(spark, tmp_path, lambda i: F.floor(i * 5 / (top + 1))), {}

    def each(batch, number):
        seen.update({r.key: tuple(r)[1:] for r in batch.collect()})

    upsert.run_once(upsert.counters(upsert.events_stream(spark, path, 1)), each, f"{tmp_path}/state")
    found = stats.totals(events_log(spark, DATA)).first()
    assert tuple(sum(v[i] for v in seen.values()) for i in range(3)) == (found.total_data_bytes, found.total_garbage_bytes, found.entry_count)
