"""Each rule of the log, one positive and one negative case, and random logs against a dictionary."""

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidelog.functions import semantics as S
from tidelog.operators import compaction, layout, ordered, stats, view

LOG = "key long, seq long, op string, value string, value_len long"


def log_of(spark, ops):
    """ops: (key, seq, value or None for a delete)."""
    return spark.createDataFrame([(k, s, "DEL" if v is None else "PUT", v, len(v or "")) for k, s, v in ops], LOG)


def test_pages_and_status(spark):
    rows = spark.createDataFrame([(0,), (1,), (4064,), (4065,), (300 << 20,)], "n long")
    got = [tuple(r) for r in rows.select(S.page_count(F.col("n")), S.put_status(F.col("n"))).collect()]
    assert got == [(1, -6), (1, 0), (1, 0), (2, 0), (76801, -2)]


def test_sequence_order(spark):
    top = (1 << 32) - 1
    cases = [(1, top, True), (top, 1, False), (5, 5, False), (1 << 31, 0, False), ((1 << 31) - 1, 0, True)]
    rows = spark.createDataFrame(cases, "a long, b long, want boolean")
    assert all(r.want == r.got for r in rows.withColumn("got", S.is_newer(F.col("a"), F.col("b"))).collect())
    assert spark.range(1).select(S.unwrapped(F.lit(3), F.lit(2))).first()[0] == (2 << 32) + 3


def test_hash_and_crc_match_plain_models(spark):
    keys = [0, 1, -1, (1 << 63) - 1, -(1 << 63), 123456789]

    def fnv(k):
        h = 14695981039346656037
        for b in (k & (1 << 64) - 1).to_bytes(8, "little"):
            h = ((h ^ b) * 1099511628211) % (1 << 64)
        return h

    got = spark.createDataFrame([(k,) for k in keys], "k long").select("k", S.fnv1a(F.col("k")).alias("h"), S.tag(F.col("k")).alias("t"), S.unsigned_key(F.col("k")).alias("u")).collect()
    assert all(r.h & (1 << 64) - 1 == fnv(r.k) and r.t == fnv(r.k) >> 56 and int(r.u) == r.k & (1 << 64) - 1 for r in got)
    value = "über"
    image = S.MAGIC.to_bytes(4, "little") + (1).to_bytes(4, "little") + bytes(4) + (9).to_bytes(4, "little") + (7).to_bytes(8, "little") + (5).to_bytes(4, "little") + value.encode()
    crc = spark.createDataFrame([(7, 9, value)], "k long, s long, v string").select(S.entry_crc(F.col("k"), F.col("s"), F.col("v"), F.lit(False))).first()[0]
    assert crc == zlib.crc32(image)


def test_unsigned_order(spark):
    keys = [0, (1 << 63) - 1, -(1 << 63), -1]
    got = [r.k for r in spark.createDataFrame([(k,) for k in reversed(keys)], "k long").orderBy(S.unsigned_order(F.col("k"))).collect()]
    assert got == keys


def test_deletes_and_late_puts(spark):
    assert [(r.seq, r.status) for r in view.op_status(log_of(spark, [(1, 1, "a"), (1, 2, None), (1, 3, None), (2, 4, None)])).orderBy("seq").collect()] == [(1, 0), (2, 0), (3, -1), (4, -1)]
    assert view.live(log_of(spark, [(1, 1, "a"), (1, 3, None), (1, 2, "late")])).isEmpty()
    assert view.live(log_of(spark, [(1, 101, "new"), (1, 100, "old")])).first().value == "new"
    again = stats.totals(log_of(spark, [(1, 1, "a"), (1, 2, None), (1, 3, "b")])).first()
    assert (again.total_data_bytes, again.total_garbage_bytes) == (3 * 4096, 4096)


def test_empty_log(spark):
    found = stats.totals(log_of(spark, [])).first()
    assert tuple(found) == (0, 0, 0, 0)
    assert view.latest(log_of(spark, [])).isEmpty()
    assert layout.place(spark.createDataFrame([], "seq long, page_count long"), 8).isEmpty()


def model(ops):
    state, data, garbage, ever = {}, 0, 0, set()
    for k, s, v in sorted(ops, key=lambda o: o[1]):
        pages = (32 + len(v or "") + 4095) // 4096
        if v is None and k not in state:
            continue
        data += pages * 4096
        garbage += state.pop(k)[1] * 4096 if k in state else 0
        if v is not None:
            state[k] = (v, pages)
            ever.add(k)
    return {k: v for k, (v, _) in state.items()}, data, garbage, len(ever)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_logs_with_shuffled_arrival(spark, seed):
    rng = random.Random(seed)
    ops = [(rng.randint(1, 9), s, None if rng.random() < 0.3 else "v" * rng.choice([1, 4064, 4065, 9000])) for s in range(1, 150)]
    shuffled = rng.sample(ops, len(ops))
    log = log_of(spark, shuffled)
    state, data, garbage, ever = model(ops)
    assert {r.key: r.value for r in view.live(log).collect()} == state
    found = stats.totals(log).first()
    assert (found.total_data_bytes, found.total_garbage_bytes, found.entry_count) == (data, garbage, ever)
    assert found.garbage_ratio == (100 * garbage // data if data else 0)
    for cut in (0, 40, 149):  # a crash after the snapshot: the tail restores the state
        assert {r.key: r.value for r in view.replay(view.as_of(log, cut), log.where(F.col("seq") > cut)).collect()} == state


def test_chunks_carry_over(spark):
    rng = random.Random(3)
    rows = [(rng.randint(1, 3), s, rng.choice("ab")) for s in range(200)]
    df = spark.createDataFrame(rows, "key long, seq long, op string")
    got = {r.seq: r.prev_op for r in ordered.with_previous(df, ["op"], chunk=F.floor(F.col("seq") / 7)).collect()}
    last, want = {}, {}
    for k, s, op in rows:
        want[s], last[k] = last.get(k), op
    assert got == want
    top = {r.seq: r.prev_max for r in ordered.with_running_max(df.withColumn("at", 200 - F.col("seq")), "seq", "at", F.floor(F.col("at") / 7)).collect()}
    assert all(top[s] == max([t for k2, t, _ in rows if k2 == k and t > s], default=None) for k, s, _ in rows)
    at = {r.seq: r.position for r in ordered.with_position(df.where("seq % 3 = 0")).collect()}
    assert at == {s: i for i, s in enumerate(range(0, 200, 3))}


def next_fit(sizes, limit):
    file, at, out = 0, 1, []
    for p in sizes:
        if at + p > limit:
            file, at = file + 1, 1
        out.append((file, at))
        at += p
    return out, file, at


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 12), max_size=120), st.integers(2, 20))
def test_folded_tables_are_next_fit_from_every_offset(sizes, limit):
    files, ends = layout._folded(np.array(sizes, dtype=np.int64), limit)
    for start in range(1, limit + 1):
        file, at = 0, start
        for p in sizes:
            if at + p > limit:
                file, at = file + 1, 1
            at += p
        assert (files[start - 1], ends[start - 1]) == (file, at)


def test_placement_in_chunks(spark, monkeypatch):
    rng = random.Random(8)
    sizes = [rng.randint(1, 11) for _ in range(300)]
    monkeypatch.setattr(layout, "chunk_of", lambda seq: F.floor(seq / 17).cast("long"))
    placed = layout.place(spark.createDataFrame(list(enumerate(sizes)), "seq long, page_count long"), 10)
    assert [(r.file_id, r.offset_index) for r in placed.orderBy("seq").collect()] == next_fit(sizes, 10)[0]


def test_compaction_moves_live_entries_only(spark):
    rows = [(1, 1, "PUT", 1, 0, 1), (2, 2, "PUT", 1, 0, 2), (1, 3, "PUT", 1, 0, 3), (2, 4, "DEL", 1, 1, 1), (3, 5, "PUT", 1, 1, 2)]
    located = spark.createDataFrame(rows, "key long, seq long, op string, page_count long, file_id long, offset_index long")
    assert [(r.file_id, r.garbage_ratio) for r in compaction.candidates(located).collect()] == [(0, pytest.approx(2 / 3))]
    moved = compaction.migrate(located, spark.createDataFrame([(0,)], "file_id long"))
    assert [(r.key, r.seq, r.new_offset) for r in moved.collect()] == [(1, 3, 1)]
    index = spark.createDataFrame([(1, 3, 0, 3), (3, 5, 1, 2)], "key long, seq long, file_id long, offset_index long")
    to = spark.createDataFrame([(1, 0, 3, 9, 1), (3, 0, 9, 9, 2)], "key long, file_id long, offset_index long, new_file_id long, new_offset long")
    assert sorted(tuple(r) for r in compaction.relocate(index, to).collect()) == [(1, 3, 9, 1), (3, 5, 1, 2)]
    bitmap = layout.bitmap_stats(layout.valid_page_bitmap(located)).orderBy("file_id").collect()
    assert [tuple(r) for r in bitmap] == [(0, 1, 1), (1, 1, 1)]
    assert layout.readable(spark.createDataFrame([("ACTIVE",), ("DELETED",)], "state string")).count() == 1
