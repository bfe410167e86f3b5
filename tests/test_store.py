"""The store's life: the scenarios of the usual example programs, crashes, compaction, checkpoints."""

import random

from pyspark.sql import functions as F

from tidelog.functions.semantics import Status
from tidelog.plans import manifest as M
from tidelog.plans.store import KvStore, Options


def make(spark, tmp_path, **options):
    store = KvStore(spark, f"file://{tmp_path}/kv")
    assert store.create(Options(**options)) == Status.OK
    return store


def test_basic_scenario(spark, tmp_path):
    store = make(spark, tmp_path)
    assert store.create() == Status.EXISTS
    for k in range(1, 101):
        assert store.put(k, f"value_{k - 1}".encode()) == Status.OK
    assert store.put(1, b"changed") == Status.OK
    assert store.delete(50) == Status.OK
    assert store.delete(50) == Status.NOT_FOUND
    assert store.delete(99999) == Status.NOT_FOUND
    assert store.put(7, b"") == Status.INVALID
    assert store.get(1) == (Status.OK, 7, b"changed")
    assert store.get(2, 3) == (Status.TOO_SMALL, 7, None)
    assert store.get(2, 0)[0] == Status.INVALID
    assert store.get(50)[0] == Status.NOT_FOUND
    found = store.stats()
    assert (found["entry_count"], found["total_data_bytes"], found["total_garbage_bytes"], found["garbage_ratio"]) == (100, 417792, 8192, 1)
    assert store.scan().count() == 99
    assert store.close() == Status.OK
    assert store.get(1)[0] == store.put(1, b"x") == store.delete(1) == Status.NOT_READY
    again = KvStore(spark, f"file://{tmp_path}/kv")
    assert again.open() == Status.OK
    assert again.get(1) == (Status.OK, 7, b"changed")
    assert again.meta["next_seq"] == 103
    assert again.verify().count() == 0


def test_open_without_store_and_segments(spark, tmp_path):
    assert KvStore(spark, f"file://{tmp_path}/none").open() == Status.CORRUPT
    store = make(spark, tmp_path)
    assert store.put_segments(1, [b"a" * 4096, b"b"]) == Status.OK
    assert store.put_segments(1, [b"short"]) == Status.INVALID
    assert store.put_segments(1, []) == Status.INVALID
    assert store.get((1 << 64) - 1)[0] == Status.NOT_FOUND
    store.put((1 << 64) - 1, b"top")
    assert store.get((1 << 64) - 1)[2] == b"top"


def test_checkpoint_compaction_vacuum_and_fallback(spark, tmp_path):
    rng = random.Random(4)
    store = make(spark, tmp_path, data_file_size=20 * 4096, flush_entries=15)
    model = {}
    for i in range(120):
        k = rng.randint(1, 12)
        if rng.random() < 0.2:
            assert store.delete(k) == (Status.OK if model.pop(k, None) is not None else Status.NOT_FOUND)
        else:
            model[k] = f"v{i}".encode()
            store.put(k, model[k])
    show = lambda s: {r.key: bytes(r.value) for r in s.scan().collect()}
    assert show(store) == model
    assert store.compact() == Status.OK
    assert show(store) == model
    assert store.checkpoint() == Status.OK
    assert show(store) == model
    store.put(1, b"after")
    model[1] = b"after"
    store.flush()
    assert store.vacuum()
    assert show(store) == model
    # A folder that no manifest names is ignored; a damaged manifest falls back to the one before.
    store.folder.make("log/999999-crash")
    newest = [n for n in store.folder.names("manifest") if n.endswith(".json")][-1]
    whole = store.folder.read(f"manifest/{newest}")
    store.folder.write(f"manifest/{store.meta['version'] + 1:012d}.json", whole[:-1])
    again = KvStore(spark, f"file://{tmp_path}/kv")
    assert again.open() == Status.OK
    assert show(again) == model
    assert again.vacuum() == ["log/999999-crash"]


def test_put_all_and_multi_get(spark, tmp_path):
    store = make(spark, tmp_path)
    rows = spark.createDataFrame([(1, 5, "PUT", "five"), (1, 4, "PUT", "four"), (2, 6, "PUT", ""), (3, 7, "PUT", "x"), (3, 8, "DEL", None)], "key long, seq long, op string, value string")
    assert store.put_all(rows) == Status.OK
    asked = store.multi_get(spark.createDataFrame([(1,), (2,), (3,)], "key long"), 3).orderBy("key").collect()
    assert [(r.key, r.status, r.actual_len) for r in asked] == [(1, -2, 4), (2, -1, None), (3, -1, None)]
    assert store.as_of(4).select(F.decode("value", "utf-8")).first()[0] == "four"


def rows_of(spark, rows):
    return spark.createDataFrame(rows, "key long, seq long, op string, value string")


def test_staged_puts_count_once_and_in_their_epoch(spark, tmp_path):
    store = make(spark, tmp_path, checkpoint_bytes=4096)
    slot, epoch = store.stage(rows_of(spark, [(1, 3, "PUT", "x"), (9, 4, "DEL", None)]))
    assert store.get(1)[0] == Status.NOT_FOUND
    assert store.commit_slot(slot, epoch + 1) == Status.INVALID
    assert store.commit_slot(slot, epoch) == Status.OK and store.get(1)[2] == b"x"
    assert store.commit_slot(slot, epoch) == Status.INVALID
    assert store.stats()["entry_count"] == 1  # the delete of a key that never was wrote nothing
    assert store.meta["snapshot"] is None and store.poll() == Status.OK and store.meta["snapshot"]["seq"] == 3
    late, epoch = store.stage(rows_of(spark, [(2, 5, "PUT", "y")]))
    # A crash behind the commit's manifest leaves the slot's folder, but not the slot.
    again = KvStore(spark, f"file://{tmp_path}/kv")
    assert again.open() == Status.OK
    assert again.commit_slot(slot, epoch) == again.commit_slot(late, epoch) == Status.INVALID
    assert again.get(1)[2] == b"x" and late in again.vacuum()


def test_counters_survive_checkpoint_compaction_and_reopening(spark, tmp_path):
    store = make(spark, tmp_path, data_file_size=3 * 4096, flush_entries=2)
    want = lambda data, garbage, keys: (data, garbage, keys, garbage * 100 // data)
    seen = lambda s: tuple(s.stats()[k] for k in ("total_data_bytes", "total_garbage_bytes", "entry_count", "garbage_ratio"))
    for k in (1, 2, 1, 3, 2):
        store.put(k, b"v" * 5000 if k == 2 else b"v")
    store.delete(3)
    page = 4096
    first = want(8 * page, (1 + 2 + 1) * page, 3)
    assert seen(store) == first
    assert store.checkpoint() == Status.OK and seen(store) == first
    store.put(3, b"again")  # of a deleted key: no garbage
    store.put(1, b"more")
    second = want(10 * page, 5 * page, 3)
    assert seen(store) == second
    store.put(4, b"new")
    store.put(4, b"newer")
    third = want(12 * page, 6 * page, 4)
    assert seen(store) == third
    store.compact([f["file_id"] for f in store.meta["files"]])
    assert seen(store) == third
    store.delete(2)
    fourth = want(13 * page, 8 * page, 4)
    assert seen(store) == fourth
    store.close()
    again = KvStore(spark, f"file://{tmp_path}/kv")
    again.open()
    assert seen(again) == fourth
    again.checkpoint()
    assert seen(again) == fourth and {r.key for r in again.scan().collect()} == {1, 3, 4}


def test_vacuum_spares_the_manifest_before(spark, tmp_path):
    store = make(spark, tmp_path)
    for round_ in range(3):
        for k in range(5):
            store.put(k, f"{round_}{k}".encode())
        store.checkpoint()
    store.vacuum()
    newest = [n for n in store.folder.names("manifest") if n.endswith(".json")][-1]
    store.folder.write(f"manifest/{newest}", b"damaged")
    again = KvStore(spark, f"file://{tmp_path}/kv")
    assert again.open() == Status.OK
    assert {r.key: bytes(r.value) for r in again.scan().collect()} == {k: f"2{k}".encode() for k in range(5)}


def test_a_checkpoint_writes_changed_segments_only(spark, tmp_path):
    store = make(spark, tmp_path)
    store.put_all(rows_of(spark, [(k, k + 1, "PUT", f"v{k}") for k in range(200)]))
    store.checkpoint()
    before = dict(store.meta["snapshot"]["segments"])
    store.put(7, b"changed")
    store.flush()
    assert len(store.meta["dirty"]) == 1
    store.checkpoint()
    after = store.meta["snapshot"]["segments"]
    assert [s for s in after if after[s] != before.get(s)] == [s for s, d in after.items() if d not in before.values()] and sum(after[s] != before[s] for s in after) == 1
    assert store.get(7)[2] == b"changed" and store.scan().count() == 200


def test_compaction_has_a_destination_for_each_source(spark, tmp_path):
    store = make(spark, tmp_path, data_file_size=4 * 4096)
    for r in range(4):
        store.put_all(rows_of(spark, [(k, 10 * r + k + 1, "PUT", f"{r}" * 5000) for k in (r, 5)]))
    sealed = sorted({f["file_id"] for f in store.meta["files"]} - {store.meta["active"]})
    assert len(sealed) == 4
    assert store.compact(sealed[:2]) == Status.OK
    files = {f["file_id"]: f["bytes"] for f in store.meta["files"]}
    assert not set(sealed[:2]) & set(files) and sorted(files.values()) == [2 * 4096] * 2 + [4 * 4096] * 2
    assert {r.key for r in store.scan().collect()} == {0, 1, 2, 3, 5}
    heads = store.headers().collect()
    assert all(h.whole for h in heads) and {h.file_id for h in heads if h.sealed} >= set(files) - {store.meta["active"]}


def test_recovery_stops_a_folder_at_a_bad_checksum(spark, tmp_path):
    store = make(spark, tmp_path, flush_entries=10)
    for k in range(30):
        store.put(k, f"v{k}".encode())
    folder = store.meta["files"][1]["dir"]
    path = f"{tmp_path}/kv/{folder}"
    rows = spark.read.parquet(f"file://{path}").collect()
    bad = [(r.key, r.seq, r.op, bytes(r.value), r.value_len, r.file_id, r.crc + (r.key == 14), 0 if r.key == 11 else r.magic) for r in rows]
    from tidelog.plans.store import ROW

    spark.createDataFrame(bad, ROW).coalesce(1).write.mode("overwrite").parquet(f"file://{path}")
    again = KvStore(spark, f"file://{tmp_path}/kv")
    assert again.open() == Status.OK
    # 11 has no magic and is passed over; nothing from 14 on is trusted in that folder.
    assert sorted(r.key for r in again.scan().collect()) == [k for k in range(30) if k != 11 and not 14 <= k < 20]
    assert again.compact([again.meta["files"][1]["file_id"]]) == Status.NOT_FOUND  # it is active
    again.checkpoint()
    assert again.verify().isEmpty() and again.get(13)[2] == b"v13" and again.get(14)[0] == Status.NOT_FOUND


def test_asynchronous_verbs_are_answered_by_poll(spark, tmp_path):
    store = make(spark, tmp_path, queue_size=9, flush_entries=4)
    store.put(1, b"one")
    got = []
    note = lambda name: lambda *result: got.append((name, *result))
    assert store.put_async(2, b"two", note("put")) == store.get_async(1, note("get"), 2) == store.get_async(2, note("get")) == Status.OK
    assert store.delete_async(1, note("del")) == store.delete_async(1, note("del")) == store.get_async(1, note("get")) == Status.OK
    assert store.put_async(3, [b"a" * 4096, b"b"], note("put")) == Status.OK and store.put_async(3, [b"a"]) == store.put_async(3, b"") == Status.INVALID
    assert store.pending() == 7 and store.get_async(9, note("get"), 0) == Status.INVALID
    assert store.delete_async(8, note("del")) == store.delete_async(9) == Status.OK and store.delete_async(9) == Status.BUSY
    assert store.poll() == Status.OK and store.pending() == 0
    assert got == [("put", 0), ("get", -6, 3, None), ("get", 0, 3, b"two"), ("del", 0), ("del", -1), ("get", -1, None, None), ("put", 0), ("del", -1)]
    store.get_async(2, note("late"))
    store.close()
    assert got[-1] == ("late", Status.NOT_READY, None, None) and store.put_async(1, b"x") == Status.NOT_READY


def test_poll_compacts_scheduled_files_as_far_as_load_allows(spark, tmp_path):
    store = make(spark, tmp_path, data_file_size=2 * 4096)
    for r in range(3):
        store.put_all(rows_of(spark, [(k, 10 * r + k + 1, "PUT", "x") for k in range(3)]))
    first, second, _ = sorted({f["file_id"] for f in store.meta["files"]})
    store.schedule([first, second, first])
    there = lambda: {f["file_id"] for f in store.meta["files"]}
    store.poll(1000)
    store.poll(500)  # still paused
    assert list(store.scheduled) == [first, second] and store.paused
    store.poll(100)
    assert first in there() and not store.paused
    store.poll(100)
    assert first not in there() and second in there()
    store.poll(0)
    assert second not in there() and not store.scheduled
    assert store.scan().count() == 3


def test_states(spark, tmp_path):
    from tidelog.plans.store import State

    store = KvStore(spark, f"file://{tmp_path}/kv")
    assert store.state is State.UNINITIALIZED and store.open() == Status.CORRUPT and store.state is State.ERROR
    assert store.create() == Status.OK and store.state is State.READY and store.open() == Status.EXISTS
    assert store.close() == Status.OK and store.state is State.CLOSED and store.close() == store.poll() == store.flush() == store.checkpoint() == store.compact() == store.schedule([1]) == Status.NOT_READY
    assert store.put_vectored(1, [b"a" * 4096]) == Status.NOT_READY and store.open() == Status.OK
    assert store.put_vectored(1, [b"a" * 4096]) == store.put_buffered(2, b"b") == Status.OK and store.get(1)[1] == 4096
