"""The catalogue: a query over the driver's tables for each operator, and the same in SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions import semantics as S
from tidelog.operators import compaction, layout, stats, view
from tidelog.operators.ordered import with_running_max
from tidelog.plans.store import KvStore, Options
from tidelog.sources import oplog
from tidelog.sources.shared import delete_at_exit, shared_folder
from tidelog.streaming import upsert

FILE_PAGES = 256
SNAPSHOT = 5000

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

# Relations that the SQL of several queries shares.
_OPS = "ops as (select user_id as k, event_id as seq, case when event_type = 'error' then 1 else 0 end as del, case when event_type = 'error' then 0 else strlen(props) end as vlen, props from events)"
_CUR = _OPS + ", cur as (select * from (select *, row_number() over (partition by k order by seq desc) as rn from ops) where rn = 1)"
_EFF = _OPS + ", eff as (select k, seq, del, vlen, (32 + vlen + 4095) // 4096 as pages from (select *, lag(del) over (partition by k order by seq) as pdel from ops) where del = 0 or pdel = 0)"
_LOC = _EFF + ", ranked as (select *, row_number() over (order by seq) - 1 as rk from eff), loc as (select *, rk // 255 as file_id, 1 + rk % 255 as offset_index from ranked)"
_LIVE = _LOC + ", live as (select * from (select *, row_number() over (partition by k order by seq desc) as rn from loc) where rn = 1 and del = 0)"
# Documents over 300 keys, of several pages, placed next fit.
_DOCS = f"recursive e as (select row_number() over (order by doc_id) as rn, doc_id % 300 as k, doc_id as seq, (32 + coalesce(strlen(text), 0) + 4095) // 4096 as pages from documents), " + (
    f"p(rn, file_id, offset_index, after) as (select rn, cast(case when 1 + pages > {FILE_PAGES} then 1 else 0 end as bigint), cast(1 as bigint), cast(1 + pages as bigint) from e where rn = 1 "
    f"union all select e.rn, case when p.after + e.pages > {FILE_PAGES} then p.file_id + 1 else p.file_id end, case when p.after + e.pages > {FILE_PAGES} then 1 else p.after end, case when p.after + e.pages > {FILE_PAGES} then 1 + e.pages else p.after + e.pages end from p join e on e.rn = p.rn + 1), "
    "loc as (select k, seq, pages, file_id, offset_index from p join e using (rn)), live as (select * from (select *, row_number() over (partition by k order by seq desc) as rn from loc) where rn = 1)"
)
# Events as entries of 1 to 97 pages in files of several bitmap chunks.
WIDE_PAGES = 100_000
_WIDE = f"recursive e as (select row_number() over (order by event_id) as rn, user_id as k, event_id as seq, 1 + event_id % 97 as pages from events where event_id < 3000), " + (
    f"p(rn, file_id, offset_index, after) as (select rn, cast(case when 1 + pages > {WIDE_PAGES} then 1 else 0 end as bigint), cast(1 as bigint), cast(1 + pages as bigint) from e where rn = 1 "
    f"union all select e.rn, case when p.after + e.pages > {WIDE_PAGES} then p.file_id + 1 else p.file_id end, case when p.after + e.pages > {WIDE_PAGES} then 1 else p.after end, case when p.after + e.pages > {WIDE_PAGES} then 1 + e.pages else p.after + e.pages end from p join e on e.rn = p.rn + 1), "
    "loc as (select k, seq, pages, file_id, offset_index from p join e using (rn)), live as (select * from (select *, row_number() over (partition by k order by seq desc) as rn from loc) where rn = 1)"
)
_FS = _LIVE + ", fs as (select loc.file_id, 4096 * count(*) as total_bytes, 4096 * count(live.seq) as valid_bytes, count(*) as total_entries, count(live.seq) as valid_entries from loc left join live on live.seq = loc.seq group by loc.file_id)"


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oplog.events_log(spark, sf_dir)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.place(view.effective(oplog.documents_log(spark, sf_dir)), FILE_PAGES)


def _located(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.place_uniform(view.effective(_events(spark, sf_dir)), FILE_PAGES)


@_query("select o_custkey as key, o_orderkey as seq, o_totalprice as value from (select *, row_number() over (partition by o_custkey order by o_orderkey desc) as rn from orders) where rn = 1")
def kv_latest_order(spark, sf_dir):
    return view.latest(oplog.orders_log(spark, sf_dir)).select("key", "seq", F.col("value").cast("double").alias("value"))


@_query(f"with {_CUR} select k as key, seq, case when del = 1 then 'DEL' else 'PUT' end as op from cur")
def kv_latest_version(spark, sf_dir):
    return view.latest(_events(spark, sf_dir)).select("key", "seq", "op")


@_query(f"with {_CUR} select k as key, seq, props as value from cur where del = 0")
def kv_live_snapshot(spark, sf_dir):
    return view.live(_events(spark, sf_dir)).select("key", "seq", "value")


@_query(f"with {_CUR} select k as key, seq, props as value from cur where del = 0 and k = 7")
def kv_point_get(spark, sf_dir):
    return view.get(_events(spark, sf_dir), 7).select("key", "seq", "value")


@_query(f"""with {_CUR}, req as (select event_id as key from events where event_id < 300)
select req.key, cast(case when cur.k is null or del = 1 then -1 when vlen > 9 then -2 else 0 end as integer) as status, cast(case when del = 0 then vlen end as bigint) as actual_len,
case when del = 0 and vlen <= 9 then props end as value from req left join cur on cur.k = req.key""")
def kv_multi_get(spark, sf_dir):
    log = _events(spark, sf_dir)
    requests = log.where(F.col("seq") < 300).select(F.col("seq").alias("key"))
    return view.multi_get(log, requests, F.lit(9))


@_query(f"with {_OPS} select k as key, seq, case when del = 1 then 'DEL' else 'PUT' end as op, cast(case when del = 1 and coalesce(pdel, 1) = 1 then -1 else 0 end as integer) as status from (select *, lag(del) over (partition by k order by seq) as pdel from ops)")
def kv_op_status(spark, sf_dir):
    return view.op_status(_events(spark, sf_dir))


@_query("select doc_id as seq, cast(case when coalesce(strlen(text), 0) = 0 then -6 when strlen(text) > 16384 then -2 else 0 end as integer) as status from documents")
def kv_put_validate(spark, sf_dir):
    return oplog.documents_log(spark, sf_dir).select("seq", S.put_status(F.col("value_len"), 16384).alias("status"))


@_query("select doc_id as seq, cast(coalesce(strlen(text), 0) as bigint) as value_len, cast((32 + coalesce(strlen(text), 0) + 4095) // 4096 as bigint) as page_count, cast(4096 * ((32 + coalesce(strlen(text), 0) + 4095) // 4096) as bigint) as aligned_size from documents")
def kv_entry_pages(spark, sf_dir):
    return oplog.documents_log(spark, sf_dir).select("seq", "value_len", S.page_count(F.col("value_len")).alias("page_count"), S.aligned_size(F.col("value_len")).alias("aligned_size"))


_TOTALS = f"""with {_EFF}, r as (select *, lag(del) over (partition by k order by seq) as pdel, lag(pages) over (partition by k order by seq) as ppages from eff),
t as (select cast(coalesce(sum(pages), 0) * 4096 as bigint) as total_data_bytes, cast(coalesce(sum(case when pdel = 0 then ppages end), 0) * 4096 as bigint) as total_garbage_bytes,
cast(count(distinct case when del = 0 then k end) as bigint) as entry_count from r)"""


@_query(_TOTALS + " select * from t")
def kv_stats(spark, sf_dir):
    return stats.totals(_events(spark, sf_dir)).drop("garbage_ratio")


@_query(_TOTALS + " select cast(case when total_data_bytes = 0 then 0 else total_garbage_bytes * 100 // total_data_bytes end as bigint) as garbage_ratio from t")
def kv_garbage_ratio(spark, sf_dir):
    return stats.totals(_events(spark, sf_dir)).select("garbage_ratio")


@_query(f"with {_OPS} select count(distinct k) as size, cast(2048 as bigint) as capacity, cast(count(distinct k) as double) / 2048 as load_factor from ops where del = 0")
def kv_load_factor(spark, sf_dir):
    return stats.load_factor(_events(spark, sf_dir), 1000)


@_query(f"with {_OPS} select case when del = 1 then 'DEL' else 'PUT' end as op, count(*) as ops, cast(sum(vlen) as bigint) as value_bytes from ops group by 1")
def kv_workload_mix(spark, sf_dir):
    return stats.workload_mix(_events(spark, sf_dir))


@_query(f"""with {_OPS}, a as (select k, seq, md5(cast(seq as varchar)) as arrival from ops), b as (select *, max(seq) over (partition by k order by arrival rows between unbounded preceding and 1 preceding) as pm from a)
select k as key, max(seq) as seq, count(*) filter (where pm is null or seq > pm) as updates from b group by k""")
def kv_lww_out_of_order(spark, sf_dir):
    arrived = _events(spark, sf_dir).select("key", "seq", F.md5(F.col("seq").cast("string")).alias("arrival"))
    rows = with_running_max(arrived, "seq", "arrival", F.substring("arrival", 1, 2))
    applied = F.col("prev_max").isNull() | (F.col("seq") > F.col("prev_max"))
    return rows.groupBy("key").agg(F.max("seq").alias("seq"), F.count(F.when(applied, 1)).alias("updates"))


@_query(f"with {_OPS}, cut as (select * from (select *, row_number() over (partition by k order by seq desc) as rn from ops where seq <= {SNAPSHOT}) where rn = 1) select k as key, seq, props as value from cut where del = 0")
def kv_asof(spark, sf_dir):
    return view.as_of(_events(spark, sf_dir), SNAPSHOT).where(F.col("op") == "PUT").select("key", "seq", "value")


@_query(f"with {_CUR} select k as key, seq, props as value from cur where del = 0")
def kv_ckpt_replay(spark, sf_dir):
    log = _events(spark, sf_dir)
    return view.replay(view.as_of(log, SNAPSHOT), log.where(F.col("seq") > SNAPSHOT)).select("key", "seq", "value")


@_query(f"select greatest({SNAPSHOT}, max(event_id)) + 1 as next_seq from events")
def kv_recovery_seq(spark, sf_dir):
    return _events(spark, sf_dir).agg((F.greatest(F.lit(SNAPSHOT), F.max("seq")) + 1).alias("next_seq"))


@_query(f"with {_LOC} select k as key, seq, cast(file_id as bigint) as file_id, cast(offset_index as bigint) as offset_index from loc")
def kv_locations(spark, sf_dir):
    return _located(spark, sf_dir).select("key", "seq", "file_id", "offset_index")


@_query(f"""with recursive e as (select row_number() over (order by doc_id) as rn, doc_id as seq, (32 + coalesce(strlen(text), 0) + 4095) // 4096 as pages from documents),
p(rn, seq, file_id, offset_index, after) as (select rn, seq, cast(case when 1 + pages > {FILE_PAGES} then 1 else 0 end as bigint), cast(1 as bigint), cast(1 + pages as bigint) from e where rn = 1
union all select e.rn, e.seq, case when p.after + e.pages > {FILE_PAGES} then p.file_id + 1 else p.file_id end, case when p.after + e.pages > {FILE_PAGES} then 1 else p.after end, case when p.after + e.pages > {FILE_PAGES} then 1 + e.pages else p.after + e.pages end from p join e on e.rn = p.rn + 1)
select seq, file_id, offset_index from p""")
def kv_layout_nextfit(spark, sf_dir):
    entries = oplog.documents_log(spark, sf_dir).select("seq", S.page_count(F.col("value_len")).alias("page_count"))
    return layout.place(entries, FILE_PAGES).select("seq", "file_id", "offset_index")


@_query(f"with {_FS} select cast(file_id as bigint) as file_id, case when file_id < max(file_id) over () then 'SEALED' else 'ACTIVE' end as state, cast(total_bytes as bigint) as total_bytes, cast(valid_bytes as bigint) as valid_bytes, total_entries, valid_entries, cast(1 as double) - cast(valid_bytes as double) / cast(total_bytes as double) as garbage_ratio from fs")
def kv_file_stats(spark, sf_dir):
    return layout.file_stats(_located(spark, sf_dir))


@_query(f"with {_FS}, f as (select *, max(file_id) over () as top, cast(1 as double) - cast(valid_bytes as double) / cast(total_bytes as double) as garbage_ratio from fs) select cast(file_id as bigint) as file_id, garbage_ratio, cast(total_bytes - valid_bytes as bigint) as reclaimable_bytes from f where file_id < top and garbage_ratio >= 0.3")
def kv_compaction_candidates(spark, sf_dir):
    return compaction.candidates(_located(spark, sf_dir))


@_query(f"with {_LIVE}, m as (select * from live where file_id < (select max(file_id) from loc)) select k as key, seq, cast(file_id as bigint) as file_id, cast(offset_index as bigint) as offset_index, cast(pages as bigint) as page_count, cast(1 + coalesce(sum(pages) over (partition by file_id order by offset_index rows between unbounded preceding and 1 preceding), 0) as bigint) as new_offset from m")
def kv_compact_migrate(spark, sf_dir):
    located = _located(spark, sf_dir)
    return compaction.migrate(located, layout.file_stats(located).where(F.col("state") == "SEALED"))


@_query(f"with {_LIVE} select cast(file_id as bigint) as file_id, cast(count(*) as bigint) as valid_pages, cast(1 as bigint) as chunks from live group by file_id")
def kv_valid_page_bitmap(spark, sf_dir):
    return layout.bitmap_stats(layout.valid_page_bitmap(_located(spark, sf_dir)))


@_query(f"with {_LOC} select cast(file_id as bigint) as file_id, cast(max(offset_index + pages) as bigint) as write_offset from loc group by file_id")
def kv_write_offsets(spark, sf_dir):
    return layout.first_after(_located(spark, sf_dir))


_FNV = "list_reduce([14695981039346656037::uhugeint] || list_transform(range(0, 8), lambda i: ((k >> (8 * i)) & 255)::uhugeint), lambda h, b: (xor(h, b) * 1099511628211::uhugeint) % 18446744073709551616::uhugeint)"
_HASHED = f"keys as (select distinct o_custkey as k from orders), h as (select k, {_FNV} as h from keys)"


@_query(f"with {_HASHED} select k as key, cast(h // 4294967296 as bigint) as high, cast(h % 4294967296 as bigint) as low, cast(h // 72057594037927936 as bigint) as tag from h")
def kv_hash_tag(spark, sf_dir):
    keys = oplog.orders_log(spark, sf_dir).select("key").distinct().withColumn("h", S.fnv1a(F.col("key")))
    return keys.select("key", F.shiftrightunsigned("h", 32).alias("high"), F.col("h").bitwiseAND(F.lit(0xFFFFFFFF)).alias("low"), F.shiftrightunsigned("h", 56).alias("tag"))


_WRAPS = "(select event_id as seq, (event_id * 2654435761) % 4294967296 as a, case when event_id % 5 = 0 then (event_id * 2654435761) % 4294967296 when event_id % 5 = 1 then (event_id * 2654435761 + 2147483648) % 4294967296 else (event_id * 40503) % 4294967296 end as b from events)"


@_query(f"select seq, a, b, ((a - b) & 4294967295) between 1 and 2147483647 as newer from {_WRAPS}")
def kv_seq_newer(spark, sf_dir):
    """Pairs of 32-bit sequences across the wrap: equal ones, half the range apart, and others."""
    seq, whole = F.col("seq"), F.lit(1 << 32)
    a = F.pmod(seq * 2654435761, whole)
    b = F.when(seq % 5 == 0, a).when(seq % 5 == 1, F.pmod(a + (1 << 31), whole)).otherwise(F.pmod(seq * 40503, whole))
    return _events(spark, sf_dir).select("seq", a.alias("a"), b.alias("b")).withColumn("newer", S.is_newer(F.col("a"), F.col("b")))


@_query(f"with keys as (select distinct user_id as k from events where event_id > 9900 or event_id % 100 = 99), h as (select k, {_FNV} as h from keys) select distinct cast(least((h % 4096) // 51, 79) as bigint) as segment_id from h")
def kv_dirty_segments(spark, sf_dir):
    changed = _events(spark, sf_dir).where((F.col("seq") > 9900) | (F.col("seq") % 100 == 99)).select("key").distinct()
    return changed.select(S.segment_of(F.col("key")).alias("segment_id")).distinct()


@_query("select doc_id as seq, cast(case when doc_id % 7 = 3 then -5 else 0 end as integer) as status from documents")
def kv_crc_verify(spark, sf_dir):
    log = oplog.documents_log(spark, sf_dir)
    crc = lambda value: S.entry_crc(F.col("key"), F.col("seq"), value, F.col("op") == "DEL")
    stored = log.withColumn("crc", crc(F.col("value")))
    damaged = F.when(F.col("seq") % 7 == 3, F.concat(F.lit("x"), F.col("value"))).otherwise(F.col("value"))
    return stored.select("seq", F.when(crc(damaged) == F.col("crc"), 0).otherwise(int(S.Status.CORRUPT)).alias("status"))


@_query(f"with {_LOC} select distinct user_id as path_id from events where user_id not in (select file_id from loc)")
def kv_dangling_files(spark, sf_dir):
    """Files on disk (stood in for by user ids) that no manifest names."""
    on_disk = _events(spark, sf_dir).select(F.col("key").alias("path_id")).distinct()
    known = _located(spark, sf_dir).select(F.col("file_id").alias("path_id")).distinct()
    return on_disk.join(known, "path_id", "left_anti")


@_query("select o_custkey as key, o_orderkey as seq, o_totalprice as value from (select *, row_number() over (partition by o_custkey order by o_orderkey desc) as rn from orders where o_custkey between 100 and 199) where rn = 1")
def kv_range_scan(spark, sf_dir):
    return view.range_scan(oplog.orders_log(spark, sf_dir), 100, 199).select("key", "seq", F.col("value").cast("double").alias("value"))


@_query("select page_id % 50 as key, max(page_id) as seq, cast(max_by(strlen(html), page_id) as bigint) as value_len from pages group by 1")
def kv_pages_latest(spark, sf_dir):
    return view.latest(oplog.pages_log(spark, sf_dir)).select("key", "seq", "value_len")


@_query("select event_id as seq, event_id % 1200 as pending, case when event_id % 1200 >= 1000 then 0.0::double when event_id % 1200 >= 500 then 0.25::double when event_id % 1200 >= 100 then 0.5::double else 1.0::double end as rate from events")
def kv_throttle(spark, sf_dir):
    return _events(spark, sf_dir).select("seq", (F.col("seq") % 1200).alias("pending")).withColumn("rate", S.throttle(F.col("pending")))


@_query(f"with {_CUR} select k as key, seq from cur")
def kv_stream_upsert(spark, sf_dir):
    """The state of a stream over the events' file once all is read."""
    return upsert.latest_once(spark, f"{sf_dir}/events.parquet")


@_query("with g as (select user_id as key, max(event_id) % 400 as seconds, cast(count(*) * 131072000 as bigint) as written, count(distinct event_id % 80) % 12 as dirty from events group by 1) select key, seconds, written, dirty, (seconds >= 300 or written >= 10737418240 or dirty >= 8) as due from g")
def kv_checkpoint_due(spark, sf_dir):
    """Each user's events as a log of its own."""
    logs = _events(spark, sf_dir).groupBy("key").agg((F.max("seq") % 400).alias("seconds"), (F.count("*") * 131072000).alias("written"), (F.count_distinct(F.col("seq") % 80) % 12).alias("dirty"))
    return logs.withColumn("due", S.checkpoint_due(F.col("seconds"), F.col("written"), F.col("dirty")))


@_query("with g as (select user_id as key, count(*) as entries, count(*) // 5 as buffers, max(event_id) % 14 as waited_ms from events group by 1) select key, entries, buffers, waited_ms, (buffers >= 16 or entries >= 128 or waited_ms >= 10) as due from g")
def kv_flush_due(spark, sf_dir):
    """Each user's events as writes that wait."""
    waiting = _events(spark, sf_dir).groupBy("key").agg(F.count("*").alias("entries"), F.floor(F.count("*") / 5).cast("long").alias("buffers"), (F.max("seq") % 14).alias("waited_ms"))
    return waiting.withColumn("due", S.flush_due(F.col("buffers"), F.col("entries"), F.col("waited_ms")))


@_query("select event_id as seq, event_id % 17 as buffers, case when event_id % 17 >= 12 then true when event_id % 17 <= 6 then false else event_id % 3 = 0 end as waits from events")
def kv_back_pressure(spark, sf_dir):
    rows = _events(spark, sf_dir).select("seq", (F.col("seq") % 17).alias("buffers"))
    return rows.withColumn("waits", S.back_pressure(F.col("buffers"), F.col("seq") % 3 == 0))


@_query(f"with {_LOC} select k as key, seq, cast(file_id as bigint) as file_id, cast(offset_index as bigint) as offset_index from loc where file_id > 10 or (file_id = 10 and offset_index >= 100)")
def kv_scan_tail(spark, sf_dir):
    return layout.from_position(_located(spark, sf_dir), 10, 100).select("key", "seq", "file_id", "offset_index")


@_query(f"with {_FS} select cast(file_id as bigint) as file_id, cast(case when 1.0::double - valid_bytes::double / total_bytes::double >= 0.3 then valid_bytes // 4096 else total_bytes // 4096 end as bigint) as valid_pages from fs")
def kv_page_validity(spark, sf_dir):
    return layout.valid_pages(_located(spark, sf_dir))


@_query("with j as (select event_id // 64 as group_id, event_id % 64 as slot, case when event_id % 53 = 52 then event_id - 70 else event_id end as seq, event_id % 41 <> 40 as good from events), f as (select *, good and coalesce(seq > lag(seq) over (partition by group_id order by slot), true) as fine from j), p as (select *, bool_and(fine) over (partition by group_id order by slot) as whole from f) select group_id, slot, seq from p where whole")
def kv_journal_prefix(spark, sf_dir):
    """Journals of 64 slots, some with damaged records, some whose sequence falls back."""
    at = F.col("seq")
    records = _events(spark, sf_dir).select(F.floor(at / 64).cast("long").alias("group_id"), (at % 64).alias("slot"), F.when(at % 53 == 52, at - 70).otherwise(at).alias("seq"), (at % 41 != 40).alias("good"))
    return view.journal_prefix(records).select("group_id", "slot", "seq")


@_query(f"with {_LIVE}, req as (select event_id as key from events where event_id < 300) select req.key, cast(file_id as bigint) as file_id, cast(offset_index as bigint) as offset_index, cast(case when live.k is null then -1 else 0 end as integer) as status from req left join live on live.k = req.key")
def kv_locate(spark, sf_dir):
    located = _located(spark, sf_dir)
    requests = _events(spark, sf_dir).where(F.col("seq") < 300).select(F.col("seq").alias("key"))
    return view.locate(located, layout.file_stats(located), requests)


@_query(f"with {_LIVE}, req as (select event_id as key from events where event_id < 300), ok as (select * from live where file_id % 5 <> 2) select req.key, cast(file_id as bigint) as file_id, cast(offset_index as bigint) as offset_index, cast(case when ok.k is null then -1 else 0 end as integer) as status from req left join ok on ok.k = req.key")
def kv_locate_unreadable(spark, sf_dir):
    """Every fifth file is deleted: entries there aren't found."""
    located = _located(spark, sf_dir)
    requests = _events(spark, sf_dir).where(F.col("seq") < 300).select(F.col("seq").alias("key"))
    files = layout.file_stats(located).withColumn("state", F.when(F.col("file_id") % 5 == 2, "DELETED").when(F.col("file_id") % 5 == 3, "COMPACTING").otherwise(F.col("state")))
    return view.locate(located, files, requests)


@_query(f"with {_DOCS}, fs as (select loc.file_id, 4096 * sum(loc.pages) as total_bytes, 4096 * coalesce(sum(live.pages), 0) as valid_bytes, count(*) as total_entries, count(live.seq) as valid_entries from loc left join live on live.seq = loc.seq group by loc.file_id) select file_id, case when file_id < max(file_id) over () then 'SEALED' else 'ACTIVE' end as state, cast(total_bytes as bigint) as total_bytes, cast(valid_bytes as bigint) as valid_bytes, total_entries, valid_entries, cast(1 as double) - cast(valid_bytes as double) / cast(total_bytes as double) as garbage_ratio from fs")
def kv_doc_file_stats(spark, sf_dir):
    return layout.file_stats(_documents(spark, sf_dir))


_MOVED = "m as (select * from live where file_id < (select max(file_id) from loc)), d as (select file_id, 100 + row_number() over (order by file_id) as new_file_id from (select distinct file_id from loc where file_id < (select max(file_id) from loc)))"


@_query(f"with {_DOCS}, {_MOVED} select k as key, seq, file_id, offset_index, cast(pages as bigint) as page_count, cast(1 + coalesce(sum(pages) over (partition by file_id order by offset_index rows between unbounded preceding and 1 preceding), 0) as bigint) as new_offset, new_file_id from m join d using (file_id)")
def kv_doc_migrate(spark, sf_dir):
    """Compaction of entries of several pages: a destination for each source, from 101 on."""
    located = _documents(spark, sf_dir)
    sources = layout.file_stats(located).where(F.col("state") == "SEALED")
    return compaction.migrate(located, sources).join(F.broadcast(compaction.destinations(sources, 101)), "file_id")  # 1024 files at most


@_query(f"""with {_DOCS}, cut as (select * from (select *, row_number() over (partition by k order by seq desc) as rn from loc where seq < 700) where rn = 1), top as (select max(file_id) as f from loc where seq < 700),
m as (select k, file_id, offset_index, 1 + coalesce(sum(pages) over (partition by file_id order by offset_index rows between unbounded preceding and 1 preceding), 0) as new_offset from cut where file_id < (select f from top)),
d as (select file_id, 100 + row_number() over (order by file_id) as new_file_id from (select distinct file_id from loc where seq < 700 and file_id < (select f from top)))
select live.k as key, live.seq, cast(coalesce(new_file_id, live.file_id) as bigint) as file_id, cast(coalesce(new_offset, live.offset_index) as bigint) as offset_index from live left join (m join d using (file_id)) x on x.k = live.k and x.file_id = live.file_id and x.offset_index = live.offset_index""")
def kv_relocate(spark, sf_dir):
    """The index after a compaction that began at sequence 700: entries written since keep their place."""
    located = _documents(spark, sf_dir)
    before = located.where(F.col("seq") < 700)
    sources = layout.file_stats(before).where(F.col("state") == "SEALED")
    moved = compaction.migrate(before, sources).join(F.broadcast(compaction.destinations(sources, 101)), "file_id")
    return compaction.relocate(layout.live_locations(located).select("key", "seq", "file_id", "offset_index"), moved)


@_query(f"with {_DOCS} select file_id, cast(sum(pages) as bigint) as valid_pages, cast(1 as bigint) as chunks from live group by file_id")
def kv_doc_page_bitmap(spark, sf_dir):
    return layout.bitmap_stats(layout.valid_page_bitmap(_documents(spark, sf_dir)))


@_query(f"with {_WIDE}, pages as (select file_id, unnest(range(offset_index, offset_index + pages)) as page from live) select file_id, page // 32768 as chunk, count(*) as valid_pages from pages group by 1, 2")
def kv_bitmap_chunks(spark, sf_dir):
    """Bitmaps of files of 100,000 pages: several chunks each, some entries across their border."""
    entries = _events(spark, sf_dir).where(F.col("seq") < 3000).select("key", "seq", F.lit("PUT").alias("op"), (1 + F.col("seq") % 97).alias("page_count"))
    bitmaps = layout.valid_page_bitmap(layout.place(entries, WIDE_PAGES))
    return bitmaps.select("file_id", "chunk", F.bitmap_count("bitmap").alias("valid_pages"))


@_query(f"with {_DOCS} select file_id, cast(max(offset_index + pages) as bigint) as write_offset from loc group by file_id")
def kv_doc_write_offsets(spark, sf_dir):
    return layout.first_after(_documents(spark, sf_dir))


@_query("select doc_id as seq, cast(case when doc_id % 18 not between 1 and 16 or strlen(text) < 4096 then -6 else 0 end as integer) as status, cast(strlen(text) * (doc_id % 18) // 4096 as bigint) as page_count from documents")
def kv_put_segments(spark, sf_dir):
    """Documents as first segments of 0 to 17 equal ones."""
    log = oplog.documents_log(spark, sf_dir)
    n = F.col("seq") % 18
    return log.select("seq", S.segmented_put_status(n, F.col("value_len")).alias("status"), S.segmented_pages(F.col("value_len") * n).alias("page_count"))


@_query(f"select user_id as key, event_id as seq, cast(case when event_id // 8 >= 1024 or event_id * 419 > 2097151 or 1 + event_id * 13 % 70000 > 65535 then -2 else 0 end as integer) as status from events")
def kv_limit_status(spark, sf_dir):
    """Locations made of the events' numbers: some beyond the bits of an index entry."""
    located = _events(spark, sf_dir).select("key", "seq", F.floor(F.col("seq") / 8).alias("file_id"), (F.col("seq") * 419).alias("offset_index"), (1 + F.col("seq") * 13 % 70000).alias("page_count"))
    return layout.limit_status(located)


_TAIL = f"""{_LOC}, tail as (select *, offset_index // 64 as chunk from loc where seq > {SNAPSHOT} and seq % 97 <> 5), stop as (select file_id, chunk, min(offset_index) as stopped from tail where seq % 211 = 7 group by 1, 2),
good as (select tail.* from tail left join stop using (file_id, chunk) where stopped is null or offset_index < stopped),
base as (select * from (select *, row_number() over (partition by k order by seq desc) as rn from ops where seq <= {SNAPSHOT}) where rn = 1)"""


@_query(f"with {_TAIL}, n as (select * from (select *, row_number() over (partition by k order by seq desc) as rn from (select k, seq, del from base union all select k, seq, del from good)) where rn = 1) select k as key, seq from n where del = 0")
def kv_replay_trusted(spark, sf_dir):
    """Recovery from a snapshot and a tail with records without the magic, and others whose checksum fails."""
    log = _events(spark, sf_dir)
    return view.replay(view.as_of(log, SNAPSHOT).select("key", "seq", "op"), _tail(spark, sf_dir).select("key", "seq", "op")).select("key", "seq")


@_query(f"with {_TAIL} select greatest({SNAPSHOT}, max(seq)) + 1 as next_seq, count(*) as replayed from good")
def kv_replay_counter(spark, sf_dir):
    return _tail(spark, sf_dir).agg((F.greatest(F.lit(SNAPSHOT), F.max("seq")) + 1).alias("next_seq"), F.count("*").alias("replayed"))


def _tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("seq")
    records = _located(spark, sf_dir).where(at > SNAPSHOT).withColumns({"chunk": F.floor(F.col("offset_index") / 64), "magic_ok": at % 97 != 5, "crc_ok": at % 211 != 7})
    return view.trusted(records, ["file_id", "chunk"])


# The store itself, over the events: its whole life, then what it shows.


def _store(spark: SparkSession, sf_dir: str) -> KvStore:
    """A store that took the events in four parts, one of them staged, with a checkpoint, a compaction, a vacuum, and a
    reopening between them."""
    log = _events(spark, sf_dir).select("key", "seq", "op", "value")
    part = lambda k: log.where((F.col("seq") > k * 2500) & (F.col("seq") <= (k + 1) * 2500) if k < 3 else F.col("seq") > 7500)
    path = f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"
    delete_at_exit(spark, path)
    store = KvStore(spark, path)
    store.create(Options(data_file_size=1 << 20))
    store.put_all(log.where("seq <= 0").unionByName(part(0)))
    store.put_all(part(1))
    store.checkpoint()
    store.commit_slot(*store.stage(part(2)))
    store.compact()
    store.vacuum()
    store.put_all(part(3))
    store.close()
    again = KvStore(spark, path)
    again.open()
    return again


@_query(f"with {_CUR} select k as key, seq, props as value from cur where del = 0")
def kv_store_live(spark, sf_dir):
    return _store(spark, sf_dir).scan().withColumn("value", F.col("value").cast("string"))


@_query(_TOTALS + " select *, cast(case when total_data_bytes = 0 then 0 else total_garbage_bytes * 100 // total_data_bytes end as bigint) as garbage_ratio, cast(0 as bigint) as pending from t")
def kv_store_stats(spark, sf_dir):
    """The counters after all that, which change none of them."""
    found = _store(spark, sf_dir).stats()
    names = ["total_data_bytes", "total_garbage_bytes", "entry_count", "garbage_ratio", "pending"]
    return spark.createDataFrame([tuple(int(found[n]) for n in names)], ", ".join(f"{n} long" for n in names))


@_query(f"""with {_CUR}, req as (select unnest(range(0, 300)) as key)
select req.key, cast(case when cur.k is null or del = 1 then -1 when vlen > 9 then -6 else 0 end as integer) as status, cast(case when del = 0 then vlen end as bigint) as actual_len,
case when del = 0 and vlen <= 9 then props end as value from req left join cur on cur.k = req.key""")
def kv_store_get_async(spark, sf_dir):
    """300 asynchronous lookups, answered by one poll on one look at the log."""
    store, rows = _store(spark, sf_dir), []
    for key in range(300):
        store.get_async(key, lambda status, size, value, key=key: rows.append((key, int(status), size, value.decode() if value else None)), 9)
    store.poll()
    return spark.createDataFrame(rows, "key long, status int, actual_len long, value string")


@_query(f"with {_CUR}, half as (select * from cur where k % 2 = 0) select k as key, cast(case when del = 1 then -1 else 0 end as integer) as status from half")
def kv_store_delete_async(spark, sf_dir):
    """Asynchronous deletes of every second key ever seen: those that are deleted already aren't found."""
    store, rows = _store(spark, sf_dir), []
    keys = sorted(r.key for r in _events(spark, sf_dir).select("key").distinct().where("key % 2 = 0").collect())  # the store's queue holds as many
    for at in range(0, len(keys), 4096):
        for key in keys[at : at + 4096]:
            store.delete_async(key, lambda status, key=key: rows.append((key, int(status))))
        store.poll()
    return spark.createDataFrame(rows, "key long, status int")
