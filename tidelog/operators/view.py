"""What a log shows: latest versions, live entries, lookups, the outcome of each operation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions.semantics import Status, page_count
from tidelog.operators.ordered import with_previous


def latest(log: DataFrame) -> DataFrame:
    """The newest version of each key, tombstones too. Each task keeps one row a key before the shuffle, so a hot key
    costs no more than others."""
    newest = Window.partitionBy("key").orderBy(F.col("seq").desc())
    return log.withColumn("_rank", F.row_number().over(newest)).where("_rank = 1").drop("_rank")


def live(log: DataFrame) -> DataFrame:
    return latest(log).where(F.col("op") == "PUT")


def as_of(log: DataFrame, seq: int) -> DataFrame:
    """The versions that a snapshot at that sequence holds, tombstones too."""
    return latest(log.where(F.col("seq") <= seq))


def get(log: DataFrame, key: int) -> DataFrame:
    """The live entry of a key; the filter reaches the scan."""
    return live(log.where(F.col("key") == key))


def range_scan(log: DataFrame, low: int, high: int) -> DataFrame:
    """Live entries of keys between the bounds (an extension; keys as signed numbers)."""
    return live(log.where(F.col("key").between(low, high)))


def multi_get(log: DataFrame, requests: DataFrame, buffer: Column) -> DataFrame:
    """requests (key) with status, actual_len and value: missing or deleted -1, larger than the buffer -2 with its
    length, else 0. A request for a key that isn't there is a row all the same."""
    buffer_size = buffer
    found = requests.join(latest(log.join(requests.select("key").distinct(), "key", "left_semi")), "key", "left")
    there = F.coalesce(F.col("op") == "PUT", F.lit(False))
    status = F.when(~there, int(Status.NOT_FOUND)).when(F.col("value_len") > buffer_size, int(Status.TOO_SMALL)).otherwise(int(Status.OK))
    return found.select(*[found[c] for c in requests.columns], status.alias("status"), F.when(there, F.col("value_len")).alias("actual_len"), F.when(status == 0, F.col("value")).alias("value"))


def op_status(log: DataFrame) -> DataFrame:
    """key, seq, op, status: a delete of a key that isn't there, or is deleted already, is -1 and writes nothing."""
    rows = with_previous(log.select("key", "seq", "op"), ["op"])
    idle = (F.col("op") == "DEL") & F.coalesce(F.col("prev_op") != "PUT", F.lit(True))
    return rows.select("key", "seq", "op", F.when(idle, int(Status.NOT_FOUND)).otherwise(int(Status.OK)).alias("status"))


def effective(log: DataFrame) -> DataFrame:
    """The operations that write an entry, with its pages."""
    rows = with_previous(log.select("key", "seq", "op", "value_len"), ["op"])
    return rows.where((F.col("op") == "PUT") | (F.col("prev_op") == "PUT")).select("key", "seq", "op", "value_len", page_count(F.col("value_len")).alias("page_count"))


def replay(snapshot: DataFrame, tail: DataFrame) -> DataFrame:
    """Live entries of a snapshot (with tombstones) and the log after it."""
    return live(snapshot.unionByName(tail))


def journal_prefix(records: DataFrame, group: str = "group_id", order: str = "slot", good: str = "good") -> DataFrame:
    """Of each group's records those before the first that is damaged, or whose seq isn't greater than the one before;
    groups are a ring's few slots."""
    within = Window.partitionBy(group).orderBy(order)
    rising = F.coalesce(F.col("seq") > F.lag("seq").over(within), F.lit(True))
    rows = records.withColumn("_fine", (F.col(good) & rising).cast("int"))
    return rows.withColumn("_whole", F.min("_fine").over(within.rowsBetween(Window.unboundedPreceding, 0))).where("_whole = 1").drop("_whole", "_fine")


def trusted(records: DataFrame, chunk: list[str], order: str = "offset_index") -> DataFrame:
    """The records of a log's tail that recovery takes: those without the magic (not magic_ok) are passed over, and in
    each chunk nothing from the first mismatch of the checksum (not crc_ok) on. The first mismatches are aggregated,
    a row a damaged chunk, and joined."""
    marked = records.where("magic_ok")
    damaged = marked.where("not crc_ok").groupBy(*chunk).agg(F.min(order).alias("_stop"))
    return marked.join(damaged, chunk, "left").where(F.col("_stop").isNull() | (F.col(order) < F.col("_stop"))).drop("_stop")


def locate(located: DataFrame, files: DataFrame, requests: DataFrame) -> DataFrame:
    """requests (key) with the file and offset of their live entries; status -1 where there is none, or where the file
    (file_id, state) can't be read in its state."""
    alive = latest(located).where(F.col("op") == "PUT").select("key", "file_id", "offset_index")
    usable = alive.join(files.where(F.col("state").isin("ACTIVE", "SEALED", "COMPACTING")).select("file_id"), "file_id", "left_semi")
    found = requests.join(usable, "key", "left")
    return found.select("key", "file_id", "offset_index", F.when(F.col("file_id").isNull(), int(Status.NOT_FOUND)).otherwise(int(Status.OK)).alias("status"))
