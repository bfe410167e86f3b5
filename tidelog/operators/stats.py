"""A log's counters: entries ever put, bytes written, garbage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.functions.semantics import PAGE, capacity_for, page_count
from tidelog.operators.ordered import with_previous
from tidelog.operators.view import effective


def totals(log: DataFrame) -> DataFrame:
    """One row: total_data_bytes, total_garbage_bytes, entry_count, garbage_ratio (a whole percentage, 0 of nothing).

    Every effective operation writes its pages; the pages of a live version that it replaces become garbage,
    tombstones never. Keys ever put are counted, deleted ones too.
    """
    rows = with_previous(effective(log), ["op", "page_count"])
    found = rows.agg(
        F.coalesce(F.sum(F.col("page_count") * PAGE), F.lit(0)).cast("long").alias("total_data_bytes"),
        F.coalesce(F.sum(F.when(F.col("prev_op") == "PUT", F.col("prev_page_count") * PAGE)), F.lit(0)).cast("long").alias("total_garbage_bytes"),
        F.count_distinct(F.when(F.col("op") == "PUT", F.col("key"))).alias("entry_count"),
    )
    ratio = F.when(F.col("total_data_bytes") == 0, F.lit(0)).otherwise(F.floor(F.col("total_garbage_bytes") * 100 / F.nullif("total_data_bytes", F.lit(0))))
    return found.withColumn("garbage_ratio", F.coalesce(ratio, F.lit(0)).cast("long"))


def added(log: DataFrame) -> DataFrame:
    """One row: data and garbage bytes that the rows which aren't `counted` add, and all keys ever put (entries).

    Counted rows only tell what was there before: of each key its newest one at least.
    """
    rows = with_previous(log.select("key", "seq", "op", "value_len", "counted"), ["op", "value_len"])
    wrote = (F.col("op") == "PUT") | (F.col("prev_op") == "PUT")
    replaced = F.when(F.col("prev_op") == "PUT", page_count(F.col("prev_value_len")) * PAGE)
    sums = lambda c: F.coalesce(F.sum(F.when(wrote & ~F.col("counted"), c)), F.lit(0)).cast("long")
    return rows.agg(sums(page_count(F.col("value_len")) * PAGE).alias("data"), sums(replaced).alias("garbage"), F.count_distinct(F.when(wrote | F.col("counted"), F.col("key"))).alias("entries"))


def load_factor(log: DataFrame, max_entries: int) -> DataFrame:
    slots = capacity_for(max_entries)
    return log.where(F.col("op") == "PUT").agg(F.count_distinct("key").alias("size")).select("size", F.lit(slots).cast("long").alias("capacity"), (F.col("size") / F.lit(float(slots))).alias("load_factor"))


def workload_mix(log: DataFrame) -> DataFrame:
    """Operations and value bytes of each kind."""
    return log.groupBy("op").agg(F.count("*").alias("ops"), F.sum("value_len").cast("long").alias("value_bytes"))
