"""Ordered computations that no key or single task has to hold whole.

Rows are cut into chunks that follow the order (sequences count up, so a division makes them); a window runs within a
chunk, and what the chunks before contribute is aggregated to a row each and carried over. A key of any share of the
log so spreads over as many tasks as it has chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Sequences of a chunk.
CHUNK = 1 << 20


def chunk_of(seq: Column, size: int = CHUNK) -> Column:
    return F.floor(seq / size).cast("long")


def with_previous(df: DataFrame, columns: list[str], key: str = "key", order: str = "seq", chunk: Column | None = None) -> DataFrame:
    """df with prev_<column>: the value in the key's row before, in order; null at its first row."""
    chunk = chunk_of(F.col(order)) if chunk is None else chunk
    rows = df.withColumn("_chunk", chunk)
    within = Window.partitionBy(key, "_chunk").orderBy(order)
    picked = F.struct(*columns)
    last = rows.groupBy(key, "_chunk").agg(F.max_by(picked, order).alias("_last"))
    carried = last.withColumn("_carried", F.lag("_last").over(Window.partitionBy(key).orderBy("_chunk"))).select(key, "_chunk", "_carried")
    joined = rows.withColumns({"_prev": F.lag(picked).over(within)}).join(carried, [key, "_chunk"])
    found = F.coalesce("_prev", "_carried")
    return joined.select(*[joined[c] for c in df.columns], *[found[c].alias(f"prev_{c}") for c in columns])


def with_running_max(df: DataFrame, column: str, order: str, chunk: Column, key: str = "key") -> DataFrame:
    """df with prev_max: the greatest value of the column in the key's rows before, in order."""
    rows = df.withColumn("_chunk", chunk)
    before = Window.partitionBy(key, "_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    tops = rows.groupBy(key, "_chunk").agg(F.max(column).alias("_top"))
    carried = tops.withColumn("_carried", F.max("_top").over(Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1))).select(key, "_chunk", "_carried")
    joined = rows.withColumn("_own", F.max(column).over(before)).join(carried, [key, "_chunk"])
    return joined.select(*[joined[c] for c in df.columns], F.greatest("_own", "_carried").alias("prev_max"))


def with_position(df: DataFrame, order: str = "seq", name: str = "position") -> DataFrame:
    """df with each row's place in the order, from 0, over all rows. Only a count for each chunk meets in one task."""
    rows = df.withColumn("_chunk", chunk_of(F.col(order)))
    counts = rows.groupBy("_chunk").agg(F.count("*").alias("_n"))
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_chunk", "_start")
    local = rows.withColumn("_rank", F.row_number().over(Window.partitionBy("_chunk").orderBy(order)))
    joined = local.join(starts, "_chunk")
    return joined.select(*[joined[c] for c in df.columns], (F.col("_start") + F.col("_rank") - 1).cast("long").alias(name))
