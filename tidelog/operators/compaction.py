"""Compaction: which files to rewrite, which entries move, and where the index then points."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.operators.layout import file_stats, live_locations

THRESHOLD = 0.3


def candidates(located: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Sealed files with that share of garbage at least, and the bytes that they would free."""
    return file_stats(located).where((F.col("state") == "SEALED") & (F.col("garbage_ratio") >= threshold)).select("file_id", "garbage_ratio", (F.col("total_bytes") - F.col("valid_bytes")).alias("reclaimable_bytes"))


def migrate(located: DataFrame, files: DataFrame) -> DataFrame:
    """The live entries of the files (file_id), with the offset that each gets in its destination, in order of old
    location. Each source file has a destination of its own, so none overflows; entries follow each other there from
    page 1 on, as many pages apart as they have. Stale versions and tombstones stay behind; sequences are kept."""
    moving = live_locations(located).join(files.select("file_id").distinct(), "file_id", "left_semi")
    # A file's entries are 2**21 at most, and only their numbers are in the window.
    before = Window.partitionBy("file_id").orderBy("offset_index").rowsBetween(Window.unboundedPreceding, -1)
    return moving.select("key", "seq", "file_id", "offset_index", "page_count", (F.coalesce(F.sum("page_count").over(before), F.lit(0)) + 1).cast("long").alias("new_offset"))


def destinations(files: DataFrame, first: int) -> DataFrame:
    """files (file_id) with new_file_id: one for each source, from `first` on, in order of source."""
    order = Window.partitionBy(F.lit(0)).orderBy("file_id")  # a row a file: 1024 at most
    return files.select("file_id").distinct().select("file_id", (F.row_number().over(order) + (first - 1)).cast("long").alias("new_file_id"))


def relocate(index: DataFrame, moved: DataFrame) -> DataFrame:
    """The index (key, seq, file_id, offset_index) after a move (key, file_id, offset_index, new_file_id, new_offset):
    only entries that still point to the old location change."""
    to = moved.select("key", "file_id", "offset_index", "new_file_id", "new_offset")
    joined = index.join(to, ["key", "file_id", "offset_index"], "left")
    return joined.select("key", "seq", F.coalesce("new_file_id", "file_id").alias("file_id"), F.coalesce("new_offset", "offset_index").alias("offset_index"))
