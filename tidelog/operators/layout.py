"""Where entries lie: files of pages filled in order of sequence, their totals, and their valid pages.

A file holds pages_per_file pages, the first of which is its header. An entry that doesn't fit the rest of the file
opens the next one (next fit), at page 1.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions.semantics import MAX_FILES, MAX_OFFSET, MAX_PAGES, PAGE, Status
from tidelog.operators.ordered import chunk_of, with_position
from tidelog.operators.view import latest


def place_uniform(entries: DataFrame, pages_per_file: int) -> DataFrame:
    """entries of one page each with file_id and offset_index, in closed form."""
    room = pages_per_file - 1
    placed = with_position(entries)
    return placed.select(*entries.columns, F.floor(F.col("position") / room).cast("long").alias("file_id"), (F.col("position") % room + 1).cast("long").alias("offset_index"))


def _reach(sums: np.ndarray, first: np.ndarray, at: np.ndarray, limit: int) -> np.ndarray:
    """The entry behind the last that fits a file when entry `first` is placed at an offset; sums: pages before each."""
    return np.searchsorted(sums, limit - at + sums[first], side="right") - 1


def _folded(pages: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """For each offset 1..limit that a chunk may begin at: files opened, and the offset at its end.

    Every file but the first is filled from page 1, so all ways go from entry to entry along one table; a step is a
    file, and ways that have come to the same entry go on as one.
    """
    n, sums = len(pages), np.concatenate([[0], np.cumsum(pages)])
    start = np.arange(1, limit + 1, dtype=np.int64)
    at = _reach(sums, np.zeros(limit, np.int64), start, limit)
    files, ends = np.zeros(limit, np.int64), start + sums[n]
    places, way = np.unique(at, return_inverse=True)
    opened, end = np.zeros(len(places), np.int64), np.zeros(len(places), np.int64)
    root, here = np.arange(len(places)), places.copy()
    done = np.flatnonzero(here >= n)
    live = np.flatnonzero(here < n)
    count = np.zeros(len(places), np.int64)  # files opened by each way that still goes on, until it joins another
    joined: list[tuple[int, int, int]] = []
    while len(live):
        last = here[live]
        after = np.maximum(_reach(sums, last, np.ones(len(live), np.int64), limit), last + 1)  # a file takes one entry
        count[live] += 1
        over = after >= n
        end[live[over]] = 1 + sums[n] - sums[last[over]]
        opened[live[over]] = count[live[over]]
        here[live] = after
        live = live[~over]
        _, first, inverse = np.unique(here[live], return_index=True, return_inverse=True)
        for k in np.flatnonzero(first[inverse] != np.arange(len(live))).tolist():
            joined.append((int(live[k]), int(live[first[inverse[k]]]), int(count[live[k]] - count[live[first[inverse[k]]]])))
        live = live[np.sort(first)]
    for k, other, more in reversed(joined):
        opened[k], end[k] = opened[other] + more, end[other]
    going = at < n
    files[going], ends[going] = opened[way[going]], end[way[going]]
    return files, ends


def _placed(pages: np.ndarray, file: int, at: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """The file and offset of each entry of a chunk that begins there; a file at a time."""
    n, sums = len(pages), np.concatenate([[0], np.cumsum(pages)])
    files, offsets, i = np.empty(n, np.int64), np.empty(n, np.int64), 0
    while i < n:
        j = int(np.searchsorted(sums, limit - at + sums[i], side="right")) - 1
        if j <= i:
            file, at = file + 1, 1
            j = max(i + 1, int(np.searchsorted(sums, limit - 1 + sums[i], side="right")) - 1)
        files[i:j], offsets[i:j] = file, at + sums[i:j] - sums[i]
        at += int(sums[j] - sums[i])
        i = j
    return files, offsets


def place(entries: DataFrame, pages_per_file: int) -> DataFrame:
    """entries (seq, page_count) of any sizes with file_id and offset_index.

    Next fit is a fold over all entries, but what a chunk of the log does to the position is a small table: for each
    offset it may begin at, the files it opens and the offset it ends at, as runs of offsets that do the same. Chunks
    make these tables in parallel, one task goes through the tables, and the chunks place their entries from where
    they then begin. Only seq and page_count pass through Python, whole arrays at once.
    """
    slim = entries.select("seq", "page_count").withColumn("chunk", chunk_of(F.col("seq")))
    limit = pages_per_file

    def fold(key, pdf: pd.DataFrame) -> pd.DataFrame:
        files, ends = _folded(pdf.sort_values("seq").page_count.to_numpy(), limit)
        # Offsets that don't fill the first file end where they began, plus the chunk: told by their difference.
        ends = np.where(files > 0, ends, ends - np.arange(1, limit + 1))
        begins = np.flatnonzero(np.concatenate([[True], (files[1:] != files[:-1]) | (ends[1:] != ends[:-1])]))
        return pd.DataFrame({"chunk": [key[0]], "begins": [(begins + 1).tolist()], "files": [files[begins].tolist()], "ends": [ends[begins].tolist()]})

    tables = slim.groupBy("chunk").applyInPandas(fold, "chunk long, begins array<long>, files array<long>, ends array<long>")

    def chain(batches):
        file, at = 0, 1
        for pdf in batches:
            rows = []
            for chunk, begins, files, ends in zip(pdf.chunk, pdf.begins, pdf.files, pdf.ends, strict=True):
                rows.append((chunk, file, at))
                # Beyond the file's end, as after an entry larger than a file, the next entry opens one in any case.
                start = min(at, limit)
                k = int(np.searchsorted(begins, start, side="right")) - 1
                file, at = file + int(files[k]), int(ends[k]) + (0 if files[k] else start)
            yield pd.DataFrame(rows, columns=["chunk", "first_file", "first_offset"])

    starts = tables.repartition(1).sortWithinPartitions("chunk").mapInPandas(chain, "chunk long, first_file long, first_offset long")

    def put(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values("seq")
        files, offsets = _placed(left.page_count.to_numpy(), int(right.first_file.iloc[0]), int(right.first_offset.iloc[0]), limit)
        return pd.DataFrame({"seq": left.seq, "file_id": files, "offset_index": offsets})

    placed = slim.groupBy("chunk").cogroup(starts.groupBy("chunk")).applyInPandas(put, "seq long, file_id long, offset_index long")
    return entries.join(placed, "seq").select(*[entries[c] for c in entries.columns], "file_id", "offset_index")


def live_locations(located: DataFrame) -> DataFrame:
    """The locations that the index points to: each key's newest entry, unless it is a tombstone."""
    return latest(located).where(F.col("op") == "PUT")


def file_stats(located: DataFrame) -> DataFrame:
    """Each file's bytes and entries, valid ones, garbage ratio and state; the last file is active.

    Two aggregations meet by file, a row each; entries themselves are joined with nothing.
    """
    size = F.sum(F.col("page_count") * PAGE).cast("long")
    every = located.groupBy("file_id").agg(size.alias("total_bytes"), F.count("*").alias("total_entries"))
    valid = live_locations(located).groupBy("file_id").agg(size.alias("valid_bytes"), F.count("*").alias("valid_entries"))
    none = F.lit(0).cast("long")
    totals = every.join(valid, "file_id", "left").withColumns({c: F.coalesce(c, none) for c in ("valid_bytes", "valid_entries")})
    top = F.max("file_id").over(Window.partitionBy(F.lit(0)))  # a row a file: 1024 at most
    ratio = F.lit(1.0) - F.col("valid_bytes").cast("double") / F.col("total_bytes").cast("double")
    return totals.select("file_id", F.when(F.col("file_id") < top, "SEALED").otherwise("ACTIVE").alias("state"), "total_bytes", "valid_bytes", "total_entries", "valid_entries", ratio.alias("garbage_ratio"))


def readable(files: DataFrame) -> DataFrame:
    return files.where(F.col("state").isin("ACTIVE", "SEALED", "COMPACTING"))


def valid_page_bitmap(located: DataFrame) -> DataFrame:
    """Sparse bitmaps of the pages that live entries cover: (file_id, chunk, bitmap), chunks of 32,768 pages from 0."""
    pages = live_locations(located).select("file_id", F.explode(F.sequence(F.col("offset_index"), F.col("offset_index") + F.col("page_count") - 1)).alias("page"))
    numbered = pages.select("file_id", "page", (F.bitmap_bucket_number(F.col("page") + 1) - 1).alias("chunk"), F.bitmap_bit_position(F.col("page") + 1).alias("bit"))
    return numbered.groupBy("file_id", "chunk").agg(F.bitmap_construct_agg("bit").alias("bitmap"))


def bitmap_stats(bitmaps: DataFrame) -> DataFrame:
    return bitmaps.groupBy("file_id").agg(F.sum(F.bitmap_count("bitmap")).cast("long").alias("valid_pages"), F.count("*").alias("chunks"))


def first_after(located: DataFrame) -> DataFrame:
    """Where each file's next entry would lie: its write offset in pages."""
    newest = Window.partitionBy("file_id").orderBy(F.col("offset_index").desc())
    return located.withColumn("_rank", F.row_number().over(newest)).where("_rank = 1").select("file_id", (F.col("offset_index") + F.col("page_count")).alias("write_offset"))


def valid_pages(located: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Each file's pages that count as valid: files below that share of garbage have no bitmap, and all theirs do."""
    stats = file_stats(located).select("file_id", (F.col("garbage_ratio") >= threshold).alias("_mapped"), (F.col("total_bytes") / PAGE).cast("long").alias("_all"))
    mapped = bitmap_stats(valid_page_bitmap(located)).select("file_id", "valid_pages")
    joined = stats.join(mapped, "file_id", "left")
    return joined.select("file_id", F.when(F.col("_mapped"), F.coalesce("valid_pages", F.lit(0))).otherwise(F.col("_all")).cast("long").alias("valid_pages"))


def limit_status(located: DataFrame) -> DataFrame:
    """key, seq and whether the location fits an index entry: file, offset and pages within their bits, else -2."""
    fits = (F.col("file_id") < MAX_FILES) & (F.col("offset_index") <= MAX_OFFSET) & (F.col("page_count") <= MAX_PAGES)
    return located.select("key", "seq", F.when(fits, int(Status.OK)).otherwise(int(Status.TOO_SMALL)).alias("status"))


def from_position(located: DataFrame, file_id: int, offset_index: int) -> DataFrame:
    """Entries at or after a checkpoint's position; files before it aren't read."""
    return located.where((F.col("file_id") > file_id) | ((F.col("file_id") == file_id) & (F.col("offset_index") >= offset_index)))
