"""Requests and replies between blocks of rows and buckets of keys.

A block is a bounded set of documents, chosen by a hash of their ids. Each block asks about its distinct keys, packed
as one row for each bucket (a range of the 64-bit key space); a bucket's task compares what the blocks sent and
answers each block in packed rows again. However many documents hold a key, a bucket gets it once from a block, so no
hot key gathers in a task, and the shuffles carry few, large rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import BLOCK_BYTES, cleaning, kept, shuffle_partitions
from tidelog.sources.shared import shared_folder

ASK = "bucket int, block long, keys binary, counts binary"
REPLY = "block long, keys binary, counts binary"
#: Keys that one task compares at once, on average.
KEYS_A_TASK = 4_000_000


def by_block(rows: DataFrame, blocks: int, name: str) -> DataFrame:
    """rows, which have a column `block`, written once in buckets by it: cogroups by block read them without a shuffle
    of their own, however often. As many buckets as tasks, and one for eight blocks at least."""
    spark = rows.sparkSession
    buckets = max(shuffle_partitions(spark), -(-blocks // 8))
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    entry = f"tidelog_{uuid.uuid4().hex}"
    with cleaning(spark):
        rows.repartition(buckets, "block").write.option("compression", "zstd").option("path", path).bucketBy(buckets, "block").saveAsTable(entry)
    kept(spark, path)
    found = spark.table(entry)
    found.schema  # resolved: the catalogue's entry can go, the files stay
    spark.sql(f"drop table {entry}")
    return found


def block_count(total_bytes: int, each: int = BLOCK_BYTES) -> int:
    return max(1, -(-total_bytes // each))


def block_of(col, blocks: int):
    return F.pmod(F.xxhash64(col), F.lit(blocks))


def bucket_bits(df: DataFrame, total_keys: int) -> int:
    """Buckets enough for all tasks, several a task."""
    tasks = max(shuffle_partitions(df.sparkSession), total_keys // KEYS_A_TASK)
    return min(30, max(3, int(np.ceil(np.log2(4 * tasks)))))


def packed(block: int, keys: np.ndarray, counts: np.ndarray, bits: int) -> list[tuple]:
    """ASK rows for ascending distinct keys, which must spread evenly over 64 bits."""
    if not len(keys):
        return []
    bucket = (keys >> np.uint64(64 - bits)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    ends = [*first[1:].tolist(), len(keys)]
    counts = np.minimum(counts, 2**31 - 1).astype(np.int32)
    return [(int(bucket[a]), block, keys[a:b].tobytes(), counts[a:b].tobytes()) for a, b in zip(first.tolist(), ends, strict=True)]


def as_batch(rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def as_table(rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.Table:
    return pa.Table.from_batches([as_batch(rows, kinds, names)])


def ask_table(rows: list[tuple]) -> pa.Table:
    return as_table(rows, [pa.int32(), pa.int64(), pa.binary(), pa.binary()], ["bucket", "block", "keys", "counts"])


def _totals(rows: list[tuple[int, bytes, bytes]]) -> Iterator[tuple[int, bytes, bytes]]:
    """Of a bucket's (block, keys, counts): each block's keys with a total of two or more, and that total."""
    parts = [np.frombuffer(k, np.uint64) for _, k, _ in rows]
    keys, count = np.concatenate(parts), np.concatenate([np.frombuffer(c, np.int32) for _, _, c in rows]).astype(np.int64)
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    total = np.add.reduceat(count[order], first)
    found = np.empty(len(keys), np.int64)
    found[order] = np.repeat(total, np.diff(np.append(first, len(keys))))
    ends = np.cumsum([len(p) for p in parts]).tolist()
    for (block, _, _), a, b in zip(rows, [0, *ends[:-1]], ends, strict=True):
        mask = found[a:b] >= 2
        if mask.any():
            yield block, keys[a:b][mask].tobytes(), np.minimum(found[a:b][mask], 2**31 - 1).astype(np.int32).tobytes()


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[list[dict]]:
    """The rows of each value of a column, by which the batches are sorted: one value's rows are held at a time."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and row[key] != held[0][key]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def shared_keys(asked: DataFrame, tasks: int, bits: int) -> DataFrame:
    """REPLY rows: of each block's keys those with a total count of two or more, and that total.

    A task holds one bucket at a time, whose size the number of buckets bounds (a key comes once from a block).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(batches, "bucket"):
            yield as_batch(list(_totals([(r["block"], r["keys"], r["counts"]) for r in rows])), [pa.int64(), pa.binary(), pa.binary()], ["block", "keys", "counts"])

    # Four buckets a task, or more.
    return asked.repartition(max(tasks, (1 << bits) // 16), "bucket").sortWithinPartitions("bucket").mapInArrow(run, REPLY)


def merged_reply(keys: list[bytes], counts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A block's replies of all buckets as ascending keys and their counts."""
    k = np.frombuffer(b"".join(keys), np.uint64)
    c = np.frombuffer(b"".join(counts), np.int32)
    order = np.argsort(k)
    return k[order], c[order]


def looked_up(keys: np.ndarray, known: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The value of each key, 0 if it is not among the ascending known ones."""
    if not len(known) or not len(keys):
        return np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[at] == keys, values[at], 0).astype(np.int64)
