"""Shared plumbing of the operators: Arrow slices, shared tables, data-driven partition counts."""

from __future__ import annotations

import contextlib
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.sources.shared import delete, delete_at_exit, shared_folder

#: Bytes of text handed to a numpy kernel at once; its work arrays take about sixty times that.
SLICE_BYTES = 1 << 19
#: Rows of such a slice, for kernels that hold a dense vector for each.
SLICE_ROWS = 256
#: Rows of a sample for fitting, on average; twice that at most.
SAMPLE_ROWS = 6000
#: Classes that a classifier learns, at most.
MOST_CLASSES = 500
#: Bytes of text that one block (the unit of a request and its reply) holds on average.
BLOCK_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Drops the shuffle files of a query as it ends, not when the driver happens to collect its garbage.
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


_scratch: list[list[str]] = []


@contextlib.contextmanager
def cleaning(spark: SparkSession) -> Iterator[None]:
    """Inside, a query's shuffles free their disk as it ends."""
    before = spark.conf.get(_CLEAN_UP, "false")
    spark.conf.set(_CLEAN_UP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEAN_UP, before)


def written(df: DataFrame, name: str) -> str:
    """Writes df to a new folder of the shared one, which is deleted at the session's end; its path."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    with cleaning(spark):
        df.write.option("compression", "zstd").parquet(path)
    delete_at_exit(spark, path)
    return path


def kept(spark: SparkSession, path: str) -> None:
    """Notes a folder for deletion: as the scratch() around ends, and with the session."""
    delete_at_exit(spark, path)
    if _scratch:
        _scratch[-1].append(path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends there, so a lost executor costs a reread, and the
    shuffles behind it free their disk."""
    path = written(df, name)
    kept(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes, at the end, the tables that operators stored inside: what they return must be written by then."""
    _scratch.append([])
    try:
        yield
    finally:
        for path in _scratch.pop():
            delete(spark, path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Classes with over this share of all rows are joined by a broadcast: 1 / HOT_SHARE of them at most.
HOT_SHARE = 1 / 1000


def with_class(rows: DataFrame, classes: DataFrame, keys: list[str], total: int) -> DataFrame:
    """rows left joined with their class (keys, `class_rows`, further columns); no class gathers in a task: the large
    ones are few and broadcast, and the rest have at most HOT_SHARE of the rows each."""
    large = F.col("class_rows") > HOT_SHARE * total
    hot, rest = classes.where(large), classes.where(~large)
    marked = rows.join(F.broadcast(hot.select(*keys, F.lit(1).alias("_hot"))), keys, "left")
    first = marked.where("_hot = 1").drop("_hot").join(F.broadcast(hot), keys)
    return first.unionByName(marked.where("_hot is null").drop("_hot").join(rest, keys, "left"))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(df: DataFrame, text_col: str = "text") -> int:
    return df.agg(F.sum(F.octet_length(text_col))).first()[0] or 0


def slices(batches: Iterator[pa.RecordBatch], text_col: str, limit: int = SLICE_BYTES, rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that each slice holds at most `limit` bytes of text, or a single row, and at most `rows` rows."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text_col)), 0).to_pylist()
        start = size = 0
        for i, s in enumerate(sizes):
            if i > start and (size + s > limit or i - start == rows):
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += s
        yield batch.slice(start, n - start)


def map_slices(df: DataFrame, text_col: str, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str | T.StructType, limit: int = SLICE_BYTES) -> DataFrame:
    """mapInArrow of `fn` over text-bounded slices; no shuffle, one pass."""

    def run(batches):
        for piece in slices(batches, text_col, limit):
            out = fn(piece)
            if out is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


def held_out(doc_id: int | None) -> bool:
    """The contract's fold: crc32 of the id as text, modulo 5, is 0. A null id counts as empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5 == 0


def held_out_column(col):
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def bounded_sample(rows: DataFrame, id_col: str, class_col: str, per_class: int) -> DataFrame:
    """About per_class rows of each class (all of a smaller class), chosen by a hash of the id; never over twice that.

    For fitting classifiers only. The classes are counted over all rows; of many, each gives less: SAMPLE_ROWS in all.
    Of more than MOST_CLASSES the most frequent are learned (ties to the smaller name).
    """
    counts = {r[0]: r[1] for r in rows.groupBy(class_col).count().orderBy(F.desc("count"), class_col).limit(MOST_CLASSES).collect()}
    if not counts:
        return rows.limit(0)
    space, per_class = 1 << 30, max(1, min(per_class, SAMPLE_ROWS // len(counts)))
    rate = F.lit(0)
    for value, n in sorted(counts.items()):
        rate = F.when(F.col(class_col) == F.lit(value), int(space * min(1.0, per_class / n))).otherwise(rate)
    return rows.where(F.pmod(F.xxhash64(F.col(id_col)), F.lit(space)) < rate).limit(2 * per_class * len(counts))
