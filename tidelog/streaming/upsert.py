"""Upserts as a stream: the latest version of each key, and the counters, kept from operations as they arrive."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions.semantics import PAGE, page_count
from tidelog.sources.oplog import as_log
from tidelog.sources.shared import shared_folder


def events_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """The events' log as a file stream; max_files a trigger stands for the writers' back-pressure."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    # A single file can't be a stream's source: its folder is, with a filter on the file's name.
    folder, _, name = path.rstrip("/").rpartition("/")
    events = reader.option("pathGlobFilter", name).parquet(folder) if _is_file(spark, path) else reader.parquet(path)
    return as_log(events, F.col("user_id"), F.col("event_id"), F.col("props"), F.col("event_type") == "error")


def _is_file(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile()


def latest_versions(log: DataFrame) -> DataFrame:
    """The newest version of each key, whatever the order of arrival; tombstones stay, so a late older put can't
    bring a key back. There is no watermark: the log has no limit of lateness, and the state is a row a key."""
    newest = F.max_by(F.struct("seq", "op", "value"), "seq").alias("top")
    return log.groupBy("key").agg(newest).select("key", "top.*")


_COUNTERS = "key long, data_bytes long, garbage_bytes long, entries long"


def counters(log: DataFrame) -> DataFrame:
    """Bytes written and garbage of each key so far. Operations of a key must arrive in order of sequence; for any
    other order recompute from the log."""
    slim = log.select("key", "seq", "op", page_count(F.col("value_len")).alias("pages"))

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        pages, data, garbage, entries = state.get if state.exists else (0, 0, 0, 0)
        rows = pd.concat(list(batches)).sort_values("seq")
        for op, n in zip(rows.op, rows.pages, strict=True):
            if op == "DEL" and not pages:
                continue
            data += n * PAGE
            garbage += pages * PAGE
            entries = entries or int(op == "PUT")
            pages = n if op == "PUT" else 0
        state.update((int(pages), int(data), int(garbage), int(entries)))
        yield pd.DataFrame({"key": [key[0]], "data_bytes": [int(data)], "garbage_bytes": [int(garbage)], "entries": [int(entries)]})

    from pyspark.sql.streaming.state import GroupStateTimeout

    return slim.groupBy("key").applyInPandasWithState(update, _COUNTERS, "pages long, data_bytes long, garbage_bytes long, entries long", "update", GroupStateTimeout.NoTimeout)


def run_once(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update") -> None:
    """Everything that has come so far, batch by batch."""
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(each).trigger(availableNow=True).start()
    query.awaitTermination()


def latest_once(spark: SparkSession, path: str) -> DataFrame:
    """key, seq of the newest versions after all of the stream's input."""
    run = uuid.uuid4().hex
    base = f"{shared_folder(spark)}/upsert-{run}"

    def each(batch: DataFrame, number: int) -> None:
        batch.select("key", "seq").withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{base}/out/{number}")

    run_once(latest_versions(events_stream(spark, path)), each, f"{base}/state")
    found = spark.read.schema("key long, seq long").parquet(f"{base}/out/*")
    return found.groupBy("key").agg(F.max("seq").alias("seq"))
