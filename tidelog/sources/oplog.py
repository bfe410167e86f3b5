"""Operation logs: their schema, and adapters from tables.

A log has key, seq, op ('PUT' or 'DEL'), value, value_len. Sequences come from one counter; nothing is assumed of the
rows' order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.functions.semantics import value_length

LOG = T.StructType([T.StructField("key", T.LongType(), False), T.StructField("seq", T.LongType(), False), T.StructField("op", T.StringType(), False), T.StructField("value", T.StringType()), T.StructField("value_len", T.LongType())])


def as_log(df: DataFrame, key: Column, seq: Column, value: Column, deleted: Column | None = None) -> DataFrame:
    deleted = F.lit(False) if deleted is None else deleted
    kept = F.when(~deleted, value)
    return df.select(key.cast("long").alias("key"), seq.cast("long").alias("seq"), F.when(deleted, "DEL").otherwise("PUT").alias("op"), kept.alias("value"), value_length(kept).alias("value_len"))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' events: an error deletes the user's entry, anything else replaces it."""
    return as_log(_table(spark, sf_dir, "events"), F.col("user_id"), F.col("event_id"), F.col("props"), F.col("event_type") == "error")


def documents_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents over 300 keys: values of several pages."""
    return as_log(_table(spark, sf_dir, "documents"), F.pmod(F.col("doc_id"), F.lit(300)), F.col("doc_id"), F.col("text"))


def orders_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders, the last of which counts."""
    return as_log(_table(spark, sf_dir, "orders"), F.col("o_custkey"), F.col("o_orderkey"), F.col("o_totalprice"))


def pages_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages over 50 keys."""
    return as_log(_table(spark, sf_dir, "pages"), F.pmod(F.col("page_id"), F.lit(50)), F.col("page_id"), F.col("html"))
