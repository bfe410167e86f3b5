"""A corpus pipeline: toxicity, language, near duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of `documents`.
run() writes what each stage keeps and reads it again, so no stage is computed twice, and deletes what the stages stored
on the way.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import fresh, scratch, table, written
from tidelog.llm.languages import fit_languages, with_language
from tidelog.llm.ngram_join import representatives
from tidelog.llm.packing import pack_documents
from tidelog.llm.suffix_dedup import dedup_documents
from tidelog.llm.toxicity import fit_toxicity, flag_toxic
from tidelog.sources.shared import delete

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose score is 0.5 or more. Texts without words are kept."""
    mark = fresh(docs, "toxic")
    flagged = flag_toxic(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")), mark)
    return flagged.where(~F.col(mark)).select(*_columns(docs))


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without null texts, those without letters, and those that the model flags as ambiguous; lang is the predicted
    one. Without a learned language only the first two go."""
    model = fit_languages(docs)
    lang, ambiguous = fresh(docs, "language"), fresh(docs, "ambiguous")
    found = with_language(docs, model, lang, ambiguous)
    if model is None:
        return found.where(F.col("text").rlike(r"\p{L}")).select(*_columns(docs))
    kept = found.where(~F.col(ambiguous))
    return kept.select(*[F.col(lang).alias("lang") if c == "lang" else F.col(f"`{c}`") for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of links stays: that of the smallest id, and of its rows one. Rows without an id
    stay unless a row with one, or another of them, has the same shingles; texts without words stay, once an id."""
    return representatives(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that repeat from a document of a smaller id; texts of which nothing remains go.

    Cuts fall between bytes; the rest of a character that is cut in two goes as well. n_chars follows the text.
    """
    was_null = fresh(docs, "was_null")
    kept = dedup_documents(docs, with_text=True).where("n_removed = 0 or length(kept) > 0")
    columns = []
    for c in docs.columns:
        own = F.col("row").getField(c)
        if c == "text":
            own = F.when(~F.col("row").getField(was_null), F.col("kept"))
        elif c == "n_chars":
            own = F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(own)
        columns.append(own.alias(c))
    return kept.select(*columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of each document in its sequence."""
    return pack_documents(docs, TOKENIZER)


STAGES = [
    ("toxicity", drop_toxic),
    ("language", drop_unknown_language),
    ("near duplicates", drop_near_duplicates),
    ("repeated passages", cut_repeated_passages),
    ("packing", pack),
]

#: SQL can't express the classifiers and the tokenizer.
ORACLE_SQL = None


def _columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        with scratch(spark):
            path = written(stage(spark, docs, sf_dir), "stage")
        if before:
            delete(spark, before)
        docs, before = spark.read.schema(docs.schema).parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
