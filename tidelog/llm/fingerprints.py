"""SimHash document fingerprints and the search for near ones.

Terms are the pairs of adjacent lower-cased words of a text (weight 2), its single words and its four-byte grams. The
weight of the latter two falls smoothly with the words of the text, as (1 - words / FADE_WORDS) squared, and is 0 from
FADE_WORDS on: no length has a neighbour of another scheme. Each occurrence votes with its weight for the bits of its
hash and against the others; a fingerprint has the bits whose votes are positive.

near_fingerprints() finds all pairs within a Hamming radius r: bits are cut into r + 3 blocks, and for each choice of
3 blocks a table is keyed by them; two fingerprints that differ in at most r bits agree on 3 blocks at least, so they
meet in some table. Equal fingerprints are one class, so copies never multiply.

next_document_edits() compares each text with an edited version and with the next document in order of doc_id; rows
are range-partitioned and sorted, and only each partition's first and last rows are matched across partitions.

Defined results: null texts count as empty; the fingerprint of a text without terms is all zeros; null ids come last;
of repeated ids the texts decide the order; a single document is its own next one.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm import kernels
from tidelog.llm.common import map_slices, shuffle_partitions, slices, stored, table

BITS = 256
FADE_WORDS = 96
_TERMS = 8192  # voting at once; their bits take 2 MB


def _votes(hashes: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Votes for each bit, and all votes, of each of n rows; `rows` is ascending."""
    yes = np.zeros((n, BITS), np.int32)
    for at in range(0, len(hashes), _TERMS):
        h, r = hashes[at : at + _TERMS], rows[at : at + _TERMS]
        wide = np.stack([kernels.mix(h + np.uint64(0x9E3779B97F4A7C15 * (j + 1) % (1 << 64))) for j in range(BITS // 64)], axis=1)
        lanes = np.unpackbits(wide.view(np.uint8), axis=1).view(np.uint64)  # eight bits' counters in a word
        first = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
        sizes = np.diff(np.append(first, len(r)))
        cuts = np.concatenate([np.arange(s, s + k, 255) for s, k in zip(first, sizes, strict=True)]) if sizes.max() > 255 else first
        sums = np.add.reduceat(lanes, cuts, axis=0).view(np.uint8)
        if len(cuts) != len(first):
            own = np.flatnonzero(np.concatenate([[True], r[cuts][1:] != r[cuts][:-1]]))
            sums = np.add.reduceat(sums, own, axis=0, dtype=np.int32)
        yes[r[first]] += sums
    return yes, np.bincount(rows, minlength=n)


def simhash(column: pa.Array) -> np.ndarray:
    """The fingerprint of each row of a string column, as BITS/8 bytes."""
    data, offsets = kernels.text_buffers(column)
    n = len(column)
    lower = kernels.LOWER[data]
    starts, lengths, rows = kernels.words(data, offsets, ~kernels.IS_SPACE)
    h = kernels.word_hashes(lower, starts, lengths)
    yes, total = np.zeros((n, BITS), np.int64), np.zeros(n, np.int64)
    fade = np.maximum(0, FADE_WORDS - np.bincount(rows, minlength=n)) ** 2
    short = fade > 0
    if short.any():
        more, extra = _votes(h[short[rows]], rows[short[rows]], n)
        yes, total = yes + fade[:, None] * more, total + fade * extra
    if len(h) > 1:
        same = rows[1:] == rows[:-1]
        pair = kernels.mix(h[:-1] * np.uint64(3) + h[1:])[same]
        more, extra = _votes(pair, rows[:-1][same], n)
        yes, total = yes + 2 * FADE_WORDS**2 * more.astype(np.int64), total + 2 * FADE_WORDS**2 * extra
    if short.any() and len(lower) >= 4:
        of = np.repeat(np.arange(n), np.diff(offsets))
        use = np.flatnonzero((of[3:] == of[:-3]) & short[of[:-3]])
        b = lower.astype(np.uint64)
        gram = b[use] | (b[use + 1] << np.uint64(8)) | (b[use + 2] << np.uint64(16)) | (b[use + 3] << np.uint64(24))
        more, extra = _votes(kernels.mix(gram + np.uint64(1 << 40)), of[use], n)
        yes, total = yes + fade[:, None] * more, total + fade * extra
    return np.packbits(2 * yes > total[:, None], axis=1)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 1.0 - np.unpackbits(a ^ b, axis=1).sum(1) / float(BITS)


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and `fingerprint` (hex) of every row."""
    kind = dict(df.dtypes)[id_col]

    def run(batch):
        marks = [r.tobytes().hex() for r in simhash(batch.column(1))]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks, pa.string())], [id_col, "fingerprint"])

    return map_slices(df.select(id_col, text_col), text_col, run, f"`{id_col}` {kind}, fingerprint string")


def near_fingerprints(marks: DataFrame, radius: int, id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(members, pairs): class_id of each row (the smallest id with an equal fingerprint), and the class pairs
    (left_id < right_id, distance) within the radius, each once. Rows without an id or a fingerprint take no part."""
    rows = marks.select(F.col(id_col).alias("_id"), "fingerprint").where(F.col("_id").isNotNull() & F.col("fingerprint").isNotNull())
    classes = rows.groupBy("fingerprint").agg(F.min("_id").alias("class_id"))
    members = rows.join(classes, "fingerprint").select(F.col("_id").alias(id_col), "class_id")
    blocks = radius + 3
    digits = BITS // 4
    edges = [round(i * digits / blocks) for i in range(blocks + 1)]
    part = lambda i: F.substring("fingerprint", edges[i] + 1, edges[i + 1] - edges[i])
    keys = F.array(*[F.concat(F.lit(f"{t}:"), *[part(i) for i in kept]) for t, kept in enumerate(itertools.combinations(range(blocks), 3))])
    tabled = classes.select("class_id", "fingerprint", F.explode(keys).alias("key"))
    left = tabled.select("key", F.col("class_id").alias("left_id"), F.col("fingerprint").alias("_a"))
    right = tabled.select("key", F.col("class_id").alias("right_id"), F.col("fingerprint").alias("_b"))
    word = lambda c, j: F.conv(F.substring(c, 1 + 8 * j, 8), 16, 10).cast("long")
    distance = sum((F.bit_count(word("_a", j).bitwiseXOR(word("_b", j))) for j in range(1, digits // 8)), F.bit_count(word("_a", 0).bitwiseXOR(word("_b", 0))))
    pairs = left.join(right, "key").where(F.col("left_id") < F.col("right_id")).withColumn("distance", distance).where(F.col("distance") <= radius)
    return members, pairs.select("left_id", "right_id", "distance").distinct()


_COLUMNS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compared(ids: list, texts: list[str], after: list[str]) -> list[pa.Array]:
    """The result's columns for documents and the ones after them."""
    edited = []
    for t, u in zip(texts, after, strict=True):
        m = len(t) // 2
        edited.append(t[: len(t) - m] + u[:m])
    own, other = simhash(pa.array(texts, pa.string())), simhash(pa.array(edited, pa.string()))
    # Within a run each next text is the following row's; only the last needs a fingerprint of its own.
    following = np.concatenate([own[1:], simhash(pa.array(after[-1:], pa.string()))]) if after[:-1] == texts[1:] else simhash(pa.array(after, pa.string()))
    return [
        pa.array(ids, pa.int64()),
        pa.array([len(t) for t in texts], pa.int64()),
        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
        pa.array([r.tobytes().hex() for r in own], pa.string()),
        pa.array([r.tobytes().hex() for r in other], pa.string()),
        pa.array(likeness(own, other)),
        pa.array(likeness(own, following)),
    ]


def next_document_edits(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """The fingerprints of every text and of its edited text, and how near they and the next document's are."""
    spark = docs.sparkSession
    parts = partitions or shuffle_partitions(spark)
    order = [F.col("doc_id").asc_nulls_last(), F.col("text").asc_nulls_first()]
    ranged = docs.select("doc_id", "text").repartitionByRange(parts, order[0]).sortWithinPartitions(*order)

    def run(batches):
        from pyspark import TaskContext

        part, held, first = TaskContext.get().partitionId(), None, None
        empty = lambda n, kind: pa.nulls(n, kind)
        names = [*_COLUMNS, "part", "first_text", "last_text"]
        for batch in slices(batches, "text"):
            ids = batch.column("doc_id").to_pylist()
            texts = [t or "" for t in batch.column("text").to_pylist()]
            if held is None:
                first = texts[0]
            else:
                ids, texts = [held[0], *ids], [held[1], *texts]
            held = ids[-1], texts[-1]
            n = len(ids) - 1
            if n:
                yield pa.RecordBatch.from_arrays([*_compared(ids[:-1], texts[:-1], texts[1:]), empty(n, pa.int32()), empty(n, pa.string()), empty(n, pa.string())], names)
        if held is not None:
            kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array([held[0]], pa.int64()), *[empty(1, k) for k in kinds], pa.array([part], pa.int32()), pa.array([first], pa.string()), pa.array([held[1]], pa.string())], names)

    found = stored(ranged.mapInArrow(run, f"{_SCHEMA}, part int, first_text string, last_text string"), "edits")
    ends = found.where(F.col("part").isNotNull())
    filled = sorted(r[0] for r in ends.select("part").collect())  # a number for each partition
    after = spark.createDataFrame([(p, q) for p, q in zip(filled, [*filled[1:], *filled[:1]], strict=True)], "part int, after int")
    pairs = ends.select("part", "doc_id", "last_text").join(after, "part").join(ends.select(F.col("part").alias("after"), "first_text"), "after").select("doc_id", "last_text", "first_text")

    def match(batches):
        for batch in slices(batches, "last_text"):
            yield pa.RecordBatch.from_arrays(_compared(*[batch.column(i).to_pylist() for i in range(3)]), _COLUMNS)

    return found.where(F.col("part").isNull()).select(*_COLUMNS).unionByName(pairs.mapInArrow(match, _SCHEMA))


def op3_fingerprints(spark, sf_dir: str) -> DataFrame:
    return next_document_edits(table(spark, sf_dir, "documents"))
