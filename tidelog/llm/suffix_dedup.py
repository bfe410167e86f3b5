"""Suffix-array dedup: removes the bytes of strings of LENGTH bytes that also start in a document of a smaller id.

1. Equal texts (by SHA-256) form a class. All but the smallest id of a class lose every byte (or none, if shorter
   than LENGTH); only the smallest one goes on, since it holds all strings of the others.
2. Each window of LENGTH bytes has a key, the least hash of its GRAM-byte strings, so equal windows have equal keys;
   neighbouring windows mostly share theirs. Runs of windows with one key are segments (of at most RUN windows).
   Blocks of documents ask for the keys that several documents have; only those segments go on.
3. A block sends each distinct segment once to the bucket of its key, with the smallest id in the block that has it.
   A bucket sorts the suffixes of its segments by external induced sorting with common-prefix values
   (tidelog.llm.induced): neighbours that share LENGTH bytes hold the same window. Its answer is a bit for each window
   of a segment: whether a smaller id than the segment's has it.
4. A block removes what those bits and its own smaller ids cover.

So a passage or a key of a third of all documents reaches a bucket once from each block, and no text but the shared
segments leaves the blocks. Matches never cross documents.

Defined results: a null text is empty; a document without an id neither loses bytes nor takes any from others; rows
that share an id don't take bytes from each other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm import exchange, kernels
from tidelog.llm.common import SLICE_BYTES, fresh, shuffle_partitions, slices, stored, table, with_class
from tidelog.llm.induced import MEMORY, STEP, Column, on_disk, suffix_sort

LENGTH = 50
GRAM = 20
#: Windows of a segment at most; a bit each in a 64-bit answer.
RUN = 48
#: Text of a block, on average.
BLOCK = 4 << 20
#: Text of all documents for each task that sorts suffixes; shared segments are a part of it.
SORT_BYTES = 6 << 20

_OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def window_keys(data: np.ndarray) -> np.ndarray:
    """The key of each window of LENGTH bytes."""
    n = len(data)
    if n < LENGTH:
        return np.zeros(0, np.uint64)
    data = np.ascontiguousarray(data)
    load = lambda at: np.ndarray((n - GRAM + 1,), np.uint64, data, at, (1,))
    h = (load(0) * kernels.BASE) ^ (load(8) * np.uint64(0xD6E8FEB86659FD93)) ^ (load(GRAM - 8) * np.uint64(0xA5A3564E27F8862B))
    h = kernels.mix(h)
    width, least = 1, h
    while 2 * width <= LENGTH - GRAM + 1:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = LENGTH - GRAM + 1 - width
    return np.minimum(least[:-rest], least[rest:]) if rest else least


def segments(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(keys spread evenly, first byte, windows, row) of the runs of windows with one key in each row."""
    keys = window_keys(data)
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(keys)]
    inside = offsets[rows + 1] - np.arange(len(keys)) >= LENGTH
    first = np.empty(len(keys), bool)
    if len(keys):
        first[0] = True
        first[1:] = (keys[1:] != keys[:-1]) | (rows[1:] != rows[:-1]) | (inside[1:] != inside[:-1])
    at = np.flatnonzero(first)
    size = np.diff(np.append(at, len(keys)))
    ok = inside[at]
    at, size = at[ok], size[ok]
    if len(size) and size.max() > RUN:
        parts = -(-size // RUN)
        begin = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        at, size = np.repeat(at, parts) + begin * RUN, np.minimum(np.repeat(size, parts) - begin * RUN, RUN)
    return kernels.mix(keys[at] + kernels.BASE), at, size, rows[at]


def _in_order(texts: pa.Table, notes: pa.Table) -> pa.Table:
    """The block's documents that go on, in ascending order."""
    own = notes.filter(pc.equal(notes.column("kind"), 0))
    wanted = set(zip(own.column("class_id").to_pylist(), own.column("keys").to_pylist(), strict=True))
    mine = texts.filter(pa.array([x in wanted for x in zip(texts.column("doc_id").to_pylist(), texts.column("sha").to_pylist(), strict=True)], pa.bool_()))
    return mine.take(pc.sort_indices(mine, sort_keys=[("doc_id", "ascending"), ("sha", "ascending")])).combine_chunks()


def _documents(texts: pa.Table, notes: pa.Table) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """(ids, bytes, offsets) of the block's documents that go on, in ascending order, in slices."""
    for batch in slices(_in_order(texts.select(["doc_id", "text", "sha"]), notes).to_batches(), "text", SLICE_BYTES):
        yield (batch.column("doc_id").to_pylist(), *kernels.text_buffers(batch.column("text")))


def _asked(block: int, texts: pa.Table, notes: pa.Table, bits: int) -> pa.Table:
    """Every distinct key of a block, with the number of documents that have it."""
    found = []
    for _, data, offsets in _documents(texts, notes):
        keys, _, _, rows = segments(data, offsets)
        order = np.argsort(keys, kind="stable")
        keys, rows = keys[order], rows[order]
        if len(keys):
            found.append(keys[np.concatenate([[True], (keys[1:] != keys[:-1]) | (rows[1:] != rows[:-1])])])
    keys, counts = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    return exchange.ask_table(exchange.packed(block, keys, counts, bits))


class _Requests:
    """The distinct shared segments of a block by bucket, in an order that a rerun repeats."""

    def __init__(self, notes: pa.Table, bits: int):
        mine = notes.filter(pc.equal(notes.column("kind"), 1))
        self.shared, _ = exchange.merged_reply(mine.column("keys").to_pylist(), mine.column("counts").to_pylist())
        self.shift = np.uint64(64 - bits)
        self.index: dict[bytes, tuple[int, int]] = {}
        self.buckets: dict[int, list[tuple[bytes, int]]] = {}

    def add(self, ids: list[int], data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int]]]:
        """Takes in documents; (first byte, windows, row, bucket, number in it) of their shared segments."""
        keys, at, size, rows = segments(data, offsets)
        live = exchange.looked_up(keys, self.shared, np.ones(len(self.shared), np.int64)) > 0
        keys, at, size, rows = keys[live], at[live], size[live], rows[live]
        raw, index, places = data.tobytes(), self.index, []
        for bucket, a, b, row in zip((keys >> self.shift).tolist(), at.tolist(), (at + size + LENGTH - 1).tolist(), rows.tolist(), strict=True):
            segment = raw[a:b]
            place = index.get(segment)
            if place is None:
                held = self.buckets.setdefault(bucket, [])
                place = index[segment] = bucket, len(held)
                held.append((segment, ids[row]))
            places.append(place)
        return at, size, rows, places


_REQUEST = "bucket int, block long, segments binary, lengths binary, ids binary"


class Shard:
    """The segments that meet in one task, on disk, and the marks of their windows.

    Segments are appended to a text file as they come, each once as long as an index of those seen fits the memory
    (then a new index begins; a segment that comes again is sorted again). What belongs to a segment or a request is
    a file too, so a shard may be far larger than memory.
    """

    def __init__(self, memory: int = MEMORY):
        self.memory, self.held = memory, 0
        self.index: dict[bytes, int] = {}
        self.count = 0
        self.text, self.sizes = Column(np.uint8, memory), Column(np.uint8, memory)
        self.which, self.owners = Column(np.int64, memory), Column(np.int64, memory)
        self.requests: list[tuple[int, int, int]] = []

    def add(self, bucket: int, block: int, raw: bytes, lengths: bytes, ids: bytes) -> None:
        """A request: segments of these lengths, and the smallest id that has each in the block."""
        at, index, which, new = 0, self.index, [], []
        for n in lengths:
            segment = raw[at : at + n]
            place = index.get(segment)
            if place is None:
                place = index[segment] = self.count
                self.count += 1
                new.append(segment)
            which.append(place)
            at += n
        if new:
            sizes = np.array([len(x) for x in new])
            # UTF-8 has no byte above 0xF7, so symbols with room for a separator and the end symbol fit a byte.
            text = np.ones(int(sizes.sum()) + len(new), np.uint8)
            body = np.frombuffer(b"".join(new), np.uint8)
            text[np.arange(len(body)) + np.repeat(np.arange(len(new)), sizes)] = body + np.uint8(2)
            self.text.add(text)
            self.sizes.add(sizes.astype(np.uint8))
            self.held += int(sizes.sum()) + 150 * len(new)
        self.which.add(np.array(which, np.int64))
        self.owners.add(np.frombuffer(ids, np.int64))
        self.requests.append((bucket, block, len(lengths)))
        if self.held > self.memory // 2:
            self.index, self.held = {}, 0

    def marked(self) -> Iterator[list[tuple[int, int, bytes]]]:
        """(block, bucket, a 64-bit answer for each segment) of the requests."""
        if not self.requests:
            return
        self.index = {}
        self.text.add(np.zeros(1, np.uint8))
        text, sizes, which, owners = self.text.array(), self.sizes.array(), self.which.array(), self.owners.array()
        owner, answers = (on_disk(self.count, d, self.memory) for d in (np.int64, np.uint64))
        begin = on_disk(self.count + 1, np.int64, self.memory)
        total = 0
        for k in range(0, self.count, STEP):
            part = sizes[k : k + STEP].astype(np.int64) + 1
            begin[k : k + len(part)] = total + np.cumsum(part) - part
            total += int(part.sum())
            owner[k : k + len(part)] = np.iinfo(np.int64).max
            answers[k : k + len(part)] = 0
        begin[self.count] = total
        for k in range(0, len(which), STEP):
            np.minimum.at(owner, which[k : k + STEP], owners[k : k + STEP])
        _mark_windows(text, begin, sizes, owner, answers, self.memory)
        at, rows = 0, []
        for bucket, block, n in self.requests:
            of, mine = which[at : at + n], owners[at : at + n]
            # A request of a greater id than another of the same segment: all its windows are there.
            rows.append((block, bucket, np.where(mine > owner[of], np.uint64(2**64 - 1), answers[of]).tobytes()))
            at += n
            if len(rows) == 256:
                yield rows
                rows = []
        if rows:
            yield rows


def _mark_windows(text: np.ndarray, begin: np.ndarray, size: np.ndarray, owner: np.ndarray, answers: np.ndarray, memory: int) -> None:
    """Sets, in each segment's answer, the bits of the windows that a segment of a smaller id has as well."""
    last = len(size) - 1
    state = {"at": np.zeros(0, np.int64), "of": np.zeros(0, np.int64)}  # the windows of a group that may go on

    def settle(at: np.ndarray, seg: np.ndarray, first: np.ndarray) -> None:
        """Groups of equal windows: those of ids above the group's least are marked."""
        if not len(at):
            return
        ids = owner[seg]
        least = np.minimum.reduceat(ids, first)
        more = ids > np.repeat(least, np.diff(np.append(first, len(at))))
        seg, bit = seg[more], (at[more] - begin[seg[more]]).astype(np.uint64)
        np.bitwise_or.at(answers, seg, np.uint64(1) << bit)

    def emit(at: np.ndarray, lcp: np.ndarray) -> None:
        seg = np.minimum(np.searchsorted(begin, at, side="right") - 1, last)
        # Only whole windows; whatever lies between two equal ones is equal to them, so it is a window too.
        joined = lcp >= LENGTH
        group = np.cumsum(~joined)
        keep = begin[seg] + size[seg] - at >= LENGTH
        at, seg, group = at[keep], seg[keep], group[keep]
        held, of = state["at"], state["of"]
        if len(held) and (not len(at) or group[0] > 0):
            settle(held, of, np.array([0]))
            held = of = np.zeros(0, np.int64)
        if len(at):
            at, seg = np.concatenate([held, at]), np.concatenate([of, seg])
            group = np.concatenate([np.full(len(held), group[0]), group])
            first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            cut = int(first[-1])
            settle(at[:cut], seg[:cut], first[:-1])
            held, of = at[cut:], seg[cut:]
            if len(held) > 4096:  # of a long group only the windows of its least id are undecided
                settle(held, of, np.array([0]))
                ids = owner[of]
                held, of = held[ids == ids.min()], of[ids == ids.min()]
        state["at"], state["of"] = held, of

    suffix_sort(text, LENGTH, emit, memory)
    settle(state["at"], state["of"], np.array([0]))


def removed_bytes(texts: pa.Table, notes: pa.Table, bits: int) -> Iterator[tuple[list[int], np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, bytes, offsets, whether each byte goes) of a block's documents, in slices."""
    requests = _Requests(notes, bits)
    mine = notes.filter(pc.equal(notes.column("kind"), 2))
    answers = {b: np.frombuffer(k, np.uint64) for b, k in zip(mine.column("bucket").to_pylist(), mine.column("keys").to_pylist(), strict=True)}
    everything = np.uint64(2**64 - 1)
    for ids, data, offsets in _documents(texts, notes):
        at, size, rows, places = requests.add(ids, data, offsets)
        masks = np.array([int(everything) if ids[row] > requests.buckets[b][k][1] else int(answers[b][k]) if b in answers else 0 for row, (b, k) in zip(rows.tolist(), places, strict=True)], dtype=np.uint64)
        hit = np.zeros(len(data) + 1, np.int32)
        for j in range(RUN):
            use = (size > j) & ((masks >> np.uint64(j)) & np.uint64(1) > 0)
            if use.any():
                hit[at[use] + j] = 1
        total = np.cumsum(hit)[: len(data)]
        before = np.concatenate([np.zeros(LENGTH, np.int64), total[:-LENGTH]]) if len(data) > LENGTH else np.zeros(len(data), np.int64)
        yield ids, data, offsets, total > before[: len(data)]


def _finished(ids: list[int], data: np.ndarray, offsets: np.ndarray, gone: np.ndarray, with_text: bool) -> pa.Table:
    n = len(ids)
    rows = np.repeat(np.arange(n), np.diff(offsets))
    start = gone.copy()
    start[1:] &= ~gone[:-1] | (rows[1:] != rows[:-1])
    removed, spans = np.bincount(rows[gone], minlength=n), np.bincount(rows[start], minlength=n)
    kept = data[~gone].tobytes()
    ends = np.cumsum(np.diff(offsets) - removed).tolist()
    parts = [kept[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
    arrays = [pa.array(ids, pa.int64()), pa.array(np.diff(offsets), pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array([hashlib.sha256(p).hexdigest() for p in parts], pa.string())]
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    if with_text:
        texts = [p.decode(errors="ignore") for p in parts]  # the rest of a character that was cut in two goes too
        return pa.Table.from_arrays([*arrays, pa.array(texts, pa.string())], [*names, "kept"])
    return pa.Table.from_arrays(arrays, names)


def dedup_documents(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """The contract's columns for every row.

    with_text adds what remains as `kept`, a string without the rest of characters that were cut in two, and all other
    columns of docs but the text, as one struct `row`.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    others = [F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"], F.col("text").isNull().alias(fresh(docs, "was_null"))).alias("row")] if with_text else []
    source = docs.select("doc_id", text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text.cast("binary"), 256).alias("sha"), *others)
    slim = stored(source.drop("text"), "texts")
    rows, total = slim.agg(F.count("*"), F.coalesce(F.sum("n_bytes"), F.lit(0))).first()
    classes = stored(slim.where("doc_id is not null").groupBy("sha", "n_bytes").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_rows")), "classes")
    blocks, tasks = exchange.block_count(total, BLOCK), shuffle_partitions(spark)
    sorters = max(tasks, total // SORT_BYTES)
    bits = max(exchange.bucket_bits(docs, total // 16), int(np.ceil(np.log2(4 * sorters))))
    # The longer texts, written once by block. Their other columns lie there too, and only the last step reads them.
    long = source.where(F.col("doc_id").isNotNull() & (F.col("n_bytes") >= LENGTH)).withColumn("sha", F.unhex("sha")).drop("n_bytes")
    blocked = exchange.by_block(long.withColumn("block", exchange.block_of(F.col("doc_id"), blocks)), blocks, "blocks")
    texts = blocked.select("doc_id", "text", "sha", "block")
    no, never = F.lit(None).cast("binary"), F.lit(None).cast("long")
    wanted = classes.where(F.col("n_bytes") >= LENGTH).select(exchange.block_of(F.col("class_id"), blocks).alias("block"), F.lit(0).alias("kind"), "class_id", F.lit(0).alias("bucket"), F.unhex("sha").alias("keys"), no.alias("counts"))

    def ask(key, left, right):
        return _asked(key[0].as_py(), left, right, bits)

    together = lambda side, notes: side.groupBy("block").cogroup(notes.groupBy("block"))
    shared = stored(exchange.shared_keys(together(texts, wanted).applyInArrow(ask, exchange.ASK), tasks, bits), "shared")
    notes = wanted.unionByName(shared.select("block", F.lit(1).alias("kind"), never.alias("class_id"), F.lit(0).alias("bucket"), "keys", "counts"))

    def request(key, left, right):
        found = _Requests(right, bits)
        for part in _documents(left, right):
            found.add(*part)
        rows = [(b, key[0].as_py(), b"".join([s for s, _ in held]), np.array([len(s) for s, _ in held], np.uint8).tobytes(), np.array([i for _, i in held], np.int64).tobytes()) for b, held in found.buckets.items()]
        return exchange.as_table(rows, [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()], ["bucket", "block", "segments", "lengths", "ids"])

    def mark(batches):
        shard = Shard()
        for batch in batches:
            for row in zip(*[batch.column(i).to_pylist() for i in range(5)], strict=True):
                shard.add(*row)
        for answers in shard.marked():
            yield exchange.as_batch(answers, [pa.int64(), pa.int32(), pa.binary()], ["block", "bucket", "keys"])

    place = F.floor(F.col("bucket") * F.lit(sorters) / F.lit(1 << bits)).cast("int")  # even ranges of the keys
    marks = stored(together(texts, notes).applyInArrow(request, _REQUEST).repartitionById(sorters, place).mapInArrow(mark, "block long, bucket int, keys binary"), "marks")
    answered = notes.unionByName(marks.select("block", F.lit(2).alias("kind"), never.alias("class_id"), "bucket", "keys", no.alias("counts")))

    def finish(key, left, right):
        parts = [_finished(*part, with_text) for part in removed_bytes(left, right, bits)]
        if not parts:
            parts = [_finished([], np.zeros(0, np.uint8), np.zeros(1, np.int64), np.zeros(0, bool), with_text)]
        done = pa.concat_tables(parts)
        if with_text:
            done = done.append_column("row", _in_order(left, right).column("row"))
        return done

    kind = f", kept string, row {dict(source.dtypes)['row']}" if with_text else ""
    done = together(blocked if with_text else texts, answered).applyInArrow(finish, _OUT + kind)
    # Copies lose all; texts too short for a match, and those without an id, lose nothing.
    placed = with_class(slim, classes, ["sha", "n_bytes"], rows).withColumn("copy", F.coalesce(F.col("doc_id") > F.col("class_id"), F.lit(False)) & (F.col("n_bytes") >= LENGTH))
    columns = [
        "doc_id",
        "n_bytes",
        F.when(F.col("copy"), F.col("n_bytes")).otherwise(F.lit(0)).cast("long").alias("n_removed"),
        F.col("copy").cast("long").alias("n_spans"),
        F.when(F.col("copy"), F.sha2(F.lit(b""), 256)).otherwise(F.col("sha")).alias("kept_sha256"),
    ]
    if not with_text:
        return done.unionByName(placed.where(F.col("copy") | (F.col("n_bytes") < LENGTH) | F.col("doc_id").isNull()).select(*columns))
    emptied = placed.where("copy").select(*columns, F.lit("").alias("kept"), "row")
    whole = source.where((F.col("n_bytes") < LENGTH) | F.col("doc_id").isNull()).withColumn("copy", F.lit(False)).select(*columns, F.col("text").alias("kept"), "row")
    return done.unionByName(emptied).unionByName(whole)


def op1_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup_documents(table(spark, sf_dir, "documents"))
