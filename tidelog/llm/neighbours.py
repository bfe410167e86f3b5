"""Approximate nearest neighbours by largest inner product, along shifted Hilbert curves.

Vectors are lifted to a sphere (one more coordinate makes all norms equal, so the nearest direction has the largest
inner product), projected to a few dimensions by seeded rotations, shifted, and numbered along a Hilbert curve; there
are CURVES of these. Each curve's keys are cut into at most CELLS ranges of about equal counts, by the quantiles of a
bounded sample; every row lies in one range of each curve. A query looks, on every curve, at the ranges whose sampled
rows point most its way. The best of all ranges are merged and ranked by the exact inner product of the original
vectors, in double precision.

How many ranges that is, the data tell: the rotations, ranges and their mean directions come from one half of the
sample (SAMPLE rows in all), and the other half, which they don't know, is searched for its own nearest rows with ever
more ranges until TARGET of them are found. Vectors with structure need a few ranges; those without any (random
directions) need a fixed share of all rows, which no partition avoids. A query looks at LOOK rows at least.

Rows and queries of a range are dealt in chunks of CHUNK, and each chunk of one meets each of the other, so no task
holds more, whatever share of the rows is alike; the shuffle carries each row once for each curve and CHUNK queries.

Defined results: vectors that are null, zero, of another length than most, or that hold nulls or non-finite values,
and rows without an id, take no part; equal vectors tie to the smaller id; of rows that share an id the best counts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm import exchange
from tidelog.llm.common import shuffle_partitions, table

CURVES = 4
DIMENSIONS = 16
BITS = 3
CELLS = 128
#: Rows that a query looks at in any case.
LOOK = 2048
#: Share of the nearest rows of the sample that have to be found.
TARGET = 0.93
SAMPLE = 20_000
#: Sampled rows of a range, at least.
LEAST = 8
#: Vectors, and queries, that meet in one task at once.
CHUNK = 4096


def hilbert_keys(grid: np.ndarray, bits: int) -> np.ndarray:
    """The place on the Hilbert curve of each row of integer coordinates below 2**bits."""
    x = [c.astype(np.int64) for c in grid.T]
    d = len(x)
    for level in range(bits - 1, 0, -1):  # undo the rotations and reflections, from the coarsest cubes
        bit, low = 1 << level, (1 << level) - 1
        for i in range(d):
            set_ = (x[i] & bit) > 0
            swap = np.where(set_, 0, (x[0] ^ x[i]) & low)
            x[0] = x[0] ^ np.where(set_, low, swap)
            if i:
                x[i] = x[i] ^ swap
    for i in range(1, d):
        x[i] = x[i] ^ x[i - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn = np.where((x[d - 1] >> level) & 1 > 0, turn ^ ((1 << level) - 1), turn)
    key = np.zeros(len(grid), np.int64)
    for level in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | (((x[i] ^ turn) >> level) & 1)
    return key


class Curves:
    """The fitted index: rotations, shifts, the keys where ranges begin, their mean directions, and how many of them a
    query looks at."""

    def __init__(self, sample: np.ndarray, longest: float, rows: int, queries: int, k: int):
        self.longest, self.d = longest, sample.shape[1]
        rng = np.random.default_rng(17)
        sample = sample[rng.permutation(len(sample))]
        known, new = self.lift(sample[::2]), self.lift(sample[1::2])
        cells = int(np.clip(len(known) // LEAST, 1, CELLS))
        self.turns, self.lows, self.spans, self.shifts, self.starts, self.means = [], [], [], [], [], []
        held, homes = [], []
        for c in range(CURVES):
            turn = np.linalg.qr(rng.standard_normal((self.d + 1, min(DIMENSIONS, self.d + 1))))[0]
            y = known @ turn
            low, span = y.min(0), np.maximum(y.max(0) - y.min(0), 1e-12)
            self.turns.append(turn)
            self.lows.append(low)
            self.spans.append(span)
            self.shifts.append(rng.random(len(low)))
            keys = self._keys(known, c)
            ranked = np.sort(keys)
            self.starts.append(np.unique(ranked[[len(keys) * j // cells for j in range(1, cells)]]) if cells > 1 else np.zeros(0, np.int64))
            home = np.searchsorted(self.starts[c], keys, side="right")
            held.append(np.bincount(home, minlength=len(self.starts[c]) + 1))
            sums = np.zeros((len(held[c]), self.d + 1))
            np.add.at(sums, home, known)
            self.means.append(sums / np.maximum(held[c], 1)[:, None])
            homes.append(home)
        self._calibrate(new, rows, k)
        # Of many rows alike a range may hold far more than the others: chunks by what the sample saw, in both ways.
        asked = self.pointing(sample[:: max(1, len(sample) // 2000)])
        self.chunks, self.asks = [], []
        for c in range(CURVES):
            self.chunks.append(np.maximum(1, -(-held[c] * rows // (len(known) * CHUNK))).astype(np.int64))
            probes = np.bincount(self.near(asked, c).ravel(), minlength=len(held[c]))
            self.asks.append(np.maximum(1, -(-probes * queries // (len(asked) * CHUNK))).astype(np.int64))

    def _calibrate(self, new: np.ndarray, rows: int, k: int) -> None:
        """Sets `looks`, the number of ranges that a query looks at on each curve, and the curves in use."""
        self.curves, most = CURVES, max(len(m) for m in self.means)
        self.looks = most
        if len(new) > 1 and rows > LOOK:
            asks = np.arange(0, len(new), max(1, len(new) // 400))
            unit = new[asks, :-1] / np.maximum(np.sqrt(np.einsum("ij,ij->i", new[asks, :-1], new[asks, :-1])), 1e-300)[:, None]
            unit = np.concatenate([unit, np.zeros((len(asks), 1))], axis=1)
            score = unit @ new.T
            score[np.arange(len(asks)), asks] = -np.inf
            # As many of the sample's as of all rows are within the nearest k.
            top = int(np.clip(round(k * len(new) / rows), 1, min(k, len(new) - 1)))
            want = np.argpartition(-score, top - 1, axis=1)[:, :top]
            place = np.full(want.shape, most)
            for c in range(CURVES):
                rank = np.argsort(np.argsort(-(unit @ self.means[c].T), axis=1, kind="stable"), axis=1)
                place = np.minimum(place, np.take_along_axis(rank, self.cell(new, c)[want], 1))
            self.looks = int(np.sort(place, axis=None)[min(place.size - 1, int(np.ceil(TARGET * place.size)) - 1)]) + 1
        self.looks = max(self.looks, -(-most * LOOK // max(rows * CURVES, 1)))
        # Where the curves together come to all rows or more, all ranges of one are less work, and exact.
        if self.curves * self.looks >= most:
            self.curves, self.looks = 1, most

    def lift(self, x: np.ndarray) -> np.ndarray:
        x = x / self.longest
        rest = np.sqrt(np.maximum(0, 1 - np.einsum("ij,ij->i", x, x)))
        return np.concatenate([x, rest[:, None]], axis=1)

    def pointing(self, x: np.ndarray) -> np.ndarray:
        """Queries, as directions on the sphere."""
        unit = x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
        return np.concatenate([unit, np.zeros((len(x), 1))], axis=1)

    def _keys(self, lifted: np.ndarray, curve: int) -> np.ndarray:
        unit = (lifted @ self.turns[curve] - self.lows[curve]) / self.spans[curve]
        grid = np.clip((unit + self.shifts[curve]) / 2 * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
        return hilbert_keys(grid, BITS)

    def cell(self, lifted: np.ndarray, curve: int) -> np.ndarray:
        return np.searchsorted(self.starts[curve], self._keys(lifted, curve), side="right")

    def near(self, pointing: np.ndarray, curve: int) -> np.ndarray:
        """The ranges that each query looks at."""
        return np.argsort(-(pointing @ self.means[curve].T), axis=1, kind="stable")[:, : self.looks]


_VALID = "vec_id is not null and v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)"
_PACK = "slot long, kind int, ids binary, vectors binary"


def nearest(vectors: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row whose vec_id is divisible by `every`."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where(_VALID)
    single = dict(vectors.dtypes)["embedding"] == "array<float>"
    kinds = {r.d: (r.n, r.top) for r in rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("top")).collect()}
    empty = "query_id long, rank int, vec_id long, score double"
    if not kinds:
        return spark.createDataFrame([], empty)
    d = min(kinds, key=lambda x: (-kinds[x][0], x))
    n, top = kinds[d]
    rows = rows.where(F.size("v") == d)
    asked = rows.where(F.col("vec_id") % every == 0).count()
    space = 1 << 30
    sample = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(space)) < int(space * min(1.0, SAMPLE / n))).limit(2 * SAMPLE)
    found = sorted((r.vec_id, r.v) for r in sample.collect())
    if not found:
        found = [(r.vec_id, r.v) for r in rows.limit(SAMPLE).collect()]
    # A few MB at most: CURVES * CELLS directions.
    held = spark.sparkContext.broadcast(Curves(np.array([v for _, v in found]), float(np.sqrt(top)) * (1 + 1e-12), n, asked, k))
    kind = np.float32 if single else np.float64

    def deal(batches):
        index = held.value
        for batch in batches:
            for at in range(0, batch.num_rows, 8192):
                part = batch.slice(at, 8192)
                ids = part.column("vec_id").to_numpy(zero_copy_only=False)
                x = np.array(part.column("v").flatten()).reshape(-1, d)
                asks = np.flatnonzero(ids % every == 0)
                lifted, pointing = index.lift(x), index.pointing(x[asks])
                x = x.astype(kind)
                out = []
                base = 0
                spread = ids * 2654435761 & 0x7FFFFFFF
                for c in range(index.curves):
                    # A slot is a chunk of a range's rows and one of its queries.
                    chunks, parts = index.chunks[c], index.asks[c]
                    first = np.cumsum(chunks * parts) - chunks * parts + base
                    cell = index.cell(lifted, c)
                    at, j = _each(parts[cell])
                    _pack(out, first[cell[at]] + (spread[at] % chunks[cell[at]]) * parts[cell[at]] + j, 0, at, ids, x)
                    near = index.near(pointing, c)
                    own, cell = np.repeat(asks, near.shape[1]), near.ravel()
                    at, j = _each(chunks[cell])
                    _pack(out, first[cell[at]] + j * parts[cell[at]] + spread[own[at]] % parts[cell[at]], 1, own[at], ids, x)
                    base += int((chunks * parts).sum())
                yield exchange.as_batch(out, [pa.int64(), pa.int32(), pa.binary(), pa.binary()], ["slot", "kind", "ids", "vectors"])

    def meet(tab):
        side = [([], []), ([], [])]
        for which, ids, raw in zip(*[tab.column(c).to_pylist() for c in ("kind", "ids", "vectors")], strict=True):
            side[which][0].append(np.frombuffer(ids, np.int64))
            side[which][1].append(np.frombuffer(raw, kind).reshape(-1, d))
        out = []
        if side[0][0] and side[1][0]:
            ids, asks = np.concatenate(side[0][0]), np.concatenate(side[1][0])
            v, q = np.concatenate(side[0][1]).astype(np.float64), np.concatenate(side[1][1])
            order = np.argsort(ids, kind="stable")  # rows of one id side by side
            ids, v = ids[order], v[order]
            for at in range(0, len(asks), 256):
                out += _best(asks[at : at + 256], q[at : at + 256].astype(np.float64), ids, v, k)
        return exchange.as_table(out, [pa.int64(), pa.binary(), pa.binary()], ["query_id", "ids", "scores"])

    tasks = shuffle_partitions(spark)
    dealt = rows.mapInArrow(deal, _PACK).repartition(tasks, "slot")
    best = dealt.groupBy("slot").applyInArrow(meet, "query_id long, ids binary, scores binary")
    groups = max(tasks, n // (every * 64))

    def merge(tab):
        out = []
        ids = [np.frombuffer(x, np.int64) for x in tab.column("ids").to_pylist()]
        asked = np.repeat(tab.column("query_id").to_numpy(), [len(x) for x in ids])
        ids = np.concatenate(ids)
        scores = np.concatenate([np.frombuffer(x, np.float64) for x in tab.column("scores").to_pylist()])
        order = np.lexsort((ids, -scores, asked))
        asked, ids, scores = asked[order], ids[order], scores[order]
        edges = np.flatnonzero(np.concatenate([[True], asked[1:] != asked[:-1]])).tolist()
        for a, b in zip(edges, [*edges[1:], len(asked)], strict=True):
            seen: set[int] = set()
            for i, s in zip(ids[a:b].tolist(), scores[a:b].tolist(), strict=True):
                if i not in seen:
                    seen.add(i)
                    out.append((int(asked[a]), len(seen), i, s))
                    if len(seen) == k:
                        break
        return exchange.as_table(out, [pa.int64(), pa.int32(), pa.int64(), pa.float64()], ["query_id", "rank", "vec_id", "score"])

    return best.groupBy(F.pmod(F.xxhash64("query_id"), F.lit(groups)).alias("part")).applyInArrow(merge, empty)


def _each(times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each index as often as its number says, and the count of each repetition."""
    at = np.repeat(np.arange(len(times)), times)
    return at, np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)


def _pack(out: list, slots: np.ndarray, kind: int, at: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
    order = np.argsort(slots, kind="stable")
    slots, at = slots[order], at[order]
    edges = np.flatnonzero(np.concatenate([[True], slots[1:] != slots[:-1]])).tolist() if len(slots) else []
    for a, b in zip(edges, [*edges[1:], len(slots)], strict=True) if edges else ():
        out.append((int(slots[a]), kind, ids[at[a:b]].tobytes(), x[at[a:b]].tobytes()))


def _best(asks: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray, k: int) -> list[tuple]:
    """The k best ids of each query, each by its best row; `ids` is ascending."""
    rough = q @ v.T
    begins = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
    out = []
    for row, ask, own in zip(rough, asks.tolist(), q, strict=True):
        row[ids == ask] = -np.inf
        if len(begins) > k:
            # Equal vectors may differ in the last bit here: keep all near the k-th id's, then compare exact sums.
            tops = np.maximum.reduceat(row, begins) if len(begins) < len(row) else row
            edge = np.partition(tops, len(tops) - k)[len(tops) - k]
            at = np.flatnonzero(row >= edge - 1e-12 * max(1.0, abs(edge)) if np.isfinite(edge) else np.isfinite(row))
        else:
            at = np.flatnonzero(np.isfinite(row))
        score = (v[at] * own).sum(axis=1)
        order = np.lexsort((-score, ids[at]))
        order = order[np.concatenate([[True], ids[at][order][1:] != ids[at][order][:-1]])] if len(order) else order
        order = order[np.lexsort((ids[at][order], -score[order]))[:k]]
        if len(order):
            out.append((ask, ids[at][order].tobytes(), score[order].tobytes()))
    return out


def op8_neighbours(spark, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
