"""Toxicity by a convolutional text classifier in numpy.

Words (runs of ASCII letters, digits and longer characters, lower-cased) hash into an embedding table, each as the sum
of the embeddings of the word, of its first four bytes and of its first five, so that inflected forms share. Filters one,
two and three words wide slide over a whole text; the largest value of each filter goes through a rectifier into a
logistic output. Embeddings start from seeded noise; a model is the rows that training met, which are all that count,
and a few small matrices. Thresholds are calibrated by language, the one that the language model of this package
predicts from the text, and shift the logit so that a score of 0.5 is the threshold.

Fitted on a bounded sample: at most 2 * PER_CLASS texts of each label (a parameter), of which a fifth calibrates.
Scoring covers whole texts in one pass without a shuffle.

Defined results: null and empty texts are scored as texts without words; repeated rows and null ids row by row; with
no labels of both kinds every score is 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm import kernels
from tidelog.llm.common import bounded_sample, held_out, held_out_column, map_slices, table
from tidelog.llm.languages import LanguageModel, features, fit_languages

BUCKETS_BITS = 20
#: First bytes of a word that have embeddings too.
PREFIXES = (4, 5)
WIDTH = 8
FILTERS = 8
SPANS = (1, 2, 3)
PER_CLASS = 1500
EPOCHS = 6
#: Calibration texts that a language needs for a threshold of its own.
LEAST_CALIBRATION = 60
_PAD = max(SPANS) - 1

def start_table() -> np.ndarray:
    """The embeddings before training; the last row is padding, of zeros."""
    rng = np.random.default_rng(11)
    noise = rng.standard_normal(((1 << BUCKETS_BITS) + 1, WIDTH), dtype=np.float32) * np.float32(0.02)
    noise[-1] = 0
    return noise


def word_ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of the words of all rows (of the word and its prefixes), and the number of words of each row."""
    data, offsets = kernels.text_buffers(column)
    starts, lengths, rows = kernels.words(data, offsets, kernels.IS_WORD)
    lower = kernels.LOWER[data]
    ids = np.empty((len(starts), 1 + len(PREFIXES)), np.int32)
    ids[:, 0] = kernels.word_hashes(lower, starts, lengths) >> np.uint64(64 - BUCKETS_BITS)
    lower = np.concatenate([lower, np.zeros(max(PREFIXES), np.uint8)])
    head = np.zeros(len(starts), np.uint64)
    for j in range(max(PREFIXES)):
        head = (head << np.uint64(8)) | np.where(j < lengths, lower[starts + j], 0).astype(np.uint64)
        if j + 1 in PREFIXES:
            ids[:, 1 + PREFIXES.index(j + 1)] = kernels.mix(head + np.uint64(j + 1)) >> np.uint64(64 - BUCKETS_BITS)
    return ids, np.bincount(rows, minlength=len(column))


def padded(ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All rows' ids with _PAD padding ids after each (an empty row has one more); starts and ends of their windows."""
    room = np.maximum(counts, 1)
    begins = np.cumsum(room + _PAD) - (room + _PAD)
    out = np.full((int((room + _PAD).sum()), 1 + len(PREFIXES)), 1 << BUCKETS_BITS, dtype=np.int32)
    if len(ids):
        out[np.arange(len(ids)) + np.repeat(begins - (np.cumsum(counts) - counts), counts)] = ids
    return out, begins, begins + room


class ToxicityModel:
    def __init__(self, rows: np.ndarray, values: np.ndarray, filters: list[np.ndarray], bias: np.ndarray, out: np.ndarray, shift: float, thresholds: dict[str, float], languages: LanguageModel | None):
        self.rows, self.values, self.filters, self.bias, self.out, self.shift = rows, values, filters, bias, out, shift
        self.thresholds, self.languages = thresholds, languages
        self._places = None

    def __getstate__(self):
        return self.__dict__ | {"_places": None}

    def embedded(self, at: np.ndarray) -> np.ndarray:
        """The embeddings of rows of ids: of learnt ones, since all others are zeros."""
        if self._places is None:
            self._places = np.full((1 << BUCKETS_BITS) + 1, len(self.rows), np.int32)
            self._places[self.rows] = np.arange(len(self.rows), dtype=np.int32)
            self.values = np.concatenate([self.values[: len(self.rows)], np.zeros((1, WIDTH), np.float32)])
        return _embedded(self.values, self._places[at])

    def logits(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        at, begins, ends = padded(ids, counts)
        pooled = _pooled(self.embedded(at), begins, ends, self.filters)
        return np.maximum(pooled + self.bias, 0) @ self.out + self.shift

    def score(self, column: pa.Array) -> np.ndarray:
        z = self.logits(*word_ids(column)).astype(float)
        if self.thresholds and self.languages:
            best, _ = self.languages.predict(features(column))
            z = z - np.array([self.thresholds.get(n, self.thresholds[""]) for n in self.languages.names])[best]
        elif self.thresholds:
            z = z - self.thresholds[""]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _embedded(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    x = table[at[:, 0]]
    for j in range(1, at.shape[1]):
        x += table[at[:, j]]
    return x


def _pooled(x: np.ndarray, begins: np.ndarray, ends: np.ndarray, filters: list[np.ndarray]) -> np.ndarray:
    cuts = np.stack([begins, ends], axis=1).ravel()
    tops = []
    for w in filters:
        z = _convolved(x, w)
        z = np.concatenate([z, np.zeros((1, z.shape[1]), z.dtype)])  # the last end is len(z); its row is in no text
        tops.append(np.maximum.reduceat(z, cuts, axis=0)[::2])
    return np.concatenate(tops, axis=1)


def _convolved(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Of each window that starts at a word; windows of the last _PAD places are left out."""
    n = len(x) - _PAD
    z = x[:n] @ w[0]
    for j in range(1, len(w)):
        z += x[j : n + j] @ w[j]
    return z


def _fit(docs: list[np.ndarray], y: np.ndarray, epochs: int = EPOCHS):
    """Stochastic gradient steps (Adam; lazily for embeddings) on minibatches of whole documents."""
    rng = np.random.default_rng(3)
    emb = start_table()
    filters = [rng.standard_normal((s, WIDTH, FILTERS)).astype(np.float32) * np.float32(0.5 / np.sqrt(s)) for s in SPANS]
    bias = np.zeros(FILTERS * len(SPANS), np.float32)
    out = np.abs(rng.standard_normal(FILTERS * len(SPANS)).astype(np.float32)) * np.float32(0.3)
    shift = np.zeros(1, np.float32)
    dense = [*filters, bias, out, shift]
    first, second = [np.zeros_like(p) for p in dense], [np.zeros_like(p) for p in dense]
    square = np.zeros(len(emb), np.float32)
    touched: set[int] = set()
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(docs))
        for k in range(0, len(order), 32):
            batch = order[k : k + 32]
            ids, begins, ends = padded(np.concatenate([docs[i] for i in batch]), np.array([len(docs[i]) for i in batch]))
            x = _embedded(emb, ids)
            wins = []
            pooled = np.empty((len(batch), len(bias)), np.float32)
            for s, w in enumerate(filters):
                z = _convolved(x, w)
                where = np.stack([b + z[b:e].argmax(0) for b, e in zip(begins, ends, strict=True)])
                wins.append(where)
                pooled[:, s * FILTERS : (s + 1) * FILTERS] = z[where, np.arange(FILTERS)]
            hidden = np.maximum(pooled + bias, 0)
            g = (1 / (1 + np.exp(-np.clip(hidden @ out + shift, -30, 30))) - y[batch]).astype(np.float32) / len(batch)
            gh = g[:, None] * out * (hidden > 0)
            grads = [np.zeros_like(w) for w in filters] + [gh.sum(0), hidden.T @ g, np.array([g.sum()], np.float32)]
            rows, values = [], []
            for s, w in enumerate(filters):
                gs = gh[:, s * FILTERS : (s + 1) * FILTERS]
                for j in range(len(w)):
                    at = wins[s] + j
                    grads[s][j] += np.einsum("nf,nfd->df", gs, x[at])
                    value = (gs[:, :, None] * w[j].T[None]).reshape(-1, WIDTH)
                    for part in ids[at].reshape(-1, ids.shape[1]).T:
                        rows.append(part)
                        values.append(value)
            step += 1
            for i, (p, d) in enumerate(zip(dense, grads, strict=True)):
                first[i] = 0.9 * first[i] + 0.1 * d
                second[i] = 0.99 * second[i] + 0.01 * d * d
                p -= (0.01 * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
            rows, values = np.concatenate(rows), np.concatenate(values)
            live = np.abs(values).sum(1) > 0
            unique, inverse = np.unique(rows[live], return_inverse=True)
            total = np.zeros((len(unique), WIDTH), np.float32)
            np.add.at(total, inverse, values[live])
            square[unique] += (total**2).sum(1)
            emb[unique] -= np.float32(0.15) * total / (np.sqrt(square[unique])[:, None] + np.float32(1e-6))
            emb[-1] = 0
            touched.update(unique.tolist())
    changed = np.array(sorted(touched - {len(emb) - 1}), dtype=np.int64)
    return changed, emb[changed], filters, bias, out, float(shift[0])


def _threshold(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The logit, midway between two texts, that errs least; of equals the one nearest to the middle of them."""
    order = np.argsort(z, kind="stable")
    z, y, weight = z[order], y[order], weight[order]
    errors = np.concatenate([[0], np.cumsum(np.where(y == 1, weight, -weight))]) + weight[y == 0].sum()
    edges = np.concatenate([[z[0] - 1], (z[1:] + z[:-1]) / 2, [z[-1] + 1]])
    best = np.flatnonzero(errors <= errors.min() + 1e-9)
    return float(edges[best[len(best) // 2]])


def fit_toxicity(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> ToxicityModel | None:
    """Learns from labelled rows that are not held out; None unless both labels occur."""
    marks = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out_column(F.col("doc_id"))).select("doc_id", "toxic")
    chosen = bounded_sample(marks, "doc_id", "toxic", per_class)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most 4 * per_class rows are broadcast
    languages = fit_languages(docs) if "lang" in docs.columns else None

    def run(batch):
        column = batch.column("text")
        ids, counts = word_ids(column)
        packed = [p.tobytes() for p in np.split(ids, np.cumsum(counts)[:-1])] if len(counts) else []
        best = languages.predict(features(column))[0] if languages else np.zeros(batch.num_rows, np.int64)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(packed, pa.binary()), pa.array(best, pa.int64())], ["doc_id", "toxic", "ids", "best"])

    kind = dict(rows.dtypes)["toxic"]
    found = sorted((r.doc_id, r.toxic, bytes(r.ids), r.best) for r in map_slices(rows, "text", run, f"doc_id long, toxic {kind}, ids binary, best long").collect())
    y = np.array([r[1] for r in found], dtype=np.float32)
    if len(set(y.tolist())) < 2:
        return None
    ids = [np.frombuffer(r[2], dtype=np.int32).reshape(-1, 1 + len(PREFIXES)) for r in found]
    best = np.array([r[3] for r in found])
    aside = np.random.default_rng(5).random(len(found)) < 0.2
    if len(set(y[~aside].tolist())) < 2 or len(set(y[aside].tolist())) < 2:
        aside = np.zeros(len(found), dtype=bool)
    train = np.flatnonzero(~aside)
    model = ToxicityModel(*_fit([ids[i] for i in train], y[train]), {}, languages)
    test = np.flatnonzero(aside) if aside.any() else train
    z = model.logits(np.concatenate([ids[i] for i in test]), np.array([len(ids[i]) for i in test]))
    weight = np.where(y[test] == 1, 0.5 / max(1, (y[test] == 1).sum()), 0.5 / max(1, (y[test] == 0).sum())) * len(test)
    # Clean texts are the most of a corpus: a false alarm counts three times a miss.
    weight = np.where(y[test] == 0, 3 * weight, weight)
    model.thresholds[""] = _threshold(z, y[test], weight)
    for k, name in enumerate(languages.names if languages else []):
        own = best[test] == k
        if own.sum() >= LEAST_CALIBRATION and len(set(y[test][own].tolist())) == 2:
            model.thresholds[name] = _threshold(z[own], y[test][own], weight[own])
    return model


def score_toxicity(docs: DataFrame, model: ToxicityModel | None) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch):
        m = held.value
        score = m.score(batch.column("text")) if m else np.zeros(batch.num_rows)
        folds = [held_out(i) for i in batch.column("doc_id").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(folds), pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return map_slices(docs.select("doc_id", "text"), "text", run, "doc_id long, held_out boolean, score double, predicted int")


def flag_toxic(docs: DataFrame, model: ToxicityModel | None, name: str = "_toxic") -> DataFrame:
    """All columns of docs and `name`, which must be new: whether the text's score is 0.5 or more."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch):
        m = held.value
        toxic = m.score(batch.column("text")) >= 0.5 if m else np.zeros(batch.num_rows, bool)
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(toxic)], [*batch.schema.names, name])

    return map_slices(docs, "text", run, T.StructType([*docs.schema.fields, T.StructField(name, T.BooleanType())]))


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))
