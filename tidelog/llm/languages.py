"""Language identification with error-correcting output codes.

Every language has a codeword of +1 and -1 bits. A logistic classifier on hashed byte n-grams (two to four bytes,
lower-cased, everything but letters as single spaces) predicts each bit of a text's codeword; decoding takes the
language of the least loss, each bit weighted by how well its classifier does on that language in training. A text
whose two best languages are close in probability is flagged as ambiguous.

It is fitted on a bounded sample, at most 2 * PER_LANGUAGE texts a language (the bound is a parameter); everything
else covers all rows, whole texts, in one pass without a shuffle.

Defined results: a null text, an empty one or one without letters is `und` with score 0, as is every text if no
language could be learned; repeated rows and null ids are judged row by row.
"""

from __future__ import annotations

import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm import kernels
from tidelog.llm.common import bounded_sample, held_out, held_out_column, map_slices, table

DIMENSIONS = 4096
PER_LANGUAGE = 700
UNKNOWN = "und"
#: Below this probability of the best language a text is ambiguous.
AMBIGUOUS = 0.6

_CLEAN = np.where(kernels.IS_LETTER, kernels.LOWER, 32).astype(np.uint8)


def features(column: pa.Array) -> np.ndarray:
    """A unit vector of square-rooted n-gram counts for each row."""
    data, offsets = kernels.text_buffers(column)
    n = len(offsets) - 1
    rows = np.repeat(np.arange(n), np.diff(offsets))
    clean = _CLEAN[data]
    keep = np.ones(len(clean), dtype=bool)
    keep[1:] = (clean[1:] != 32) | (clean[:-1] != 32) | (rows[1:] != rows[:-1])
    clean, rows = clean[keep].astype(np.uint32), rows[keep]
    counts = np.zeros(n * DIMENSIONS)
    base = rows * DIMENSIONS
    code = clean
    for size in (2, 3, 4):
        if len(clean) < size:
            break
        code = (code[:-1] << np.uint32(8)) | clean[size - 1 :]
        whole = rows[size - 1 :] == rows[: len(rows) - size + 1]
        bins = ((code * np.uint32(2654435761)) >> np.uint32(20)).astype(np.int64) ^ (size * 977)
        counts += np.bincount((base[: len(bins)] + bins)[whole], minlength=n * DIMENSIONS)
    x = np.sqrt(counts, dtype=np.float32).reshape(n, DIMENSIONS) if counts.dtype == np.float32 else np.sqrt(counts).astype(np.float32).reshape(n, DIMENSIONS)
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))
    return x / np.maximum(norm, 1e-9)[:, None]


def codewords(n: int) -> np.ndarray:
    """A codeword for each of n languages: all ways to split them up to six, else the widest of seeded random codes."""
    if n == 1:
        return np.ones((1, 1))
    if n <= 6:
        splits = [(1, *rest) for rest in itertools.product((1, -1), repeat=n - 1)][1:]
        return np.array(splits, dtype=float).T
    rng = np.random.default_rng(7)
    bits, best, widest = int(np.ceil(12 * np.log2(n))), None, -1
    for _ in range(200):
        code = rng.choice((-1.0, 1.0), size=(n, bits))
        code = code[:, np.abs(code.sum(0)) < n]
        distance = (code.shape[1] - code @ code.T) / 2 + np.eye(n) * bits
        if distance.min() > widest:
            best, widest = code, distance.min()
    return best


class LanguageModel:
    def __init__(self, names: list[str], code: np.ndarray, weights: np.ndarray, bias: np.ndarray, trust: np.ndarray):
        self.names, self.code, self.weights, self.bias, self.trust = names, code, weights, bias, trust

    @classmethod
    def fit(cls, x: np.ndarray, labels: list[str], steps: int = 150) -> LanguageModel:
        names = sorted(set(labels))
        y = np.array([names.index(v) for v in labels])
        code = codewords(len(names))
        target = code[y].astype(np.float32)
        share = np.bincount(y, minlength=len(names))
        weight = (len(y) / (len(names) * share))[y].astype(np.float32)[:, None] / len(y)
        w = np.zeros((x.shape[1], code.shape[1]), np.float32)
        b = np.zeros(code.shape[1], np.float32)
        vw, vb, rate = np.zeros_like(w), np.zeros_like(b), np.float32(8)
        for step in range(steps):  # Nesterov's momentum; the features are unit vectors
            m = np.float32(step / (step + 3))
            pw, pb = w + m * vw, b + m * vb
            g = -target * weight / (1 + np.exp(np.clip(target * (x @ pw + pb), -30, 30)))
            nw, nb = pw - rate * (x.T @ g + np.float32(1e-5) * pw), pb - rate * np.float32(0.1) * g.sum(0)
            vw, vb, w, b = nw - w, nb - b, nw, nb
        right = (np.sign(x @ w + b) == target).astype(float)
        trust = np.array([right[y == k].mean(0) for k in range(len(names))])
        return cls(names, code.astype(np.float32), w, b, (trust / trust.sum(1, keepdims=True) * code.shape[1]).astype(np.float32))

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best language's index and its probability, for each row."""
        margins = x @ self.weights + self.bias
        loss = np.stack([(np.logaddexp(0, -margins * self.code[k]) * self.trust[k]).sum(1) for k in range(len(self.names))], axis=1)
        p = np.exp(loss.min(1, keepdims=True) - loss)
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        return best, p[np.arange(len(best)), best]


_maybe_letter = re.compile(r"[^\W\d_]").finditer


def has_letter(text: str) -> bool:
    """Whether a character is a letter; the pattern also finds digits of other kinds."""
    return any(m.group().isalpha() for m in _maybe_letter(text))


def fit_languages(docs: DataFrame, per_language: int = PER_LANGUAGE) -> LanguageModel | None:
    """Learns from text and non-null lang of the rows that are not held out; None if there are none."""
    rows = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out_column(F.col("doc_id")))
    chosen = bounded_sample(rows, "doc_id", "lang", per_language)

    def run(batch):
        column = batch.column("text")
        x = features(column).astype(np.float16)
        return pa.RecordBatch.from_arrays([batch.column("lang"), pa.array([r.tobytes() for r in x], pa.binary())], ["lang", "x"])

    found = [(r.lang, r.x) for r in map_slices(chosen, "text", run, "lang string, x binary").collect()]
    found.sort()
    if not found:
        return None
    x = np.frombuffer(b"".join(r[1] for r in found), dtype=np.float16).reshape(len(found), DIMENSIONS).astype(np.float32)
    return LanguageModel.fit(x, [r[0] for r in found])


def _judged(model: LanguageModel | None, texts: pa.Array) -> tuple[list[str], list[float]]:
    names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    if model:
        best, p = model.predict(features(texts))
        for i, t in enumerate(texts.to_pylist()):
            if t and has_letter(t):
                names[i], scores[i] = model.names[best[i]], float(p[i])
    return names, scores


def identify(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous of every row."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch):
        names, scores = _judged(held.value, batch.column("text"))
        folds = [held_out(i) for i in batch.column("doc_id").to_pylist()]
        unclear = [s < AMBIGUOUS for s in scores]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(folds), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(unclear)], ["doc_id", "held_out", "lang_pred", "score", "ambiguous"])

    return map_slices(docs.select("doc_id", "text"), "text", run, "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean")


def with_language(docs: DataFrame, model: LanguageModel | None, name: str = "_lang", ambiguous: str = "_ambiguous") -> DataFrame:
    """All columns of docs, the predicted language and whether it is ambiguous (und always is), under new names."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch):
        names, scores = _judged(held.value, batch.column("text"))
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array([s < AMBIGUOUS for s in scores], pa.bool_())], [*batch.schema.names, name, ambiguous])

    return map_slices(docs, "text", run, T.StructType([*docs.schema.fields, T.StructField(name, T.StringType()), T.StructField(ambiguous, T.BooleanType())]))


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit_languages(docs))
