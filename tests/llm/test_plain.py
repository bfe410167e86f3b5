"""Plain versions, a row and a number at a time, of what the operators compute in bulk."""

import math
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F

from tests.llm.names import INTERNAL
from tidelog.llm import fingerprints as fp
from tidelog.llm import kernels, languages, licences, ngram_join, packing, sentencepieces, toxicity, url_filters

TEXTS = ["", None, "one", "One two", "a b c d", "the same words " * 9, "x" * 40, "é ü\tß\n日本 語", " ".join(f"w{i}" for i in range(95)), " ".join(f"w{i}" for i in range(120)), "12 34 !? a"]


def plain_simhash(text):
    data = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode()
    words = [w for w in "".join(chr(b) for b in data).replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    one = lambda w: int(kernels.word_hashes(np.frombuffer(w.encode("latin-1"), np.uint8), np.array([0]), np.array([len(w)]))[0])
    mixed = lambda v: int(kernels.mix(np.array([v % 2**64], np.uint64))[0])
    hashes = [one(w) for w in words]
    fade = max(0, fp.FADE_WORDS - len(words)) ** 2
    terms = [(h, fade) for h in hashes]
    terms += [(mixed(a * 3 + b), 2 * fp.FADE_WORDS**2) for a, b in zip(hashes, hashes[1:])]
    terms += [(mixed(int.from_bytes(data[i : i + 4], "little") + (1 << 40)), fade) for i in range(len(data) - 3)]
    votes = [0] * fp.BITS
    for h, weight in terms:
        for j in range(fp.BITS // 64):
            wide = mixed(h + 0x9E3779B97F4A7C15 * (j + 1)).to_bytes(8, "little")
            for k in range(64):
                votes[64 * j + k] += weight if wide[k // 8] >> (7 - k % 8) & 1 else -weight
    return bytes(sum((votes[8 * i + k] > 0) << (7 - k) for k in range(8)) for i in range(fp.BITS // 8))


def test_simhash_is_the_plain_one():
    bulk = fp.simhash(pa.array(TEXTS, pa.string()))
    for text, mark in zip(TEXTS, bulk):
        assert mark.tobytes() == plain_simhash(text), text


def test_decoding_takes_the_codeword_of_least_weighted_loss():
    rng = np.random.default_rng(4)
    for n in (2, 3, 5, 9):
        code = languages.codewords(n).astype(np.float32)
        bits = code.shape[1]
        trust = rng.uniform(0.2, 1.5, (n, bits)).astype(np.float32)
        model = languages.LanguageModel([f"l{k}" for k in range(n)], code, rng.standard_normal((6, bits)).astype(np.float32), rng.standard_normal(bits).astype(np.float32), trust)
        x = rng.standard_normal((40, 6)).astype(np.float32)
        best, p = model.predict(x)
        for row, b, q in zip(x, best, p):
            margins = [sum(float(row[i]) * float(model.weights[i, j]) for i in range(6)) + float(model.bias[j]) for j in range(bits)]
            loss = [sum(float(trust[k, j]) * math.log1p(math.exp(-m * float(code[k, j]))) for j, m in enumerate(margins)) for k in range(n)]
            assert loss[b] - min(loss) < 1e-4
            assert abs(q - 1 / sum(math.exp(min(loss) - v) for v in loss)) < 1e-3


def plain_boost(rows):
    """Newton boosting by trying every split of every node."""
    blocked, allowed = sum(r[1] for r in rows), sum(r[2] for r in rows)
    base = math.log((blocked + 0.5) / (allowed + 0.5))
    score = [base] * len(rows)

    def grow(held, depth):
        g, h = sum(x[1] for x in held), sum(x[2] for x in held)
        leaf = {x[0]: -g / (h + 1) for x in held}
        best, found = 1e-6, None
        for f in range(len(url_filters.FEATURES)) if depth else ():
            for k in range(url_filters.BINS):
                left, right = [x for x in held if rows[x[0]][0][f] <= k], [x for x in held if rows[x[0]][0][f] > k]
                hl, hr = sum(x[2] for x in left), sum(x[2] for x in right)
                if hl < 1e-3 or hr < 1e-3:
                    continue
                gain = sum(x[1] for x in left) ** 2 / (hl + 1) + sum(x[1] for x in right) ** 2 / (hr + 1) - g**2 / (h + 1)
                if gain > best + 1e-9:
                    best, found = gain, (left, right)
        return leaf if found is None else grow(found[0], depth - 1) | grow(found[1], depth - 1)

    for _ in range(url_filters.TREES):
        p = [1 / (1 + math.exp(-s)) for s in score]
        step = grow([(i, p[i] * (a + b) - a, p[i] * (1 - p[i]) * (a + b)) for i, (_, a, b) in enumerate(rows)], url_filters.DEPTH)
        score = [s + url_filters.RATE * step[i] for i, s in enumerate(score)]
    return score


def test_boosted_trees_are_the_plain_ones():
    rng = random.Random(3)
    rows = []
    for _ in range(60):
        bins = tuple(rng.randrange(4) for _ in url_filters.FEATURES)
        rows.append((bins, float(rng.randint(0, 3) + 4 * (bins[2] > 1)), float(rng.randint(0, 3) + 4 * (bins[5] > 2))))
    base, trees = url_filters.boost(rows)
    own = [base + sum(url_filters.RATE * url_filters._value(t, r[0]) for t in trees) for r in rows]
    for a, b in zip(own, plain_boost(rows)):
        assert abs(a - b) < 0.05 or math.copysign(1, a) == math.copysign(1, b)
    assert np.corrcoef(own, plain_boost(rows))[0, 1] > 0.99


def test_convolution_is_the_plain_one():
    rng = np.random.default_rng(8)
    learnt = np.unique(rng.integers(0, 1 << toxicity.BUCKETS_BITS, 5000))
    ids, counts = toxicity.word_ids(pa.array(TEXTS, pa.string()))
    learnt = np.unique(np.concatenate([learnt, ids[::2].ravel()]))
    filters = [rng.standard_normal((s, toxicity.WIDTH, toxicity.FILTERS)).astype(np.float32) for s in toxicity.SPANS]
    n = toxicity.FILTERS * len(toxicity.SPANS)
    model = toxicity.ToxicityModel(learnt, rng.standard_normal((len(learnt), toxicity.WIDTH)).astype(np.float32), filters, rng.standard_normal(n).astype(np.float32), rng.standard_normal(n).astype(np.float32), 0.25, {}, None)
    values = dict(zip(learnt.tolist(), model.values))
    zero, at = np.zeros(toxicity.WIDTH, np.float32), 0
    for z, k in zip(model.logits(ids, counts), counts.tolist()):
        words = [sum((values.get(i, zero) for i in row), zero) for row in ids[at : at + k].tolist()] or [zero]
        at += k
        words += [zero] * toxicity._PAD
        tops = [max(sum(float(words[i + j] @ w[j][:, f]) for j in range(len(w))) for i in range(max(k, 1))) for w in filters for f in range(toxicity.FILTERS)]
        assert abs(sum(max(t + float(b), 0) * float(o) for t, b, o in zip(tops, model.bias, model.out)) + 0.25 - z) < 1e-3


def test_repeated_ids_and_clashing_columns_in_every_operator_on_texts(spark, make_docs):
    """Each row is judged by itself, whatever rows share its id and whatever columns are beside it."""
    rows = [(1, "one text of some words in it"), (1, "one text of some words in it"), (1, "another text"), (2, None), (2, ""), (None, "no id here"), (None, None)]
    docs = make_docs(rows)
    for name in INTERNAL.split():
        if name not in docs.columns:
            docs = docs.withColumn(name, F.lit("own"))
    same = lambda found, columns: sorted([tuple(r[c] for c in columns) for r in found.collect()], key=str)
    plain = make_docs(rows)
    pieces, words = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
    for run, columns in (
        (lambda d: sentencepieces.piece_digests(d, pieces), ["doc_id", "n_tokens", "ids_sha256"]),
        (lambda d: fp.next_document_edits(d, 2), ["doc_id", "fingerprint", "edited_sha256"]),
        (lambda d: fp.fingerprints(d), ["doc_id", "fingerprint"]),
        (lambda d: languages.identify(d, None), ["doc_id", "lang_pred"]),
        (lambda d: ngram_join.jaccard_components(d), ["doc_id", "n_shingles", "component_id"]),
        (lambda d: licences.license_matches(d), ["doc_id", "license"]),
        (lambda d: packing.pack_documents(d, words), ["doc_id", "start", "length", "ids_crc32"]),
        (lambda d: toxicity.score_toxicity(d, None), ["doc_id", "score"]),
    ):
        found = same(run(docs), columns)
        assert found == same(run(plain), columns)
        if "license" not in columns:
            assert len(found) == len(rows)
    marks = same(sentencepieces.piece_digests(docs, pieces), ["doc_id", "ids_sha256"])
    assert len([m for m in marks if m[0] == 1]) == 3 and len({m[1] for m in marks if m[0] == 1}) == 2
