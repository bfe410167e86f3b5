"""The pipeline against the stages done plainly, a document at a time."""

import zlib

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm import test_joins, test_suffix_dedup
from tidelog.llm.common import table
from tidelog.llm.languages import AMBIGUOUS, fit_languages
from tidelog.llm.languages import features as ngrams
from tidelog.llm.toxicity import fit_toxicity

SMALL = "/root/testdata/sf0.001"


def test_run_equals_brute_force(spark):
    docs = table(spark, SMALL, "documents")
    rows = [tuple(r) for r in docs.collect()]
    assert docs.columns[:2] == ["doc_id", "text"]

    toxic = fit_toxicity(docs, table(spark, SMALL, "labels"))
    rows = [r for r in rows if toxic.score(pa.array([r[1]], pa.string()))[0] < 0.5]

    spoken = fit_languages(spark.createDataFrame(rows, docs.schema))
    kept = []
    for r in rows:
        if r[1] and any(c.isalpha() for c in r[1]):
            _, p = spoken.predict(ngrams(pa.array([r[1]], pa.string())))
            if p[0] >= AMBIGUOUS:
                kept.append(r)

    groups = test_joins.brute([(r[0], r[1]) for r in kept])
    alone = {i for i, _, component in groups if i == component}
    kept = [r for r in kept if r[0] in alone]

    left = {i: text for i, n, gone, _, _, text in test_suffix_dedup.brute([(r[0], r[1]) for r in kept]) if not gone or text}
    library = Tokenizer.from_file(corpus_pipeline.TOKENIZER)
    want = {i: [*library.encode(t, add_special_tokens=False).ids, 1] for i, t in left.items()}
    assert 100 < len(want) < len(docs.collect())

    found: dict = {}
    for r in corpus_pipeline.run(spark, SMALL).collect():
        found.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32, r.doc_tokens))
    assert found.keys() == want.keys()
    for i, pieces in found.items():
        at = 0
        for start, length, crc, total in sorted(pieces):
            assert (start, total) == (at, len(want[i])) and crc == zlib.crc32(np.array(want[i][at : at + length], "<u4").tobytes())
            at += length
        assert at == len(want[i])
