"""Language, toxicity, URL filters, license scans, and the pipeline."""

import os
import random
import re

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.names import INTERNAL
from tidelog.llm import licences, toxicity, url_filters
from tidelog.llm.common import held_out, table
from tidelog.llm.languages import codewords, fit_languages, identify, with_language
from tidelog.llm.toxicity import fit_toxicity, score_toxicity

DATA = "/root/testdata/sf0.01"


def test_codewords_differ_in_many_bits():
    for n in (1, 2, 4, 6, 9, 30):
        code = codewords(n)
        assert code.shape[0] == n
        if n > 2:
            least = min(int((code[i] != code[j]).sum()) for i in range(n) for j in range(i))
            assert least >= max(2, code.shape[1] // 4)


def test_language_on_held_out_rows(spark, make_docs):
    docs = table(spark, DATA, "documents")
    model = fit_languages(docs)
    rows = identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == held_out(r.doc_id) for r in rows)
    tested = [r for r in rows if r.held_out]
    assert sum(r.lang == r.lang_pred for r in tested) / len(tested) > 0.97
    odd = {r.doc_id: r for r in identify(make_docs([(1, None), (2, ""), (3, "12 $% 3"), (None, "the and of")]), model).collect()}
    assert all(odd[i].lang_pred == "und" and odd[i].score == 0 for i in (1, 2, 3)) and odd[None].lang_pred in ("de", "en", "es", "fr")
    assert with_language(make_docs([(1, "the of and")]), model).columns[-2:] == ["_lang", "_ambiguous"]
    empty = make_docs([])
    assert fit_languages(empty) is None and identify(empty, None).isEmpty()
    assert identify(make_docs([(1, "text")]), None).first().lang_pred == "und"


def test_toxicity_on_held_out_rows(spark, make_docs):
    docs, labels = table(spark, DATA, "documents"), table(spark, DATA, "labels")
    model = fit_toxicity(docs, labels)
    rows = score_toxicity(docs, model).join(labels, "doc_id").collect()
    assert all(r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)
    seen = [r for r in rows if not r.held_out]
    assert sum(r.predicted == r.toxic for r in seen) / len(seen) > 0.95
    new = [r for r in rows if r.held_out]
    assert sum(r.predicted == r.toxic for r in new) / len(new) > 0.9
    odd = score_toxicity(make_docs([(1, None), (2, ""), (None, "x"), (2, "")]), model).collect()
    assert len(odd) == 4 and all(r.predicted == 0 for r in odd)
    assert fit_toxicity(make_docs([]), labels) is None and score_toxicity(make_docs([(1, "a")]), None).first().score == 0


def plain_parts(url):
    rest = (url or "").partition("://")[2] if "://" in (url or "") else ""
    host = re.match(r"[^/?#]*", rest).group()
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host) :]).group()


def plain_rule(host, path):
    fits = [(h + p, k) for k, h, p in url_filters.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda f: len(f[0]), default=(None, None))


ODD_URLS = [None, "", "no scheme", "http://", "HTTP://A.NET", "http://A.Example.NET/en/x?q=/fr/", "http://net/", "http://xnet/", "https://u@h.org:80/fr/", "ftp://example.com/de/?a=b&c=d#f", "http://a.b?x://y/z", "x://ÀÉ.Org/fr/é", "http://a.net#/", "http://h.org/\nx"]


def test_url_rules_and_verdicts(spark):
    pages = table(spark, DATA, "pages").select("page_id", "url").unionByName(spark.createDataFrame([(1000 + i, u) for i, u in enumerate(ODD_URLS)] + [(None, "http://b.net/")], "page_id long, url string")).withColumn("host", F.lit("clash"))
    urls = {r.page_id: r.url for r in pages.collect()}
    for r in url_filters.judge_urls(pages).collect():
        host, path = plain_parts(urls[r.page_id])
        rule, action = plain_rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule), urls[r.page_id]
        assert r.verdict == (action or ("block" if r.block_score >= 0.5 else "allow"))
    assert url_filters.judge_urls(pages.limit(0)).isEmpty()
    assert url_filters.judge_urls(spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")).first().verdict == "allow"


def test_trees_learn_what_divides():
    rng = random.Random(1)
    rows = []
    for _ in range(400):
        bins = tuple(rng.randrange(12) for _ in url_filters.FEATURES)
        bad = (bins[3] > 5) != (bins[5] > 7)
        rows.append((bins, float(bad), float(not bad)))
    base, trees = url_filters.boost(rows)
    right = sum(((base + sum(url_filters.RATE * url_filters._value(t, b) for t in trees)) > 0) == bool(bad) for b, bad, _ in rows)
    assert right / len(rows) > 0.97


def plain_matches(text):
    words, out = licences._words(text or ""), set()
    for name, wording in licences.TEMPLATES.items():
        own = licences._words(wording)
        span = licences.span_of(wording)
        want = set(licences._shingles(own))
        for at in range(0, max(1, len(words)), span):
            if len(want & set(licences._shingles(words[at : at + 2 * span]))) / len(want) >= licences.CONTAINMENT:
                out.add(name)
    return out


def test_license_scan_equals_brute_force(spark, make_docs):
    rng = random.Random(6)
    fill = lambda n: " ".join(rng.choice("lorem ipsum dolor software the of this license copy".split()) for _ in range(n))
    rows = [(i, fill(rng.randint(0, 90)) + " " + t.upper() + "\n" + fill(rng.randint(0, 50))) for i, t in enumerate(licences.TEMPLATES.values())]
    for i, t in enumerate(licences.TEMPLATES.values()):
        w = t.split()
        w[rng.randrange(len(w))] = "changed"
        rows.append((100 + i, " ".join(w) + fill(3)))
    rows += [(200, None), (201, ""), (202, "license"), (None, "Released under the MIT License."), (203, "Released under the MIT License. " * 200)]
    rows += [(r.doc_id + 1000, r.text) for r in table(spark, "/root/testdata/sf0.001", "documents").collect()]
    got = {}
    for r in licences.license_matches(make_docs(rows)).collect():
        got.setdefault(r.doc_id, set()).add(r.license)
    assert got == {i: m for i, t in rows if (m := plain_matches(t))}
    assert licences.license_matches(make_docs([])).isEmpty()


def test_license_scan_of_long_texts_and_long_templates(spark, make_docs):
    """A text of 400,000 words, and a template of 1,500 of them."""
    rng = random.Random(8)
    whole = " ".join(f"clause{rng.randint(0, 400)}" for _ in range(1500))
    worn = whole.split()
    for k in range(0, 1500, 100):
        worn[k] = "worn"
    filler = "license some words here and there " * 66_667
    grant = licences.TEMPLATES["mit-grant"]
    templates = {"whole": whole, "grant": grant, "nothing": " - "}
    rows = [(1, filler + grant), (2, filler[:9000] + " ".join(worn) + filler[:500]), (3, " ".join(whole.split()[:1100])), (2, None)]
    found = {(r.doc_id, r.license): r for r in licences.license_matches(make_docs(rows), templates).collect()}
    assert set(found) == {(1, "grant"), (2, "whole")}
    assert found[1, "grant"].first_word + 2 * licences.span_of(grant) >= 400_000 and 0.9 < found[2, "whole"].containment < 1
    assert licences.license_matches(make_docs(rows[:1]), {"nothing": " - "}).isEmpty()


def test_no_match_is_without_a_telling_word():
    told = set(licences.telling_words(licences.TEMPLATES))
    for text in licences.TEMPLATES.values():
        shingles = licences._shingles(licences._words(text))
        assert sum(not told & set(s) for s in shingles) < licences.CONTAINMENT * len(shingles)


def test_pipeline_stages(spark, tmp_path):
    small = "/root/testdata/sf0.001"
    docs, counts = spark.read.parquet(f"{small}/documents.parquet"), []
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, small).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        counts.append(docs.count())
        if k < 4:
            assert docs.columns == columns
        if k == 3:
            assert docs.where("n_chars <> length(text)").isEmpty()
            ids = {r.doc_id for r in docs.collect()}
    assert 200 >= counts[0] >= counts[1] >= counts[2] >= counts[3] > 100
    assert {r.doc_id for r in docs.collect()} == ids


def test_pipeline_stages_on_odd_rows(spark, make_docs, tmp_path):
    rows = [(1, None), (2, ""), (2, ""), (3, "12"), (4, "the of and to in " * 20), (4, "the of and to in " * 20), (5, "the of and to in " * 20), (None, "the of and to in " * 20), (None, "la casa de los otros dias y las noches"), (None, "LA casa de los otros dias y las noches"), (6, "the of and to in " * 20 + "more words of it")]
    docs = make_docs(rows)
    for name in INTERNAL.split():  # clashing names are carried through
        if name not in docs.columns:
            docs = docs.withColumn(name, F.lit(f"own {name}"))
    sf = "/root/testdata/sf0.001"
    kept = [r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, sf).collect()]
    assert sorted(kept, key=str) == [1, 2, 3, 4, 6, None]
    cut = corpus_pipeline.cut_repeated_passages(spark, docs, sf)
    assert cut.columns == docs.columns
    cut = cut.collect()
    assert all(r[name] == f"own {name}" for r in cut for name in INTERNAL.split() if name not in ("component_id", "score"))
    texts = sorted([(r.doc_id, r.text) for r in cut], key=str)
    alike = rows[4][1]
    assert texts == sorted([(1, None), (2, ""), (2, ""), (3, "12"), (4, alike), (4, alike), (6, "more words of it"), (None, alike), *rows[8:10]], key=str)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        done = stage(spark, docs, sf)
        assert k == 4 or done.columns == docs.columns
        done.write.parquet(f"{tmp_path}/odd{k}")
        assert stage(spark, make_docs([]), sf).count() == 0
    spoken = {r.doc_id for r in spark.read.parquet(f"{tmp_path}/odd1").collect()}
    assert spoken.isdisjoint({1, 2, 3}) and 4 in spoken


def test_language_stage_without_a_learned_language(spark, make_docs):
    docs = make_docs([(1, "words"), (2, "12 ?"), (3, None), (4, "")]).withColumn("lang", F.lit(None).cast("string"))
    assert [r.doc_id for r in corpus_pipeline.drop_unknown_language(spark, docs, DATA).collect()] == [1]


def test_pipeline_run_equals_its_stages_and_leaves_no_tables(spark, tmp_path):
    from tidelog.sources.shared import shared_folder

    small = "/root/testdata/sf0.001"
    folder = shared_folder(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    out = corpus_pipeline.run(spark, small)
    assert len([n for n in set(os.listdir(folder)) - before if n.startswith("stage")]) == 1 == len(set(os.listdir(folder)) - before)
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, small).write.parquet(f"{tmp_path}/run{k}")
        docs = spark.read.parquet(f"{tmp_path}/run{k}")
    pieces = lambda df: sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in df.collect())
    assert pieces(out) == pieces(docs)


def test_last_window_of_the_last_text_counts():
    begins, ends = np.array([0, 3]), np.array([2, 5])
    x = np.zeros((5 + toxicity._PAD, 2), np.float32)
    x[4] = 7  # the window that starts at the last word
    filters = [np.ones((1, 2, 3), np.float32)]
    assert toxicity._pooled(x, begins, ends, filters).tolist() == [[0.0] * 3, [14.0] * 3]
