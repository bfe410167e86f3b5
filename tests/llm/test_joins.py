"""The Jaccard join, components, nearest neighbours."""

import random
import re

import numpy as np
import pytest

from tidelog.llm import neighbours, ngram_join
from tidelog.llm.components import components


def brute(rows):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append(set() if not w else {tuple(w)} if len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)})
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            o = len(sets[a] & sets[b])
            if o and 100 * o >= 80 * (len(sets[a]) + len(sets[b]) - o):
                parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[root(k)] = min(least.get(root(k), i), i)
    return sorted((i, len(sets[k]), least[root(k)]) for k, (i, _) in enumerate(rows))


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(make_docs, seed, monkeypatch):
    if seed == 2:  # probes in many parts, sets in many blocks
        monkeypatch.setattr(ngram_join, "PROBES", 3)
        monkeypatch.setattr(ngram_join, "TRIE_BYTES", 1 << 12)
    rng = random.Random(seed)
    word = lambda: rng.choice("alpha Beta gamma delta epsilon zeta eta theta".split()) + str(rng.randint(0, 99))
    bases = [[word() for _ in range(rng.choice([3, 6, 40, 120]))] for _ in range(6)]
    passage = [word() for _ in range(60)]
    rows = []
    for i in range(120):
        w = list(rng.choice(bases))
        for _ in range(rng.randint(0, 1 + len(w) // 25)):
            w[rng.randrange(len(w))] = word()
        if i % 4 == 0:
            w = passage + [word() for _ in range(rng.randint(5, 20))]
        text = " ".join(w)
        rows.append((i, text.upper() if i % 7 == 0 else text.replace(" ", "\n\t ") if i % 7 == 1 else text))
    rows += [(200, ""), (201, None), (202, "  \n"), (203, "one"), (204, "ONE "), (205, "é É"), (206, "É É"), (207, "same words here now"), (208, "same words here now")]
    rng.shuffle(rows)
    found = ngram_join.jaccard_components(make_docs(rows))
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found.collect()) == brute(rows)


def test_null_ids_repeats_and_empty(make_docs):
    text = " ".join(f"w{i}" for i in range(30))
    found = ngram_join.jaccard_components(make_docs([(None, text), (4, text), (4, text), (9, text + " end"), (None, "alone here")])).collect()
    assert sorted([(r.doc_id, r.component_id) for r in found], key=str) == sorted([(None, 4), (4, 4), (4, 4), (9, 4), (None, None)], key=str)
    assert ngram_join.jaccard_components(make_docs([])).isEmpty()


def test_doubled_table_equals_brute_force(make_docs):
    rng = random.Random(4)
    rows = []
    for g in range(8):
        base = [f"g{g}w{rng.randint(0, 999)}" for _ in range(60)]
        for _ in range(2):
            w = list(base)
            w[rng.randrange(60)] = f"x{rng.randint(0, 10**6)}"
            rows.append((len(rows), " ".join(w)))
    rows *= 2
    found = ngram_join.jaccard_components(make_docs(rows))
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found.collect()) == brute(rows)


def test_texts_of_one_id_link_by_each(make_docs):
    """Id 1 has four texts, in pairs of equal size that share most shingles; each group has another document."""
    words = lambda g, end: " ".join([f"{g}{k}" for k in range(60)] + [end])
    rows = [(1, words(g, e)) for g in "ab" for e in ("one", "two")] + [(5, words("a", "three")), (6, words("b", "three")), (8, words("c", "one")), (9, words("c", "two"))]
    found = ngram_join.jaccard_components(make_docs(rows)).collect()
    assert {(r.doc_id, r.component_id) for r in found} == {(1, 1), (5, 1), (6, 1), (8, 8), (9, 8)}


def test_a_trie_of_nested_sets_is_as_deep_as_it_gets():
    """3,000 sets, each the beginning of the next: deeper than Python recurses."""
    tokens = np.arange(3000, dtype=np.uint64)
    trie = ngram_join.Trie([(i, i + 1, tokens[: i + 1]) for i in range(3000)])
    want = [i for i in range(3000) if 9 * min(i + 1, 1000) >= 4 * (1000 + i + 1)]
    assert sorted(trie.links(1000, tokens[:1000])) == want


def test_digests_before_empty_texts_are_whole(make_docs):
    texts = ["a b c d e f g", "a b c d e f h"]
    alone = {r.doc_id: (r.d1, r.d2) for r in ngram_join.set_digests(make_docs(list(enumerate([*texts, "z"]))).coalesce(1)).collect()}
    for k, text in enumerate(texts):
        found = {r.doc_id: (r.d1, r.d2) for r in ngram_join.set_digests(make_docs([(k, text), (8, ""), (9, None)]).coalesce(1)).collect()}
        assert found == {k: alone[k], 8: (0, 0), 9: (0, 0)}


def test_components_of_chains_and_loops(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(50, 50), (60, 61), (61, 60), (None, 3)]
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(41)} | {60: 60, 61: 60}


def exact(rows, k=20):
    good = {i: np.array(v, float) for i, v in rows if i is not None and v is not None and len(v) == 16 and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for q, v in good.items():
        if q % 20 == 0:
            s = sorted((-float((w * v).sum()), i) for i, w in good.items() if i != q)[:k]
            out[q] = [(i, -x) for x, i in s]
    return out


def test_neighbours_exact_on_small_tables_with_bad_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(16).tolist()) for i in range(200)]
    rows += [(200 + i, rows[7][1]) for i in range(30)]  # equal vectors tie to smaller ids
    rows += [(300, None), (301, []), (302, [0.0] * 16), (303, [float("nan")] * 16), (304, [None] * 16), (305, [1.0] * 3), (306, [float("inf")] * 16), (None, [1.0] * 16), (320, (3 * rng.standard_normal(16)).tolist())]
    found = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = exact(rows)
    assert got.keys() == want.keys()
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
        assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]])
    assert neighbours.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).isEmpty()


def test_repeated_ids_take_no_places(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.standard_normal(16).tolist()) for i in range(120)]
    near = [(500, (np.array(rows[20][1]) * (2 + j / 10)).tolist()) for j in range(25)]  # one id fills the first places of query 20
    found = neighbours.nearest(spark.createDataFrame(rows + rows + near, "vec_id long, embedding array<double>")).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert len(set(got.pop(500))) == 20
    vectors = [(i, np.array(v)) for i, v in rows + near]
    for q, ids in got.items():
        own, best = np.array(rows[q][1]), {}
        for i, v in vectors:
            if i != q:
                best[i] = max(best.get(i, -np.inf), float((v * own).sum()))
        assert ids == sorted(best, key=lambda i: (-best[i], i))[:20]


def test_hilbert_curve_steps_to_neighbours():
    for d, bits in ((2, 4), (3, 3), (4, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * d, indexing="ij"), -1).reshape(-1, d)
        keys = neighbours.hilbert_keys(grid, bits)
        assert sorted(keys.tolist()) == list(range(len(grid)))
        assert (np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(1) == 1).all()


def recall_and_share(x):
    """Recall of the registered parameters' index for some queries, and the share of all rows that a query scores."""
    n = len(x)
    rng = np.random.default_rng(2)
    sample = x[rng.choice(n, min(n, neighbours.SAMPLE), replace=False)]
    index = neighbours.Curves(sample, float(np.linalg.norm(x, axis=1).max()) * (1 + 1e-12), n, n // 20, 20)
    asks = np.arange(0, n, 20)[:400]
    score = x[asks] @ x.T
    score[np.arange(len(asks)), asks] = -np.inf
    want = np.argpartition(-score, 19, axis=1)[:, :20]
    lifted, pointing = index.lift(x), index.pointing(x[asks])
    hit, scored = np.zeros(want.shape, bool), 0
    for c in range(index.curves):
        cell, near = index.cell(lifted, c), index.near(pointing, c)
        hit |= (near[:, :, None] == cell[want][:, None, :]).any(1)
        scored += np.bincount(cell, minlength=len(index.means[c]))[near].sum(1).mean()
    return hit.mean(), scored / n


def test_work_follows_the_structure_of_the_vectors():
    """The shipped constants: recall holds everywhere, and vectors near a plane or in groups need a part of the rows."""
    rng = np.random.default_rng(4)
    plane = rng.standard_normal((40_000, 8)) @ rng.standard_normal((8, 64))
    groups = rng.standard_normal((1500, 64))[rng.integers(0, 1500, 40_000)] + 0.6 * rng.standard_normal((40_000, 64))
    lengths = plane * rng.uniform(0.5, 2, (40_000, 1))
    for x, most in ((plane / np.linalg.norm(plane, axis=1)[:, None], 0.25), (groups, 0.6), (lengths, 0.5), (rng.standard_normal((40_000, 64)), 1.0)):
        found, share = recall_and_share(x)
        assert found >= 0.9 and share <= most, (found, share)


def test_recall_of_the_query_with_many_ranges(spark):
    """The shipped constants, through Spark: 8,000 rows of which a query looks at a part, with a third alike."""
    rng = np.random.default_rng(5)
    x = rng.standard_normal((8000, 6)) @ rng.standard_normal((6, 16))
    x[2:8000:3] = x[2]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    found = {}
    for r in neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    gram = x[::20] @ x.T
    hits = 0
    for j, q in enumerate(range(0, 8000, 20)):
        gram[j, q] = -np.inf
        edge = np.partition(gram[j], 7980)[7980]
        got = sorted(found[q])
        assert [g[0] for g in got] == list(range(1, 21)) and len({g[1] for g in got}) == 20
        assert np.allclose([g[2] for g in got], [x[q] @ x[g[1]] for g in got])
        hits += sum(g[2] >= edge - 1e-9 * abs(edge) for g in got)
    assert hits / (400 * 20) >= 0.9
