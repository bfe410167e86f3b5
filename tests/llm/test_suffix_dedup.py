import hashlib
import random

import numpy as np
import pytest

from tidelog.llm import induced
from tidelog.llm.suffix_dedup import LENGTH, dedup_documents


def brute(rows):
    """(doc_id, n_bytes, n_removed, n_spans, digest, kept) for each row, by the definition."""
    held = [(i, (t or "").encode()) for i, t in rows]
    least = {}
    for i, b in held:
        if i is not None:
            for k in range(len(b) - LENGTH + 1):
                w = b[k : k + LENGTH]
                least[w] = min(least.get(w, i), i)
    out = []
    for i, b in held:
        gone = [False] * len(b)
        for k in range(len(b) - LENGTH + 1):
            if i is not None and least.get(b[k : k + LENGTH], i) < i:
                gone[k : k + LENGTH] = [True] * LENGTH
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest(), kept.decode(errors="ignore")))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.randint(1, 9)))
    passage = " ".join(word() for _ in range(40))
    rows = [(i, " ".join(word() for _ in range(rng.randint(0, 60)))) for i in range(30)]
    for i in range(30, 60):
        own = " ".join(word() for _ in range(20))
        a = rng.randint(0, 60)
        rows.append((i, own + passage[a : a + rng.randint(45, 120)] + own[::-1]))
    rows += [(70 + i, rows[i][1]) for i in range(8)]
    rows += [(80, "a" * 300), (81, "a" * 49), (82, "a" * 50), (83, "b" + "a" * 400 + "c"), (84, None), (85, ""), (86, None), (87, "é" * 60), (88, "xé" + "é" * 59)]
    rows += [(None, passage), (None, None), (90, passage), (90, passage), (90, "z" + passage), (5, passage + "q"), (91, (passage + " ") * 40)]
    rng.shuffle(rows)
    return rows


def test_matches_brute_force_with_ties_nulls_and_repeats(make_docs):
    rows = corpus()
    found = dedup_documents(make_docs(rows), with_text=True)
    mine = sorted([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, r.kept) for r in found.collect()], key=str)
    assert mine == brute(rows)


def test_empty_table(make_docs):
    assert dedup_documents(make_docs([])).isEmpty()


@pytest.mark.parametrize("memory", [24, 2400, 1 << 24])
def test_suffix_sort_spills_and_recurses(memory, monkeypatch):
    rng = random.Random(memory)
    monkeypatch.setattr(induced, "STEP", 5)
    monkeypatch.setattr(induced, "RANGES", 3)
    for _ in range(40):
        text = [rng.randint(1, rng.choice([1, 2, 4])) for _ in range(rng.randint(1, 90))]
        at, lcp = [], []
        induced.suffix_sort(np.array([*text, 0], np.uint8), 200, lambda a, b: (at.extend(a.tolist()), lcp.extend(b.tolist())), memory)
        assert at == sorted(range(len(text)), key=lambda i: text[i:], reverse=True)
        for k in range(1, len(at)):
            a, b = text[at[k - 1] :], text[at[k] :]
            same = next((j for j, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert lcp[k] == same


def test_a_shard_many_times_the_memory(monkeypatch):
    """Texts of 2 and 15 times the allowance, of 4 KB: what the sorter holds hardly grows with them."""
    import tracemalloc

    rng = np.random.default_rng(3)
    monkeypatch.setattr(induced, "STEP", 1 << 9)
    monkeypatch.setattr(induced, "RANGES", 64)
    peaks = []
    for n in (10_000, 60_000):
        text = induced.on_disk(n + 1, np.uint8, 1 << 10)
        text[:n] = rng.integers(1, 5, n)
        text[n // 2 : n // 2 + 400] = text[:400]
        found, held = np.zeros(n, bool), []
        tracemalloc.start()

        def emit(at, lcp):
            held.append((at[-1], int(lcp.max())))
            found[at] = True

        induced.suffix_sort(text, 50, emit, 1 << 12)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert found.all() and max(h[1] for h in held) == 50
        some = np.array([h[0] for h in held])[:: max(1, len(held) // 300)]
        keys = [text[a : a + 50].tobytes() for a in some.tolist()]
        assert keys == sorted(keys, reverse=True)
    assert peaks[1] < 1e6, peaks  # forty bytes for each of the text would be 2.4e6; this test holds a part of it


def test_a_shard_on_disk_marks_the_same_windows(monkeypatch):
    from tidelog.llm import suffix_dedup

    rng = random.Random(7)
    passages = [bytes(rng.choice(b"abcd ") for _ in range(97)) for _ in range(12)]
    requests = []
    for block in range(40):
        segments = [p[a : a + rng.randint(50, 97 - a)] for p in rng.sample(passages, 6) for a in (rng.randint(0, 40),)]
        ids = sorted(rng.sample(range(1000), len(segments)))
        requests.append((block % 3, block, b"".join(segments), bytes(len(s) for s in segments), np.array(ids, np.int64).tobytes()))
    answers = []
    for memory in (1 << 26, 1 << 9):
        shard = suffix_dedup.Shard(memory)
        for r in requests:
            shard.add(*r)
        answers.append([a for part in shard.marked() for a in part])
    assert len(answers[0]) == 40 and sum(any(a[2]) for a in answers[0]) > 20
    windows = {}
    for _, _, raw, lengths, ids in requests:
        at = 0
        for n, i in zip(lengths, np.frombuffer(ids, np.int64).tolist()):
            for k in range(n - LENGTH + 1):
                w = raw[at + k : at + k + LENGTH]
                windows[w] = min(windows.get(w, i), i)
            at += n
    for found in answers:
        for (block, bucket, mask), (b, k, raw, lengths, ids) in zip(found, requests):
            assert (block, bucket) == (k, b)
            at = 0
            for n, i, bits in zip(lengths, np.frombuffer(ids, np.int64).tolist(), np.frombuffer(mask, np.uint64).tolist()):
                for w in range(n - LENGTH + 1):
                    assert bool(bits >> w & 1) == (windows[raw[at + w : at + w + LENGTH]] < i)
                at += n


def test_texts_of_several_megabytes_and_clashing_columns(make_docs):
    rng = random.Random(9)
    long = " ".join(f"{rng.randint(0, 10**9):x}" for _ in range(400_000))
    passage = "a passage of more than fifty bytes that comes in two documents, once far inside"
    docs = make_docs([(1, passage), (2, long + passage), (3, long), (4, "x" * 3_000_000)])
    for name in ("kept", "n_removed", "n_bytes", "sha", "block", "row", "copy", "class_id"):
        docs = docs.withColumn(name, docs.doc_id)
    found = {r.doc_id: r for r in dedup_documents(docs).collect()}
    assert found[2].n_removed == len(passage) and found[3].n_removed == len(long) and found[4].n_removed == 0 == found[1].n_removed
