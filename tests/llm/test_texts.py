"""SentencePiece, fingerprints and packing."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from tokenizers import Tokenizer

from tidelog.llm import fingerprints as fp
from tidelog.llm import packing, sentencepieces

ODD = ["", " ", "  a  b ", "▁x▁▁y", "a\0b", "日本語 テキスト", "😀 � <s> </s> <0x41>", "\n\n\t x", "x" * 500, "a" * 49 + " " * 70 + "é" * 60, "I'll DON'T 's ... '' .'s", "x y\u0085z", "e\u0301 é", "<|endoftext|> a", "\x1fa b", "İstanbul ß", "the same", "the same"]
PIECES, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")


def test_sentencepiece_equals_the_library_and_spans_cover(spark, make_docs):
    library, own = sentencepiece.SentencePieceProcessor(model_file=PIECES), sentencepieces.PieceModel(PIECES)
    for text in ODD:
        ids, spans = library.encode(text), own.encode_spans(text)
        assert [s[0] for s in spans] == ids and own.decode(ids) == library.decode(ids)
        data = text.encode()
        ends = [s for k, s in enumerate(spans) if k == 0 or s[1:] != spans[k - 1][1:]]
        assert b"".join(data[a:b] for _, a, b in ends) == data
    rows = list(enumerate([*ODD, None]))
    found = {r.doc_id: r for r in sentencepieces.piece_digests(make_docs([*rows, (None, "x")]), PIECES).collect()}
    assert len(found) == len(rows) + 1
    for i, t in rows:
        ids = library.encode(t or "")
        assert (found[i].n_tokens, found[i].ids_sha256, found[i].decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
    shown = sentencepieces.encode_pieces(make_docs([(1, " né")]), PIECES).first()
    assert [(p.first_byte, p.end_byte) for p in shown.pieces][-1][1] == 4 and shown.decoded == " né"
    assert sentencepieces.piece_digests(make_docs([]), PIECES).isEmpty()


def test_every_text_of_op2_goes_through_alignment_and_own_merges(make_docs):
    own = sentencepieces.PieceModel(PIECES)
    for text, (count, joined, decoded, spans) in zip(ODD, own.digests(ODD), strict=True):
        want = own.encode_spans(text)
        assert joined == ",".join(str(x[0]) for x in want) and count == len(want)
        assert spans.tolist() == [[a, b] for _, a, b in want]
    # The walk of every character through a map that has none of them aligns as the empty map does.
    walked = sentencepieces.PieceModel(PIECES)
    walked.plain, walked.map.units = False, tuple([256 << 10] + [0] * 1023)
    for text in ODD:
        (a, x), (b, y) = own.normalise(text), walked.normalise(text)
        assert a == b and x.tolist() == y.tolist()
    found = {r.doc_id: r.spans_sha256 for r in sentencepieces.piece_digests(make_docs(list(enumerate(ODD))), PIECES).collect()}
    for i, text in enumerate(ODD):
        assert found[i] == hashlib.sha256(np.array([s[1:] for s in own.encode_spans(text)], "<i8").tobytes()).hexdigest()


def test_charmap_takes_the_longest_prefix():
    """A hand-made double array: 'a' -> 'x', 'ab' -> 'yz'."""
    units = [0] * 1024
    put = lambda at, label, offset, leaf: units.__setitem__(at, label | (leaf << 8) | ((at ^ offset) << 10))
    a, b = 256 ^ ord("a"), 384 ^ ord("b")
    units[0] = 256 << 10
    put(a, ord("a"), 384, 1)
    units[384] = 1 << 31
    put(b, ord("b"), 512, 1)
    units[512] = 1 << 31 | 2
    pool = b"x\0yz\0"
    blob = (4 * len(units)).to_bytes(4, "little") + np.array(units, "<u4").tobytes() + pool
    chars = sentencepieces.CharMap(blob)
    assert chars.longest(b"abc", 0) == (2, b"yz") and chars.longest(b"ac", 0) == (1, b"x") and chars.longest(b"ba", 0) is None


def test_fingerprints(spark, make_docs):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(100, None), (None, "last one"), (None, None), (50, "one " * 300), (51, "one " * 300 + "two")]
    found = fp.next_document_edits(make_docs(rows), 3).collect()
    assert len(found) == len(rows)
    ordered = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, (r[1] is not None, r[1] or "")))
    edits = {}
    for (i, t), (_, u) in zip(ordered, [*ordered[1:], ordered[0]]):
        t, u = t or "", u or ""
        edits.setdefault(i, []).append((len(t), hashlib.sha256((t[: len(t) - len(t) // 2] + u[: len(t) // 2]).encode()).hexdigest()))
    got = {}
    for r in found:
        got.setdefault(r.doc_id, []).append((r.n_chars, r.edited_sha256))
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in edits.items()}
    marks = {r.doc_id: r.fingerprint for r in found}
    assert marks[16] == marks[17] and marks[100] == "0" * 64
    assert fp.next_document_edits(make_docs([]), 2).isEmpty()
    assert fp.next_document_edits(make_docs([(1, "abcd")]), 2).first().near_next == 1.0


def test_near_fingerprints_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2, 256)
    rows = []
    for i in range(60):
        bits = (base if i % 2 else rng.integers(0, 2, 256)).copy()
        bits[rng.choice(256, rng.integers(0, 5), replace=False)] ^= 1
        rows.append((i, np.packbits(bits).tobytes().hex()))
    rows += [(200, rows[3][1]), (None, rows[3][1]), (201, None)]
    members, pairs = fp.near_fingerprints(spark.createDataFrame(rows, "doc_id long, fingerprint string"), 5)
    reps = {}
    for i, m in rows:
        if i is not None and m is not None:
            reps[m] = min(reps.get(m, i), i)
    want = {(a, b) for ma, a in reps.items() for mb, b in reps.items() if a < b and bin(int(ma, 16) ^ int(mb, 16)).count("1") <= 5}
    assert {(r.left_id, r.right_id) for r in pairs.collect()} == want
    assert {r.doc_id: r.class_id for r in members.collect()} == {i: reps[m] for i, m in rows if i is not None and m is not None}


def test_packing_is_gapless_and_exact(spark, make_docs):
    library = Tokenizer.from_file(WORDS)
    rows = list(enumerate([*ODD, "word " * 9000, None])) + [(None, "no id")]
    docs = {i: [*library.encode(t or "", add_special_tokens=False).ids, 1] for i, t in rows}
    found = packing.pack_documents(make_docs(rows).repartition(2), WORDS, with_ids=True).collect()
    spans, sequences = {}, {}
    for r in found:
        ids = docs[r.doc_id][r.start : r.start + r.length]
        assert list(r.ids) == ids and r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes()) and r.doc_tokens == len(docs[r.doc_id])
        spans.setdefault(r.doc_id, []).append((r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, ids in docs.items():
        at = 0
        for start, length in sorted(spans[i]):
            assert start == at
            at += length
        assert at == len(ids)
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    assert packing.pack_documents(make_docs([]), WORDS).isEmpty()


def test_padding_is_little_in_many_small_tasks(spark, make_docs):
    """64 tasks of a few thousand tokens each: all that isn't a power of two long is a class of short rests."""
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(f"w{j}" for j in rng.integers(0, 9999, rng.integers(1, 200)))) for i in range(640)]
    found = packing.pack_documents(make_docs(rows).repartition(64, "doc_id"), WORDS).collect()
    filled = {}
    for r in found:
        filled[r.sequence_id] = filled.get(r.sequence_id, 0) + r.length
    padding = sum(0 if n & (n - 1) == 0 else packing.CAPACITY - n for n in filled.values())
    assert max(filled.values()) <= packing.CAPACITY and padding <= 0.005 * sum(filled.values())


def test_cuts_fill_classes():
    assert packing.cuts(5000) == [(0, 2048), (2048, 2048), (4096, 512), (4608, 256), (4864, 128), (4992, 8)]
    assert packing.cuts(1) == [(0, 1)]


def test_simhash_of_slices_is_the_same():
    texts = pa.array(["one two three " * 40, None, "", "x"] * 3)
    whole = fp.simhash(texts)
    assert all((fp.simhash(texts.slice(i, 1))[0] == whole[i]).all() for i in range(len(texts)))


def test_one_word_less_is_near_at_every_length():
    rng = np.random.default_rng(2)
    words = np.array(["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(2, 9))) for _ in range(2000)])
    apart = {}
    for n in (16, 23, 24, 25, 48, 95, 96, 97):
        texts = [rng.choice(words, n) for _ in range(100)]
        whole, cut = (fp.simhash(pa.array([" ".join(t[:k]) for t in texts])) for k in (n, n - 1))
        apart[n] = 256 * (1 - fp.likeness(whole, cut)).mean()
    assert all(apart[b] < apart[a] + 1 for a, b in zip(list(apart), list(apart)[1:])) and apart[24] < 24, apart
