"""Harmonic packing of token sequences.

A document's ids are cut into full sequences, then into pieces of capacity/2, capacity/4 ... down to SHORTEST, and a
rest below that. Lengths fall into reciprocal-capacity classes: class k holds the lengths in (C/(k+1), C/k] and each
of its sequences takes k pieces, so the halving pieces fill theirs without padding. Every task fills the sequences of
its own documents, holding at most k pieces of each class; there is no shuffle. At a task's end the open classes of
halving pieces are emitted in groups of a power of two pieces (whose total is a power of two, which needs no
padding), and the open rests, cut where need be, fill sequences of powers of two as well. So there is no padding but in
the classes of rests, whose k pieces may fall short of the capacity.

Defined results: a null text is an empty document, of the end id alone; repeated rows and null ids are packed row by
row; an empty table gives no rows. Sequence ids are unique, not contiguous: partition number above the lower 36 bits.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tidelog.llm.common import slices, table

CAPACITY = 2048
#: The shortest piece that a document's rest is halved into.
SHORTEST = 32
END_ID = 1
CACHE_ENTRIES = 400_000


class WordTokens:
    """Ids of a lower-casing word-level BPE file, as little-endian unsigned 32-bit bytes.

    Texts of Latin-1 characters are split by the file's own pattern and their words looked up in a bounded cache; all
    others (and those that may hold special tokens or control characters) are encoded by the library as a whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        letters, numbers = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼-¾"
        self.words = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^\s{letters}{numbers}]+").findall
        self.odd = re.compile("[\x00-\x08\x0e-\x1f\x7f-\x9f]|<\\|").search
        self.ends = {i for w, i in self.library.get_vocab(False).items() if w.endswith("</w>")}
        self.cache: dict[str, bytes] = {}

    def _learn(self, words: list[str]) -> None:
        """Encodes new words in one call; each ends with its own end-of-word id."""
        ids = self.library.encode(" ".join(words), add_special_tokens=False).ids
        start, k, ends, cache = 0, 0, self.ends, self.cache
        data = b"".join([i.to_bytes(4, "little") for i in ids])
        for at, i in enumerate(ids, 1):
            if i in ends:
                cache[words[k]] = data[4 * start : 4 * at]
                start, k = at, k + 1
        if k != len(words) or start != len(ids):
            raise ValueError("a word of the tokenizer file has no end-of-word id")

    def encode(self, texts: list[str]) -> list[bytes]:
        rows: list[list[str] | None] = []
        for t in texts:
            try:
                t.encode("latin-1")
                rows.append(None if self.odd(t) else self.words(t.lower()))
            except UnicodeEncodeError:
                rows.append(None)
        if len(self.cache) > CACHE_ENTRIES:
            self.cache.clear()
        if new := list(set().union(*[r for r in rows if r]).difference(self.cache)):
            self._learn(new)
        get = self.cache.__getitem__
        return [b"".join(map(get, r)) if r is not None else b"".join([i.to_bytes(4, "little") for i in self.library.encode(t, add_special_tokens=False).ids]) for r, t in zip(rows, texts, strict=True)]


_tokens: dict[str, WordTokens] = {}


def word_tokens(path: str) -> WordTokens:
    if path not in _tokens:
        _tokens[path] = WordTokens(path)
    return _tokens[path]


def cuts(length: int, capacity: int = CAPACITY, shortest: int = SHORTEST) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces."""
    out, at = [], 0
    size = capacity
    while at < length:
        rest = length - at
        while size > rest and size > shortest:
            size //= 2
        size = min(size, rest)
        out.append((at, size))
        at += size
    return out


class Packer:
    """Places pieces (as _piece makes them) into sequences of one task."""

    def __init__(self, capacity: int, shortest: int, first_id: int):
        self.capacity, self.shortest, self.next = capacity, shortest, first_id
        self.open: dict[int, list[tuple[int, tuple]]] = {}

    def _emit(self, pieces: list[tuple[int, tuple]]) -> list[tuple[tuple, int, int]]:
        out, at = [], 0
        for length, piece in pieces:
            out.append((piece, self.next, at))
            at += length
        self.next += 1
        return out

    def add(self, length: int, piece: tuple) -> list[tuple[tuple, int, int]]:
        """The placed pieces of the sequence that this one completes, if it does."""
        k = self.capacity // length
        held = self.open.setdefault(k, [])
        held.append((length, piece))
        return self._emit(self.open.pop(k)) if len(held) == k else []

    def close(self) -> list[tuple[tuple, int, int]]:
        out, rests = [], []
        for k, held in sorted(self.open.items()):
            length = held[0][0]
            if k & (k - 1) or length != self.capacity // k or length & (length - 1):
                rests += held
                continue
            while held:
                group = 1 << (len(held).bit_length() - 1)
                out += self._emit(held[:group])
                held = held[group:]
        self.open = {}
        total = sum(length for length, _ in rests)
        rests.reverse()
        while total:
            room = size = min(self.capacity, 1 << (total.bit_length() - 1))
            filled = []
            while room:
                length, piece = rests.pop()
                if length > room:
                    piece, other = _cut(piece, room)
                    rests.append((length - room, other))
                    length = room
                filled.append((length, piece))
                room -= length
            out += self._emit(filled)
            total -= size
        return out


def _piece(doc_id: int | None, start: int, ids: bytes, doc_tokens: int) -> tuple:
    return doc_id, start, len(ids) // 4, zlib.crc32(ids), doc_tokens, ids


def _cut(piece: tuple, at: int) -> tuple[tuple, tuple]:
    doc_id, start, _, _, doc_tokens, ids = piece
    return _piece(doc_id, start, ids[: 4 * at], doc_tokens), _piece(doc_id, start + at, ids[4 * at :], doc_tokens)


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, shortest: int = SHORTEST, with_ids: bool = False) -> DataFrame:
    """One row per piece of each document; with_ids adds the piece's ids as `ids`, an array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tokens = word_tokens(path)
        packer = Packer(capacity, shortest, TaskContext.get().partitionId() << 36)
        end = END_ID.to_bytes(4, "little")
        names = [x.split()[0] for x in SCHEMA.split(", ")]

        def rows(placed):
            columns = list(zip(*[(*piece[:5], seq, off) for piece, seq, off in placed], strict=True))
            arrays = [pa.array(c, pa.int64()) for c in columns]
            if not with_ids:
                return pa.RecordBatch.from_arrays(arrays, names)
            ids = [list(memoryview(piece[5]).cast("I")) for piece, _, _ in placed]
            return pa.RecordBatch.from_arrays([*arrays, pa.array(ids, pa.list_(pa.int32()))], [*names, "ids"])

        for batch in slices(batches, "text"):
            placed = []
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), tokens.encode(texts), strict=True):
                ids += end
                n = len(ids) // 4
                for start, length in cuts(n, capacity, shortest):
                    placed += packer.add(length, _piece(doc_id, start, ids[4 * start : 4 * (start + length)], n))
            if placed:
                yield rows(placed)
        if placed := packer.close():
            yield rows(placed)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA + (", ids array<int>" if with_ids else ""))


def op9_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
