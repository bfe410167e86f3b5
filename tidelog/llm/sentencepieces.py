"""SentencePiece encoding and decoding with source offsets.

Texts are normalised by longest-prefix matching in the model's compiled character map, a double-array trie; every
normalised character keeps the byte offset of the source that it came from, so each piece projects to a span of
original bytes. Pieces come from byte-pair merges in order of score; characters outside the vocabulary fall back to
byte pieces, whose spans are those of the whole character.

Whole slices of texts are encoded at once. Their distinct segments (words, as a rule) are rows of numbers, one for
each symbol; each round merges the best pair of every row, and whatever symbols come out tile the slice, so positions,
and through the alignment source bytes, are sums of their lengths. Segments of over WIDEST characters are merged one
by one, with a heap.

Defined results: a null text counts as empty; an empty text has no ids and decodes to an empty text. Repeated rows
and null ids are encoded row by row. Very long texts are encoded whole (merges in a run without spaces are
O(n log n)).
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidelog.llm import kernels
from tidelog.llm.common import map_slices, table

SPACE = "▁"
#: Characters of the segments that are merged in rows.
WIDEST = 64
#: Text of a slice that is encoded at once.
SLICE = 2 << 20
_NEVER = np.int32(2**31 - 1)


class CharMap:
    """The compiled map of a model: a double-array trie of UTF-8 prefixes and a pool of replacements."""

    def __init__(self, blob: bytes):
        self.units: tuple[int, ...] = ()
        self.pool = b""
        if blob:
            (size,) = struct.unpack_from("<I", blob)
            self.units = struct.unpack_from(f"<{size // 4}I", blob, 4)
            self.pool = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest prefix of data[at:] in the map."""
        units, found = self.units, None
        if not units:
            return None
        offset = lambda u: (u >> 10) << ((u & (1 << 9)) >> 6)
        node = offset(units[0])
        for i in range(at, len(data)):
            byte = data[i]
            node ^= byte
            unit = units[node]
            if unit & 0x800000FF != byte:
                break
            node ^= offset(unit)
            if (unit >> 8) & 1:
                start = units[node] & 0x7FFFFFFF
                found = (i + 1 - at, self.pool[start : self.pool.index(b"\0", start)])
        return found


class PieceModel:
    """A BPE model file: normalisation, encoding with spans, decoding."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        spec = proto.normalizer_spec
        if proto.trainer_spec.model_type != pb.TrainerSpec.BPE or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only BPE models with white space as a prefix are supported")
        self.map = CharMap(spec.precompiled_charsmap)
        self.dummy, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        self.pieces = [p.piece for p in proto.pieces]
        kinds = [p.type for p in proto.pieces]
        kind = pb.ModelProto.SentencePiece
        if kind.USER_DEFINED in kinds or kind.UNUSED in kinds:
            raise ValueError("user-defined and unused pieces are not supported")
        self.ids = {p: i for i, p in enumerate(self.pieces) if kinds[i] == kind.NORMAL}
        self.score = {p.piece: p.score for p in proto.pieces if p.type == kind.NORMAL}
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if kinds[i] == kind.BYTE}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.fallback = proto.trainer_spec.byte_fallback
        self.unk_surface = proto.trainer_spec.unk_surface
        self.silent = {i for i, k in enumerate(kinds) if k == kind.CONTROL}
        self.unk = kinds.index(kind.UNKNOWN)
        self.names = [str(i) for i in range(len(self.pieces))]
        # What ids spell by themselves: bytes below 128 are characters, whatever bytes are beside them.
        self.surface = [p.replace(SPACE, " ") for p in self.pieces]
        for b, i in self.bytes.items():
            self.surface[i] = chr(b) if b < 128 else ""
        self.low = {self.unk, *[i for b, i in self.bytes.items() if b > 127]} | self.silent
        self._tabulate()
        # No piece continues across the start of a run of spaces: such places cut the text into independent segments.
        self.cuttable = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self.cut = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.plain = not self.map.units and self.dummy and not self.squeeze and self.escape

    # -- normalisation

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, and for each of its characters and its end the byte offset in the source."""
        data = text.encode()
        if self.plain and data:  # an empty map: every character stands for itself
            starts = np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
            return SPACE + text.replace(" ", SPACE), np.concatenate([[0], starts, [len(data)]])
        units: list[tuple[str, int, int]] = []
        at = 0
        while at < len(data):
            hit = self.map.longest(data, at)
            if hit:
                size, out = hit[0], hit[1].decode()
            else:
                lead = data[at]
                size = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                out = data[at : at + size].decode()
            units.append((out, at, at + size))
            at += size
        if self.squeeze:
            while units and units[0][0] in (" ", ""):
                units.pop(0)
        if not units:
            return "", np.array([len(data)])
        chars, align = [], []
        if self.dummy:
            chars.append(SPACE if self.escape else " ")
            align.append(units[0][1])
        for out, start, _ in units:
            for c in out:
                if c == " ":
                    if self.squeeze and chars and chars[-1] in (SPACE, " "):
                        continue
                    c = SPACE if self.escape else " "
                chars.append(c)
                align.append(start)
        end = units[-1][2]
        if self.squeeze:
            while chars and chars[-1] in (SPACE, " "):
                chars.pop()
                end = align.pop()
        return "".join(chars), np.array([*align, end])

    # -- merges

    def merge(self, segment: str) -> list[str]:
        """The pieces of a segment: the best-scored adjacent pair merges first, the leftmost of equals."""
        score = self.score
        if len(segment) > 48:
            return self._merge_long(segment)
        parts = list(segment)
        gains = [score.get(a + b) for a, b in zip(parts, parts[1:], strict=False)]
        while True:
            best, where = None, -1
            for i, g in enumerate(gains):
                if g is not None and (best is None or g > best):
                    best, where = g, i
            if where < 0:
                return parts
            parts[where : where + 2] = [parts[where] + parts[where + 1]]
            del gains[where]
            if where < len(gains):
                gains[where] = score.get(parts[where] + parts[where + 1])
            if where:
                gains[where - 1] = score.get(parts[where - 1] + parts[where])

    def _merge_long(self, segment: str) -> list[str]:
        score, parts = self.score, list(segment)
        n = len(parts)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap: list[tuple[float, int, int, str]] = []

        def offer(i: int) -> None:
            j = right[i]
            if j < n and (g := score.get(w := parts[i] + parts[j])) is not None:
                heap.append((-g, i, j, w)) if not started else heapq.heappush(heap, (-g, i, j, w))

        started = False
        for i in range(n - 1):
            offer(i)
        heapq.heapify(heap)
        started = True
        while heap:
            _, i, j, w = heapq.heappop(heap)
            if right[i] != j or not parts[i] or not parts[j] or parts[i] + parts[j] != w:
                continue
            parts[i], parts[j] = w, ""
            right[i] = right[j]
            if right[j] < n:
                left[right[j]] = i
            offer(i)
            if left[i] >= 0:
                offer(left[i])
        return [p for p in parts if p]

    def _ids(self, piece: str) -> list[int]:
        found = self.ids.get(piece)
        if found is not None:
            return [found]
        return [self.bytes[b] for b in piece.encode()] if self.fallback else [self.unk]

    def segments(self, normal: str) -> list[str]:
        return self.cut.findall(normal) if self.cuttable else [normal] if normal else []

    # -- the general interface

    def encode_spans(self, text: str) -> list[tuple[int, int, int]]:
        """(id, first source byte, end of source bytes) of each piece of the text."""
        normal, align = self.normalise(text)
        align = align.tolist()
        out, at = [], 0
        for segment in self.segments(normal):
            for piece in self.merge(segment):
                begin, end = align[at], align[at + len(piece)]
                out += [(i, begin, end) for i in self._ids(piece)]
                at += len(piece)
        return out

    def encode(self, text: str) -> list[int]:
        return [x[0] for x in self.encode_spans(text)]

    def decode(self, ids: list[int]) -> str:
        out: list[str] = []
        held = bytearray()
        first = True
        for i in [*ids, None]:
            if i in self.byte_of:
                held.append(self.byte_of[i])
                first = False
                continue
            if held:
                out.append(_repaired(bytes(held)))
                held.clear()
            if i is None or i in self.silent:
                continue
            if i == self.unk:
                out.append(self.unk_surface)
            else:
                piece = self.pieces[i]
                if first and (self.dummy or self.squeeze) and piece.startswith(SPACE):
                    piece = piece.lstrip(SPACE) if self.squeeze else piece[1:]
                out.append(piece.replace(SPACE, " "))
            first = False
        return "".join(out)

    # -- whole slices

    def _tabulate(self) -> None:
        """Symbols are the pieces by id, then other characters of pieces, then one for all other characters; pairs of
        symbols that make a piece, with its id and its place in the order of merges."""
        more = sorted({c for p in self.ids for c in p} - set(self.ids))
        symbols = self.ids | {c: len(self.pieces) + k for k, c in enumerate(more)}
        self.symbols, self.other = symbols, len(self.pieces) + len(more)
        self.size = np.ones(self.other + 1, np.int32)
        for p, i in self.ids.items():
            self.size[i] = len(p)
        self.symbol_of = np.full(0x110000, self.other, np.int32)
        for p, i in symbols.items():
            if len(p) == 1:
                self.symbol_of[ord(p)] = i
        place = {score: k for k, score in enumerate(sorted({self.score[p] for p in self.ids}, reverse=True))}
        pairs = [(symbols[p[:k]] * (self.other + 1) + symbols[p[k:]], place[self.score[p]], i) for p, i in self.ids.items() for k in range(1, len(p)) if p[:k] in symbols and p[k:] in symbols]
        pairs.sort()
        self.pair_keys = np.array([x[0] for x in pairs] + [np.iinfo(np.int64).max], np.int64)
        self.pair_place = np.array([x[1] for x in pairs] + [_NEVER], np.int32)
        self.pair_made = np.array([x[2] for x in pairs] + [0], np.int32)

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The index of each pair; the last one for those that make no piece."""
        keys = left.astype(np.int64) * (self.other + 1) + right
        at = np.searchsorted(self.pair_keys, keys)
        return np.where(self.pair_keys[at] == keys, at, len(self.pair_keys) - 1).astype(np.int32)

    def _merged_rows(self, rows: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merges rows of symbols, of which the first `lengths` count; the best pair first, the leftmost of equals."""
        n, width = rows.shape
        out, count = rows.copy(), lengths.copy()
        none = len(self.pair_keys) - 1
        made = np.full((n, width), none, np.int32)
        inside = np.arange(1, width) < lengths[:, None]
        left, right = rows[:, :-1][inside], rows[:, 1:][inside]
        made[:, :-1][inside] = self._pairs(left, right)
        live = np.arange(n)
        rows, lengths = rows.copy(), lengths.copy()
        columns = np.arange(width - 1)
        while len(live):
            where = self.pair_place[made].argmin(axis=1)
            each = np.arange(len(live))
            best = made[each, where]
            going = best != none
            if not going.all():
                done = live[~going]
                out[done], count[done] = rows[~going], lengths[~going]
                live, rows, made, lengths, where, best = live[going], rows[going], made[going], lengths[going], where[going], best[going]
                each = np.arange(len(live))
                if not len(live):
                    break
            rows[each, where] = self.pair_made[best]
            # What lies behind the pair moves up by one.
            later = columns > where[:, None]
            rows[:, :-1] = np.where(later, rows[:, 1:], rows[:, :-1])
            made[:, :-1] = np.where(later, made[:, 1:], made[:, :-1])
            made[:, -1] = none
            lengths -= 1
            after = where + 1 < lengths
            made[each, where] = none
            made[each[after], where[after]] = self._pairs(rows[each[after], where[after]], rows[each[after], where[after] + 1])
            before = where > 0
            made[each[before], where[before] - 1] = self._pairs(rows[each[before], where[before] - 1], rows[each[before], where[before]])
        return out, count

    def _merged(self, code: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of segments, one after the other, and the number of each one's."""
        counts = np.zeros(len(starts), np.int64)
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        low = 0
        for width in (4, 8, 12, 16, 24, 32, WIDEST):
            of = np.flatnonzero((lengths > low) & (lengths <= width))
            low = width
            for k in range(0, len(of), 1 << 14):
                these = of[k : k + (1 << 14)]
                at = np.minimum(starts[these][:, None] + np.arange(width), len(code) - 1)
                rows, counts[these] = self._merged_rows(self.symbol_of[code[at]], lengths[these])
                parts.append((these, rows, counts[these]))
        long = np.flatnonzero(lengths > WIDEST)
        found = {}
        for i in long.tolist():
            text = code[starts[i] : starts[i] + lengths[i]].astype("<u4").tobytes().decode("utf-32-le")
            found[i] = np.array([self.symbols.get(p, self.other) for p in self.merge(text)], np.int32)
            counts[i] = len(found[i])
        begins = np.cumsum(counts) - counts
        out = np.empty(int(counts.sum()), np.int32)
        for these, rows, held in parts:
            inside = np.arange(rows.shape[1]) < held[:, None]
            out[(begins[these][:, None] + np.arange(rows.shape[1]))[inside]] = rows[inside]
        for i, symbols in found.items():
            out[begins[i] : begins[i] + len(symbols)] = symbols
        return out, counts

    def digests(self, texts: list[str]) -> list[tuple[int, str, str, np.ndarray]]:
        """For each text the number of ids, the ids joined by commas, the decoded text, and the spans of the ids: rows
        of (first source byte, end of source bytes), as encode_spans gives them."""
        normals, aligns = zip(*[self.normalise(t) for t in texts], strict=True) if texts else ((), ())
        sizes = np.array([len(x) for x in normals], np.int64)
        edges = np.concatenate([[0], np.cumsum(sizes)])
        code = np.frombuffer("".join(normals).encode("utf-32-le"), "<u4")
        if not len(code):
            return [(0, "", "", np.zeros((0, 2), np.int64)) for _ in texts]
        first = np.zeros(len(code), bool)
        if self.cuttable:
            space = code == ord(SPACE)
            first[1:] = space[1:] & ~space[:-1]
        first[edges[:-1][sizes > 0]] = True
        starts = np.flatnonzero(first)
        lengths = np.diff(np.append(starts, len(code)))
        chosen, which = self._distinct(code, starts, lengths)
        symbols, counts = self._merged(code, starts[chosen], lengths[chosen])
        begins = np.cumsum(counts) - counts
        times = counts[which]
        symbols = symbols[np.arange(times.sum()) - np.repeat(np.cumsum(times) - times - begins[which], times)]
        size = self.size[symbols].astype(np.int64)
        end = np.cumsum(size)
        begin = end - size
        owner = np.searchsorted(edges, begin, side="right") - 1
        align = np.concatenate(aligns)
        spans = np.stack([align[begin + owner], align[end + owner]], axis=1)  # each alignment has an end of its own
        ids = symbols
        strange = np.flatnonzero(symbols >= len(self.pieces))
        if len(strange):  # characters that are no pieces: their bytes, or the unknown piece
            own = [self._ids(chr(c)) for c in code[begin[strange]].tolist()]
            repeat = np.ones(len(ids), np.int64)
            repeat[strange] = [len(x) for x in own]
            at = np.repeat(np.arange(len(ids)), repeat)
            ids, owner, spans = ids[at], owner[at], spans[at]
            ids[np.flatnonzero(symbols[at] >= len(self.pieces))] = [i for x in own for i in x]
        cuts = np.searchsorted(owner, np.arange(len(texts) + 1)).tolist()
        names, surface, low = self.names, self.surface, np.isin(ids, list(self.low))
        out = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            mine = ids[a:b].tolist()
            if low[a:b].any():
                decoded = self.decode(mine)
            else:
                decoded = "".join([surface[i] for i in mine])
                if (self.dummy or self.squeeze) and decoded.startswith(" "):
                    decoded = decoded.lstrip(" ") if self.squeeze else decoded[1:]
            out.append((b - a, ",".join([names[i] for i in mine]), decoded, spans[a:b]))
        return out

    def _distinct(self, code: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(segments with distinct texts, the one that each segment equals)."""
        within = np.arange(len(code)) - np.repeat(starts, lengths)
        h = kernels.mix(np.add.reduceat((code.astype(np.uint64) + np.uint64(1)) * kernels.powers(int(lengths.max()))[within], starts) + lengths.astype(np.uint64))
        _, chosen, which = np.unique(h, return_index=True, return_inverse=True)
        other = np.repeat(starts[chosen[which]], lengths) + within
        if (lengths[chosen[which]] != lengths).any() or (code[np.minimum(other, len(code) - 1)] != code).any():
            return np.arange(len(starts)), np.arange(len(starts))  # two texts of one hash
        return chosen, which

    def digest(self, text: str) -> tuple[int, str, str, np.ndarray]:
        return self.digests([text])[0]


def _repaired(data: bytes) -> str:
    """UTF-8 with a replacement character for each byte that starts no valid character."""
    out, at = [], 0
    while at < len(data):
        for size in (1, 2, 3, 4):
            try:
                out.append(data[at : at + size].decode())
                at += size
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


_models: dict[str, PieceModel] = {}


def model(path: str) -> PieceModel:
    """One model per Python worker."""
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def encode_pieces(df: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """All columns of df, with `pieces`: array of (id, first_byte, end_byte), and `decoded`; null texts count as empty."""
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    kind = T.StructType([T.StructField("pieces", T.ArrayType(T.StructType([T.StructField("id", T.IntegerType()), T.StructField("first_byte", T.LongType()), T.StructField("end_byte", T.LongType())]))), T.StructField("decoded", T.StringType())])

    @F.pandas_udf(kind)
    def run(texts):
        import pandas as pd

        m, rows = model(path), []
        for t in texts:
            spans = m.encode_spans(t or "")
            rows.append(([{"id": i, "first_byte": a, "end_byte": b} for i, a, b in spans], m.decode([s[0] for s in spans])))
        return pd.DataFrame(rows, columns=["pieces", "decoded"])

    return df.withColumn("_coded", run(F.col(text_col))).withColumns({"pieces": F.col("_coded.pieces"), "decoded": F.col("_coded.decoded")}).drop("_coded")


def piece_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, spans_sha256 of every whole text; one pass, no shuffle.

    The last is of the source span of each id: first byte and end, as little-endian 64-bit numbers.
    """

    def run(batch):
        m = model(path)
        n, ids, decoded, projected = [], [], [], []
        for count, joined, out, spans in m.digests([t or "" for t in batch.column("text").to_pylist()]):
            n.append(count)
            ids.append(hashlib.sha256(joined.encode()).hexdigest())
            decoded.append(hashlib.sha256(out.encode()).hexdigest())
            projected.append(hashlib.sha256(spans.astype("<i8").tobytes()).hexdigest())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string()), pa.array(projected, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"])

    return map_slices(docs.select("doc_id", "text"), "text", run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string", SLICE)


def op2_sentencepiece(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return piece_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
