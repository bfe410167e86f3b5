"""N-gram Jaccard join by prefix trees.

A document's set is its distinct shingles of SHINGLE words; two documents link when their sets' Jaccard likeness is at
least 0.8. The join answers with components of links:

1. Equal sets form a class, of which the smallest id goes on.
2. Sketches: a set x linked with any y has, of its first (by hash) |x| - t + l shingles, t = ceil(0.8 |x|) and
   l = max(1, |x| div 5), at least max(1, t div 5) in common with y's. Classes with fewer sketch shingles that any
   other class has too are out; their links would have been seen.
3. The rest count the shingles that they share, which gives the global order: rarest first, unshared before all. Sets
   that share less than t are out; the others index the first shingles in that order, of which a linked pair has one
   in common (prefix filtering).
4. Probes meet blocks of documents: the globally ordered sets of a block form a trie; a probe traverses it, carrying
   the overlap with each shared path, and leaves a subtree when that and the remaining lengths can't reach a link.
   A block reports links that join what its own links have not joined yet.
5. First, the smallest and the largest document of each indexed shingle probe the blocks of its others (two probes a
   posting at most). Then the components of the links found so far; of every shingle that still holds several, each
   document probes the blocks with one of a greater component, if sizes and shared counts allow a link. So a group of
   n near copies costs about n, no pairs of documents are listed, and no link between components is missed.

Defined results: null and empty texts, and those of white space alone, have the empty set and link with nothing, not
even with each other; rows that share an id count as one node; a row without an id takes part only in its class, and
its component is null unless the class has one with an id. Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm import exchange, kernels
from tidelog.llm.common import SLICE_BYTES, fresh, map_slices, shuffle_partitions, slices, stored, table, with_class
from tidelog.llm.components import components

SHINGLE = 5
#: Bytes of text in a block, on average.
TEXT_BYTES = 4 << 20
#: Bytes of ordered sets in a block of the trie join, on average.
TRIE_BYTES = 4 << 20
#: Probes that meet a block's trie in one task, on average.
PROBES = 20_000


def needed(n):
    """The least overlap of a set of n with any set that links with it."""
    return (4 * n + 4) // 5


def shingle_sets(column: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The ascending distinct shingle hashes of all rows, one row after the other, and the size of each row's set."""
    data, offsets = kernels.text_buffers(column)
    n = len(column)
    starts, lengths, rows = kernels.words(data, offsets, ~kernels.IS_SPACE)
    w = kernels.word_hashes(kernels.LOWER[data], starts, lengths)
    counts = np.bincount(rows, minlength=n)
    begins = np.cumsum(counts) - counts
    code = np.zeros(0, np.uint64)
    if len(w) >= size:
        code = w[: len(w) - size + 1].copy()
        for j in range(1, size):
            code = code * kernels.BASE + w[j : len(w) - size + 1 + j]
        whole = rows[size - 1 :] == rows[: len(rows) - size + 1]
        code, of = code[whole], rows[: len(rows) - size + 1][whole]
    else:
        of = np.zeros(0, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < size))
    extra = np.zeros(len(short), np.uint64)
    for j in range(size - 1):
        use = counts[short] > j
        extra[use] = extra[use] * kernels.BASE + w[begins[short[use]] + j]
    code = kernels.mix(np.concatenate([code, extra + counts[short].astype(np.uint64)]))
    of = np.concatenate([of, short])
    if len(short):
        order = np.argsort(of, kind="stable")
        code, of = code[order], of[order]
    edges = np.searchsorted(of, np.arange(n + 1))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        if b - a > 1:
            code[a:b].sort()
    if len(code):
        keep = np.concatenate([[True], (code[1:] != code[:-1]) | (of[1:] != of[:-1])])
        code, of = code[keep], of[keep]
    return code, np.bincount(of, minlength=n)


def _digests(column: pa.Array) -> list[pa.Array]:
    """The size and a 128-bit digest, in two parts, of each row's set."""
    code, n = shingle_sets(column)
    cuts = np.cumsum(n) - n
    # One more hash, for the begins of empty sets behind all others.
    digest = [np.where(n > 0, np.add.reduceat(np.append(v, np.uint64(0)), cuts), 0).astype(np.uint64).view(np.int64) for v in (kernels.mix(code + np.uint64(1)), kernels.mix(code ^ kernels.BASE))]
    return [pa.array(n, pa.int64()), pa.array(digest[0]), pa.array(digest[1])]


def set_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and a 128-bit digest (d1, d2) of the set of every row."""

    def run(batch):
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *_digests(batch.column("text"))], ["doc_id", "n_shingles", "d1", "d2"])

    return map_slices(docs.select("doc_id", "text"), "text", run, "doc_id long, n_shingles long, d1 long, d2 long")


def _text_slices(tab: pa.Table):
    return slices(tab.combine_chunks().to_batches(), "text", SLICE_BYTES)


def _split(code: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    return np.split(code, np.cumsum(n)[:-1]) if len(n) else []


def _sketch(s: np.ndarray) -> np.ndarray:
    n = len(s)
    return s[: n - needed(n) + max(1, n // 5)]


def _class_rows(texts: pa.Table, notes: pa.Table) -> pa.Table:
    ids = notes.column("class_id").filter(pc.equal(notes.column("kind"), 0))
    return texts.filter(pc.is_in(texts.column("doc_id"), value_set=ids.combine_chunks()))


def _class_sets(texts: pa.Table, notes: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
    """(doc_id, shingles) of the rows with a class id; a set that an id has in several rows comes once."""
    rows = _class_rows(texts, notes)
    times = Counter(rows.column("doc_id").to_pylist())
    seen: set[tuple[int, bytes]] = set()
    for batch in _text_slices(rows):
        for doc_id, s in zip(batch.column("doc_id").to_pylist(), _split(*shingle_sets(batch.column("text"))), strict=True):
            if times[doc_id] > 1:
                mark = doc_id, hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                if mark in seen:
                    continue
                seen.add(mark)
            yield doc_id, s


def candidate_sets(docs: DataFrame, classes: DataFrame, total_bytes: int) -> DataFrame:
    """doc_id, n, block, tokens (ascending hashes) of the classes that their sketches leave in."""
    spark = docs.sparkSession
    blocks = exchange.block_count(total_bytes, TEXT_BYTES)
    tasks = shuffle_partitions(spark)
    bits = exchange.bucket_bits(docs, total_bytes // 16)
    rows = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    texts = exchange.by_block(rows.withColumn("block", exchange.block_of(F.col("doc_id"), blocks)), blocks, "blocks")
    empty = F.lit(None).cast("binary")
    wanted = classes.select(exchange.block_of(F.col("class_id"), blocks).alias("block"), F.lit(0).alias("kind"), "class_id", empty.alias("keys"), empty.alias("counts"))

    def ask(key, left, right):
        found = [_sketch(s) for _, s in _class_sets(left, right)]
        keys, counts = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        return exchange.ask_table(exchange.packed(key[0].as_py(), keys, counts, bits))

    asked = texts.groupBy("block").cogroup(wanted.groupBy("block")).applyInArrow(ask, exchange.ASK)
    reply = exchange.shared_keys(asked, tasks, bits)
    notes = wanted.unionByName(reply.select("block", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("class_id"), "keys", "counts"))

    def answer(key, left, right):
        known = right.filter(pc.equal(right.column("kind"), 1))
        keys, counts = exchange.merged_reply(known.column("keys").to_pylist(), known.column("counts").to_pylist())
        rows = []
        if len(keys):
            for doc_id, s in _class_sets(left, right):
                if len(s) and (exchange.looked_up(_sketch(s), keys, counts) > 0).sum() >= max(1, needed(len(s)) // 5):
                    rows.append((doc_id, len(s), s.tobytes()))
        return exchange.as_table(rows, [pa.int64(), pa.int64(), pa.binary()], ["doc_id", "n", "tokens"])

    return stored(texts.groupBy("block").cogroup(notes.groupBy("block")).applyInArrow(answer, "doc_id long, n long, tokens binary"), "candidates")


_ORDERED = "doc_id long, n long, m long, tokens binary, prefix array<long>"


def ordered_sets(candidates: DataFrame) -> DataFrame:
    """Of the candidates that share enough: n, m shared shingles, these in global order, and those to index.

    Sets of one id with equal n and m index a shingle that they share once.
    """
    spark = candidates.sparkSession
    total = candidates.agg(F.sum(F.octet_length("tokens"))).first()[0] or 0
    blocks = exchange.block_count(total, TRIE_BYTES * 4)
    tasks = shuffle_partitions(spark)
    bits = exchange.bucket_bits(candidates, total // 8)
    sets = exchange.by_block(candidates.withColumn("block", exchange.block_of(F.col("doc_id"), blocks)), blocks, "sets")

    def ask(key, tab):
        keys, counts = np.unique(np.frombuffer(b"".join(tab.column("tokens").to_pylist()), np.uint64), return_counts=True)
        return exchange.ask_table(exchange.packed(key[0].as_py(), keys, counts, bits))

    reply = exchange.shared_keys(sets.groupBy("block").applyInArrow(ask, exchange.ASK), tasks, bits)

    def answer(key, left, right):
        keys, counts = exchange.merged_reply(right.column("keys").to_pylist(), right.column("counts").to_pylist())
        rows = []
        times = Counter(left.column("doc_id").to_pylist())
        indexed: dict[tuple[int, int, int], set[int]] = {}
        for doc_id, n, raw in zip(*[left.column(c).to_pylist() for c in ("doc_id", "n", "tokens")], strict=True):
            s = np.frombuffer(raw, np.uint64)
            df = exchange.looked_up(s, keys, counts)
            s, df = s[df > 0], df[df > 0]
            if len(s) >= needed(n):
                s = s[np.lexsort((s, df))]
                prefix = s[: len(s) - needed(n) + 1].view(np.int64).tolist()
                if times[doc_id] > 1:
                    before = indexed.setdefault((doc_id, n, len(s)), set())
                    prefix = [t for t in prefix if t not in before]
                    before.update(prefix)
                rows.append((doc_id, n, len(s), s.tobytes(), prefix))
        return exchange.as_table(rows, [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())], ["doc_id", "n", "m", "tokens", "prefix"])

    return stored(sets.groupBy("block").cogroup(reply.groupBy("block")).applyInArrow(answer, _ORDERED), "ordered")


class Trie:
    """Globally ordered sets by shared beginnings; an edge holds all tokens up to the next branch.

    A node is (tokens of its edge, children, ids that end there, longest rest below, least size below).
    """

    def __init__(self, sets: list[tuple[int, int, np.ndarray]]):
        """sets: (id, full size, ordered tokens)."""
        self.vocabulary, flat = np.unique(np.concatenate([s for _, _, s in sets]), return_inverse=True)
        ends = np.cumsum([len(s) for _, _, s in sets])
        local = [(flat[e - len(s) : e].astype(np.int32), i, n) for e, (i, n, s) in zip(ends.tolist(), sets, strict=True)]
        # Big-endian bytes sort as the numbers do, so equal beginnings lie side by side.
        local.sort(key=lambda x: x[0].astype(">i4").tobytes())
        self.root = self._grown(local)

    def _grown(self, rows: list):
        """The tree of sorted rows, without recursion: nodes open downward and close upward."""
        top: list = []
        work = [(0, len(rows), 0, top)]
        opened = []
        while work:
            a, b, depth, above = work.pop()
            head, tail = rows[a][0], rows[b - 1][0]
            if b - a == 1:
                end = len(head)
            else:  # sorted: what the first and the last have in common, all have
                k = min(len(head), len(tail))
                differ = np.flatnonzero(head[depth:k] != tail[depth:k])
                end = depth + int(differ[0]) if len(differ) else k
            here, at = [], a
            while at < b and len(rows[at][0]) == end:
                here.append((rows[at][1], rows[at][2]))
                at += 1
            children: list = []
            while at < b:
                token, stop = rows[at][0][end], at + 1
                while stop < b and rows[stop][0][end] == token:
                    stop += 1
                work.append((at, stop, end, children))
                at = stop
            opened.append((head[depth:end], children, here, above))
        for edge, children, here, above in reversed(opened):  # children are opened after their parent
            rest = max([0, *(len(c[0]) + c[3] for c in children)])
            least = min([n for _, n in here] + [c[4] for c in children])
            above.append((edge, children, here, rest, least))
        return top[0]

    def links(self, n: int, tokens: np.ndarray) -> list[int]:
        """Ids of the sets that link with a set of full size n and these tokens."""
        mine = np.zeros(len(self.vocabulary), bool)
        at = np.minimum(np.searchsorted(self.vocabulary, tokens), len(self.vocabulary) - 1)
        hit = at[self.vocabulary[at] == tokens]
        mine[hit] = True
        out, stack = [], [(self.root, 0)]
        while stack:
            (edge, children, here, rest, least), overlap = stack.pop()
            if 9 * min(overlap + len(edge) + rest, len(hit)) < 4 * (n + least):
                continue
            overlap += int(np.count_nonzero(mine[edge]))
            if 9 * min(overlap + rest, len(hit)) < 4 * (n + least):
                continue
            out += [i for i, size in here if 9 * overlap >= 4 * (n + size)]
            stack += [(c, overlap) for c in children]
        return out


def block_links(probes: DataFrame, own: DataFrame, ordered: DataFrame, blocks: int) -> DataFrame:
    """Links (a, b) of probes (a, block) with the documents of the block that are in own (id): not all of them, but
    enough to join what the links of the block join."""
    # However many probes a block has, a task holds PROBES of them at once, on average, and the block's sets.
    parts = probes.groupBy("block").agg(F.ceil(F.count("*") / PROBES).cast("int").alias("parts"))
    asked = probes.join(ordered.select(F.col("doc_id").alias("a"), "n", "tokens"), "a").join(parts, "block")
    asked = asked.select("block", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int").alias("part"), F.lit(0).alias("kind"), F.col("a").alias("id"), "n", "tokens")
    held = ordered.select(F.col("doc_id").alias("id"), "n", "tokens").join(own, "id", "left_semi").withColumn("block", exchange.block_of(F.col("id"), blocks)).join(parts, "block")
    held = held.select("block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(1).alias("kind"), "id", "n", "tokens")

    def meet(tab):
        rows = list(zip(*[tab.column(c).to_pylist() for c in ("kind", "id", "n", "tokens")], strict=True))
        if not any(r[0] for r in rows):
            return exchange.as_table([], [pa.int64(), pa.int64()], ["a", "b"])
        trie = Trie([(i, n, np.frombuffer(t, np.uint64)) for kind, i, n, t in rows if kind])
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (y := parent.setdefault(x, x)) != x:
                parent[x] = x = parent[y]
            return x

        out = []
        for kind, i, n, t in rows:
            for j in trie.links(n, np.frombuffer(t, np.uint64)) if not kind else ():
                a, b = root(i), root(j)
                if a != b:
                    parent[max(a, b)] = min(a, b)
                    out.append((i, j))
        return exchange.as_table(out, [pa.int64(), pa.int64()], ["a", "b"])

    return asked.unionByName(held).groupBy("block", "part").applyInArrow(meet, "a long, b long")


def _possible(na, ma, nb, mb):
    return F.lit(9) * F.least(ma, mb) >= F.lit(4) * (na + nb)


def class_links(ordered: DataFrame) -> DataFrame:
    """(node, component) of the classes that link with others."""
    total = ordered.agg(F.sum(F.octet_length("tokens"))).first()[0] or 0
    blocks = exchange.block_count(total, TRIE_BYTES)
    every = stored(ordered.select("doc_id", "n", "m", exchange.block_of(F.col("doc_id"), blocks).alias("block"), F.explode("prefix").alias("token")), "postings")
    # Shingles of one passage mostly have the same documents: of those with equal lists (by 128 bits) one will do, and
    # those with a single document none. A list has no (doc_id, n, m) twice, so nothing cancels in the sums.
    one = F.struct("doc_id", "n", "m")
    lists = every.groupBy("token").agg(F.count("*").alias("df"), F.bit_xor(F.xxhash64(one)).alias("x"), F.bit_xor(F.xxhash64(one, F.lit(1))).alias("y")).where("df > 1")
    posts = stored(every.join(lists.groupBy("df", "x", "y").agg(F.min("token").alias("token")).select("token"), "token"), "postings")
    ends = posts.groupBy("token").agg(F.min(one).alias("low"), F.max(one).alias("high")).where("low.doc_id <> high.doc_id")
    centres = ends.select("token", F.explode(F.array("low", "high")).alias("c")).select("token", F.col("c.doc_id").alias("a"), F.col("c.n").alias("an"), F.col("c.m").alias("am"))
    near = posts.join(centres, "token").where((F.col("doc_id") != F.col("a")) & _possible(F.col("n"), F.col("m"), F.col("an"), F.col("am")))
    near = stored(near.select("a", "block", "doc_id").distinct(), "stars")
    first = stored(block_links(near.select("a", "block").distinct(), near.select(F.col("doc_id").alias("id")).distinct(), ordered, blocks), "links")
    known = stored(components(first), "components")
    # What shingles hold several components yet.
    placed = stored(posts.join(known.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id")), "placed")
    mixed = placed.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("token")
    rest = stored(placed.join(mixed, "token"), "mixed")
    by_block = rest.groupBy("token", "block").agg(F.max("component").alias("high"), F.min("n").alias("least_n"), F.max("m").alias("most_m"))
    across = rest.drop("block").join(by_block, "token").where((F.col("component") < F.col("high")) & _possible(F.col("n"), F.col("m"), F.col("least_n"), F.col("most_m")))
    across = stored(across.select(F.col("doc_id").alias("a"), "block").distinct(), "across")
    if across.isEmpty():
        return known
    more = block_links(across, rest.select(F.col("doc_id").alias("id")).distinct(), ordered, blocks)
    return components(known.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    digests = stored(set_digests(docs), "digests")
    classes = digests.groupBy("n_shingles", "d1", "d2").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_rows")).where("n_shingles > 0")
    classes = stored(classes, "classes")
    rows, total = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    candidates = candidate_sets(docs, classes.where("class_id is not null").select("class_id"), total)
    ordered = ordered_sets(candidates)
    found = class_links(ordered) if not ordered.isEmpty() else None
    if found is None:
        named = classes.withColumn("component", F.col("class_id"))
    else:
        named = classes.join(found.groupBy(F.col("node").alias("class_id")).agg(F.min("component").alias("component")), "class_id", "left").withColumn("component", F.coalesce("component", "class_id"))
    sized = with_class(digests, stored(named.select("n_shingles", "d1", "d2", "class_rows", "component"), "named"), ["n_shingles", "d1", "d2"], rows)
    return sized.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))


def representatives(docs: DataFrame) -> DataFrame:
    """One row of each group of links, with all columns: of its smallest id the row of the least text digest.

    Texts without words stay, once for each id. Rows without an id stay if no row with one has their set, one for each
    set; those without words all do.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    place, digest = fresh(docs, "place"), F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)
    first = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(digest))
    groups = jaccard_components(docs).where("doc_id = component_id").select("doc_id").distinct()
    named = docs.where("doc_id is not null").join(groups, "doc_id", "left_semi")
    # The rank is cut to 1 before the shuffle, so no id gathers its rows in a task.
    out = named.withColumn(place, first("doc_id")).where(F.col(place) == 1).select(*columns)
    bare = docs.where("doc_id is null")
    if bare.isEmpty():
        return out
    n, d1, d2 = (fresh(docs, c) for c in ("n_shingles", "d1", "d2"))

    def run(batch):
        found = _digests(batch.column("text"))
        return pa.RecordBatch.from_arrays([*batch.columns, *found], [*batch.schema.names, n, d1, d2])

    marked = map_slices(bare, "text", run, T.StructType([*docs.schema.fields, *[T.StructField(c, T.LongType()) for c in (n, d1, d2)]]))
    known = set_digests(docs.where("doc_id is not null")).where("n_shingles > 0").toDF("_", n, d1, d2).select(n, d1, d2).distinct()
    once = marked.where(F.col(n) > 0).join(known, [n, d1, d2], "left_anti").withColumn(place, first(n, d1, d2)).where(F.col(place) == 1)
    return out.unionByName(once.select(*columns)).unionByName(marked.where(F.col(n) == 0).select(*columns))


def op5_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))
