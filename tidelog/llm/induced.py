"""Suffix sorting with common-prefix values by external induced sorting.

The suffixes of a text are L (greater than the next one) or S; the leftmost of each run of S are the seeds. Induction
scans suffixes in order and puts each one's predecessor at the end of its first symbol's bucket: once upward, which
sorts the L suffixes from the seeds, and once downward, which sorts the S suffixes from the L ones. The two passes
over seeds in any order sort the substrings between seeds; naming these gives a shorter text, whose suffixes are
sorted by recursion (in memory once it is short), and the passes over the seeds in that order sort everything.

A pass takes its suffixes from a priority queue keyed by (first symbol, rank of the inducing suffix). Ranks only
grow, so the queue is a heap of symbols with a first-in-first-out spool each, which goes to disk beyond a memory
budget; of large alphabets (names) only the symbols of the range that the scan is in have spools of their own. Tuples
carry the common prefix with the tuple before: one more than the least value among the inducing suffixes passed since.
Values are cut at a depth; deeper suffixes may come in any order.

Whatever has the size of the text, its seeds or names (the text itself, marks, sizes, orders, values) is read and
written in steps, and lies in a map of a temporary file of the task if it is large for the memory. These are a task's
own scratch, up to about thirty bytes for each of the text, and end with it.
"""

from __future__ import annotations

import heapq
import tempfile
from collections.abc import Callable, Iterator

import numpy as np

#: Tuples that are induced from at once; their range-minimum table has sixteen levels.
STEP = 1 << 16
MEMORY = 128 << 20
#: Ranges of symbols of a large alphabet.
RANGES = 4096
_ENTRY = np.dtype([("at", np.int64), ("lcp", np.uint8)])


def on_disk(n: int, dtype, memory: int) -> np.ndarray:
    """n zeros, in a map of a temporary file if they are large for the memory."""
    if n * np.dtype(dtype).itemsize <= memory // 8:
        return np.zeros(n, dtype)
    with tempfile.TemporaryFile() as file:
        return np.memmap(file, dtype, "w+", shape=(n,))


class Column:
    """An array that grows at its end, on disk once it is large for the memory."""

    def __init__(self, dtype, memory: int):
        self.dtype, self.limit = np.dtype(dtype), memory // 8
        self.held: list[np.ndarray] = []
        self.size = self.bytes = 0
        self.file = None

    def add(self, part: np.ndarray) -> None:
        self.held.append(part)
        self.size += len(part)
        self.bytes += part.nbytes
        if self.bytes > self.limit:
            if self.file is None:
                self.file = tempfile.TemporaryFile()
            for x in self.held:
                self.file.write(x.astype(self.dtype, copy=False).tobytes())
            self.held, self.bytes = [], 0

    def array(self) -> np.ndarray:
        if self.file is None:
            return np.concatenate(self.held).astype(self.dtype, copy=False) if self.held else np.zeros(0, self.dtype)
        self.limit = -1
        self.add(np.zeros(0, self.dtype))
        self.file.flush()
        return np.memmap(self.file, self.dtype, "r+", shape=(self.size,))


class _Spill:
    """The file that the spools of a queue share."""

    def __init__(self):
        self.file, self.end = None, 0

    def write(self, at: np.ndarray, lcp: np.ndarray) -> int:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        rows = np.empty(len(at), _ENTRY)
        rows["at"], rows["lcp"] = at, lcp
        begin = self.end
        self.file.seek(begin)
        self.file.write(rows.tobytes())
        self.end += rows.nbytes
        return begin

    def read(self, begin: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        self.file.seek(begin)
        rows = np.frombuffer(self.file.read(n * _ENTRY.itemsize), _ENTRY)
        return rows["at"].copy(), rows["lcp"].copy()


class Spool:
    """A first-in-first-out list of (position, common prefix) that can move to disk."""

    def __init__(self, spill: _Spill):
        self.spill_file = spill
        self.stored: list[tuple[int, int]] = []  # where in the file, and how many
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.holds = 0

    def add(self, at: np.ndarray, lcp: np.ndarray) -> None:
        self.held.append((at, lcp))
        self.holds += len(at)

    def _gathered(self) -> tuple[np.ndarray, np.ndarray]:
        return self.held[0] if len(self.held) == 1 else (np.concatenate([h[0] for h in self.held]), np.concatenate([h[1] for h in self.held]))

    def spill(self) -> None:
        """Moves the held tuples behind those on disk."""
        if self.held:
            at, lcp = self._gathered()
            self.stored.append((self.spill_file.write(at, lcp), len(at)))
            self.held, self.holds = [], 0

    def chunks(self, backward: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All tuples in order, STEP at once; or the same pieces from the last to the first."""
        pieces = [(begin + k * _ENTRY.itemsize, min(STEP, n - k)) for begin, n in self.stored for k in range(0, n, STEP)]
        if not backward:
            for begin, n in pieces:
                yield self.spill_file.read(begin, n)
        if self.held:
            at, lcp = self._gathered()
            cuts = range(0, len(at), STEP)
            for k in reversed(cuts) if backward else cuts:
                yield at[k : k + STEP], lcp[k : k + STEP]
        if backward:
            for begin, n in reversed(pieces):
                yield self.spill_file.read(begin, n)


class SymbolQueue:
    """A priority queue of tuples by symbol, upward or downward; equal symbols leave in order of arrival."""

    def __init__(self, text: np.ndarray, symbols: int, descending: bool, memory: int = MEMORY):
        self.text, self.top = text, symbols - 1 if descending else None
        self.single = symbols <= RANGES
        self.width = symbols if self.single else -(-symbols // RANGES)
        self.range = 0  # the range of the symbols that have spools of their own
        self.near: dict[int, Spool] = {}
        self.far: dict[int, Spool] = {}
        self.near_heap: list[int] = []
        self.far_heap: list[int] = []
        self.file, self.limit, self.held = _Spill(), max(1, memory // 24), 0

    def _order(self, symbols):
        """Symbols as numbers that ascend in the order of leaving."""
        return symbols if self.top is None else self.top - symbols

    def _add(self, spools: dict[int, Spool], heap: list[int], keys: np.ndarray, at: np.ndarray, lcp: np.ndarray) -> None:
        if not len(keys):
            return
        order = np.argsort(keys, kind="stable")
        keys, at, lcp = keys[order], at[order], lcp[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])).tolist()
        for a, b in zip(first, [*first[1:], len(at)], strict=True):
            key = int(keys[a])
            if key not in spools:
                spools[key] = Spool(self.file)
                heapq.heappush(heap, key)
            spools[key].add(at[a:b], lcp[a:b])

    def push(self, symbols: np.ndarray, at: np.ndarray, lcp: np.ndarray) -> None:
        keys = self._order(symbols.astype(np.int64))
        if self.single:
            self._add(self.near, self.near_heap, keys, at, lcp)
        else:
            ranges = keys // self.width
            here = ranges == self.range
            self._add(self.near, self.near_heap, keys[here], at[here], lcp[here])
            self._add(self.far, self.far_heap, ranges[~here], at[~here], lcp[~here])
        self.held += len(at)
        if self.held > self.limit:
            for spools in (self.near, self.far):
                for spool in spools.values():
                    spool.spill()
            self.held = 0

    def next(self, waiting: int | None) -> int | None:
        """The first symbol to leave: of the queue, or the waiting one if that comes before."""
        limit = None if waiting is None else int(self._order(waiting))
        while not self.near_heap and self.far_heap and (limit is None or self.far_heap[0] * self.width <= limit):
            self.range = heapq.heappop(self.far_heap)
            for at, lcp in self.far.pop(self.range).chunks():
                self._add(self.near, self.near_heap, self._order(self.text[at].astype(np.int64)), at, lcp)
        if self.near_heap and (limit is None or self.near_heap[0] <= limit):
            return int(self._order(self.near_heap[0]))
        return waiting

    def take(self, symbol: int) -> Spool | None:
        """What has come for the symbol so far; it may come again."""
        key = int(self._order(symbol))
        spool = self.near.pop(key, None)
        if spool is not None:
            if heapq.heappop(self.near_heap) != key:
                raise RuntimeError("symbols leave in order")
            self.held -= min(self.held, spool.holds)
        return spool


class _Minima:
    """Common prefixes of induced tuples, from those of the inducing ones in order."""

    def __init__(self, symbols: int, depth: int, memory: int):
        self.since = on_disk(symbols, np.uint8, memory)  # the least value since the symbol's last tuple
        self.seen = on_disk(symbols, np.bool_, memory)
        self.depth = depth

    def induced(self, lcp: np.ndarray, source: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """For sources (ascending indexes into lcp) and the symbols that they put suffixes to."""
        n = len(lcp)
        low = int(lcp.min())
        if not len(source):
            np.minimum(self.since, low, out=self.since)
            return np.zeros(0, np.uint8)
        levels = [lcp]
        while 2 << (len(levels) - 1) <= n:
            half, top = 1 << (len(levels) - 1), levels[-1]
            levels.append(np.minimum(top[:-half], top[half:]))
        table = np.zeros((len(levels), n), np.uint8)
        for k, level in enumerate(levels):
            table[k, : len(level)] = level

        def least(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            """Over lcp[a:b]; the depth where that is empty."""
            size = b - a
            k = np.maximum(np.frexp(np.maximum(size, 1).astype(np.float64))[1] - 1, 0)
            left = np.minimum(a, n - 1)
            found = np.minimum(table[k, left], table[k, np.maximum(b - (1 << k), 0)])
            return np.where(size > 0, found, self.depth)

        order = np.argsort(symbols, kind="stable")
        s, k = symbols[order].astype(np.int64), source[order]
        new = np.concatenate([[True], s[1:] != s[:-1]])
        start = np.where(new, 0, np.concatenate([[0], k[:-1] + 1]))
        value = least(start, k + 1)
        value = np.where(new, np.minimum(value, self.since[s]), value)
        value = np.where(new & ~self.seen[s], 0, np.minimum(value.astype(np.int64) + 1, self.depth))
        last = np.flatnonzero(np.append(new[1:], True))
        kept = least(k[last] + 1, np.full(len(last), n))
        np.minimum(self.since, low, out=self.since)
        self.since[s[last]] = kept
        self.seen[s[last]] = True
        out = np.empty(len(source), np.uint8)
        out[order] = value
        return out


def _common(text: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """The common prefix, cut at the depth, of suffixes a and b; the text ends in a symbol that occurs once."""
    out = np.zeros(len(a), np.uint8)
    live = np.arange(len(a))
    n = len(text) - 1
    k = 0
    if text.dtype == np.uint8:  # eight symbols at once; the end symbol stops a pair before the end of the loads
        loads = np.ndarray((max(0, n - 6),), "<u8", np.ascontiguousarray(text), 0, (1,))
        while k < depth and len(live):
            x, y = a[live] + k, b[live] + k
            inside = np.maximum(x, y) < len(loads)
            if not inside.all():
                break
            differ = loads[x] ^ loads[y]
            equal = differ == 0
            part = differ[~equal]
            low = part & (~part + np.uint64(1))  # its lowest bit tells the first symbol that differs
            out[live[~equal]] += (np.log2(low.astype(np.float64)).astype(np.uint8)) // 8
            live = live[equal]
            out[live] += 8
            k += 8
    while k < depth and len(live):
        x, y = a[live] + k, b[live] + k
        live = live[(x <= n) & (y <= n) & (text[np.minimum(x, n)] == text[np.minimum(y, n)])]
        out[live] += 1
        k += 1
    return np.minimum(out, depth).astype(np.uint8)


def _steps(n: int) -> Iterator[tuple[int, int]]:
    for k in range(0, n, STEP):
        yield k, min(n, k + STEP)


def _seeds(text: np.ndarray, memory: int) -> np.ndarray:
    """Positions of S suffixes with an L one before, ascending; the end symbol is the last of them."""
    n = len(text)
    out = on_disk(n // 2 + 1, np.int64, memory)
    end = len(out) - 1
    out[end] = n - 1
    after = False  # whether the suffix behind the step is S; the end is a seed by itself
    for a, b in reversed(list(_steps(n - 1))):
        part = np.array(text[a : b + 1])
        differ = part[:-1] != part[1:]
        # A suffix is S if the next symbol that differs is greater: runs of equal symbols are of one kind.
        place = np.where(differ, np.arange(b - a), b - a)
        place = np.minimum.accumulate(place[::-1])[::-1]
        rising = np.append(part[:-1] < part[1:], after)
        small = np.append(rising[place], after)
        found = np.flatnonzero(small[1:] & ~small[:-1]) + a + 1
        out[end - len(found) : end] = found
        end -= len(found)
        after = bool(small[0])
    return out[end:]


def _by_head(text: np.ndarray, seeds: np.ndarray, symbols: int, memory: int) -> np.ndarray:
    """The seeds by their first symbol, equal ones by position."""
    room = on_disk(symbols + 1, np.int64, memory)
    for a, b in _steps(len(seeds)):
        heads, counts = np.unique(text[seeds[a:b]], return_counts=True)
        room[heads.astype(np.int64) + 1] += counts
    total = 0
    for a, b in _steps(len(room)):
        part = np.cumsum(room[a:b]) + total
        room[a:b], total = part, int(part[-1])
    out = on_disk(len(seeds), np.int64, memory)
    for a, b in _steps(len(seeds)):
        at = np.array(seeds[a:b])
        heads = text[at].astype(np.int64)
        order = np.argsort(heads, kind="stable")
        at, heads = at[order], heads[order]
        first = np.flatnonzero(np.concatenate([[True], heads[1:] != heads[:-1]]))
        counts = np.diff(np.append(first, len(heads)))
        out[np.repeat(room[heads[first]] - first, counts) + np.arange(len(heads))] = at
        room[heads[first]] += counts
    return out


def _passes(text: np.ndarray, symbols: int, seeds: np.ndarray, lcps: np.ndarray | None, depth: int, memory: int, emit: Callable[[np.ndarray, np.ndarray, bool], None]) -> None:
    """Both inductions from seeds in order; emits all suffixes but the end, downward, as (positions, common prefix
    with the one before, whether they are S)."""

    def induce(queue, minima, at, lcp, keep) -> None:
        before = at - 1
        sym = text[np.maximum(before, 0)]
        source = np.flatnonzero((before >= 0) & keep(sym))
        chosen = sym[source]
        got = minima.induced(lcp, source, chosen) if minima else np.zeros(len(source), np.uint8)
        if len(source):
            queue.push(chosen, before[source], got)

    def minima():
        return None if lcps is None else _Minima(symbols, depth, memory)

    queue, least = SymbolQueue(text, symbols, False, memory), minima()
    lefts = Spool(_Spill())
    ptr, k = 0, len(seeds)
    while True:
        waiting = int(text[seeds[ptr]]) if ptr < k else None
        c = queue.next(waiting)
        if c is None:
            break
        last = None
        while (spool := queue.take(c)) is not None:
            for at, lcp in spool.chunks():
                lefts.add(at, lcp)
                last = at[-1:]
                induce(queue, least, at, lcp, lambda sym: sym >= c)  # noqa: B023
            if lefts.holds > memory // 24:
                lefts.spill()
        begun = False
        while waiting == c and ptr < k:
            at = np.array(seeds[ptr : ptr + STEP])
            other = np.flatnonzero(text[at] != c)
            n = int(other[0]) if len(other) else len(at)
            if not n:
                break
            at, lcp = at[:n], np.zeros(n, np.uint8) if lcps is None else np.array(lcps[ptr : ptr + n])
            if not begun:
                lcp[0] = _common(text, last, at[:1], depth)[0] if least and last is not None else 0
            induce(queue, least, at, lcp, lambda sym: sym > c)  # noqa: B023
            ptr, begun = ptr + n, True
            if len(other):
                break

    queue, least = SymbolQueue(text, symbols, True, memory), minima()
    pieces = lefts.chunks(backward=True)
    held = next(pieces, None)
    held = (held[0][::-1], held[1][::-1]) if held else None  # from the greatest on
    while True:
        waiting = int(text[held[0][0]]) if held else None
        c = queue.next(waiting)
        if c is None:
            break
        last = None
        while (spool := queue.take(c)) is not None:
            for at, lcp in spool.chunks():
                emit(at, lcp, True)
                last = at[-1:]
                induce(queue, least, at, lcp, lambda sym: sym <= c)  # noqa: B023
        over = None  # the value of the tuple that came before, in reading backward
        while waiting == c and held:
            other = np.flatnonzero(text[held[0]] != c)
            n = int(other[0]) if len(other) else len(held[0])
            if not n:
                break
            at, lcp = held[0][:n], held[1][:n]
            if over is None:
                over = _common(text, last, at[:1], depth)[0] if least and last is not None else np.uint8(0)
            shifted = np.concatenate([[over], lcp[:-1]]).astype(np.uint8)
            over = lcp[-1]
            emit(at, shifted, False)
            induce(queue, least, at, shifted, lambda sym: sym < c)  # noqa: B023
            if len(other):
                held = held[0][n:], held[1][n:]
                break
            held = next(pieces, None)
            held = (held[0][::-1], held[1][::-1]) if held else None


def _ranks(names: np.ndarray, depth: int, step: int, memory: int) -> np.ndarray:
    """The suffixes of a text of names (the last is unique and least), ascending, as far as the depth; each name
    stands for `step` symbols at least."""
    n = len(names)
    if n > max(4, memory // 40):  # in memory these are five arrays of numbers
        order = on_disk(n, np.int64, memory)
        order[0], end = n - 1, n

        def fill(at: np.ndarray, _: np.ndarray) -> None:
            nonlocal end
            order[end - len(at) : end] = at[::-1]
            end -= len(at)

        suffix_sort(names, max(1, -(-depth // step)) + 1, fill, memory)
        return order
    rank, width = names.astype(np.int64), 1
    while True:
        after = np.zeros(n, np.int64)
        after[:-width] = rank[width:] + 1 if width < n else 0
        key = rank * (n + 2) + after
        order = np.argsort(key, kind="stable")
        key = key[order]
        ranked = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))
        width *= 2
        if ranked[-1] == n - 1 or width * step >= depth or width >= n:
            return order
        rank = np.empty(n, np.int64)
        rank[order] = ranked


def _named(text: np.ndarray, order: np.ndarray, seeds: np.ndarray, depth: int, memory: int) -> tuple[np.ndarray | None, int]:
    """The names of the seeds' substrings (each up to and with the next seed) in order of position, None if all
    differ; and the length of the shortest one, less one."""
    k, n = len(seeds), len(text)
    size = on_disk(n, np.int32, memory)
    least = n
    for a, b in _steps(k - 1):
        part = np.diff(seeds[a : b + 1]) + 1
        size[seeds[a:b]] = np.minimum(part, 2**31 - 1)
        least = min(least, int(part.min()))
    size[n - 1] = 1
    name = on_disk(n, np.int64, memory)
    number, before = 0, None
    for a, b in _steps(k):
        at = np.array(order[a:b])
        prior = np.concatenate([at[:1] if before is None else [before], at[:-1]])
        same = size[at] == size[prior]
        if before is None:
            same[0] = True  # the first name is 0
        live, j = np.flatnonzero(same), 0
        while len(live) and j < depth:
            live = live[size[at[live]] > j]
            differ = text[prior[live] + j] != text[at[live] + j]
            same[live[differ]] = False
            live = live[~differ]
            j += 1
        found = number + np.cumsum(~same)
        name[at] = found
        number, before = int(found[-1]), int(at[-1])
    if number == k - 1:
        return None, least - 1
    names = on_disk(k, np.int64, memory)
    for a, b in _steps(k):
        names[a:b] = name[seeds[a:b]]
    return names, least - 1


def suffix_sort(text: np.ndarray, depth: int, emit: Callable[[np.ndarray, np.ndarray], None], memory: int = MEMORY) -> None:
    """Emits the suffixes of text[:-1] in descending order, with each one's common prefix with the one before.

    The text is an array of integers (a map of a file as well) whose last, 0, occurs once. Values are cut at `depth`
    (at most 254); suffixes that agree so far may come in any order.
    """
    n = len(text)
    if n < 2:
        return
    symbols = max(int(text[a:b].max()) for a, b in _steps(n)) + 1
    seeds = _seeds(text, memory)
    k = len(seeds)
    order, lcps = seeds, np.zeros(1, np.uint8)
    if k > 1:
        is_seed = on_disk(n, np.bool_, memory)
        for a, b in _steps(k):
            is_seed[seeds[a:b]] = True
        order = on_disk(k, np.int64, memory)
        order[0], end = n - 1, k

        def collect(at: np.ndarray, _: np.ndarray, small: bool) -> None:
            nonlocal end
            if small:
                at = at[is_seed[at]]
                order[end - len(at) : end] = at[::-1]
                end -= len(at)

        _passes(text, symbols, _by_head(text, seeds, symbols, memory), None, depth, memory, collect)
        names, least = _named(text, order, seeds, depth, memory)
        if names is not None:
            ranked = _ranks(names, depth, max(1, least), memory)
            for a, b in _steps(k):
                order[a:b] = seeds[ranked[a:b]]
            del names, ranked
        lcps = on_disk(k, np.uint8, memory)
        for a, b in _steps(k - 1):
            lcps[a + 1 : b + 1] = _common(text, order[a:b], order[a + 1 : b + 1], depth)
    _passes(text, symbols, order, lcps, depth, memory, lambda at, lcp, small: emit(at, lcp))
