"""External induced sorting: suffixes and their common prefixes by priority queues that overflow to disk.

The suffixes of a string of numbers are S (less than the next suffix) or L (greater). The S suffixes that follow
an L suffix are sorted by the substrings between them; equal substrings are named alike and the string of names is
sorted by the same algorithm, recursively. The others are induced: a pass upwards takes suffixes in order and
puts the L suffix before each into a priority queue by its first number; a pass downwards does the same for the
S suffixes. Queue items are tuples (place, common prefix with the item before). A common prefix is one more than
the least of those that lie between the two suffixes from which two neighbours were induced; a stack of minima
over the pass answers that.

Memory holds ``held`` items of a queue, a list or a sort and no more: queues and lists write runs to files, the
substrings are sorted in runs that are merged, and every array with an entry for each number (the string itself,
its kinds, places, names, prefixes) is a mapped file once it is longer than that.
"""

from __future__ import annotations

import heapq
import marshal
import tempfile
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np

#: Items that a queue, a list or a sort holds in memory.
HELD = 1 << 18
_BLOCK = 4096


def numbers(n: int, kind=np.int64, folder: str | None = None, held: int = HELD) -> np.ndarray:
    """An array of n zeros; a mapped file without a name if n is over ``held``."""
    if n <= held:
        return np.zeros(n, dtype=kind)
    with tempfile.TemporaryFile(dir=folder) as f:
        f.truncate(n * np.dtype(kind).itemsize)
        return np.memmap(f, dtype=kind, mode="r+", shape=(n,))


class Grown:
    """An array that is appended to, in memory up to ``held`` entries, then in a file."""

    def __init__(self, kind=np.int64, folder: str | None = None, held: int = HELD):
        self.kind, self.folder, self.held, self.parts, self.n, self.file = np.dtype(kind), folder, held, [], 0, None

    def append(self, part: np.ndarray) -> None:
        self.n += len(part)
        if self.file is None and self.n > self.held:
            self.file = tempfile.TemporaryFile(dir=self.folder)
            for p in self.parts:
                self.file.write(p.tobytes())
            self.parts = []
        if self.file is None:
            self.parts.append(np.asarray(part, dtype=self.kind))
        else:
            self.file.write(np.asarray(part, dtype=self.kind).tobytes())

    def array(self) -> np.ndarray:
        if self.file is None:
            return np.concatenate([np.zeros(0, self.kind), *self.parts])
        self.file.flush()
        return np.memmap(self.file, dtype=self.kind, mode="r+", shape=(self.n,))


class DiskList:
    """Rows of two numbers, appended and read again forwards or backwards, in blocks that go to a file."""

    def __init__(self, folder: str | None = None, held: int = HELD):
        self.folder, self.held, self.rows, self.file, self.blocks = folder, min(held, 1 << 16), [], None, []

    def append(self, row: tuple[int, int]) -> None:
        self.rows.append(row)
        if len(self.rows) >= self.held:
            if self.file is None:
                self.file = tempfile.TemporaryFile(dir=self.folder)
            block = np.array(self.rows, dtype=np.int64).tobytes()
            self.blocks.append((self.file.seek(0, 2), len(block)))
            self.file.write(block)
            self.rows = []

    def _block(self, at: int, size: int) -> list:
        self.file.seek(at)
        return np.frombuffer(self.file.read(size), dtype=np.int64).reshape(-1, 2).tolist()

    def __iter__(self):
        for b in self.blocks:
            yield from self._block(*b)
        yield from self.rows

    def __reversed__(self):
        yield from reversed(self.rows)
        for b in reversed(self.blocks):
            yield from reversed(self._block(*b))


class _Run:
    """Items of a queue in a file, by key, read a block at a time; key is that of the next item."""

    def __init__(self, lists: dict[int, list], taken: tuple[int | None, int], folder: str | None):
        """taken: of one key so many items are gone."""
        self.file, self.rows, self.key = tempfile.TemporaryFile(dir=folder), [], None
        rows = []
        for key in sorted(lists):
            for item in lists[key][taken[1] if key == taken[0] else 0 :]:
                rows.append((key, *item))
                if len(rows) >= _BLOCK:
                    self.file.write(np.array(rows, dtype=np.int64).tobytes())
                    rows = []
        if rows:
            self.file.write(np.array(rows, dtype=np.int64).tobytes())
        self.file.seek(0)
        self._next()

    def _next(self) -> None:
        if not self.rows:
            self.rows = np.frombuffer(self.file.read(24 * _BLOCK), dtype=np.int64).reshape(-1, 3).tolist()[::-1]
        self.key = self.rows[-1][0] if self.rows else None
        if self.key is None:
            self.file.close()

    def take(self) -> tuple[int, int]:
        _, place, prefix = self.rows.pop()
        self._next()
        return place, prefix


class DiskQueue:
    """A priority queue: items come out by key, those of a key in the order they came in.

    Keys are never less than the one taken last. In memory a line for each key and a heap of keys; at ``held``
    items all are written, by key, as a run. Runs are older than what is in memory, the first the oldest.
    """

    def __init__(self, folder: str | None = None, held: int = HELD):
        self.folder, self.held, self.n = folder, held, 0
        self.lines: dict[int, list] = {}
        self.taken: tuple[int | None, int] = (None, 0)
        self.keys: list[int] = []
        self.runs: list[_Run] = []
        self.heads: list[tuple[int, int]] = []  # (key of its next item, run)

    def push(self, key: int, item: tuple[int, int]) -> None:
        line = self.lines.get(key)
        if line is None:
            self.lines[key] = [item]
            heapq.heappush(self.keys, key)
        else:
            line.append(item)
        self.n += 1
        if self.n >= self.held:
            run = _Run(self.lines, self.taken, self.folder)
            if run.key is not None:
                heapq.heappush(self.heads, (run.key, len(self.runs)))
                self.runs.append(run)
            self.lines, self.keys, self.n = {}, [], 0

    def least(self) -> int | None:
        if not self.heads:
            return self.keys[0] if self.keys else None
        return min(self.heads[0][0], self.keys[0]) if self.keys else self.heads[0][0]

    def take(self, key: int):
        """The items of a key, those included that come in meanwhile."""
        while True:
            if self.heads and self.heads[0][0] == key:
                _, k = heapq.heappop(self.heads)
                run = self.runs[k]
                while run.key == key:
                    yield run.take()
                if run.key is not None:
                    heapq.heappush(self.heads, (run.key, k))
                continue
            line = self.lines.get(key)
            if line is None:
                return
            k = 0
            while k < len(line) and self.lines.get(key) is line:
                k += 1
                self.n -= 1
                self.taken = (key, k)
                yield line[k - 1]
                if k >= _BLOCK and self.lines.get(key) is line:
                    del line[:k]
                    k = 0
            self.taken = (None, 0)
            if self.lines.get(key) is line:
                del self.lines[key]
                heapq.heappop(self.keys)
                return


class Minima:
    """The least value after a place, of values that are told one after another."""

    def __init__(self):
        self.at, self.value = [], []

    def tell(self, place: int, value: int) -> None:
        values = self.value
        while values and values[-1] >= value:
            values.pop()
            self.at.pop()
        self.at.append(place)
        values.append(value)

    def after(self, place: int) -> int:
        return self.value[bisect_right(self.at, place)]


def common(text, i: int, j: int) -> int:
    n, k = len(text), 0
    while i + k < n and j + k < n and text[i + k] == text[j + k]:
        k += 1
    return k


def _read(file, n: int) -> Iterator[tuple[bytes, int]]:
    file.seek(0)
    for _ in range(n):
        yield from marshal.load(file)


def in_order(rows: Iterable[tuple[bytes, int]], folder: str | None = None, held: int = HELD) -> Iterator[tuple[bytes, int]]:
    """Rows (key, number) in order: runs of ``held`` rows or eight times as many bytes, sorted, in files, merged."""
    runs, some, size = [], [], 0
    for row in rows:
        some.append(row)
        size += len(row[0])
        if len(some) >= held or size >= 8 * held:
            some.sort()
            file = tempfile.TemporaryFile(dir=folder)
            for at in range(0, len(some), _BLOCK):
                marshal.dump(some[at : at + _BLOCK], file)
            runs.append(_read(file, -(-len(some) // _BLOCK)))
            some, size = [], 0
    some.sort()
    return heapq.merge(*runs, some) if runs else iter(some)


def _kinds(text: np.ndarray, kinds: np.ndarray, step: int = 1 << 18) -> None:
    """1 for S, 0 for L, from the end."""
    n = len(text)
    kinds[n - 1] = 1
    for z in range(n - 1, 0, -step):
        a = max(0, z - step)
        here, after = np.asarray(text[a:z]), np.asarray(text[a + 1 : z + 1])
        decides = np.where(here == after, z, np.arange(a, z))
        decides = np.minimum.accumulate(decides[::-1])[::-1]
        kinds[a:z] = np.r_[here < after, bool(kinds[z])][decides - a]


def sort(text: np.ndarray, folder: str | None = None, held: int = HELD):
    """Yields (place, common prefix with the suffix yielded before) of all suffixes, the greatest first.

    text: 64-bit numbers from 0 up, whose last is 0 and the only 0.
    """
    n = len(text)
    if n == 1:
        yield 0, 0
        return
    kind_of = numbers(n, np.int8, folder, held)
    _kinds(text, kind_of)
    found = Grown(np.int64, folder, held)
    most, step = 0, 1 << 18
    for a in range(0, n, step):
        k = np.asarray(kind_of[max(0, a - 1) : a + step])
        found.append(np.flatnonzero((k[1:] == 1) & (k[:-1] == 0)) + max(1, a))
        most = max(most, int(np.max(text[a : a + step])))
    star_at = found.array()
    m = len(star_at)
    order_of, prefix_of = _ordered(text, kind_of, star_at, folder, held)
    text, kinds, stars, order, prefixes = map(memoryview, (text, kind_of, star_at, order_of, prefix_of))

    # upwards: L suffixes
    up, large, minima, time = DiskQueue(folder, held), DiskList(folder, held), Minima(), 0
    last_of = numbers(most + 1, np.int64, folder, held)
    pushed = memoryview(last_of)  # one more than the time of the last push of a number
    star = 0
    while True:
        key = up.least()
        head = text[stars[order[star]]] if star < m else None
        if key is None and head is None:
            break
        c = key if head is None or (key is not None and key <= head) else head
        last = None
        if key == c:
            for i, lcp in up.take(c):
                minima.tell(time, lcp)
                large.append((i, lcp))
                last = i
                if i and not kinds[i - 1]:
                    d = text[i - 1]
                    before = pushed[d]
                    up.push(d, (i - 1, 1 + minima.after(before - 1) if before else 0))
                    pushed[d] = time + 1
                time += 1
        first = True
        while star < m and text[stars[order[star]]] == c:
            i = stars[order[star]]
            lcp = prefixes[star] if not first else 0 if last is None else common(text, last, i)
            minima.tell(time, lcp)
            first = False
            if i and not kinds[i - 1]:
                d = text[i - 1]
                before = pushed[d]
                up.push(d, (i - 1, 1 + minima.after(before - 1) if before else 0))
                pushed[d] = time + 1
            time += 1
            star += 1

    # downwards: S suffixes; a large suffix's common prefix is with the one below it
    down, minima, time = DiskQueue(folder, held), Minima(), 0
    last_of[:] = 0
    larges = reversed(large)
    nxt = next(larges, None)
    while True:
        key = down.least()
        head = None if nxt is None else -text[nxt[0]]
        if key is None and head is None:
            break
        c = key if head is None or (key is not None and key <= head) else head
        last = None
        if key == c:
            for i, lcp in down.take(c):
                minima.tell(time, lcp)
                yield i, lcp
                last = i
                if i and kinds[i - 1]:
                    d = text[i - 1]
                    before = pushed[d]
                    down.push(-d, (i - 1, 1 + minima.after(before - 1) if before else 0))
                    pushed[d] = time + 1
                time += 1
        above = None
        while nxt is not None and -text[nxt[0]] == c:
            i = nxt[0]
            lcp = above if above is not None else 0 if last is None else common(text, last, i)
            minima.tell(time, lcp)
            yield i, lcp
            above = nxt[1]
            if i and kinds[i - 1]:
                d = text[i - 1]
                before = pushed[d]
                down.push(-d, (i - 1, 1 + minima.after(before - 1) if before else 0))
                pushed[d] = time + 1
            time += 1
            nxt = next(larges, None)
    yield n - 1, 0


def _substrings(text: np.ndarray, kinds: np.ndarray, stars: np.ndarray, step: int = 1 << 15) -> Iterator[tuple[bytes, int]]:
    """The substring from each star to the next, as bytes that compare as its numbers and kinds do."""
    m, n = len(stars), len(text)
    for k in range(0, m, step):
        places = np.asarray(stars[k : k + step + 1]).tolist()
        ends = [p + 1 for p in places[1:]] if k + step < m else [*(p + 1 for p in places[1:]), n]
        a, z = places[0], ends[-1]
        some = (2 * np.asarray(text[a:z]) + np.asarray(kinds[a:z])).astype(">i8").tobytes()
        for j, (i, end) in enumerate(zip(places[: len(ends)], ends, strict=True)):
            yield some[8 * (i - a) : 8 * (end - a)], k + j


def _ordered(text: np.ndarray, kinds: np.ndarray, stars: np.ndarray, folder: str | None, held: int) -> tuple[np.ndarray, np.ndarray]:
    """(the stars in order of their suffixes, common prefix of each with the one before)."""
    m, n = len(stars), len(text)
    names, order, prefixes = (numbers(m, np.int64, folder, held) for _ in range(3))
    name, last, named, by = -1, None, memoryview(names), memoryview(order)
    for r, (key, k) in enumerate(in_order(_substrings(text, kinds, stars), folder, held)):
        if key != last:
            name, last = name + 1, key
        named[k], by[r] = name, k
    view, places, out = memoryview(text), memoryview(stars), memoryview(prefixes)
    if name + 1 == m:
        for r in range(1, m):
            out[r] = common(view, places[by[r - 1]], places[by[r]])
        return order, prefixes
    r, above = m - 1, 0
    for k, with_above in sort(names, folder, held):  # the greatest first
        if r < m - 1:
            i, j = places[k], places[above]
            ahead = (places[k + with_above] if k + with_above < m else n) - i
            out[r + 1] = ahead + common(view, i + ahead, j + ahead)
        by[r], above, r = k, k, r - 1
    return order, prefixes
