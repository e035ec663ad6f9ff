"""Exact removal of repeated passages of ``width`` bytes by external induced suffix sorting.

1. Anchors (see anchors.py) split the windows of SHORT bytes of every text into runs; equal windows have equal
   anchors, and so have equal windows of WIDTH bytes, by the SHORT bytes that they start with.
2. Anchors are counted. Those that occur once are done: their windows occur nowhere else.
3. The string of a run is what its windows of WIDTH bytes cover. Strings are counted by digest: a string that
   occurs twice repeats all its windows. Counting comes before anything is gathered, so thousands of copies are
   a row a task.
4. An anchor with more than HOT strings that differ (the edge of a passage in very many texts) is split: its runs
   are cut into stretches of 16 windows, which are dealt by the bytes that all windows of a stretch have in common;
   where that is not enough, into single windows, which need no sorting.
5. Strings that differ but share an anchor are dealt out by it. A task writes its shard to a file, cuts it into
   phrases after four-byte sequences that a digest chooses, names phrases in order, and induced.py sorts the
   suffixes of the names with their common prefixes. A window from s is then looked up at the first cut b from
   s + 4 on: it is repeated if another suffix has ``width - (b - s)`` bytes in common and the same ``b - s`` bytes
   before it. A window without a cut (text of a short period) is known by its digest.
6. Repeated windows return to their texts, whose covered bytes go.

Every array of a shard with an entry for each byte, phrase or cut is a mapped file once it is longer than HELD; a
task holds some arrays and queues of HELD entries, whatever the shard's size.

Texts are the same document if id and text are equal; such rows count as occurrences of one another.
"""

from __future__ import annotations

import hashlib
import math
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import induced
from .anchors import GRAM, SHORT, WIDTH, anchors, digests
from .common import arrow_function, col, utf8, written
from .induced import HELD, Grown, numbers

#: Bytes of strings of a shard, about.
SHARD = 4_000_000
#: Different strings of one anchor that are sorted together.
HOT = 4000
#: A repeated passage is reported, whatever its bytes, if it has more words than this.
PASSAGE_WORDS = 50
CUT_EVERY = 40
_WIDTHS = (SHORT, WIDTH)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_STEP = 1 << 18


def _signed(x: list[int]) -> pa.Array:
    return pa.array(np.array(x, dtype=np.uint64).view(np.int64))


def _structs(ends: list[int], h: pa.Array, c: list[int], lo: np.ndarray, hi: np.ndarray) -> pa.Array:
    columns = [h, _signed(c), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, names=["h", "c", "lo", "hi"]))


@arrow_function("array<struct<h:long,c:long,lo:int,hi:int>>")
def _runs(texts: pa.Array) -> pa.Array:
    """The runs of each text: digests of anchor and string, first and last window."""
    ends, parts, contents = [0], [], []
    digest = xxhash.xxh3_64_intdigest
    for text in utf8(texts):
        h, lo, hi = anchors(text or b"")
        parts.append((h.view(np.int64), lo, hi))
        contents += [digest(text[a:b]) for a, b in zip(lo.tolist(), (hi + WIDTH).tolist(), strict=True)]
        ends.append(len(contents))
    h, lo, hi = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else [np.zeros(0, np.int64)] * 3
    return _structs(ends, pa.array(h), contents, lo, hi)


_STRINGS = "h long, c long, n long, last int, string binary"
_PIECES = "h long, c long, n long, first int, h2 long, c2 long, last int, string binary"


def _strings(batches):
    """The strings of the places of texts, a row each with its last window, in small batches."""
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            part = batch.slice(at, 200)
            rows = []
            for text, places in zip(utf8(part.column(0)), part.column(1).to_pylist(), strict=True):
                rows += [(r["h"], r["c"], r["n"], r["hi"] - r["lo"], text[r["lo"] : r["hi"] + WIDTH]) for r in places]
            yield _batch(rows, _STRINGS)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(x.split() for x in schema.split(", ")), strict=True)
    of = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.record_batch([pa.array([r[i] for r in rows], of[k]) for i, k in enumerate(kinds)], names=list(names))


def _cut(size: int):
    """A function of batches of strings: the windows of each in stretches of ``size``, from ``first`` to first + last.

    A stretch has its windows at fixed distances from the anchor; h2 is of the bytes that all of them cover, c2 of
    the stretch's string.
    """

    def cut(batches):
        digest = lambda *x: int(np.uint64(xxhash.xxh3_64_intdigest(*x)).view(np.int64))
        for batch in batches:
            rows = []
            for h, c, n, z, string in zip(*(batch.column(k).to_pylist() for k in ("h", "c", "n", "last", "string")), strict=True):
                place, first = z, 0  # of a single window nothing but its bytes counts
                if size > 1:
                    place = int(np.flatnonzero(digests(np.frombuffer(string, np.uint8, z + SHORT), GRAM).view(np.int64) == h)[0])
                while first <= z:
                    end = place - (place - first) // size * size
                    last = min(end, z)
                    piece = string[first : last + WIDTH]
                    rows.append((h, c, n, first, digest(string[end : end - size + 1 + SHORT], (place - end) * (size > 1)), digest(piece), last - first, piece))
                    first = end + 1
                if len(rows) > 2000:
                    yield _batch(rows, _PIECES)
                    rows = []
            yield _batch(rows, _PIECES)

    return cut


def phrases(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Places of cuts: after four bytes of one string whose digest is a multiple of CUT_EVERY."""
    if len(data) < 4:
        return np.zeros(0, np.int64)
    four = data[:-3].astype(np.uint32) | data[1:-2].astype(np.uint32) << 8 | data[2:-1].astype(np.uint32) << 16 | data[3:].astype(np.uint32) << 24
    mixed = (four * np.uint32(0x9E3779B1)) ^ (four >> np.uint32(15))
    mixed = (mixed * np.uint32(0x85EBCA77)) >> np.uint32(8)
    cut = np.flatnonzero(mixed % CUT_EVERY == 0) + 4
    begins = starts[np.searchsorted(starts, cut - 1, side="right") - 1]
    return cut[cut - 4 >= begins]


class Shard:
    """Strings joined, as bytes that may be a mapped file, and what their sorted suffixes tell of their windows."""

    def __init__(self, data: np.ndarray, sizes: np.ndarray, lasts: np.ndarray | None = None, folder: str | None = None, held: int = HELD):
        """lasts: the last window of each string that counts; those behind it belong to another string of the text."""
        self.data, self.folder, self.held = data, folder, held
        self.ends = np.cumsum(sizes, dtype=np.int64)
        self.starts = self.ends - sizes
        self.lasts = self.starts + (sizes if lasts is None else lasts)

    def _numbers(self, n: int, kind=np.int64) -> np.ndarray:
        return numbers(n, kind, self.folder, self.held)

    def _chunks(self, n: int) -> Iterator[tuple[int, int]]:
        step = min(_STEP, self.held)
        return ((a, min(a + step, n)) for a in range(0, n, step))

    def _slabs(self) -> Iterator[tuple[int, int]]:
        """Strings from i to j - 1 that have some megabytes together."""
        i, most = 0, len(self.ends)
        while i < most:
            j = max(i + 1, int(np.searchsorted(self.ends, self.starts[i] + 4 * min(_STEP, self.held), side="right")))
            yield i, j
            i = j

    def _words(self) -> Iterator[tuple[bytes, int]]:
        """Each phrase with its number; ``edge`` and ``owner`` of phrases and ``cut`` and ``cut_phrase`` grow along."""
        grown = lambda: Grown(np.int64, self.folder, self.held)
        edges, owners, cuts, cut_phrases, n = grown(), grown(), grown(), grown(), 0
        for i, j in self._slabs():
            at, z = int(self.starts[i]), int(self.ends[j - 1])
            data, starts, ends = np.asarray(self.data[at:z]), self.starts[i:j] - at, self.ends[i:j] - at
            cut = phrases(data, starts)
            owner = np.searchsorted(starts, cut - 1, side="right") - 1
            cut = cut[cut < ends[owner]]  # at its string's end a cut tells nothing
            edge = np.union1d(starts[ends > starts], cut)
            owner = np.searchsorted(starts, edge, side="right") - 1
            stop = np.minimum(np.r_[edge[1:], len(data)], ends[owner])
            whole = data.tobytes()
            for k, (a, b) in enumerate(zip(edge.tolist(), stop.tolist(), strict=True)):
                yield whole[a:b], n + k
            edges.append(edge + at)
            owners.append(owner + i)
            cuts.append(cut + at)
            cut_phrases.append(np.searchsorted(edge, cut) + n)
            n += len(edge)
        self.edge, self.owner, self.cut, self.cut_phrase = (x.array() for x in (edges, owners, cuts, cut_phrases))

    def order(self) -> None:
        """Sorts the suffixes: ``rank`` of each cut and ``lcp`` in bytes, to a WIDTH at most, of neighbours."""
        words = induced.in_order(self._words(), self.folder, self.held)
        first = next(words, None)
        n, m = len(self.edge), len(self.ends)
        total = n + m + 1
        # the string of names: phrases from 2 up, 1 after each string, 0 at the end
        text = self._numbers(total)
        text[:-1] = 1
        offset = self._numbers(total)
        at, place = 0, memoryview(self._numbers(n))
        for a, z in self._chunks(n):
            np.asarray(place)[a:z] = np.arange(a, z) + self.owner[a:z]
        view, name, last = memoryview(text), 1, None
        while first is not None:
            word, at = first
            if word != last:
                name, last = name + 1, word
            view[place[at]] = name
            first = next(words, None)
        for a, z in self._chunks(m):  # the place after a string: where the next one starts
            offset[np.searchsorted(self.owner, np.arange(a, z), side="right") + np.arange(a, z)] = self.ends[a:z]
        for a, z in self._chunks(n):
            offset[np.asarray(place)[a:z]] = self.edge[a:z]
        offset[total - 1] = len(self.data)

        rank, same = self._numbers(total), self._numbers(total)
        order, r = memoryview(rank), 0
        prefix = memoryview(same)
        for i, lcp in induced.sort(text, self.folder, self.held):
            order[r], prefix[r], r = i, lcp, r + 1
        self.lcp = self._numbers(total, np.int32)
        for a, z in self._chunks(total):
            self.lcp[a:z] = self._bytes(np.asarray(rank[a:z]), np.asarray(rank[max(0, a - 1) : z - 1]), np.asarray(same[a:z]), offset, total)
        found = same  # no longer needed: the rank of each suffix
        for a, z in self._chunks(total):
            found[np.asarray(rank[a:z])] = np.arange(a, z)
        for a, z in self._chunks(len(self.cut)):
            self.cut_phrase[a:z] = found[np.asarray(place)[self.cut_phrase[a:z]]]
        self.rank = self.cut_phrase

    def _bytes(self, a: np.ndarray, b: np.ndarray, m: np.ndarray, offset: np.ndarray, total: int) -> np.ndarray:
        """Bytes in common of suffixes a and b, m names of which are alike: those of names, then of the two that differ."""
        head = len(a) - len(b)  # the first suffix of all has none before it
        a, m = a[head:], m[head:]
        x, y = offset[np.minimum(a + m, total - 1)], offset[np.minimum(b + m, total - 1)]
        lcp = np.minimum(x - offset[a], WIDTH)
        stop = np.r_[self.ends, len(self.data)]
        bound = lambda p: stop[np.minimum(np.searchsorted(self.starts, p, side="right") - 1, len(self.ends) - 1)] - p
        room = np.minimum(bound(x), bound(y))
        live, k = np.flatnonzero(lcp < WIDTH), 0
        while len(live):
            live = live[room[live] > k]
            live = live[self.data[x[live] + k] == self.data[y[live] + k]]
            lcp[live] += 1
            live = live[lcp[live] < WIDTH]
            k += 1
        return np.r_[np.zeros(head, np.int64), lcp]

    def repeated(self, widths: tuple[int, ...] = (WIDTH,)) -> np.ndarray:
        """For each byte a number whose bit k says that the window of widths[k] from there, within its string, also starts elsewhere."""
        flags = self._numbers(len(self.data) + 1, np.uint8)
        self._by_cut(flags, widths)
        for k, width in enumerate(widths):
            self._without_cut(flags, np.uint8(1 << k), width)
        return flags[:-1]

    def _cuts(self, widths: tuple[int, ...]) -> dict[str, np.ndarray]:
        """The cuts in the order of their suffixes: place, least ``lcp`` since the cut before, and the distances of the
        windows that are looked up there: up to ``most``, from ``least<width>`` on."""
        n, total = len(self.cut), len(self.lcp)
        of_rank = self._numbers(total)  # one more than the cut of a rank
        for a, z in self._chunks(n):
            of_rank[np.asarray(self.rank[a:z])] = np.arange(a, z) + 1
        out = {k: self._numbers(n, np.int32 if k == "lcp" else np.int64) for k in ("place", "lcp", "most", *(f"least{w}" for w in widths))}
        last = {w: np.minimum(self.ends - w, self.lasts) for w in widths}
        done, low = 0, WIDTH
        for a, z in self._chunks(total):
            at = np.flatnonzero(of_rank[a:z])
            if not len(at):
                low = min(low, int(self.lcp[a:z].min()))
                continue
            lcp = np.asarray(self.lcp[a:z])
            least = np.minimum.reduceat(lcp[: at[-1] + 1], np.r_[0, at[:-1] + 1])
            least[0] = min(low, least[0])
            low = int(lcp[at[-1] + 1 :].min(initial=WIDTH))
            here = np.asarray(of_rank[a:z])[at] - 1
            cut = np.asarray(self.cut[here])
            owner = np.searchsorted(self.starts, cut, side="right") - 1
            start = self.starts[owner]
            before = np.where(here > 0, np.asarray(self.cut[np.maximum(here - 1, 0)]), -1)
            to = slice(done, done + len(at))
            out["place"][to], out["lcp"][to] = cut, least
            out["most"][to] = np.minimum(cut - start, np.where(before > start, cut - before + 3, len(self.data)))
            for w in widths:
                out[f"least{w}"][to] = np.maximum(4, cut - last[w][owner])
            done += len(at)
        return out

    def _by_cut(self, flags: np.ndarray, widths: tuple[int, ...]) -> None:
        """Windows looked up at their first cut, at all distances d in turn; cuts that serve no greater one are left out."""
        live, n = self._cuts(widths), len(self.cut)
        live["digest"] = self._numbers(n, np.uint64)
        for d in range(1, max(widths)):
            keys = {w: (Grown(np.uint64, self.folder, self.held), Grown(np.int64, self.folder, self.held)) for w in widths if 4 <= d < w}
            carry = dict.fromkeys(keys, 0)
            for a, z in self._chunks(n):
                place = np.asarray(live["place"][a:z])
                # of a cut that serves no distance from d on it doesn't matter what stands there
                live["digest"][a:z] = live["digest"][a:z] * _BASE + self.data[np.maximum(place - d, 0)] + np.uint64(1)
                use = live["most"][a:z] >= d
                for w, (key, at) in keys.items():
                    interval = np.cumsum(live["lcp"][a:z] < w - d) + carry[w]
                    carry[w] = int(interval[-1])
                    own = np.flatnonzero(use & (live[f"least{w}"][a:z] <= d))
                    k = interval[own].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + live["digest"][a:z][own] * np.uint64(0x165667B19E3779F9)
                    key.append(k ^ (k >> np.uint64(32)))
                    at.append(place[own] - d)
            for k, w in enumerate(widths):
                if w in keys:
                    self._mark(flags, np.uint8(1 << k), *(x.array() for x in keys[w]))
            if d % 8 == 0:
                n = self._shortened(live, n, d)
                if not n:
                    return

    def _shortened(self, live: dict[str, np.ndarray], n: int, d: int) -> int:
        """Leaves out cuts that serve no distance over d, in place; the next one takes over their least prefix."""
        done, low = 0, WIDTH
        for a, z in self._chunks(n):
            at = np.flatnonzero(live["most"][a:z] > d)
            lcp = np.asarray(live["lcp"][a:z])
            if not len(at):
                low = min(low, int(lcp.min()))
                continue
            least = np.minimum.reduceat(lcp[: at[-1] + 1], np.r_[0, at[:-1] + 1])
            least[0] = min(low, least[0])
            low = int(lcp[at[-1] + 1 :].min(initial=WIDTH))
            for k, x in live.items():
                x[done : done + len(at)] = least if k == "lcp" else np.asarray(x[a:z])[at]
            done += len(at)
        return done

    def _without_cut(self, flags: np.ndarray, bit: np.uint8, width: int) -> None:
        """Windows from s with no cut between s + 4 and s + width - 1, by their digests."""
        keys, places = Grown(np.uint64, self.folder, self.held), Grown(np.int64, self.folder, self.held)
        for i, j in self._slabs():
            first = np.searchsorted(self.cut, self.starts[i])
            cut = np.asarray(self.cut[first : np.searchsorted(self.cut, self.ends[j - 1])])
            # from a start or just behind a cut up to the next one or the end
            a = np.r_[self.starts[i:j], cut - 3]
            owner = np.searchsorted(self.ends, a, side="right").clip(max=len(self.ends) - 1)
            z = np.minimum(np.r_[cut, self.ends[j - 1]][np.searchsorted(cut, a + 4)], self.ends[owner]) - width
            z = np.minimum(z, self.lasts[owner])
            for p, q in zip(a[z >= a].tolist(), z[z >= a].tolist(), strict=True):
                for at in range(p, q + 1, _STEP):
                    text = self.data[at : min(at + _STEP, q + 1) + width - 1].tobytes()
                    keys.append(np.array([xxhash.xxh3_64_intdigest(text[x : x + width]) for x in range(len(text) - width + 1)], dtype=np.uint64))
                    places.append(np.arange(at, min(at + _STEP, q + 1)))
        self._mark(flags, bit, keys.array(), places.array())

    def _mark(self, flags: np.ndarray, bit: np.uint8, keys: np.ndarray, places: np.ndarray) -> None:
        """Sets the bit at places whose key occurs twice; keys are taken by their remainder, so many at a time."""
        parts = -(-len(keys) // self.held)
        for part in range(parts):
            k, at = (keys, places) if parts == 1 else self._part(keys, places, part, parts)
            if not len(k):
                continue
            by = np.argsort(k, kind="stable")
            k = k[by]
            equal = k[1:] == k[:-1]
            twice = np.r_[False, equal] | np.r_[equal, False]
            flags[at[by[twice]]] |= bit

    def _part(self, keys: np.ndarray, places: np.ndarray, part: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
        found = []
        for a, z in self._chunks(len(keys)):
            k = np.asarray(keys[a:z])
            own = k % np.uint64(parts) == part
            found.append((k[own], np.asarray(places[a:z])[own]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def repeated_windows(strings: list[bytes], widths: tuple[int, ...] = (WIDTH,), folder: str | None = None, held: int = HELD) -> np.ndarray:
    shard = Shard(np.frombuffer(b"".join(strings), np.uint8), np.array([len(s) for s in strings], dtype=np.int64), None, folder, held)
    shard.order()
    return shard.repeated(widths)


def _folder() -> str | None:
    """A folder on a disk that Spark gives its tasks."""
    given = [d for d in os.environ.get("SPARK_LOCAL_DIRS", "").split(",") if os.path.isdir(d)]
    return given[os.getpid() % len(given)] if given else None


def _sorted(batches):
    """One partition of strings: (h, c, spans of windows of width k) of those that occur once."""
    folder = _folder()
    data, sizes, rows = Grown(np.uint8, folder, 1 << 23), Grown(np.int64, folder), Grown(np.int64, folder)
    for batch in batches:
        strings = batch.column("string").to_pylist()
        data.append(np.frombuffer(b"".join(strings), np.uint8))
        sizes.append(np.array([len(s) for s in strings], dtype=np.int64))
        rows.append(np.stack([batch.column(k).to_numpy() for k in ("h", "c", "n", "last")], axis=1).ravel())
    if not data.n:
        return
    rows = rows.array().reshape(-1, 4)
    shard = Shard(data.array(), sizes.array(), rows[:, 3], folder)
    shard.order()
    flags, out = shard.repeated(_WIDTHS), []
    kind = pa.schema([("h", pa.int64()), ("c", pa.int64()), ("spans", pa.list_(pa.struct([("k", pa.int32()), ("a", pa.int32()), ("z", pa.int32())])))])
    for (h, c, n, _), a, z in zip(rows, shard.starts.tolist(), shard.ends.tolist(), strict=True):
        own = np.asarray(flags[a:z])
        if n == 1 and own.any():
            spans = []
            for k in range(len(_WIDTHS)):
                edge = np.flatnonzero(np.diff(np.r_[0, own >> k & 1, 0].astype(np.int8))).reshape(-1, 2)
                spans += [{"k": k, "a": int(x), "z": int(y) - 1} for x, y in edge]
            out.append({"h": int(h), "c": int(c), "spans": spans})
            if len(out) >= 5000:
                yield pa.RecordBatch.from_pylist(out, kind)
                out = []
    yield pa.RecordBatch.from_pylist(out, kind)


@arrow_function("struct<n_bytes:long,n_removed:long,n_spans:long,n_passages:long,kept:binary>")
def _without(texts: pa.Array, covered: pa.Array) -> pa.Array:
    rows = []
    for text, windows in zip(utf8(texts), covered.to_pylist(), strict=True):
        text = text or b""
        size = len(text)
        passages = [text[a:z] for a, z in _joined(windows, 0, size)]
        gone = _joined(windows, 1, size)
        at, kept = 0, []
        for a, z in gone:
            kept.append(text[at:a])
            at = z
        kept.append(text[at:])
        rows.append((size, sum(z - a for a, z in gone), len(gone), sum(len(p.split()) > PASSAGE_WORDS for p in passages), b"".join(kept)))
    names = ["n_bytes", "n_removed", "n_spans", "n_passages", "kept"]
    return pa.StructArray.from_arrays([*(pa.array([r[i] for r in rows], pa.int64()) for i in range(4)), pa.array([r[4] for r in rows], pa.binary())], names=names)


def _joined(windows: list[dict] | None, k: int, size: int) -> list[tuple[int, int]]:
    """The maximal stretches that windows of _WIDTHS[k] cover; k of a row is its width's, or -1 for both."""
    width, out = _WIDTHS[k], []
    for lo, hi in sorted((w["lo"], min(w["hi"] + width, size)) for w in windows or [] if w["k"] in (k, -1) and w["lo"] + width <= size):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(a, z) for a, z in out]


def _spans(k, a, z) -> Column:
    return F.array(F.struct(F.lit(k).alias("k"), F.lit(a).alias("a"), F.lit(z).alias("z")))


def _known(strings: DataFrame, hot: int, sizes: tuple[int, ...] = (16, 1)) -> DataFrame:
    """(h, c, spans) of strings of anchors whose strings differ: spans of windows of width k (-1: all) from a to z (-1: all)."""
    rest, split = strings, None
    if sizes:
        split = written(strings.groupBy("h").count().where(F.col("count") > hot).select("h"), "hot")
        split = None if split.isEmpty() else split
    if split is not None:
        rest = strings.join(split, "h", "left_anti")
    size = rest.agg(F.sum(F.octet_length("string"))).first()[0] or 0
    found = rest.repartition(max(1, math.ceil(size / SHARD)), "h").mapInArrow(_sorted, "h long, c long, spans array<struct<k:int,a:int,z:int>>")
    known = rest.where("n > 1").select("h", "c", _spans(-1, 0, -1).alias("spans")).unionByName(found)
    if split is None:
        return known
    pieces = written(strings.join(split, "h", "left_semi").mapInArrow(_cut(sizes[0]), _PIECES), "pieces")
    again = pieces.groupBy("h2").agg(F.sum("n").alias("of"), F.min("c2").alias("c0"), F.max("c2").alias("c1")).where("of > 1")
    again = written(again.select("h2", (F.col("c0") != F.col("c1")).alias("mixed")), "anchors")
    pieces = written(pieces.join(again, "h2"), "pieces")
    mixed = pieces.where("mixed").groupBy(F.col("h2").alias("h"), F.col("c2").alias("c"))
    if sizes[0] > 1:
        mixed = written(mixed.agg(F.sum("n").alias("n"), F.max("last").alias("last"), F.max("string").alias("string")), "strings")
        inner = _known(mixed, hot, sizes[1:])
    else:  # single windows: known by their first SHORT bytes, and by all WIDTH where these occur again
        inner = mixed.agg(F.sum("n").alias("n")).select("h", "c", F.when(F.col("n") > 1, _spans(-1, 0, -1)).otherwise(_spans(0, 0, -1)).alias("spans"))
    inner = written(inner.select(F.col("h").alias("h2"), F.col("c").alias("c2"), "spans"), "known")
    pieces = pieces.select("h", "c", "h2", "c2", "first", "last", "mixed")
    spans = pieces.where("mixed").join(inner, ["h2", "c2"]).select("h", "c", "first", "last", F.explode("spans").alias("s"))
    spans = spans.unionByName(pieces.where("not mixed").select("h", "c", "first", "last", F.struct(F.lit(-1).alias("k"), F.lit(0).alias("a"), F.lit(-1).alias("z")).alias("s")))
    end = F.when(F.col("s.z") < 0, F.col("last")).otherwise(F.col("s.z"))
    spans = spans.groupBy("h", "c").agg(F.collect_set(F.struct(F.col("s.k").alias("k"), (F.col("first") + F.col("s.a")).alias("a"), (F.col("first") + end).alias("z"))).alias("spans"))
    return known.unionByName(spans)


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, n_passages, kept) of every row.

    kept is the remaining bytes, which removal may leave in the middle of a character; n_passages the stretches
    of over PASSAGE_WORDS words that strings of SHORT bytes cover which also start elsewhere, removed or not. A null
    text is empty, texts under WIDTH bytes stay whole; ids may be null. Repeated rows lose what they share, as copies
    with different ids do; equal passages need no order, all go. Texts of any length are read in slices; columns of
    docs besides the two are not read, whatever their names.
    """
    rows = docs.select(col(id_col).alias("id"), F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    runs = written(rows.select("id", "tie", F.explode(_runs(F.col("text"))).alias("r")).select("id", "tie", "r.*"), "every")
    again = runs.groupBy("h").agg(F.count("*").alias("n"), F.min("c").alias("c0"), F.max("c").alias("c1")).where("n > 1")
    again = written(again.select("h", (F.col("c0") != F.col("c1")).alias("mixed")), "anchors")
    held = written(runs.join(again, "h"), "runs")
    mixed = held.where("mixed").groupBy("h", "c").agg(F.count("*").alias("n"), F.min(F.struct("id", "tie", "lo", "hi")).alias("at"))
    places = mixed.groupBy(F.col("at.id").alias("id0"), F.col("at.tie").alias("tie0")).agg(F.collect_list(F.struct("h", "c", "n", "at.lo", "at.hi")).alias("places"))
    here = rows.join(places, F.col("id").eqNullSafe(F.col("id0")) & (F.col("tie") == F.col("tie0")))
    strings = written(here.select("text", "places").mapInArrow(_strings, _STRINGS), "strings")
    known = written(_known(strings, hot), "known")  # a table, so that the join below may split a string of many documents

    part = held.where("mixed").join(known, ["h", "c"]).select("id", "tie", "lo", "hi", F.explode("spans").alias("s"))
    part = part.select("id", "tie", F.col("s.k").alias("k"), (F.col("lo") + F.col("s.a")).alias("lo"), F.when(F.col("s.z") < 0, F.col("hi")).otherwise(F.col("lo") + F.col("s.z")).alias("hi"))
    gone = held.where("not mixed").select("id", "tie", F.lit(-1).alias("k"), "lo", "hi").unionByName(part)
    gone = written(gone.groupBy(F.col("id").alias("id0"), F.col("tie").alias("tie0")).agg(F.collect_set(F.struct("k", "lo", "hi")).alias("gone")), "covered")
    met = rows.join(gone, F.col("id").eqNullSafe(F.col("id0")) & (F.col("tie") == F.col("tie0")), "left")
    return met.select(F.col("id").alias(id_col), _without(F.col("text"), F.col("gone")).alias("s")).select(col(id_col), "s.*")


def brute_force(texts: list[bytes], width: int = WIDTH) -> list[tuple[int, int, int, str]]:
    """(n_bytes, n_removed, n_spans, digest of what stays) of each text, for tests: every window is compared."""
    seen: dict[bytes, int] = {}
    for t in texts:
        for i in range(len(t) - width + 1):
            seen[t[i : i + width]] = seen.get(t[i : i + width], 0) + 1
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - width + 1):
            if seen[t[i : i + width]] > 1:
                gone[i : i + width] = b"\1" * width
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((len(t), sum(gone), sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1])), hashlib.sha256(kept).hexdigest()))
    return out
