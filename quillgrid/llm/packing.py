"""Best-fit packing by exact complements, planned on counts of lengths.

Documents become pieces of at most ``capacity`` tokens. A plan needs only how many pieces there are of each
length, at most ``capacity`` numbers however large the corpus is. From the longest length down a sequence is
opened; its gap is looked up among the single lengths, the sums of pairs and the sums of triples that still
have pieces, and a combination that fills it exactly is consumed as often as the counts allow. Where none
does, the longest length that fits goes in and the smaller gap is looked up again (best fit). Every step uses
up a length or a gap's last combination, so a plan has a few thousand lines at most.

The pieces then take their places: their ranks within their length come from counts of salted groups (their
number is the root of the length's count, so that a frequent length is spread out) and the plan, which is
bounded by ``capacity``, turns (length, rank) into (sequence, offset).
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_function, col, fresh, utf8, written
from .merges import LONGEST, Merges

CAPACITY = 2048
END = 0
#: Words whose ids a worker keeps in either of two halves; when one is full it becomes the older, and words still in use move on.
CACHED_WORDS = 300_000
#: A word by itself whose single id no other word has.
MARK, MARKED = b"\x02", b" \x02 "
#: Neither letters, digits, white space nor apostrophes.
TAIL = b".,;:!?*#%$&|"
#: Letters before it have one form only.
LATIN = "\u0180"
#: Texts that are looked up together.
TEXTS_AT_ONCE = 256


def whole_letters(word: bytes) -> bool:
    """A word of small Latin letters, composed ones included, no longer than what is merged side by side."""
    if not 0 < len(word) <= LONGEST:
        return False
    if word.isascii():
        return word.isalpha() and word.islower()
    text = word.decode()
    return text.isalpha() and max(text) < LATIN and text == text.lower()


#: Texts by which it is told whether a tokenizer's ids are those of its words one by one.
PROBES = (
    "Plain words, Mixed CASE and tails... of marks!?", "  two  spaces\ttab\nline\r\n end ", "don't we'll O'Neil's x' 'y", "3.14 1,000 0042 2026-07-04", "naïve Ünïcode é e\u0301 ﬁ ß ẞ İ", "日本語 テスト。 中文，标点", "🙂 a🙂b \u200b x\u00a0y",
    "a_b-c/d\\e {f} [g] <h> <|i|> #j $k %l &m |n", "antidisestablishmentarianism" * 3, "\x02 \x00 \x1c", "", " ",
)


class WordIds:
    """Ids of texts, kept by white-space separated word where the tokenizer takes words one by one.

    That is tried on PROBES when the file is read; with any other tokenizer every text is encoded as a whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.known, self.older = Tokenizer.from_file(path), {}, {}
        try:
            # the same model for words of small letters, which its normaliser and its pattern leave as they are
            self.merges = Merges(path)
            (self.mark,) = self.tokenizer.encode(MARK.decode(), add_special_tokens=False).ids
            self.by_word = True
            self.by_word = all(self.encode_all([t.encode()]) == [self._whole(t)] for t in PROBES)
        except (ValueError, KeyError):  # another kind of model, or one whose words run together
            self.by_word = False

    def _whole(self, text: str) -> bytes:
        return np.array([*self.tokenizer.encode(text, add_special_tokens=False).ids, END], dtype="<u4").tobytes()

    def _encode(self, words: list[bytes]) -> None:
        """Words become known by the tokenizer: many in one call, a mark between them.

        White space separates words, so the ids of a text are those of its words and the mark's id stands alone.
        """
        bare = [w for w in words if whole_letters(w)]
        self.known.update(self.merges.encode(bare))
        words = set(words).difference(bare)
        plain = [w for w in words if MARK not in w and b"<|" not in w]
        if len(plain) < len(words):
            for w in words.difference(plain):
                self.known[w] = np.array(self.tokenizer.encode(w.decode(), add_special_tokens=False).ids, dtype="<u4").tobytes()
        for at in range(0, len(plain), 5000):
            some = plain[at : at + 5000]
            ids = np.array(self.tokenizer.encode(MARKED.join(some).decode(), add_special_tokens=False).ids, dtype="<u4")
            ends = np.flatnonzero(ids == self.mark)
            buffer, ends = ids.tobytes(), [*(4 * ends).tolist(), 4 * len(ids)]
            if len(ends) != len(some):
                raise ValueError("the tokenizer joins words across white space")
            start = 0
            for w, end in zip(some, ends, strict=True):
                self.known[w] = buffer[start:end]
                start = end + 4

    def _recall(self, words: set[bytes]) -> list[bytes]:
        """Those of words that are new; the others are known, or move on from the older half."""
        known, older = self.known, self.older
        old = [w for w in words if w in older]
        known.update(zip(old, map(older.__getitem__, old), strict=True))
        return [w for w in words if w not in known]

    def learn(self, words: set[bytes]) -> None:
        """Words become known. A tail of marks after a letter is a token of its own, and case doesn't count, so
        only the parts that are new go to the tokenizer."""
        whole, parts, missing = [], [], set()
        known = self.known
        for w in self._recall(words):
            if w.islower() and w.isalpha():
                missing.add(w)
                continue
            low = w.lower()
            core = low.rstrip(TAIL)
            if core and core != w and (core[-1:].isalpha() or whole_letters(core)):
                tail = low[len(core) :]
                whole.append(w)
                parts.append((core, tail))
                if core not in known:
                    missing.add(core)
                if tail and tail not in known:
                    missing.add(tail)
            else:
                missing.add(w)
        self._encode(self._recall(missing))
        known[b""] = b""
        known.update((w, known[core] + known[tail]) for w, (core, tail) in zip(whole, parts, strict=True))

    def encode_all(self, texts: list[bytes | None]) -> list[bytes]:
        """Each document's ids as little-endian 32-bit numbers, then END."""
        if not self.by_word:
            return [self._whole((t or b"").decode()) for t in texts]
        if len(self.known) > CACHED_WORDS:
            self.older, self.known = self.known, {}
        known, split = self.known, [(t or b"").split() for t in texts]
        self.learn({w for words in split for w in words if w not in known})
        return [b"".join(map(known.__getitem__, words)) + END.to_bytes(4, "little") for words in split]


_loaded: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _loaded:
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)  # what earlier work of this process has freed goes back to the system
        _loaded[path] = WordIds(path)
    return _loaded[path]


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]) of all documents; ids as little-endian 32-bit numbers."""
    kind = "array<struct<piece:int,start:long,length:long,ids_crc32:long" + (",ids:binary" if with_ids else "") + ">>"

    @arrow_function(kind)
    def cut(texts: pa.Array) -> pa.Array:
        words, ends = word_ids(tokenizer), [0]
        piece, start, length, crc, ids = [], [], [], [], []
        values = utf8(texts)
        gc.disable()  # many objects, no cycles
        for buffer in (b for at in range(0, len(values), TEXTS_AT_ONCE) for b in words.encode_all(values[at : at + TEXTS_AT_ONCE])):
            for k, at in enumerate(range(0, len(buffer), 4 * capacity)):
                part = buffer[at : at + 4 * capacity]
                piece.append(k)
                start.append(at // 4)
                length.append(len(part) // 4)
                crc.append(zlib.crc32(part))
                if with_ids:
                    ids.append(part)
            ends.append(len(piece))
        gc.enable()
        columns = [pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))] + ([pa.array(ids, pa.binary())] if with_ids else [])
        names = ["piece", "start", "length", "ids_crc32"] + (["ids"] if with_ids else [])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, names=names))

    return docs.select(col(id_col).alias("__id"), F.explode(cut(col(text_col))).alias("__p")).select(col("__id").alias(id_col), "__p.*")


def _fill(gap: int, free: np.ndarray) -> tuple[int, ...] | None:
    """One, two or three lengths with pieces left that sum to the gap; the longest first."""
    if gap < len(free) and free[gap] > 0:
        return (gap,)
    have = np.flatnonzero(free[: gap + 1] > 0)
    have = have[have > 0][::-1]
    if not len(have):
        return None
    rest = gap - have
    ok = (rest > 0) & (rest <= have) & (free[rest] > (rest == have))
    if ok.any():
        a = int(have[ok][0])
        return (a, gap - a)
    for a in have[have * 3 >= gap].tolist():
        b = have[(have <= a) & (have < gap - a)]
        c = gap - a - b
        ok = (c > 0) & (c <= b) & (free[c] > (c == a).astype(int) + (c == b)) & (free[b] > (b == a))
        if ok.any():
            b = int(b[ok][0])
            return (a, b, gap - a - b)
    return None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, times) of sequences that hold all pieces. counts: pieces by length."""
    free = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        free[length] = n
    out = []
    for first in range(capacity, 0, -1):
        while free[first] > 0:
            chosen, gap = [first], capacity - first
            free[first] -= 1
            while gap > 0:
                exact = _fill(gap, free)
                if exact:
                    chosen += exact
                    for x in exact:
                        free[x] -= 1
                    break
                have = np.flatnonzero(free[1 : gap + 1] > 0)
                if not len(have):
                    break
                best = int(have[-1]) + 1
                chosen.append(best)
                free[best] -= 1
                gap -= best
            kinds, each = np.unique(chosen, return_counts=True)
            more = int((free[kinds] // each).min())
            free[kinds] -= each * more
            out.append((tuple(chosen), 1 + more))
    return out


def _places(patterns: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """(length, first rank, first sequence, offset), sorted."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for lengths, times in patterns:
        offset = 0
        for x in lengths:
            rows.append((x, used.get(x, 0), sequence, offset))
            used[x] = used.get(x, 0) + times
            offset += x
        sequence += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)


def pack(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """found (a stable table of pieces with ``length``) with ``sequence_id`` and ``offset``."""
    counts = {int(r[0]): int(r[1]) for r in found.groupBy("length").count().collect()}  # capacity rows at most
    places = _places(plan(counts, capacity))
    key = places[:, 0] << 42 | places[:, 1]

    @arrow_function("struct<sequence_id:long,offset:long>")
    def place(length: pa.Array, rank: pa.Array) -> pa.Array:
        n, r = length.to_numpy(zero_copy_only=False), rank.to_numpy(zero_copy_only=False)
        at = np.searchsorted(key, n << 42 | r, side="right") - 1
        line = places[at]
        return pa.StructArray.from_arrays([pa.array(line[:, 2] + r - line[:, 1]), pa.array(line[:, 3])], names=["sequence_id", "offset"])

    salt, rank, before, at, of_length, of_salt = (fresh(found, x) for x in ("salt", "rank", "before", "at", "of_length", "of_salt"))
    others = [col(c) for c in found.columns if c != "ids"]
    total = Window.partitionBy("length")
    sizes = found.groupBy("length").agg(F.ceil(F.sqrt(F.count("*"))).alias("__salts"))
    dealt = found.join(F.broadcast(sizes), "length").withColumn(salt, F.pmod(F.xxhash64(*others), "__salts")).drop("__salts")
    groups = dealt.groupBy("length", salt).count().withColumn(before, F.sum("count").over(total.orderBy(salt)) - F.col("count"))
    groups = groups.select(F.col("length").alias(of_length), col(salt).alias(of_salt), before)
    ranked = dealt.withColumn(rank, F.row_number().over(Window.partitionBy("length", salt).orderBy(*others)))
    ranked = ranked.join(groups, (F.col("length") == col(of_length)) & (col(salt) == col(of_salt)))
    ranked = ranked.withColumn(at, place(F.col("length"), (col(before) + col(rank) - 1).cast("long")))
    return ranked.select(*map(col, found.columns), F.col(f"{at}.sequence_id").alias("sequence_id"), F.col(f"{at}.offset").alias("offset"))


def packed(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """All documents packed. A null text is empty: its one piece is END. Null and repeated ids are kept apart
    by row; texts of any length are cut into pieces of ``capacity``, the last may be shorter."""
    return pack(written(pieces(docs, tokenizer, id_col, text_col, capacity, with_ids), "pieces"), capacity)
