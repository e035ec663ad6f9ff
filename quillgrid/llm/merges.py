"""Byte-pair merges of many words side by side.

A tokenizer's merges are applied to all words of one length at once: each step finds every word's best pair, its
lowest rank and of equal ones the leftmost, and merges it; a word without a pair to merge is done. Pairs are looked
up in a table of open addresses.
"""

from __future__ import annotations

import json

import numpy as np

#: Bytes of a word, and words of one length that are merged together.
LONGEST, TOGETHER = 32, 20_000
NONE, EMPTY = np.iinfo(np.int32).max, np.uint32(0xFFFFFFFF)
BITS = 19
END = "</w>"


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes themselves, then from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    letter = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}
    return [letter[b] for b in range(256)]


class Merges:
    """The model of a byte-level tokenizer with a mark at the end of words, for words that it neither rewrites nor parts."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, pairs = model["vocab"], [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        if model["type"] != "BPE" or model["end_of_word_suffix"] != END or len(vocab) >= 1 << 16 or len(pairs) * 2 > 1 << BITS:
            raise ValueError(f"{path} is not a byte-pair model of words")
        letters = byte_letters()
        self.inner = np.array([vocab[x] for x in letters], dtype=np.uint32)
        self.last = np.array([vocab[x + END] for x in letters], dtype=np.uint32)
        self.made = np.array([vocab[a + b] for a, b in pairs], dtype=np.uint32)
        keys = np.array([vocab[a] << 16 | vocab[b] for a, b in pairs], dtype=np.uint32)
        self.keys, self.ranks = np.full(1 << BITS, EMPTY), np.full(1 << BITS, NONE, dtype=np.int32)
        for rank, (key, slot) in enumerate(zip(keys.tolist(), self._slots(keys).tolist(), strict=True)):
            while self.keys[slot] != EMPTY and self.keys[slot] != key:
                slot = (slot + 1) % (1 << BITS)
            if self.keys[slot] == EMPTY:
                self.keys[slot], self.ranks[slot] = key, rank

    @staticmethod
    def _slots(keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint32(2654435769)) >> np.uint32(32 - BITS)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks of pairs, NONE where two symbols don't merge."""
        keys = left << np.uint32(16) | right
        slots = self._slots(keys)
        held = self.keys[slots]
        out = np.where(held == keys, self.ranks[slots], NONE)
        open_ = np.flatnonzero((held != keys) & (held != EMPTY))
        at, wanted = slots[open_], keys[open_]
        while len(open_):
            at = (at + np.uint32(1)) & np.uint32((1 << BITS) - 1)
            held = self.keys[at]
            hit = held == wanted
            out[open_[hit]] = self.ranks[at[hit]]
            more = ~hit & (held != EMPTY)
            open_, at, wanted = open_[more], at[more], wanted[more]
        return out

    def _alike(self, words: list[bytes], size: int) -> list[bytes]:
        """The ids of words of one size in bytes, as little-endian 32-bit numbers."""
        out: list[bytes] = [b""] * len(words)
        texts = np.frombuffer(b"".join(words), dtype=np.uint8).reshape(len(words), size).T
        symbols = self.inner[texts]
        symbols[-1] = self.last[texts[-1]]
        ranks = self.rank(symbols[:-1].ravel(), symbols[1:].ravel()).reshape(size - 1, len(words))
        rows = np.arange(len(words))
        while len(rows):
            width = len(symbols)
            best, place = np.full(len(rows), NONE, dtype=np.int32), np.zeros(len(rows), dtype=np.int64)
            for j in range(width - 1):
                np.copyto(place, j, where=ranks[j] < best)
                np.minimum(best, ranks[j], out=best)
            done = best == NONE
            if done.any():
                ids = np.ascontiguousarray(symbols[:, done].T).astype("<u4").tobytes()
                for k, row in enumerate(rows[done].tolist()):
                    out[row] = ids[4 * width * k : 4 * width * (k + 1)]
                left = ~done
                rows, symbols, ranks, best, place = rows[left], symbols[:, left], ranks[:, left], best[left], place[left]
            if not len(rows):
                break
            made, every, line = self.made[best], np.arange(len(rows)), np.arange(width - 1)[:, None]
            symbols = np.where(line < place, symbols[:-1], symbols[1:])
            symbols[place, every] = made
            ranks = np.where(line[:-1] < place, ranks[:-1], ranks[1:])
            some = np.flatnonzero(place > 0)
            at = place[some]
            ranks[at - 1, some] = self.rank(symbols[at - 1, some], made[some])
            some = np.flatnonzero(place < width - 2)
            at = place[some]
            ranks[at, some] = self.rank(made[some], symbols[at + 1, some])
        return out

    def encode(self, words: list[bytes]) -> dict[bytes, bytes]:
        """The ids of words of 1 to LONGEST bytes, as little-endian 32-bit numbers, by word."""
        sizes: dict[int, list[bytes]] = {}
        for w in words:
            sizes.setdefault(len(w), []).append(w)
        out: dict[bytes, bytes] = {}
        for size, some in sizes.items():
            for at in range(0, len(some), TOGETHER):
                part = some[at : at + TOGETHER]
                out.update(zip(part, self._alike(part, size), strict=True))
        return out
