"""Language identification by cross-parsing.

For each language a suffix automaton of labelled text is built. A text is parsed against each automaton into
phrases, each the longest match that some place of the labelled text has for what follows (plus the symbol that
ends it); a text in the automaton's language needs few, long phrases. ``phrases * log2(labelled length) / text
length`` estimates the cross entropy in bits a symbol, and the language with the least wins.

The automata learn from a bounded sample: ROWS labelled rows of a language, SPAN characters of each, drawn by a
seeded digest. Every letter of the samples is a symbol of its own, so scripts of any size are told apart; a letter
that no sample has starts a phrase in every language. Transitions are kept as one array of edges in which the rows
of the states lie over one another, so that an automaton takes room for its edges, not for states times letters.

Every text is parsed as a whole, in blocks of BLOCK symbols that are all advanced together, so that a batch takes
BLOCK array steps however long its texts are. A block's parse starts LEAD symbols before it, where it falls in with
the one that comes from the block before, and a phrase counts in the block in which it starts.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_function, col

ROWS, SPAN, SEED = 48, 1000, 5
BLOCK, LEAD = 512, 64
FOLDS = 5
UNKNOWN = "und"


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)) == 0


def automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the states of the suffix automaton of codes; state 1 is the root, state 0 has none."""
    following: list[dict[int, int]] = [{}, {}]
    link, length, last = [0, 0], [0, 0], 1
    for c in codes:
        state = len(following)
        following.append({})
        length.append(length[last] + 1)
        link.append(1)
        p = last
        while p and c not in following[p]:
            following[p][c] = state
            p = link[p]
        if p:
            q = following[p][c]
            if length[p] + 1 == length[q]:
                link[state] = q
            else:
                clone = len(following)
                following.append(dict(following[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p and following[p].get(c) == q:
                    following[p][c] = clone
                    p = link[p]
                link[q] = link[state] = clone
        last = state
    return following


def overlaid(following: list[dict[int, int]], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(bases, edges): the edge of a state by symbol c is at its base + c, as state << 32 | state that it leads to.

    States with several edges are laid where all of them find room, those with one fill what is left.
    """
    bases = np.zeros(len(following), dtype=np.int64)
    several = sorted((s for s, row in enumerate(following) if len(row) > 1), key=lambda s: -len(following[s]))
    taken = bytearray(width + sum(map(len, following)) * 2 + 4 * width)
    free = width
    for s in several:
        symbols = sorted(following[s])
        at, tries = free, 0
        while any(taken[at + c - symbols[0]] for c in symbols):
            at, tries = taken.find(0, at + 1), tries + 1
            if tries % 40 == 0:
                free = at  # what lies before is nearly full
        bases[s] = at - symbols[0]
        for c in symbols:
            taken[bases[s] + c] = 1
        if len(taken) < bases[s] + 4 * width:
            taken.extend(bytes(len(taken)))
        free = taken.find(0, free)
    alone = [(s, *row) for s, row in enumerate(following) if len(row) == 1]
    taken.extend(bytes(len(alone)))
    room = np.flatnonzero(np.frombuffer(taken, np.uint8)[width:] == 0) + width
    for (s, c), at in zip(alone, room.tolist()):
        bases[s] = at - c
    edges = np.full(int(bases.max(initial=0)) + width + 1, -1, dtype=np.int64)
    for s, row in enumerate(following):
        for c, j in row.items():
            edges[bases[s] + c] = s << 32 | j
    return bases, edges


class Model:
    """Automata of all languages."""

    def __init__(self, samples: dict[str, list[str]]):
        self.languages = sorted(samples)
        texts = {k: " ".join(v).lower() for k, v in samples.items()}
        self.letters = "".join(sorted({c for t in texts.values() for c in t if c.isalpha()}))
        self.automata, self.bits = [], []
        for k in self.languages:
            codes = self.encode(texts[k])
            self.automata.append(overlaid(automaton(codes.tolist()), len(self.letters) + 2))
            self.bits.append(math.log2(len(codes) + 2))

    def encode(self, text: str) -> np.ndarray:
        """Symbols: 0 for what lies between words, a run of it once; letters by their place; the last for unknown ones."""
        if not hasattr(self, "_code"):
            code = np.zeros(0x110000, dtype=np.int32)
            code[[i for i in range(0x110000) if chr(i).isalpha()]] = len(self.letters) + 1
            code[[ord(c) for c in self.letters]] = np.arange(1, len(self.letters) + 1)
            self._code = code
        codes = self._code[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")]
        return codes[(codes > 0) | np.r_[False, codes[:-1] > 0]] if len(codes) else codes

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_code"}

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases of each text (rows) in each language (columns)."""
        counts = np.zeros((len(texts), len(self.languages)), dtype=np.int64)
        parts = [(i, t[max(0, at - LEAD) : at + BLOCK], min(at, LEAD)) for i, t in enumerate(texts) for at in range(0, len(t), BLOCK)]
        parts.sort(key=lambda p: -len(p[1]))
        for at in range(0, len(parts), 8192):
            some = parts[at : at + 8192]
            sizes = np.array([len(p) for _, p, _ in some])
            block = np.zeros((sizes[0], len(some)), dtype=np.int32)
            for j, (_, p, _) in enumerate(some):
                block[: len(p), j] = p
            owner, lead = np.array([i for i, *_ in some]), np.array([x for *_, x in some])
            active = np.searchsorted(-sizes, -np.arange(sizes[0]), side="left")
            for k, (bases, edges) in enumerate(self.automata):
                # state 0 leads nowhere: a text's first symbol, and one after a symbol that the root lacks, start a phrase
                state = np.zeros(len(some), dtype=np.int64)
                n = np.zeros(len(some), dtype=np.int32)
                for t in range(sizes[0]):
                    m = active[t]
                    here = state[:m]
                    edge = edges[bases[here] + block[t, :m]]
                    missed = np.flatnonzero(edge >> 32 != here)
                    edge &= 0xFFFFFFFF
                    if len(missed):
                        n[missed] += lead[missed] <= t
                        anew = edges[bases[1] + block[t, missed]]
                        edge[missed] = np.where(anew >> 32 == 1, anew & 0xFFFFFFFF, 0)
                    state[:m] = edge
                counts[:, k] += np.bincount(owner, weights=n, minlength=len(texts)).astype(np.int64)
        return counts

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        codes = [self.encode((t or "").lower()) for t in texts]
        known = [i for i, c in enumerate(codes) if len(c) and self.languages]
        out = [(UNKNOWN, 0.0)] * len(texts)
        if known:
            bits = self.phrases([codes[i] for i in known]) * np.array(self.bits) / np.array([[len(codes[i])] for i in known])
            for i, b in zip(known, bits.tolist(), strict=True):
                best = min(range(len(b)), key=b.__getitem__)
                rest = min((x for j, x in enumerate(b) if j != best), default=math.inf)
                out[i] = (self.languages[best], 1.0 if math.isinf(rest) else rest / (rest + b[best]))
        return out


def learn(rows: DataFrame, text_col: str = "text", lang_col: str = "lang", key_col: str = "doc_id", n_rows: int = ROWS, span: int = SPAN, seed: int = SEED) -> Model:
    """A model of labelled rows; rows without text or language are left out. Collects about 3 * n_rows rows a language."""
    rows = rows.select(col(text_col).alias("text"), col(lang_col).cast("string").alias("lang"), F.xxhash64(F.lit(seed), col(key_col).cast("string")).alias("draw")).where("text is not null and lang is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Model({})
    share = F.lit(0.0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == F.lit(lang), min(1.0, 3 * n_rows / n)).otherwise(share)
    place = F.greatest(F.lit(0), F.length("text") - span)
    start = F.pmod(F.col("draw"), place + 1).cast("int") + 1
    drawn = rows.where(F.col("draw").cast("double") / F.lit(2.0**64) + 0.5 < share).select("lang", "draw", F.substring("text", start, F.lit(span)).alias("text"))
    samples: dict[str, list[str]] = {}
    for r in sorted(drawn.collect(), key=lambda r: (r["lang"], r["draw"], r["text"])):
        if len(samples.setdefault(r["lang"], [])) < n_rows:
            samples[r["lang"]].append(r["text"])
    return Model({k: v for k, v in samples.items() if any(c.isalpha() for t in v for c in t)})


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> Column:
    """A struct column (lang_pred, score) for a text column of docs: `und` for null texts and those without a letter.

    Of languages that need equally many bits the first by name wins, at a score of a half. Rows count one by one, so
    repeated rows have the same result; texts of any length are parsed whole; other columns are not read.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    @arrow_function("struct<lang_pred:string,score:double>")
    def predicted(texts: pa.Array) -> pa.Array:
        values, found = texts.to_pylist(), []
        for at in range(0, len(values), 2000):
            found += held.value.predict(values[at : at + 2000])
        return pa.StructArray.from_arrays([pa.array([x for x, _ in found], pa.string()), pa.array([y for _, y in found], pa.float64())], names=["lang_pred", "score"])

    return predicted(col(text_col))
