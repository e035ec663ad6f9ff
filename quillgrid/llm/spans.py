"""Substring deduplication by sliding sentence spans.

A text is cut into sentences (at a full stop, question or exclamation mark before white space, and at line
ends). A run is a passage of whole sentences with MIN_WORDS words at least, be it one sentence, or a whole text
with fewer. Every sentence starts the shortest run from there and ends the shortest run up to there; together
these cover whatever longer runs share. Runs are compared over the corpus by a 128-bit digest of their words, and
a sentence goes if a run covers it that is not the first of its kind; first is the least (document id, digest of
the text, place).

Digests are first counted as 64-bit numbers with partial sums, so that only runs that occur again are dealt
out with their places; a run of a third of all documents is one row a task by then.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_function, col, utf8, written

MIN_WORDS = 12
#: What ends a sentence, white space included: a run of . ! ? with closing quotes before white space, a line end, a
#: full stop of Chinese or Japanese. Its parts start at the front of a run and give nothing back: linear in the text.
_BREAK = re.compile(
    rb"""[.!?\n\xe3\xef](?:(?<=\n)\s*+|(?<=[.!?])(?<![.!?][.!?])[.!?]*+["')\]]*+\s++|(?:(?<=\xe3)\x80\x82|(?<=\xef)\xbc[\x81\x9f])(?:\xe3\x80\x82|\xef\xbc[\x81\x9f])*+\s*+)"""
)


def sentences(text: bytes | None) -> list[tuple[int, int]]:
    """(start, end) bytes of the sentences, which together are the text; white space at the front is one of its own."""
    text = text or b""
    ends = [m.end() for m in _BREAK.finditer(text)]
    if text and (not ends or ends[-1] < len(text)):
        ends.append(len(text))
    return list(zip([0, *ends], ends))


def runs(text: bytes, places: list[tuple[int, int]], min_words: int = MIN_WORDS) -> list[tuple[bytes, int, int]]:
    """(128-bit digest, first sentence, sentence after the last) of the runs of a text."""
    words = [text[a:b].split() for a, b in places]
    plain = list(map(b" ".join, words))
    sizes = list(map(len, words))
    n = len(sizes)
    lead = int(n > 1 and not sizes[0])  # white space at the front is no sentence of its own
    found: set[tuple[int, int]] = set()
    i, held = lead, 0
    for j in range(lead, n):  # [i, j] grows at its end and shrinks to the shortest that is long enough
        held += sizes[j]
        while held - sizes[i] >= min_words:
            held -= sizes[i]
            i += 1
        if held >= min_words:
            found.add((i, j + 1))
    j, held = n, 0
    for i in range(n - 1, lead - 1, -1):
        held += sizes[i]
        while held - sizes[j - 1] >= min_words:
            j -= 1
            held -= sizes[j]
        if held >= min_words:
            found.add((i, j))
    if not found and any(sizes):
        found.add((lead, n))
    return [(xxhash.xxh3_128_digest(b" ".join(plain[i:j])), 0 if i == lead else i, j) for i, j in sorted(found)]


@arrow_function("array<struct<h:long,g:long,i:int,j:int>>")
def _runs(texts: pa.Array) -> pa.Array:
    ends, rows = [0], []
    for text in utf8(texts):
        rows += runs(text, sentences(text)) if text else []
        ends.append(len(rows))
    digests, first, after = zip(*rows, strict=True) if rows else ((), (), ())
    halves = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
    columns = [pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(first, pa.int32()), pa.array(after, pa.int32())]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, names=["h", "g", "i", "j"]))


@arrow_function("struct<n_sentences:int,n_removed:int,n_spans:int,kept:string>")
def _without(texts: pa.Array, removed: pa.Array) -> pa.Array:
    rows = []
    for text, gone in zip(utf8(texts), removed.to_pylist(), strict=True):
        places = sentences(text)
        if not gone:
            rows.append((len(places), 0, 0, text))
            continue
        edge = np.zeros(len(places) + 1, dtype=np.int64)
        for g in gone:
            edge[g["i"]] += 1
            edge[g["j"]] -= 1
        out = np.cumsum(edge)[:-1] > 0
        kept = text if not out.any() else b"".join(text[a:b] for (a, b), o in zip(places, out.tolist(), strict=True) if not o)
        rows.append((len(places), int(out.sum()), int((np.diff(np.r_[0, out.astype(np.int8)]) == 1).sum()), kept))
    names, kinds = ["n_sentences", "n_removed", "n_spans", "kept"], [pa.int32(), pa.int32(), pa.int32(), pa.binary()]
    columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
    columns[3] = columns[3].cast(pa.string())
    return pa.StructArray.from_arrays(columns, names=names)


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_sentences, n_removed, n_spans, kept, first_ids) of every row of docs.

    kept is the text without the sentences removed (null for a null text), first_ids the ids that hold the
    first copies. Rows with the same id and text are one document and have the same result; null ids are least; of
    equal ids the lesser digest of the text is first. Empty and null texts have no sentences. Texts of any length are
    read in linear time; columns of docs besides the two are not read, whatever their names.
    """
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(col(id_col).alias("id"), col(text_col).cast("string").alias("text")).withColumn("tie", F.xxhash64("text"))
    every = written(rows.select("id", "tie", _runs(F.col("text")).alias("r")), "runs").select("id", "tie", F.explode("r").alias("r")).select("id", "tie", "r.*")
    again = written(every.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "repeated-digests")
    held = written(every.join(again, "h", "left_semi"), "repeated-runs")
    first = held.groupBy("h", "g").agg(F.min(F.struct("id", "tie", "i")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    first = written(first, "first-runs")  # a table, so that the join below may split a passage of many documents
    later = held.join(first, ["h", "g"]).where(~(F.struct("id", "tie", "i").eqNullSafe(F.col("first"))))
    gone = later.groupBy(F.col("id").alias("__id"), F.col("tie").alias("__tie")).agg(F.collect_set(F.struct("i", "j")).alias("gone"), F.array_sort(F.collect_set("first.id")).alias("first_ids"))
    gone = written(gone, "covered")
    met = rows.join(gone, F.col("id").eqNullSafe(F.col("__id")) & (F.col("tie") == F.col("__tie")), "left")
    met = met.withColumn("s", _without(F.col("text"), F.col("gone")))
    return met.select(F.col("id").alias(id_col), "s.n_sentences", "s.n_removed", "s.n_spans", "s.kept", F.coalesce("first_ids", F.array().cast(f"array<{kind}>")).alias("first_ids"))
