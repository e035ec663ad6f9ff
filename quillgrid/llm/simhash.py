"""SimHash near-duplicates found by meet-in-the-middle ball hashing.

Two fingerprints differ in at most 2r bits exactly if some value lies within r bits of both. So every
fingerprint stands for its ball, all values within r = radius / 2 bits (1 + 64 + 2016 = 2081 of them for
a radius of 4), the balls are dealt out by value, and fingerprints that meet in a value are linked.

The balls are dealt by their leading ``prefix_bits`` bits: a fingerprint is sent once to every prefix that
some of its variants have, with the number of bits it may still change, and the variants themselves are
formed on arrival (79 short rows instead of 2081 at 12 bits). Prefixes are counted, and one that too many
fingerprints share is dealt out again by further bits. Within a prefix all fingerprints that share a
variant are linked to the least of them, never pair by pair; the links are verified bit for bit, and each
prefix returns a star for each of its clusters. Alternating large-star and small-star steps, written to
the shared folder, make the stars into components. Nothing that grows with the input reaches the driver.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_function, col, fresh, utf8, written

SHINGLE_WORDS = 4
RADIUS = 4
SEED = 42
#: A prefix with more variants than this is split by further bits while it is worked on.
MAX_VARIANTS = 1_000_000
#: A prefix that more fingerprints are dealt to is dealt out by STEP further bits, to tasks of its own.
MAX_DEALT, STEP = 500_000, 8


def fingerprint(text: bytes | None, width: int = SHINGLE_WORDS) -> int:
    """The 64-bit fingerprint of one text; 0 without words. A bit is 1 if set in over half the shingles."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) <= width:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(s, SEED) for s in shingles), dtype="<u8", count=len(words) - width + 1)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 65_536):
        part = h[at : at + 65_536].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


@arrow_function("long")
def _fingerprints(texts: pa.Array) -> pa.Array:
    values = np.fromiter((fingerprint(t) for t in utf8(texts)), dtype=np.uint64, count=len(texts))
    return pa.array(values.view(np.int64))


fingerprint_column = _fingerprints


def masks(bits: int, most: int) -> list[tuple[int, int]]:
    """(mask, weight) of all masks of up to ``most`` of ``bits`` bits."""
    return [(sum(1 << i for i in chosen), w) for w in range(most + 1) for chosen in itertools.combinations(range(bits), w)]


def _deal(batches, prefix_bits: int, half: int):
    every = masks(prefix_bits, half)
    flips = np.array([m for m, _ in every], dtype=np.uint64)
    left = np.array([half - w for _, w in every], dtype=np.int8)
    for batch in batches:
        found = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for at in range(0, len(found), 4096):
            fp = found[at : at + 4096]
            prefix = ((fp >> np.uint64(64 - prefix_bits))[:, None] ^ flips[None, :]).astype(np.int64)
            yield pa.record_batch(
                [pa.array(prefix.ravel()), pa.array(np.repeat(fp.view(np.int64), len(flips))), pa.array(np.tile(left, len(fp)))],
                names=["prefix", "fp", "flips"],
            )


def _deal_on(batches, bits: int, half: int):
    """The rows of prefixes of ``bits`` bits, dealt by STEP bits more: once to each value that some variant has there."""
    every = masks(STEP, half)
    for batch in batches:
        prefix, fp, flips = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        part = (fp.view(np.uint64) >> np.uint64(64 - bits - STEP)).astype(np.int64) & ((1 << STEP) - 1)
        for mask, weight in every:
            own = flips >= weight
            yield pa.record_batch([pa.array((prefix[own] << STEP) | (part[own] ^ mask)), pa.array(fp[own]), pa.array(flips[own] - np.int8(weight))], names=["prefix", "fp", "flips"])


def _meetings(fp: np.ndarray, flips: np.ndarray, bits: int, radius: int):
    """(least, other) index pairs of fingerprints that meet in a variant of their last ``bits`` bits."""
    if len(fp) < 2:
        return
    ball = {r: np.array([m for m, _ in masks(bits, r)], dtype=np.uint64) for r in range(int(flips.max()) + 1)}
    if sum(len(ball[r]) * int((flips == r).sum()) for r in ball) > MAX_VARIANTS and bits > 12:
        step = 6
        for value in range(1 << step):
            part = (fp >> np.uint64(bits - step)) & np.uint64((1 << step) - 1)
            off = np.bitwise_count(part ^ np.uint64(value)).astype(np.int8)
            here = np.flatnonzero(off <= flips)
            for a, b in _meetings(fp[here], flips[here] - off[here], bits - step, radius):
                yield here[a], here[b]
        return
    low = fp & np.uint64((1 << bits) - 1)
    variants, owners = [], []
    for r, flip in ball.items():
        own = np.flatnonzero(flips == r)
        if len(own):
            variants.append((low[own][:, None] ^ flip[None, :]).ravel())
            owners.append(np.repeat(own, len(flip)))
    v, o = np.concatenate(variants), np.concatenate(owners)
    size = max(8, (len(v) * 4 - 1).bit_length())
    slot = ((v * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - size)).astype(np.int64)
    shared = np.bincount(slot, minlength=1 << size)[slot] > 1
    v, o = v[shared], o[shared]
    if not len(v):
        return
    order = np.lexsort((fp[o], v))
    v, o = v[order], o[order]
    first = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
    least = np.repeat(o[first], np.diff(np.r_[first, len(v)]))
    pair = np.unique(least[least != o].astype(np.int64) * len(fp) + o[least != o])
    a, b = pair // len(fp), pair % len(fp)
    near = np.bitwise_count(fp[a] ^ fp[b]) <= radius
    yield a[near], b[near]


def _stars(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the least node that links reach from it."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _link(table: pa.Table, prefix_bits: int, radius: int) -> pa.Table:
    fp, flips = table.column("fp").to_numpy().view(np.uint64), table.column("flips").to_numpy()
    order = np.argsort(fp)
    fp, flips = fp[order], flips[order]
    found = list(_meetings(fp, flips, 64 - prefix_bits, radius))
    a = np.concatenate([x for x, _ in found]) if found else np.array([], dtype=np.int64)
    b = np.concatenate([x for _, x in found]) if found else np.array([], dtype=np.int64)
    root = _stars(len(fp), a, b)
    other = np.flatnonzero(root != np.arange(len(fp)))
    return pa.table({"a": pa.array(fp[other].view(np.int64)), "b": pa.array(fp[root[other]].view(np.int64))})


def _linking(bits: int, radius: int):
    return lambda table: _link(table, bits, radius)


def links(fingerprints: DataFrame, radius: int = RADIUS, prefix_bits: int = 12, most: int = MAX_DEALT) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp): enough to connect all within the radius."""
    half, bits, out = radius // 2, prefix_bits, None
    dealt = fingerprints.select("fp").mapInArrow(lambda batches: _deal(batches, prefix_bits, half), "prefix long, fp long, flips byte")
    while True:
        hot = None
        if bits + STEP <= 48:  # fingerprints are distinct: what shares more bits than that is few
            hot = written(dealt.groupBy("prefix").count().where(F.col("count") > most).select("prefix"), "hot")
            hot = None if hot.isEmpty() else hot
        rest = dealt if hot is None else dealt.join(hot, "prefix", "left_anti")
        found = rest.groupBy("prefix").applyInArrow(_linking(bits, radius), "a long, b long")
        out = found if out is None else out.unionByName(found)
        if hot is None:
            return out.distinct()
        dealt = written(dealt.join(hot, "prefix", "left_semi").mapInArrow(lambda batches, bits=bits: _deal_on(batches, bits, half), "prefix long, fp long, flips byte"), "dealt")
        bits += STEP


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes of the links (a, b) but the roots; root is the least node of a component."""
    edges = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    print_of = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    last = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = written(large, "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = written(small.union(least.select("a", F.col("m").alias("b"))).distinct(), "small-star")
        now = print_of(edges)
        if now == last:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        last = now


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False, radius: int = RADIUS, carry: list[str] | None = None, root: bool = False) -> DataFrame:
    """docs with ``fingerprint`` (16 hexadecimal digits) and ``component_id`` (the least id reachable).

    root: with ``root`` too, the least fingerprint of the component, which tells components apart whose ids repeat.

    keep_text: carry all columns of docs, the text included; otherwise the id and the columns of ``carry``. Columns of docs named
    fingerprint or component_id are replaced. Null or blank texts have fingerprint 0 and are linked like any
    other; null ids never become a component's id unless it has no other. Repeated rows stay.
    """
    if radius % 2 or radius < 2:
        raise ValueError("the radius is an even number of bits, 2 at least")
    keep = [c for c in docs.columns if c.lower() not in ("fingerprint", "component_id")] if keep_text else [id_col, *(carry or [])]
    fp, of = fresh(docs, "fp"), fresh(docs, "of")
    rows = written(docs.select(*map(col, keep), fingerprint_column(col(text_col)).alias(fp)), "fingerprints")
    own = written(rows.groupBy(col(fp).alias("fp")).agg(F.min(col(id_col)).alias("least")), "distinct")
    bits = min(24, max(12, math.ceil(math.log2(own.count() * 2081 / 4_000_000 + 1))))
    roots = components(links(own, radius, bits))
    nodes = roots.union(roots.select("root", "root").distinct()).join(own, F.col("node") == F.col("fp")).select("node", "root", "least")
    whole = nodes.groupBy("root").agg(F.min("least").alias("whole"))
    nodes = nodes.join(whole, "root").select(F.col("node").alias("fp"), "whole", "root")
    label = own.join(nodes, "fp", "left").select(F.col("fp").alias(of), F.coalesce("whole", "least").alias("component_id"), F.coalesce("root", "fp").alias("root"))
    label = written(label, "labels")  # a table, so that the join below may split a fingerprint of many rows
    return rows.join(label, col(fp) == col(of), "left").select(
        *map(col, keep), F.lower(F.lpad(F.hex(col(fp)), 16, "0")).alias("fingerprint"), "component_id", *(["root"] if root else [])
    )


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row of each component of near-duplicates, with the columns of docs: the row of the least id.

    Rows that share this id keep one row, and so does a component without any id. Whole rows are
    met by a digest of id and text only once the rows that stay are known, so no text is stored or grouped.
    """
    row, of, whose, rank = (fresh(docs, x) for x in ("row", "of", "whose", "rank"))
    digest = F.xxhash64(col(id_col), col(text_col))
    narrow = docs.select(col(id_col).alias("id"), col(text_col).alias("text"), digest.alias("row"))
    found = near_duplicates(narrow, "id", "text", False, radius, carry=["row"], root=True)
    found = found.where((F.col("id") == F.col("component_id")) | F.col("component_id").isNull())
    by = Window.partitionBy("root").orderBy("row")
    first = found.withColumn("rank", F.row_number().over(by)).where("rank = 1").select(F.col("row").alias(of), F.col("id").alias(whose))
    first = written(first, "representatives")
    met = docs.withColumn(row, digest).join(first, (col(row) == col(of)) & col(id_col).eqNullSafe(col(whose)))
    once = Window.partitionBy(row).orderBy(row)  # the join's own partitions; repeated rows are alike
    return met.withColumn(rank, F.row_number().over(once)).where(col(rank) == 1).select(*map(col, docs.columns))


def brute_links(fps: list[int]) -> dict[int, int]:
    """Of each fingerprint the least that links reach, for tests: every pair is compared."""
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for a, b in itertools.combinations(fps, 2):
        if (a ^ b).bit_count() <= RADIUS:
            low, high = sorted((find(a), find(b)))
            root[high] = low
    return {f: find(f) for f in fps}


def brute_force(rows: list[tuple]) -> pd.DataFrame:
    """Of (id, text) rows, for tests: every pair of fingerprints is compared."""
    fps = [fingerprint(None if t is None else t.encode()) for _, t in rows]
    reach = brute_links(sorted(set(fps)))
    least: dict = {}
    for f, (doc, _) in zip(fps, rows, strict=True):
        least[reach[f]] = min(least.get(reach[f], doc), doc)
    return pd.DataFrame({"doc_id": [d for d, _ in rows], "fingerprint": [f"{f:016x}" for f in fps], "component_id": [least[reach[f]] for f in fps]})
