"""Quality rules whose cutoffs come from labelled holdouts with exact binomial bounds.

Each rule scores a text and rejects it from a cutoff on. The cutoffs of all rules move together along one path,
from none to strict: each step lowers the cutoff of one rule. The path is drawn greedily from a part of the labels
(a fifth, TUNE rows at most), which decides nothing else. On the other labels, the holdout, its steps are tested
for each stratum (a language) in their order: a step is certified while the exact (Clopper-Pearson) upper bound of
the share of good documents that the path rejects up to there stays within ``alpha``. Testing in a fixed order
needs no correction along the path; between strata the error level is divided by their number (Bonferroni). With
probability 1 - delta no stratum loses more than ``alpha`` of its good documents to the rules. Of the certified
steps the one that catches most bad documents, less a price on good ones, is used.

A stratum with fewer good labels in the holdout than certify anything (217 at four strata) is joined with the
others like it to one stratum, for which the guarantee then holds as a whole; where that has too few, no rule acts
there. All holdout labels count: only tallies per (stratum, step) reach the driver.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_function, col, fresh, utf8, written

ALPHA, DELTA, BINS = 0.02, 0.05, 64
#: Labels that draw the path: a share, and so many rows at most; steps of a path.
TUNE_SHARE, TUNE, STEPS, SEED = 0.2, 5000, 40, 6
#: A good document lost counts as so many bad ones let through, as shares.
PRICE = 10.0
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
WINDOW = 5

FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks")
#: Rules: score in [0, 1], larger is worse; as SQL over the fields.
RULES = {
    "symbols": "n_symbols / greatest(word_chars, 1)",
    "capitals": "n_upper / greatest(word_chars, 1)",
    "marks": "n_marks / greatest(word_chars, 1)",
    "repeated lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeated words": "n_repeat_words / greatest(n_words, 1)",
    "long words": "least(word_chars / greatest(n_words, 1) / 32, 1)",
    "short words": "1 - least(word_chars / greatest(n_words, 1) / 16, 1)",
}

#: Kinds of bytes: 0 within a character, 1 white space, 2 symbol, 3 A-Z, 4 mark, 5 other.
_KIND = np.full(256, 5, dtype=np.uint8)
_KIND[0x80:0xC0] = 0
_KIND[[9, 10, 11, 12, 13, 32]] = 1
_KIND[np.frombuffer(b"#*$%&|<>", dtype=np.uint8)] = 2
_KIND[65:91] = 3
_KIND[np.frombuffer(b"!?,.;:-_=+~^/\\", dtype=np.uint8)] = 4
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93], dtype=np.uint64)


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words in windows of ``width`` that the text has twice or more, the first included."""
    n = len(words)
    if n <= width:
        return 0
    index: dict[bytes, int] = {}
    number = index.setdefault
    ids = np.array([number(w, len(index)) for w in words], dtype=np.uint64)
    if len(index) == n:
        return 0
    h = np.zeros(n - width + 1, dtype=np.uint64)
    for i in range(width):
        h += (ids[i : n - width + 1 + i] + np.uint64(1)) * _ODD[i % 5] ^ (ids[i : n - width + 1 + i] << np.uint64(7 * i % 50))
    order = np.argsort(h)
    same = np.flatnonzero(h[order][1:] == h[order][:-1])
    if not len(same):
        return 0
    maybe = np.unique(np.concatenate([order[same], order[same + 1]])).tolist()
    windows = [tuple(words[i : i + width]) for i in maybe]
    times = Counter(windows)
    edge = np.zeros(n + 1, dtype=np.int64)
    for i, w in zip(maybe, windows, strict=True):
        if times[w] > 1:
            edge[i] += 1
            edge[i + width] -= 1
    return int((np.cumsum(edge) > 0).sum())


def measure(text: bytes | None) -> tuple[int, ...]:
    """The FIELDS of one text; null counts as empty."""
    text = text or b""
    words = text.split()
    if not words:
        return (0, 0, np.bincount(_KIND[np.frombuffer(text, dtype=np.uint8)], minlength=6)[2].item(), 0, 0, 0, 0, 0)
    kinds = np.bincount(_KIND[np.frombuffer(text, dtype=np.uint8)], minlength=6).tolist()
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return (len(words), kinds[2] + kinds[3] + kinds[4] + kinds[5], kinds[2], len(lines) - len(set(lines)), repeated_words(words), len(lines), kinds[3], kinds[4])


@arrow_function("struct<" + ",".join(f"{f}:long" for f in FIELDS) + ">")
def _measured(texts: pa.Array) -> pa.Array:
    rows = np.array([measure(t) for t in utf8(texts)], dtype=np.int64).reshape(-1, len(FIELDS))
    return pa.StructArray.from_arrays([pa.array(rows[:, i]) for i in range(len(FIELDS))], names=list(FIELDS))


measured = _measured


def upper_bound(k: int, n: int, level: float) -> float:
    """Exact upper bound of a rate of which k of n were seen, wrong with probability ``level`` at most."""
    if n <= 0 or k >= n:
        return 1.0

    def below(p: float) -> float:  # P(X <= k) of a binomial
        logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
        top = max(logs)
        return math.exp(top) * sum(math.exp(x - top) for x in logs)

    low, high = k / n, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if 0 < mid < 1 and below(mid) > level else (low, mid)
    return high


def path(bins: np.ndarray, good: np.ndarray, alpha: float = ALPHA) -> list[tuple[int, int]]:
    """Steps (rule, least bin that it rejects from then on), each the one that rejects most bad rows for a good one.

    bins: a row for each labelled text, a column for each rule. Ties: more bad rows, then the earlier rule, then the
    milder cutoff. It ends when no step rejects two more bad rows, or good ones beyond three times alpha would go.
    """
    alive, out = np.ones(len(good), dtype=bool), []
    lost = 0
    while len(out) < STEPS:
        best = None
        for r in range(bins.shape[1]):
            counts = [np.bincount(bins[alive & (good == g), r], minlength=BINS + 1)[::-1].cumsum()[::-1] for g in (0, 1)]
            for b in range(BINS, 0, -1):
                bad, fine = int(counts[0][b]), int(counts[1][b])
                if bad >= 2 and (best is None or (bad * (best[1] + 1), bad) > (best[0] * (fine + 1), best[0])):
                    best = (bad, fine, r, b)
        if best is None or lost + best[1] > 3 * alpha * good.sum():
            break
        alive &= bins[:, best[2]] < best[3]
        lost += best[1]
        out.append(best[2:])
    return out


def needed(strata: int, alpha: float = ALPHA, delta: float = DELTA) -> int:
    """Good labels without which a stratum can certify nothing, even if no good document is rejected."""
    return math.ceil(math.log(delta / max(1, strata)) / math.log(1 - alpha))


def certified(tallies: list[tuple], steps: int, alpha: float = ALPHA, delta: float = DELTA, price: float = PRICE) -> dict[str | None, int]:
    """stratum -> the step up to which the path is used, under None for strata that are joined.

    tallies: (stratum, first step that rejects, good, bad), steps from 1, ``steps + 1`` for rows that none rejects.
    """
    strata: dict = {}
    for stratum, step, good, bad in tallies:
        strata.setdefault(stratum, np.zeros((steps + 2, 2), dtype=np.int64))[step] += (good, bad)
    few = [k for k, counts in strata.items() if counts[:, 0].sum() < needed(len(strata), alpha, delta)]
    tested = {k: counts for k, counts in strata.items() if k not in few}
    if few:
        tested[None] = sum(strata[k] for k in few)
    out = {}
    for stratum, counts in tested.items():
        good, bad = counts.sum(axis=0).tolist()
        best, at = 0.0, 0
        for step in range(1, steps + 1):
            k, caught = counts[: step + 1].sum(axis=0).tolist()
            if k > alpha * good or upper_bound(k, good, delta / len(tested)) > alpha:
                break
            gain = caught / max(bad, 1) - price * k / max(good, 1)
            if gain > best:
                best, at = gain, step
        out[stratum] = at
    return {k: out.get(k, out.get(None, 0)) for k in [*strata, None]}


def _bin(rule: str, of: str) -> Column:
    score = RULES[rule]
    for f in FIELDS:
        score = score.replace(f, f"{of}.{f}")
    return F.expr(f"cast(floor(sqrt({score}) * {BINS}) as int)")


def judged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str | None = "lang", keep_text: bool = False, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """docs with a struct ``quality``: the FIELDS, ``base_failed``, ``kept`` and ``rule``, the one that rejects or null.

    labels: (doc_id, quality), quality 1 for good; null or other labels are left out, of several for an id the
    least counts. Null texts have no words and fail the base rule. A null stratum is a stratum. keep_text:
    carry all columns of docs (a column named quality is replaced), otherwise the id alone.
    """
    keep = [c for c in docs.columns if c.lower() != "quality"] if keep_text else [id_col]
    m, s = fresh(docs, "measured"), fresh(docs, "stratum")
    stratum = (F.coalesce(col(stratum_col).cast("string"), F.lit("")) if stratum_col else F.lit("")).alias(s)
    rows = written(docs.select(*map(col, keep), stratum, measured(col(text_col)).alias(m)), "measured")
    label = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("good"))
    label = label.select(F.col("doc_id").alias("__labelled"), "good")
    n_labels = label.count()
    draw = F.xxhash64(F.lit(SEED), F.col("__id").cast("string")).cast("double") / 2.0**64 + 0.5
    held = rows.select(col(id_col).alias("__id"), col(s).alias("s"), col(m).alias("m")).join(label, F.col("__id") == F.col("__labelled"))
    held = held.where("m.n_words > 0").select(draw.alias("draw"), "s", "m", "good")
    share = min(TUNE_SHARE, TUNE / max(1, n_labels))
    some = held.where(F.col("draw") < share).select("good", *(_bin(r, "m").alias(f"b{k}") for k, r in enumerate(RULES))).collect()
    steps = path(np.array([r[1:] for r in some], dtype=np.int64).reshape(-1, len(RULES)), np.array([r[0] for r in some], dtype=np.int64), alpha)

    def first(of: str) -> Column:
        """The first step of the path that rejects a row, or one more than the last."""
        step = F.lit(len(steps) + 1)
        for k, (rule, at) in reversed(list(enumerate(steps, 1))):
            step = F.when(_bin(names[rule], of) >= at, k).otherwise(step)
        return step

    names = list(RULES)
    tally = held.where(F.col("draw") >= share).withColumn("step", first("m")).groupBy("s", "step").agg(F.sum("good").alias("good"), F.sum(1 - F.col("good")).alias("bad"))
    used = certified([tuple(r) for r in tally.collect()], len(steps), alpha, delta)
    until = F.lit(used[None])
    for stratum_value, step in sorted((k, v) for k, v in used.items() if k is not None):
        until = F.when(col(s) == F.lit(stratum_value), step).otherwise(until)
    failed = (F.col(f"{m}.n_words") < MIN_WORDS) | (100 * F.col(f"{m}.n_repeat_words") > MAX_REPEAT_PERCENT * F.col(f"{m}.n_words"))
    rejected = first(m) <= until
    rule = F.when(rejected, F.element_at(F.array(*(F.lit(names[r]) for r, _ in steps), F.lit("")), first(m)))
    fields = [F.col(f"{m}.{f}").alias(f) for f in FIELDS]
    return rows.select(*map(col, keep), F.struct(*fields, failed.alias("base_failed"), (~failed & ~rejected).alias("kept"), rule.alias("rule")).alias("quality"))


def accepted(docs: DataFrame, labels: DataFrame, **more) -> DataFrame:
    """The rows of docs that are kept, with their columns. A column of docs named quality passes through."""
    own = next((c for c in docs.columns if c.lower() == "quality"), None)
    held = fresh(docs, "held")
    found = judged(docs.withColumnRenamed(own, held) if own else docs, labels, keep_text=True, **more)
    return found.where("quality.kept").select(*(col(held).alias(c) if c == own else col(c) for c in docs.columns))
