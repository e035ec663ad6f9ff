"""Mixing sources to target weights by capped water-filling, in DataFrame operations only.

Targets: total * share by weight, stopped at ``max_epochs`` times the source's size, the excess dealt out again
by weight until none is above its stop. Sorted by stop / weight, the stopped sources are a prefix, so the level
at which the rest stand is found in one pass of prefix sums: level_k = (total - stops before k) / weights from k
on, at the first k whose stop / weight is not below its level.

Takes: a source is taken whole as often as its target allows. What remains is a fraction: its documents are
ordered by a seeded digest and the first are taken once more, until their sizes reach the remainder (the last
is taken if at least half of it fits). The order is never sorted as a whole: documents fall into BUCKETS buckets of
the digest, bucket sums are added up, and only the bucket in which the remainder ends is put in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, col, fresh, written

MAX_EPOCHS = 3
BUCKETS = 16384
SEED = 17


def word_count(text: Column) -> Column:
    """Words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def drawn(seed: int, id: Column, text: Column) -> Column:
    """A number of 60 bits, by the MD5 of seed, id and text."""
    said = F.concat_ws(":", F.lit(str(seed)), F.coalesce(id.cast("string"), F.lit("")), F.coalesce(text.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(said.cast("binary")), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """sizes (source, source_size) with ``target``. Sources by code point, null last, weigh 1, 2, 3, repeating.

    The windows run over one row per source.
    """
    every = Window.orderBy(F.col("source").asc_nulls_last())
    w = sizes.withColumn("weight", ((F.row_number().over(every) - 1) % 3 + 1).cast("double")).withColumn("stop", F.col("source_size") * float(max_epochs))
    level = Window.orderBy(F.col("stop") / F.col("weight"), F.col("source").asc_nulls_last())
    all_of = Window.partitionBy(F.lit(1))
    before = level.rowsBetween(Window.unboundedPreceding, -1)
    w = w.withColumn("total", F.sum("source_size").over(all_of).cast("double"))
    w = w.withColumn("reach", (F.col("total") - F.coalesce(F.sum("stop").over(before), F.lit(0.0))) / F.sum("weight").over(level.rowsBetween(0, Window.unboundedFollowing)))
    w = w.withColumn("at", F.min(F.when(F.col("stop") / F.col("weight") >= F.col("reach"), F.struct(F.col("stop") / F.col("weight"), F.col("reach").alias("reach")))).over(all_of)["reach"])
    return w.select("source", "source_size", F.least(F.col("stop"), F.col("at") * F.col("weight")).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", max_epochs: int = MAX_EPOCHS, seed: int = SEED, keep_text: bool = False) -> DataFrame:
    """docs with a struct ``mix``: size, source_size, target, repeats (times the row is taken) and taken.

    A null source is a source of its own; null texts have size 0 and are taken 0 words. Equal rows may tie in
    the seeded order; whichever comes first, the result is the same set of rows. Texts of any length count as
    they are; an empty table gives an empty mix. keep_text: carry all columns
    (one named mix is replaced), otherwise id and source.
    """
    keep = [c for c in docs.columns if c.lower() != "mix"] if keep_text else [id_col]
    source, size, draw, of, to, once = (fresh(docs, x) for x in ("source", "size", "draw", "of", "to", "once"))
    rows = docs.select(*map(col, keep), col(source_col).alias(source), word_count(col(text_col)).alias(size), drawn(seed, col(id_col), col(text_col)).alias(draw))
    rows = written(rows, "sized")
    bucket = F.pmod(col(draw), F.lit(BUCKETS)).cast("int")
    by_bucket = rows.groupBy(col(source).alias("source"), bucket.alias("bucket")).agg(F.sum(size).alias("words"))
    by_bucket = written(by_bucket, "buckets")
    aim = targets(by_bucket.groupBy("source").agg(F.sum("words").alias("source_size")), max_epochs)
    aim = aim.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    aim = aim.withColumn("rest", F.greatest(F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0)))
    order = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = by_bucket.withColumn("upto", F.sum("words").over(order)).alias("b").join(aim.select(F.col("source").alias("of"), "rest"), F.col("source").eqNullSafe(F.col("of")))
    ends = ends.groupBy("of").agg(F.min(F.when(F.col("upto") > F.col("rest"), F.struct("bucket", (F.col("upto") - F.col("words")).alias("before")))).alias("end"))
    aim = aim.join(ends, F.col("source").eqNullSafe(F.col("of")), "left").select(
        F.col("source").alias(of),
        F.struct("source_size", "target", "whole", "rest", F.coalesce(F.col("end.bucket"), F.lit(BUCKETS)).alias("last"), F.coalesce(F.col("end.before"), F.lit(0)).alias("before")).alias(to),
    )
    aim = written(aim, "targets")
    met, last = rows.join(aim, col(source).eqNullSafe(col(of))), F.col(f"{to}.last")
    held = Window.partitionBy(source).orderBy(draw, F.col(size).desc()).rowsBetween(Window.unboundedPreceding, -1)
    upto = F.col(f"{to}.before") + F.coalesce(F.sum(size).over(held), F.lit(0))
    inside = met.where(bucket == last).withColumn(once, F.when(upto + col(size) / 2 <= F.col(f"{to}.rest"), 1).otherwise(0))
    outside = met.where(bucket != last).withColumn(once, F.when(bucket < last, 1).otherwise(0))
    both = outside.unionByName(inside)
    times = (F.col(f"{to}.whole") + col(once)).cast("int")
    fields = [col(size).alias("size"), F.col(f"{to}.source_size").alias("source_size"), F.col(f"{to}.target").alias("target"), times.alias("repeats"), (col(size) * times).alias("taken")]
    return both.select(*map(col, keep), F.struct(*fields).alias("mix"))


def repeated(docs: DataFrame, **more) -> DataFrame:
    """The mix itself: each row of docs as often as it is taken, with the columns of docs."""
    own = next((c for c in docs.columns if c.lower() == "mix"), None)
    held, copy = fresh(docs, "held"), fresh(docs, "copy")
    found = mix(docs.withColumnRenamed(own, held) if own else docs, keep_text=True, **more).where("mix.repeats > 0")
    found = found.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col("mix.repeats"))))
    return found.select(*(col(held).alias(c) if c == own else col(c) for c in docs.columns))
