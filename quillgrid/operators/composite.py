"""Questions that take several steps elsewhere, as one plan each."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names, values
from ..model import QueryError, QuerySpec, Region
from ..plans import catalog, compile


def compare(left: Region, left_column: str, right: Region, right_column: str, aggregate: str | None = None, filters=()) -> DataFrame:
    """One row: left_value, right_value, difference, direction, percent (of the right). Average if a side is a rate, else sum."""
    a, b = catalog.resolve(left, left_column), catalog.resolve(right, right_column)
    how = aggregate or ("avg" if names.rate(a, left.columns) or names.rate(b, right.columns) else "sum")
    if how not in ("sum", "avg", "min", "max"):
        raise QueryError(f'"{how}" can\'t be compared.', "Compare sums, averages, least or greatest values.")
    side = lambda r, c, n: compile.totals(r, QuerySpec(tuple(filters), how, c)).select(F.col("value").alias(n))
    both = side(left, left_column, "left_value").join(F.broadcast(side(right, right_column, "right_value")))
    difference = values.tidy(F.col("left_value") - F.col("right_value"))
    near = F.abs(F.col("left_value") - F.col("right_value")) <= 1e-12 * F.greatest(F.abs("left_value"), F.abs("right_value"))
    direction = F.when(near, "equal").when(F.col("left_value") > F.col("right_value"), "more").otherwise("less")
    percent = F.when(F.col("right_value") != 0, values.tidy((F.col("left_value") - F.col("right_value")) / F.abs("right_value") * 100))
    return both.select("left_value", "right_value", F.when(near, 0.0).otherwise(difference).alias("difference"), direction.alias("direction"), percent.alias("percent"))


def having(region: Region, spec: QuerySpec, op: str, value: float) -> DataFrame:
    """Groups whose value passes a comparison; however many there are."""
    return compile.groups(region, spec).where(compile._COMPARE[op](F.col("value"), F.lit(float(value))))


def top(region: Region, spec: QuerySpec, n: int) -> DataFrame:
    return compile.ordered(compile.groups(region, spec), replace(spec, limit=n, offset=0))


def nth_place(region: Region, spec: QuerySpec, n: int) -> DataFrame:
    """The rows with the n-th greatest (or, ascending, least) value of the measure; equal values share a place.

    The place is found among the distinct values, of which no more than n are kept.
    """
    c = compile.measure(region, spec)
    rows = compile.matching(region, spec).where(F.col(f"n{c.i}").isNotNull())
    order = F.col(f"n{c.i}").asc() if spec.order == "asc" else F.col(f"n{c.i}").desc()
    first = rows.select(f"n{c.i}").distinct().orderBy(order).limit(n)
    pick = F.max(f"n{c.i}") if spec.order == "asc" else F.min(f"n{c.i}")
    place = first.agg(F.when(F.count("*") == n, pick).alias("_place"))
    return rows.join(F.broadcast(place), F.col(f"n{c.i}") == F.col("_place")).drop("_place")


def best_per_group(region: Region, spec: QuerySpec) -> DataFrame:
    """The rows that hold each group's greatest (or least) value: an aggregate joined back, not a sort of groups."""
    c = compile.measure(region, spec)
    rows = compile.matching(region, spec).where(F.col(f"n{c.i}").isNotNull()).withColumn("key", compile.key_of(region, spec.group_by))
    best = rows.groupBy("key").agg((F.min if spec.order == "asc" else F.max)(f"n{c.i}").alias("_best"))
    return rows.join(best, "key").where(F.col(f"n{c.i}") == F.col("_best")).drop("_best")


def than_row(region: Region, column: str, op: str, key_column: str, key: str, filters=()) -> DataFrame:
    """Rows whose number or date compares with that of the row named by a key; asks if several rows have the name."""
    c, k = catalog.resolve(region, column), catalog.resolve(region, key_column)
    typed = f"d{c.i}" if c.kind == "date" else f"n{c.i}"
    named = region.df.where("not _is_summary").where(compile.one(region, k, "eq", key, bare=True))
    if len(named.limit(2).collect()) > 1:
        raise QueryError(f'Several rows are called "{names.clean(key, 40)}".', "Ask which one they mean.")
    other = named.select(F.col(typed).alias("_other"))
    return compile.matching(region, QuerySpec(tuple(filters))).join(F.broadcast(other.limit(1)), compile._COMPARE[op](F.col(typed), F.col("_other"))).drop("_other")


def than_average(region: Region, column: str, op: str = "gt", filters=()) -> DataFrame:
    c = catalog.resolve(region, column)
    rows = compile.matching(region, QuerySpec(tuple(filters)))
    mean = compile.matching(region, QuerySpec()).agg(F.avg(f"n{c.i}").alias("_mean"))
    return rows.join(F.broadcast(mean), compile._COMPARE[op](F.col(f"n{c.i}"), F.col("_mean"))).drop("_mean")


def same_group(region: Region, column: str, key_column: str, key: str, exclude_self: bool = True) -> DataFrame:
    """Rows that share a column's value with the row named by a key."""
    c, k = catalog.resolve(region, column), catalog.resolve(region, key_column)
    rows = region.df.where("not _is_summary")
    hit = compile.one(region, k, "eq", key)
    value = lambda: F.lower(values.trim(F.col(f"c{c.i}")))
    found = rows.withColumn("_value", value()).join(rows.where(hit).select(value().alias("_value")).distinct(), "_value", "left_semi").drop("_value")
    return found.where(~hit) if exclude_self else found


def distinct_values(region: Region, column: str) -> DataFrame:
    c = catalog.resolve(region, column)
    return compile.matching(region, QuerySpec()).where(~values.blank(F.col(f"c{c.i}"))).select(F.col(f"c{c.i}").alias("value")).distinct()


def count_groups(region: Region, column: str) -> DataFrame:
    return distinct_values(region, column).agg(F.count("*").alias("groups"))


def profile(region: Region, column: str) -> DataFrame:
    """One row: cells filled, empty, distinct, not numbers; least, greatest, sum and mean."""
    c = catalog.resolve(region, column)
    raw, m = F.col(f"c{c.i}"), ~F.col("_is_summary")
    out = [F.count_if(m & ~values.blank(raw)).alias("non_empty"), F.count_if(m & values.blank(raw)).alias("empty"), F.count_distinct(F.when(m & ~values.blank(raw), values.trim(raw))).alias("distinct")]
    if c.measure:
        n = F.when(m, F.col(f"n{c.i}"))
        out += [F.count_if(m & ~values.blank(raw) & F.col(f"n{c.i}").isNull()).alias("non_numeric"), F.min(n).alias("least"), F.max(n).alias("greatest"), values.tidy(F.sum(n)).alias("sum"), values.tidy(F.avg(n)).alias("mean")]
    return region.df.agg(*out)


def breakdown(region: Region) -> str | None:
    """The column to break a table down by: of repeating ones that are no measures or dates, that with fewest values."""
    usable = [c for c in region.columns if c.kind in ("text", "category", "boolean") and not c.identifier]
    if not usable:
        return None
    counts = region.df.where("not _is_summary").agg(F.count("*").alias("n"), *(F.count_distinct(f"c{c.i}").alias(f"k{c.i}") for c in usable)).first()
    some = [(counts[f"k{c.i}"], c.i, c.name) for c in usable if 1 < counts[f"k{c.i}"] < counts["n"]]
    return min(some)[2] if some else None


def running_totals(df: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """Sums of a group up to each row, by which subtotals are told."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("running", values.tidy(F.sum(value).over(w)))
