"""From a query form to DataFrame plans.

Filters are three-valued columns: true, false, and null for a cell that can't be read as the filter needs. From
them come, in one pass, the rows that match, the summary rows that would, and the rows left out unread.

Where only the rows that match are wanted, a filter is written as plain conditions instead, without a case for blank
cells: on a typed column a range, an equality or a test for null of the column as it is stored, beside the rounded
comparison, so that it reaches the scan; on text the test for null does.
"""

from __future__ import annotations

import datetime as dt
import re
from functools import reduce

from pyspark.sql import Column as Expr
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names, values
from ..model import AGGREGATES, LIMIT_MAX, NUMERIC, OPS, PROVENANCE_CAP, WINNER_CAP, Column, Filter, QueryError, QueryResult, QuerySpec, Region
from . import catalog

_COMPARE = {"gt": lambda a, b: a > b, "gte": lambda a, b: a >= b, "lt": lambda a, b: a < b, "lte": lambda a, b: a <= b, "eq": lambda a, b: a == b, "neq": lambda a, b: a != b}


def _stamp(d: dt.datetime) -> Expr:
    return F.lit(d.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")


def shared_year(region: Region, c: Column) -> int | None:
    """The one year of all dates of a column, or None."""
    r = region.df.where("not _is_summary").agg(F.min(F.year(f"d{c.i}")), F.max(F.year(f"d{c.i}"))).first()
    return r[0] if r and r[0] is not None and r[0] == r[1] else None


def _month_bound(region: Region, c: Column, op: str, value: str) -> tuple[str, str]:
    """gt, gte, lt or lte a month or a day without a year, as an instant."""
    if values.read_date(value, c.date_order):
        return op, value
    day, month = values.month_day(value, c.date_order), values.month_only(value)
    if not day and not month:
        return op, value
    said = f"{names.MONTHS[day[0] - 1]} {day[1]}" if day else names.MONTHS[month[0] - 1]
    year = month[1] if month and not day and month[1] else shared_year(region, c)
    if year is None:
        raise QueryError(f"Which year do you mean for {said}? The dates here span more than one.", f"Say it with the year, like {said}{',' if day else ''} 2026.")
    if day:
        return op, dt.datetime(year, *day).isoformat()
    n = month[0] + (1 if op in ("gt", "lte") else 0)
    first = dt.datetime(year + (n - 1) // 12, (n - 1) % 12 + 1, 1)
    return ("gte" if op in ("gt", "gte") else "lt"), first.isoformat()


def _slack(x: float) -> float:
    return abs(x) * 1e-11 + 1e-300


def _near(n: Expr, x: float) -> Expr:
    """Whether a number may be x when it is rounded."""
    return n.between(x - _slack(x), x + _slack(x))


def _numeric(n: Expr, op: str, x: float) -> Expr:
    """A comparison of the rounded value; a bare range decides all but the nearest values, and a scan can use it."""
    slack = _slack(x)
    exact = _COMPARE[op](values.tidy(n), F.lit(x))
    if op == "eq":
        return _near(n, x) & exact
    if op == "neq":
        return (n < x - slack) | (n > x + slack) | exact
    up = op in ("gt", "gte")
    return (n >= x - slack if up else n <= x + slack) & ((n > x + slack if up else n < x - slack) | exact)


def _stored(c: Column) -> Expr:
    """The column whose null is a blank cell."""
    return F.col({"number": "n", "date": "d", "boolean": "b", "integer": "v"}.get(c.typed, "c") + str(c.i))


def _span(d: Expr, first: dt.datetime, after: dt.datetime) -> Expr:
    return (d >= _stamp(first)) & (d < _stamp(after))


def one(region: Region, c: Column, op: str, value: str, bare: bool = False) -> Expr:
    """The outcome of one filter with one value; a blank cell is false for every operator here.

    bare: as a condition for where(), which takes null for false.
    """
    raw, stored = F.col(f"c{c.i}"), _stored(c)
    text, want = F.lower(values.trim(raw)), values.strip(value).lower()

    def guarded(e: Expr, told: bool = False) -> Expr:
        """told: e is true of no blank cell."""
        if bare:
            return e if c.typed and told else stored.isNotNull() & e if told or c.typed else stored.isNotNull() & ~values.blank(raw) & e
        return F.when(stored.isNotNull() if c.typed else ~values.blank(raw), e).otherwise(False)

    if op == "contains":
        return guarded(F.lower(raw).contains(want), want != "")
    signed = (lambda e: ~e) if op == "neq" else (lambda e: e)
    if op in ("eq", "neq"):
        if c.kind == "boolean" and values.py_truth(value) is not None:
            return guarded(signed(F.col(f"b{c.i}") == values.py_truth(value)), True)
        if c.kind == "date" and not values.read_date(value, c.date_order):
            month, day = values.month_only(value), values.month_day(value, c.date_order)
            d = F.col(f"d{c.i}")
            if month and month[1]:
                n, year = month
                return guarded(signed(_span(d, dt.datetime(year, n, 1), dt.datetime(year + n // 12, n % 12 + 1, 1))), True)
            if month:
                return guarded(signed(F.month(d) == month[0]), True)
            if day:
                return guarded(signed((F.month(d) == day[0]) & (F.dayofmonth(d) == day[1])), True)
        if c.identifier == "phone":
            digits = "".join(x for x in value.replace("+84", "0", 1) if x.isdigit()).lstrip("0")
            if len(digits) >= 6:
                return guarded(signed(values.phone(raw) == digits))
        if c.typed == "integer" and re.fullmatch(r"0|-?[1-9]\d{0,17}", want):
            return guarded(signed(stored == F.lit(int(want)).cast("long")), True)
    if c.kind in (*NUMERIC, "mixed"):
        x = values.spoken_number(value)
        if x is not None:
            return guarded(_numeric(F.col(f"n{c.i}"), op, x), True)
    if c.kind in ("date", "mixed"):
        d = values.read_date(value, c.date_order)
        if d is not None:
            return guarded(_COMPARE[op](F.col(f"d{c.i}"), _stamp(d)), True)
    if c.kind in (*NUMERIC, "date") and op not in ("eq", "neq"):
        what = "a date" if c.kind == "date" else "a number"
        raise QueryError(f'I can\'t read "{names.clean(value, 40)}" as {what}.', f"Say it as {what}, like {'July 4, 2026' if c.kind == 'date' else '1200'}.")
    return guarded(_COMPARE[op](text, F.lit(want)), op in ("eq", "gt", "gte") and want != "")


def outcome(region: Region, f: Filter, bare: bool = False) -> Expr:
    """true, false or null (unreadable) for each row; bare: as a condition for where(), which takes null for false."""
    if f.op not in OPS:
        raise QueryError(f'"{f.op}" is not a comparison.', f"Use one of {', '.join(OPS)}.")
    c = catalog.resolve(region, f.column)
    raw, stored = F.col(f"c{c.i}"), _stored(c)
    if f.op == "is_empty":
        return stored.isNull() if c.typed else values.blank(raw)
    if f.op == "is_not_empty":
        return stored.isNotNull() if c.typed else raw.isNotNull() & ~values.blank(raw)
    many = [v for v in (f.values or ()) if values.strip(v)]
    if not many and not values.strip(f.value or ""):
        raise QueryError(f"I need something to compare {c.name} with.", "Ask for the value.")
    if f.values and f.op in ("eq", "neq"):
        bare = bare and f.op == "eq"
        any_of = reduce(lambda a, b: a | b, (one(region, c, "eq", v, bare) for v in many))
        if bare and c.typed == "number" and all(values.spoken_number(v) is not None for v in many):  # apart, for the scan
            any_of = reduce(lambda a, b: a | b, (_near(F.col(f"n{c.i}"), values.spoken_number(v)) for v in many)) & any_of
        return ~any_of if f.op == "neq" else stored.isNotNull() & any_of if bare else any_of  # a blank cell passes "not in"
    op, value = f.op, f.value if f.value else many[0]
    if c.kind == "date" and op in ("gt", "gte", "lt", "lte"):
        op, value = _month_bound(region, c, op, value)
    return one(region, c, op, value, bare)


def states(region: Region, spec: QuerySpec) -> DataFrame:
    """The region's rows with _match, _skipped (summary rows) and _unread, and each filter's outcome _f<k>."""
    df = region.df
    outcomes = [outcome(region, f) for f in spec.filters]
    if not outcomes:
        return df.select("*", (~F.col("_is_summary")).alias("_match"), F.col("_is_summary").alias("_skipped"), F.lit(False).alias("_unread"))
    passes = reduce(lambda a, b: a & b, (F.coalesce(o, F.lit(True)) for o in outcomes))
    unread = reduce(lambda a, b: a | b, (o.isNull() for o in outcomes))
    return df.select(
        "*",
        (passes & ~unread & ~F.col("_is_summary")).alias("_match"),
        (passes & F.col("_is_summary")).alias("_skipped"),
        (passes & unread & ~F.col("_is_summary")).alias("_unread"),
        *(o.alias(f"_f{k}") for k, o in enumerate(outcomes)),
    )


def matching(region: Region, spec: QuerySpec) -> DataFrame:
    """The rows that count; the filters stand as such, for the scan to use."""
    df = region.df.where("not _is_summary")
    for f in spec.filters:
        df = df.where(outcome(region, f, bare=True))
    return df


def page(spec: QuerySpec) -> tuple[int, int]:
    return min(LIMIT_MAX, max(1, spec.limit)), max(0, spec.offset)


def listing(region: Region, spec: QuerySpec) -> DataFrame:
    """A page of rows in the order of the source."""
    if not region.ordered:
        raise QueryError("The rows of this table have no order, so there are no pages of them.", "Register it with a key that orders them.")
    limit, offset = page(spec)
    return matching(region, spec).orderBy("_row").offset(offset).limit(limit)


def measure(region: Region, spec: QuerySpec) -> Column:
    c = catalog.resolve(region, spec.column)
    if c.identifier == "row":
        raise QueryError(f"{c.name} only numbers the rows.", "Ask for a count instead.")
    if not c.measure:
        what = {"date": "dates", "boolean": "yes or no values"}.get(c.kind, "text")
        raise QueryError(f"{c.name} holds {what}, so it can't be {'added up' if spec.aggregate == 'sum' else 'measured'}.", "Pick a column of numbers.")
    return c


def key_of(region: Region, name: str) -> Expr:
    raw = F.col(f"c{catalog.resolve(region, name).i}")
    return F.when(values.blank(raw), F.lit("(blank)")).otherwise(raw)


def _value(spec: QuerySpec, n: Expr) -> Expr:
    return {"sum": values.tidy(F.sum(n)), "avg": values.tidy(F.sum(n) / F.count(n)), "min": F.min(n), "max": F.max(n)}[spec.aggregate]


def groups(region: Region, spec: QuerySpec) -> DataFrame:
    """(key, value, row_count, first_row) of all groups; numeric groups come from rows with a number only."""
    df = matching(region, spec).withColumn("key", key_of(region, spec.group_by))
    if spec.aggregate == "count":
        value, rows = F.count("*").cast("double"), F.count("*")
    else:
        n = F.col(f"n{measure(region, spec).i}")
        df, value, rows = df.where(n.isNotNull()), _value(spec, n), F.count("*")
    return df.groupBy("key").agg(value.alias("value"), rows.alias("row_count"), F.min("_row").alias("first_row"))


def ordered(found: DataFrame, spec: QuerySpec) -> DataFrame:
    """A page of groups by value, ties in the order of first appearance."""
    limit, offset = page(spec)
    value = F.col("value").asc_nulls_last() if spec.order == "asc" else F.col("value").desc_nulls_last()
    return found.orderBy(value, "first_row").offset(offset).limit(limit)


def totals(region: Region, spec: QuerySpec) -> DataFrame:
    """One row: matched, skipped, unread, value, numbers, empty and odd cells, and whether each filter ever holds."""
    s = states(region, spec)
    m = F.col("_match")
    out = [F.count_if(m).alias("matched"), F.count_if("_skipped").alias("skipped"), F.count_if("_unread").alias("unread")]
    out += [F.coalesce(F.max(F.col(f"_f{k}") & ~F.col("_is_summary")), F.lit(False)).alias(f"any_{k}") for k in range(len(spec.filters))]
    if spec.aggregate in ("sum", "avg", "min", "max"):
        c = measure(region, spec)
        raw, n = F.col(f"c{c.i}"), F.when(m, F.col(f"n{c.i}"))
        out += [_value(spec, n).alias("value"), F.count(n).alias("numbers"), F.count_if(m & values.blank(raw)).alias("empty_cells"), F.count_if(m & ~values.blank(raw) & F.col(f"n{c.i}").isNull()).alias("odd_cells")]
    elif spec.aggregate == "count":
        out += [F.count_if(m).cast("double").alias("value")]
    return s.agg(*out)


def winners(region: Region, spec: QuerySpec) -> DataFrame:
    """All rows that hold the least or the greatest value: one aggregate, met again by its value."""
    c = measure(region, spec)
    df = matching(region, spec).where(F.col(f"n{c.i}").isNotNull())
    best = df.agg(_value(spec, F.col(f"n{c.i}")).alias("_best"))
    return df.join(F.broadcast(best), F.col(f"n{c.i}") == F.col("_best")).drop("_best")


def address(region: Region, c: Column, row: Expr) -> Expr:
    return F.concat(F.lit(names.letters(c.i + region.origin[1])), (row + 1 + region.first_data_row).cast("string"))


def excluded(region: Region, spec: QuerySpec) -> DataFrame:
    """(_row, address, reason) of matched cells that are no numbers."""
    c = measure(region, spec)
    raw = F.col(f"c{c.i}")
    cut = F.when(F.length(raw) > 40, F.concat(F.substring(raw, 1, 40), F.lit("…"))).otherwise(raw)
    why = F.when(values.blank(raw), F.lit("empty")).otherwise(F.concat(F.lit('not a number ("'), cut, F.lit('")')))
    return matching(region, spec).where(F.col(f"n{c.i}").isNull()).select("_row", address(region, c, F.col("_row")).alias("address"), why.alias("reason"))


def evidence(region: Region, spec: QuerySpec) -> DataFrame:
    """(_row, address) of the cells that an aggregate rests on, in row order."""
    if spec.aggregate in ("count", "none"):
        c = region.columns[region.label or 0]
        df = matching(region, spec)
    else:
        c = measure(region, spec)
        df = matching(region, spec).where(F.col(f"n{c.i}").isNotNull())
    return df.select("_row", address(region, c, F.col("_row")).alias("address"))


def _record(region: Region, row) -> dict:
    return {"_row": row["_row"], **{c.name: row[f"c{c.i}"] for c in region.columns}}


def run(region: Region, spec: QuerySpec) -> QueryResult:
    """The answer with what it rests on. Only pages, capped lists and one row of totals reach the driver."""
    if spec.aggregate not in AGGREGATES:
        raise QueryError(f'"{spec.aggregate}" is not something I can work out.', f"Use one of {', '.join(AGGREGATES)}.")
    if spec.aggregate not in ("none", "count"):
        measure(region, spec)
    _refuse_unknown_dates(region, spec)
    limit, offset = page(spec)
    t = totals(region, spec).first().asDict()
    result = QueryResult(spec.aggregate, t.get("value"), t["matched"], [], [], 0, [], 0, [], 0, [], 0, t["skipped"], t["unread"], None, None, [])
    if t["matched"] == 0:
        result.first_empty_filter = next((k for k in range(len(spec.filters)) if not t[f"any_{k}"]), None)
    if spec.aggregate == "none":
        rows = listing(region, spec).collect()
        result.rows = [_record(region, r) for r in rows]
        result.next_offset = offset + len(rows) if offset + len(rows) < t["matched"] else None
        result.cells = [names.a1(int(r["_row"]) + region.first_data_row, c.i + region.origin[1]) for r in rows for c in region.columns][:PROVENANCE_CAP]
        result.cell_count = len(rows) * len(region.columns)
        return result
    c = result.column = measure(region, spec) if spec.aggregate != "count" else None
    if spec.group_by:
        found = groups(region, spec).persist()  # asked twice, read once
        try:
            size = found.agg(F.count("*").alias("n"), F.max("row_count").alias("most")).first()
            result.groups = [{"key": r["key"], "value": r["value"], "row_count": r["row_count"]} for r in ordered(found, spec).collect()]
        finally:
            found.unpersist()
        result.group_count, result.one_row_each, result.value = size["n"], size["most"] == 1, None
        end = offset + len(result.groups)
        result.next_offset = end if end < size["n"] else None
        most = size["most"] or 0
    else:
        most = t.get("numbers", 0)
    if spec.aggregate == "sum":
        why = names.rate(c, region.columns)
        if why and names.caution(why):
            result.notes.append(f"{c.name} is {why}, so its total may mean little.")
        elif why and most > 1:
            raise QueryError(f"{c.name} is {why}, so it has no real total.", "Ask for the average instead.")
    if spec.aggregate in ("min", "max") and not spec.group_by:
        best = winners(region, spec)
        result.winner_count = best.count()
        result.winners = [_record(region, r) for r in best.orderBy("_row").limit(WINNER_CAP).collect()]
    if region.ordered:  # else rows have no addresses
        result.cells = [r["address"] for r in evidence(region, spec).orderBy("_row").limit(PROVENANCE_CAP).collect()]
    result.cell_count = t["matched"] if spec.aggregate == "count" else t["numbers"]
    if c:
        result.excluded_count = t["empty_cells"] + t["odd_cells"]
        if result.excluded_count and region.ordered:
            result.excluded = [(r["address"], r["reason"]) for r in excluded(region, spec).orderBy("_row").limit(PROVENANCE_CAP).collect()]
    return result


def _refuse_unknown_dates(region: Region, spec: QuerySpec) -> None:
    """An equality with something that is no date needs a cell that holds that text."""
    for f in spec.filters:
        if f.op not in ("eq", "neq"):
            continue
        c = catalog.resolve(region, f.column)
        if c.kind != "date":
            continue
        for v in f.values or ((f.value,) if f.value else ()):
            if values.read_date(v, c.date_order) or values.month_only(v) or values.month_day(v, c.date_order):
                continue
            if region.df.where(F.lower(values.trim(F.col(f"c{c.i}"))) == values.strip(v).lower()).isEmpty():
                raise QueryError(f'I can\'t read "{names.clean(v, 40)}" as a date.', "Say it like July 4, 2026.")
