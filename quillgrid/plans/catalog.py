"""Regions by name: DataFrames registered as tables, and the columns that a question means."""

from __future__ import annotations

import re

from pyspark.sql import Column as Expr
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names, values
from ..model import Column, QueryError, Region

_SPARK_NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")


def _kind(name: str, spark_type: str) -> tuple[str, str | None]:
    if spark_type in ("timestamp", "timestamp_ntz", "date"):
        return "date", None
    if spark_type == "boolean":
        return "boolean", None
    if spark_type in _SPARK_NUMBERS or spark_type.startswith("decimal"):
        code = names.identifier_kind(name)
        return ("text", code) if code else ("number", None)
    return "text", names.identifier_kind(name)


def region_of(df: DataFrame, id: str, order_by: str | Expr | None = None, kinds: dict[str, str] | None = None, orders: dict[str, str] | None = None, label: str | None = None, summary: Expr | None = None, columns: list[str] | None = None) -> Region:
    """A DataFrame as a region, without reading it.

    ``order_by`` gives the source order (a unique key); without it rows have no order, pages and addresses. ``kinds``
    overrides what the types say, so text columns may be read as numbers, currency, percent, dates or truth words.
    Typed columns stay as they are, so that filters on them reach the scan.
    """
    columns = columns or df.columns
    types, out, found = dict(df.dtypes), [], []
    order = (F.col(order_by) if isinstance(order_by, str) else order_by) if order_by is not None else F.monotonically_increasing_id()
    select = [order.cast("long").alias("_row"), (summary if summary is not None else F.lit(False)).alias("_is_summary")]
    for i, name in enumerate(columns):
        c, spark_type = F.col(f"`{name}`"), types[name]
        kind, code = _kind(name, spark_type)
        kind = (kinds or {}).get(name, kind)
        numeric = spark_type in _SPARK_NUMBERS or spark_type.startswith("decimal")
        day_order = (orders or {}).get(name, "mdy")
        if numeric:
            raw = values.js_string(c, spark_type)
        elif spark_type in ("timestamp", "timestamp_ntz"):
            raw = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
        else:
            raw = c.cast("string")
        select.append(raw.alias(f"c{i}"))
        if kind in ("number", "currency", "percent", "mixed"):
            select.append((c.cast("double") if numeric else values.number(raw)).alias(f"n{i}"))
        if kind in ("date", "mixed"):
            select.append((c.cast("timestamp_ntz") if spark_type in ("timestamp", "timestamp_ntz", "date") else values.date(raw, day_order)).alias(f"d{i}"))
        if kind == "boolean":
            select.append((c if spark_type == "boolean" else values.truth(raw)).alias(f"b{i}"))
        typed = None
        if numeric and kind in ("number", "currency", "percent"):
            typed = "number"
        elif numeric and "int" in spark_type:
            typed = "integer"
            select.append(c.cast("long").alias(f"v{i}"))
        elif spark_type in ("timestamp", "timestamp_ntz", "date") and kind == "date":
            typed = "date"
        elif spark_type == "boolean" and kind == "boolean":
            typed = "boolean"
        column = Column(i, names.letters(i), (name,), names.spoken(name), kind, kind in ("number", "currency", "percent"), day_order, code, typed=typed)
        out.append(column)
        if label == name:
            found.append(i)
    if not found:
        found = [c.i for c in out if c.kind == "text" and not c.identifier][:1]
    return Region(id, names.title(id), out, df.select(*select), found[0] if found else None, ordered=order_by is not None)


class Catalog:
    """Tables by id, each with its regions."""

    def __init__(self):
        self.tables: dict[str, list[Region]] = {}
        self.titles: dict[str, str] = {}

    def add(self, table: str, regions: list[Region], title: str | None = None) -> str:
        taken = set(self.tables)
        own = names.unique(names.slug(table, False), taken)
        said = {t.lower() for t in self.titles.values()}
        self.titles[own] = names.unique(title or names.title(table), said, " ")
        self.tables[own] = regions
        return own

    def register(self, name: str, df: DataFrame, **more) -> Region:
        region = region_of(df, name, **more)
        self.add(name, [region])
        return region

    def locate(self, table: str | None = None, sheet: str | None = None) -> Region:
        """A region by table id or title, and by sheet, region id, title or spoken number."""
        if not self.tables:
            raise QueryError("No tables are loaded.", "Load a file first.")
        if table is None:
            key = next(iter(self.tables))
        else:
            want = names.norm(table)
            hits = [k for k in self.tables if k == table or want in (names.norm(k), names.norm(self.titles[k]))]
            if not hits:
                raise QueryError(f'There is no table called "{names.clean(table, 60)}".', f"The tables are: {', '.join(self.titles.values())}.", table)
            key = hits[0]
        regions = self.tables[key]
        if sheet is None:
            return regions[0]
        n = _spoken_index(sheet)
        if n is not None and 1 <= n <= len(regions):
            return regions[n - 1]
        want = names.norm(sheet)
        hits = [r for r in regions if sheet == r.id or want in (names.norm(r.id), names.norm(r.sheet), names.norm(r.title))]
        if not hits:
            raise QueryError(f'There is no sheet or table called "{names.clean(sheet, 60)}" there.', f"There are: {', '.join(r.title for r in regions)}.", sheet)
        return hits[0]


def _spoken_index(text: str) -> int | None:
    words = {"first": 1, "one": 1, "second": 2, "two": 2, "third": 3, "three": 3, "fourth": 4, "four": 4, "fifth": 5, "five": 5}
    m = re.fullmatch(r"(?:the\s+)?(?:(?:table|region|sheet)\s+)?(?:number\s+)?(\d{1,3}|[a-z]+)(?:\s+(?:table|region|one))?", text.strip().lower())
    return None if not m else int(m[1]) if m[1].isdigit() else words.get(m[1])


def _forms(c: Column) -> list[str]:
    return [c.spoken, c.name, c.path[-1] if c.path else "", ", ".join(c.path), " ".join(c.path)]


def matches(region: Region, name: str) -> list[Column]:
    """All columns that a name means, by the first stage that finds any: spoken names, all forms, the same without
    punctuation, all words of the name in the heading, and "column C" or "column 3"."""
    plain, n, columns = names.clean(name).lower(), names.norm(name), region.columns
    low = lambda s: names.clean(s).lower()
    stages = [
        ([c for c in columns if plain in (low(c.spoken), low(c.name))], True),
        ([c for c in columns if plain in map(low, _forms(c))], False),
        ([c for c in columns if names.norm(c.spoken) == n], True),
        ([c for c in columns if n in map(names.norm, _forms(c))], False),
        ([c for c in columns if set(n.split()) <= set(names.norm(" ".join((*c.path, c.spoken))).split())], False),
    ]
    for hits, only_one in stages:
        if len(hits) == 1 or (hits and not only_one):
            return hits
    m = re.fullmatch(r"col(?:umn)?\s+(?:([a-z]{1,3})|(\d{1,3}))", plain)
    if m:
        return [c for c in columns if (c.letter.lower() == m[1] if m[1] else c.i == int(m[2]) - 1)]
    return []


def listing(columns: list[Column], most: int = 8) -> str:
    said = [names.clean(c.name, 60) for c in columns if c.kind != "empty" or c.path]
    if len(said) > most:
        said = [*said[:most], f"{len(said) - most} more"]
    return said[0] if len(said) == 1 else f"{', '.join(said[:-1])} and {said[-1]}" if said else ""


def resolve(region: Region, name: str | None) -> Column:
    if not names.clean(name or ""):
        raise QueryError("No column name was given.", "Ask which column they mean.")
    hits = matches(region, name)
    if not hits:
        raise QueryError(f'This table has no column called "{names.clean(name, 60)}".', f"The columns are: {listing(region.columns)}.", names.clean(name, 60))
    if len(hits) > 1:
        raise QueryError(f'"{names.clean(name, 60)}" matches {len(hits)} columns in this table.', f"Ask which one: {listing(hits)}.")
    return hits[0]
