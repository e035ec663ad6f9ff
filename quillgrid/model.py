"""What questions are made of: columns, regions, filters, query forms and results."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

OPS = ("eq", "neq", "gt", "gte", "lt", "lte", "contains", "is_empty", "is_not_empty")
AGGREGATES = ("none", "count", "sum", "avg", "min", "max")
NUMERIC = ("number", "currency", "percent")
PROVENANCE_CAP, WINNER_CAP, LIMIT_MAX = 200, 5, 50


class QueryError(ValueError):
    """A question that can't be answered as put; ``next_step`` says what would help, ``missing`` an absent name."""

    def __init__(self, message: str, next_step: str = "", missing: str | None = None):
        super().__init__(message)
        self.message, self.next_step, self.missing = message, next_step, missing


@dataclass
class Column:
    """A column of a region. typed: what its cells are without being read ("number", "date", "boolean", "integer" for
    one that is asked by its text), where the source has a type; such a cell is blank only if it is null."""

    i: int
    letter: str
    path: tuple[str, ...]
    spoken: str
    kind: str
    measure: bool = False
    date_order: str = "mdy"
    identifier: str | None = None
    number_note: str | None = None
    typed: str | None = None
    profile: dict[str, Any] = field(default_factory=dict)

    @property
    def name(self) -> str:
        return " ".join(" ".join(self.path).replace(",", " ").split()) or f"column {self.letter}"


@dataclass
class Region:
    """A queryable table. ``df`` has _row, _is_summary, and for column i its text c<i>, number n<i>, instant d<i>,
    truth b<i>, and the typed value v<i> of integers that are asked by their text."""

    id: str
    title: str
    columns: list[Column]
    df: Any
    label: int | None = None
    first_data_row: int = 1
    row_count: int | None = None
    summary_rows: tuple[int, ...] = ()
    sheet: str = ""
    warnings: tuple[str, ...] = ()
    structure: dict[str, Any] = field(default_factory=dict)
    inherited: dict[str, str] = field(default_factory=dict)
    raw: list[list[Any]] | None = None
    origin: tuple[int, int] = (0, 0)
    revision: int = 0
    #: How a file's cells were read: order of dates, convention of numbers, merges of the table.
    reading: dict[str, Any] = field(default_factory=dict)
    #: Whether _row is the same in every run; else no answer rests on the order of rows.
    ordered: bool = True


@dataclass(frozen=True)
class Filter:
    column: str
    op: str
    value: str | None = None
    values: tuple[str, ...] | None = None


@dataclass(frozen=True)
class QuerySpec:
    filters: tuple[Filter, ...] = ()
    aggregate: str = "none"
    column: str | None = None
    group_by: str | None = None
    order: str = "desc"
    limit: int = 5
    offset: int = 0


@dataclass
class QueryResult:
    aggregate: str
    value: float | None
    matched: int
    rows: list[dict[str, Any]]
    groups: list[dict[str, Any]]
    group_count: int
    winners: list[dict[str, Any]]
    winner_count: int
    cells: list[str]
    cell_count: int
    excluded: list[tuple[str, str]]
    excluded_count: int
    skipped_summary: int
    unreadable: int
    first_empty_filter: int | None
    next_offset: int | None
    notes: list[str]
    column: Column | None = None
    one_row_each: bool = False
