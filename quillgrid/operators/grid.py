"""One sheet's structure: its tables, merged cells, headings and summary rows.

These are judgements about a single sheet, made in order from evidence; many sheets are read side by side.
"""

from __future__ import annotations

import datetime as dt
import math
import re
from dataclasses import dataclass, field

from ..functions import names, values

blank = values.is_blank
MAX_HEADER, MIN_SCORE, SURE = 5, 0.5, 0.7


def is_number(v) -> bool:
    return values.read_number(v) is not None


def is_date(v) -> bool:
    return isinstance(v, dt.datetime) or (isinstance(v, str) and values.read_date(v) is not None)


# ---- tables of a sheet ------------------------------------------------------------------------------------


def _runs(flags: list[bool]) -> list[tuple[int, int]]:
    out, start = [], None
    for i, f in enumerate([*flags, False]):
        if f and start is None:
            start = i
        elif not f and start is not None:
            out.append((start, i - 1))
            start = None
    return out


def regions(grid: list[list]) -> list[tuple[int, int, int, int]]:
    """(top, left, bottom, right) of the tables: blocks of rows between blank ones, parted at columns that are blank
    throughout a block, trimmed; a block right of a blank column that goes on with figures for the same rows is joined."""
    width = max(map(len, grid), default=0)
    at = lambda r, c: grid[r][c] if c < len(grid[r]) else None
    out = []
    for top, bottom in _runs([any(not blank(v) for v in row) for row in grid]):
        parts = _runs([any(not blank(at(r, c)) for r in range(top, bottom + 1)) for c in range(width)])
        joined: list[tuple[int, int]] = []
        for left, right in parts:
            if joined and _continues(grid, top, bottom, joined[-1], (left, right)):
                joined[-1] = (joined[-1][0], right)
            else:
                joined.append((left, right))
        for left, right in joined:
            filled = [r for r in range(top, bottom + 1) if any(not blank(at(r, c)) for c in range(left, right + 1))]
            out.append((filled[0], left, filled[-1], right))
    return out


def _continues(grid, top, bottom, a, b) -> bool:
    filled = lambda p: [r for r in range(top, bottom + 1) if any(not blank(v) for v in grid[r][p[0] : p[1] + 1])]
    rows = filled(b)
    if rows != filled(a) or len(rows) < 2:
        return False
    body = [grid[r][c] for r in rows[1:] for c in range(b[0], b[1] + 1) if not blank(grid[r][c])]
    heads = [str(grid[rows[0]][c] or "") for c in range(b[0], b[1] + 1)]
    return bool(body) and all(is_number(v) or is_date(v) for v in body) and not any(names.identifier_kind(h) for h in heads)


def fill(grid: list[list], merges) -> tuple[list[list], dict[str, str]]:
    """Blank cells of merges take the anchor's value; (grid, address of a filled cell -> of its anchor)."""
    grid, origin = [list(r) for r in grid], {}
    width = max(map(len, grid), default=0)
    for row in grid:
        row.extend([None] * (width - len(row)))
    for top, left, bottom, right in merges:
        value = grid[top][left] if top < len(grid) and left < width else None
        if blank(value):
            continue
        for r in range(top, min(bottom, len(grid) - 1) + 1):
            for c in range(left, min(right, width - 1) + 1):
                if (r, c) != (top, left) and (blank(grid[r][c]) or grid[r][c] == value):
                    grid[r][c] = value
                    origin[names.a1(r, c)] = names.a1(top, left)
    return grid, origin


# ---- headings ---------------------------------------------------------------------------------------------


@dataclass
class Header:
    rows: int
    score: float
    why: str
    alternatives: list[tuple[int, float, str]] = field(default_factory=list)
    ambiguous: bool = False


def _numbering(row: list) -> bool:
    """(1) (2) (3 = 1 + 2): a row that numbers the columns."""
    told = [str(v).strip() for v in row if not blank(v)]
    found = [re.fullmatch(r"\((\d+)(?:\s*=.*)?\)|([A-Z]|\d+)", t) for t in told]
    marks = [m[1] or m[2] for m in found if m]
    return len(told) >= 2 and len(marks) == len(told) and all(t.startswith("(") for t in told) and marks == [str(i + int(marks[0])) for i in range(len(marks))]


def _rises(row: list) -> bool:
    """A label and then years that follow each other: headings that look like figures."""
    filled = [v for v in row if not blank(v)]
    years = [n.value for v in filled[1:] if (n := values.read_number(v)) and n.style == "plain"]
    return len(years) >= 2 and len(years) == len(filled) - 1 and not is_number(filled[0]) and 1900 <= years[0] <= years[-1] <= 2100 and all(y == years[0] + k for k, y in enumerate(years))


class Evidence:
    """Per row of a table's top: the typed columns beneath it, and how many of its cells are of another or of the same kind.

    A column is typed from a row on if most filled cells beneath are figures (numbers or dates) or truth words. Counts
    are carried upward from the last row, so a table is looked through once.
    """

    FIGURES, WORDS_OF_TRUTH, FEW = 0.7, 0.9, 3

    def __init__(self, rows: list[list], depth: int):
        width = len(rows[0])
        self.rows, self.depth = rows, depth
        self.typed, self.other, self.alike = [0] * depth, [0] * depth, [0] * depth
        filled, figures, truths = [0] * width, [0] * width, [0] * width
        for i in range(len(rows) - 1, -1, -1):
            for c, v in enumerate(rows[i]):
                if blank(v):
                    continue
                figure, truth = is_number(v) or is_date(v), values.py_truth(v) is not None
                n = filled[c]
                if i < depth and n:
                    flags = n >= self.FEW and truths[c] > self.WORDS_OF_TRUTH * n
                    if flags or figures[c] > self.FIGURES * n:
                        self.typed[i] += 1
                        same = truth if flags else figure
                        hidden = not same and isinstance(v, str) and values.PLACEHOLDER.match(v.strip()) is not None
                        self.alike[i] += same
                        self.other[i] += not same and not hidden
                filled[c] += 1
                figures[c] += figure
                truths[c] += truth

    def balance(self, i: int) -> float:
        """1: all cells over typed columns are labels; -1: all are of their columns' kind; 0 without typed columns."""
        return (self.other[i] - self.alike[i]) / self.typed[i] if self.typed[i] else 0.0

    def density(self, i: int) -> float:
        return sum(not blank(v) for v in self.rows[i]) / len(self.rows[i])

    def labels(self, i: int) -> float:
        """How well a row reads as labels by itself, 0 to 1: words, each once, and short."""
        cells = [v for v in self.rows[i] if not blank(v)]
        if not cells:
            return 0.0
        told = [str(v).strip().lower() for v in cells]
        words = sum(not is_number(v) and not is_date(v) for v in cells) / len(cells)
        return words * len(set(told)) / len(told) * min(1.0, 32 * len(told) / max(1, sum(map(len, told))))

    def scattered(self, i: int) -> bool:
        """Labels with gaps after them, as a file without merges writes headings of several columns."""
        at = [c for c, v in enumerate(self.rows[i]) if not blank(v)]
        return 2 <= len(at) <= len(self.rows[i]) / 2 and at[-1] - at[0] >= len(at)


def header(grid: list[list], box, merges=()) -> Header:
    """The number of heading rows, with the reason, other readings, and whether to ask.

    A table with typed columns is read by kinds: the row that most sets itself off from what is beneath it names the
    columns, and the rows over it belong to it. A table of words only offers little, so its first row is taken for
    labels and the listener is asked. A row beneath joins only where the row above visibly groups it.
    """
    top, left, bottom, right = box
    rows = [[grid[r][c] for c in range(left, right + 1)] for r in range(top, bottom + 1)]
    depth = min(MAX_HEADER, len(rows) - 1)
    if depth < 1:
        return Header(0, 0.5, "there is one row only", [(1, 0.5, "take that row for headings")], True)
    corner = [next((str(v).strip().lower() for v in r if not blank(v)), "") for r in rows[:2]]
    if len(rows) > 2 and re.match(r"(?:sum|count|average|max|min) of ", corner[0]) and corner[1] == "row labels":
        return Header(2, 0.95, "a pivot table has two heading rows")
    e = Evidence(rows, depth)
    by_kind = any(e.typed)
    rank = [(e.balance(i), e.other[i]) if by_kind else (e.labels(i) if i == 0 or e.scattered(i - 1) else 0.0, 0) for i in range(depth)]
    names_at = max(range(depth), key=lambda i: (*rank[i], -i))
    if rank[names_at][0] < MIN_SCORE:
        return _without(e, rank[names_at][0])
    last = names_at
    spanning = lambda i: any(m[0] <= top + i <= m[2] and m[1] < m[3] for m in merges)
    while last + 1 < depth and (rank[last + 1][0] >= MIN_SCORE) and (spanning(last) or (e.density(last) < e.density(last + 1) if by_kind else e.scattered(last))):
        last += 1
    n = last + 1
    said = "its cells are words over figures" if by_kind else "it reads as labels"
    why = said if n == 1 else f"{said}, with {n - 1} row{'s' if n > 2 else ''} of groups above"
    if n < depth and _numbering(rows[n]):
        n, why = n + 1, f"{why}; the row beneath numbers the columns"
    score = 0.5 + 0.5 * rank[last][0] * max(0.5, e.labels(last)) if by_kind else 0.55 * rank[last][0]
    out = Header(n, score, why, ambiguous=score < SURE)
    if out.ambiguous:
        out.alternatives = [(k, s, w) for k, s, w in ((1, 0.5, "take the first row alone"), (0, 1 - score, "take all rows as data"), (n + 1, 0.4, "take one row more for headings")) if k != n and k <= depth]
    if n < depth and _rises(rows[n]):
        out.alternatives = [(n + 1, 0.5, "take the row of years for headings too"), *(x for x in out.alternatives if x[0] != n + 1)]
        out.ambiguous = True
    return out


def _without(e: Evidence, strength: float) -> Header:
    """No row sets itself off; headings that are years, dates or other figures can't, so those are asked about."""
    out = Header(0, 1 - max(0.0, strength), "no row sets itself off from those beneath")
    first = [v for v in e.rows[0] if not blank(v)]
    figures = sum(is_number(v) or is_date(v) for v in first)
    if e.depth > 1 and _rises(e.rows[1]):
        out.alternatives = [(2, 0.5, "take the row of years for headings too")]
    elif first and (figures == len(first) or _rises(e.rows[0]) or (figures >= 2 and is_date(first[-1]) and not is_date(first[0]) and e.alike[0])):
        out.alternatives = [(1, 0.5, "take the first row for labels, such as years or dates")]
    elif e.labels(0) > 0.35:
        out.alternatives = [(1, e.labels(0), "take the first row for labels")]
    if out.alternatives:
        out.ambiguous, out.score = True, min(out.score, 0.65)
    return out


def paths(grid: list[list], box, n: int) -> list[tuple[str, ...]]:
    """The headings above each column, blank levels left out and repeats told once; a label above blanks to its
    right covers them where they are named beneath."""
    top, left, _, right = box
    levels = [[grid[top + i][c] for c in range(left, right + 1)] for i in range(n)]
    for i in range(n - 1):
        carried = None
        for c in range(len(levels[i])):
            if not blank(levels[i][c]):
                carried = levels[i][c]
            elif carried is not None and c and not blank(levels[n - 1][c]) and not blank(levels[n - 1][c - 1]):
                levels[i][c] = carried
    out, seen = [], set()
    for c in range(right - left + 1):
        path: list[str] = []
        for level in levels:
            v = level[c]
            text = "" if blank(v) else f"{names.MONTHS[v.month - 1]} {v.year}" if isinstance(v, dt.datetime) else str(v).strip()
            if text and (not path or path[-1] != text):
                path.append(text)
        if path:
            key, k = " ".join(path).lower(), 2
            stem = path[-1]
            while key in seen:
                path[-1] = f"{stem} {k}"
                key, k = " ".join(path).lower(), k + 1
            seen.add(key)
        out.append(tuple(path))
    return out


# ---- summary rows -----------------------------------------------------------------------------------------

# Words of total and statistic rows.
TOTAL = re.compile(r"^(?:(?:grand|sub)[\s-]*)?totals?\s*:?$|^tổng(?:\s+(?:cộng|số))?\s*:?$|^cộng\s*:?$", re.I)
GROUP_TOTAL = re.compile(r"^(?P<a>.+?)\s+totals?\s*:?$|^totals?\s+(?:of\s+|for\s+)?(?P<b>.+?)\s*:?$|^(?:tổng(?:\s+cộng)?|cộng)\s+(?P<c>.+?)\s*:?$", re.I)
NET = re.compile(r"^net\s+\S", re.I)
STATISTICS = {"mean": r"averages?|avg|mean|trung\s+bình", "count": r"count|số\s+lượng", "max": r"max(?:imum)?|highest|lớn\s+nhất", "min": r"min(?:imum)?|lowest|nhỏ\s+nhất"}


def same(a: float, b: float) -> bool:
    return abs(a - b) <= max(0.005, abs(a) * 1e-9, abs(b) * 1e-12)


def shows(told: float, value: float) -> bool:
    """Whether a figure tells a value, rounded to as many places as the figure is written with."""
    places = len(repr(told).partition(".")[2].rstrip("0")) if "e" not in repr(told) else 6
    return same(told, value) or abs(told - value) <= 0.5 * 10**-places * (1 + 1e-9) + abs(value) * 1e-12


class Tally:
    """Figures as they come: how many, the least, the greatest, and the same sum as Python's sum() of all of them."""

    def __init__(self):
        self.n, self.total, self.rest, self.least, self.greatest = 0, 0.0, 0.0, math.inf, -math.inf

    def add(self, x: float) -> None:
        t = self.total + x
        self.rest += (self.total - t) + x if abs(self.total) >= abs(x) else (x - t) + self.total
        self.n, self.total, self.least, self.greatest = self.n + 1, t, min(self.least, x), max(self.greatest, x)

    def sum(self) -> float:
        return self.total + self.rest if math.isfinite(self.rest) else self.total


class Tallies:
    """The records of a group as they come, tallied by columns: what sums them up is told without going through them again."""

    def __init__(self, width: int):
        self.rows, self.columns = 0, [Tally() for _ in range(width)]

    def add(self, figures: list[float | None]) -> None:
        self.rows += 1
        for tally, x in zip(self.columns, figures, strict=False):
            if x is not None:
                tally.add(x)


def summary_rows(rows: list[list]) -> list[int]:
    """Rows (from 0) that sum up others. A bare total is believed by its label; any other by its figures."""
    width = max(map(len, rows), default=0)
    figure = [[(n.value if (n := values.read_number(v)) and not isinstance(v, bool) else None) for v in row] for row in rows]
    out: list[int] = []
    group, records = Tallies(width), Tallies(width)
    totals: list[int] = []
    for i, row in enumerate(rows):
        first = next(((c, v) for c, v in enumerate(row) if not blank(v)), None)
        label = first[1].strip() if first and isinstance(first[1], str) and not is_number(first[1]) else ""
        own = [c for c in range(width) if c < len(figure[i]) and figure[i][c] is not None and c != (first[0] if first else -1)]

        def adds(of: Tallies) -> bool:
            return of.rows > 0 and any(same(figure[i][c], of.columns[c].sum()) for c in own)  # noqa: B023

        found = False
        if label and TOTAL.match(label):
            found = True
            totals.append(i)
        elif label and own and GROUP_TOTAL.match(label) and (adds(group) or (not GROUP_TOTAL.match(label)["a"] and adds(records))):
            found = True
            totals.append(i)
        elif label and own and NET.match(label) and (adds(group) or adds(records) or any(same(figure[i][c], figure[a][c] - figure[b][c]) for c in own for a in totals for b in totals if a != b and figure[a][c] is not None and figure[b][c] is not None)):
            found = True
        elif label and own:
            found = any(_statistic(how, words, label, figure[i], own, group, records) for how, words in STATISTICS.items())
        if found:
            out.append(i)
            group = Tallies(width)
        elif first:
            group.add(figure[i])
            records.add(figure[i])
    return [] if len(out) == len([r for r in rows if any(not blank(v) for v in r)]) else out


def _statistic(how: str, words: str, label: str, told: list[float | None], own: list[int], group: Tallies, records: Tallies) -> bool:
    m = re.fullmatch(rf"(?:(?P<g>.+?)\s+)?(?:{words})\s*:?|(?:{words})\s+(?P<h>.+?)\s*:?", label, re.I)
    if not m:
        return False
    of_all = not (m["g"] or m["h"]) or (m["g"] or m["h"]).strip().lower() in ("grand", "overall", "total")
    for of in ([records] if of_all else [group, records]):
        if of.rows < (3 if of_all else 1):
            continue
        ok = True
        for c in own:
            x = of.columns[c]
            if how == "count":
                ok = ok and told[c] in (of.rows, x.n)
            else:
                value = {"mean": x.sum() / x.n, "max": x.greatest, "min": x.least}[how] if x.n else None
                ok = ok and value is not None and shows(told[c], value)
        if ok:
            return True
    return False
