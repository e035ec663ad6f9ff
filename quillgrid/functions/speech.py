"""Answers as sentences: rounded but honest figures, lists, and rows within a budget of words."""

from __future__ import annotations

import datetime as dt
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import names, values

_SCALES = ((1e12, "trillion"), (1e9, "billion"), (1e6, "million"), (1e3, "thousand"))


def _rounded(x: float, places: int) -> str:
    """Halves upwards, no zeros at the end, no grouping."""
    size = 10**places
    r = math.floor(x * size + 0.5) / size
    return str(int(r)) if r == int(r) else f"{r:.{places}f}".rstrip("0")


def _scales(most: str) -> tuple[tuple[float, str], ...]:
    """The scales up to the one named, the greatest first."""
    return _SCALES[[word for _, word in _SCALES].index(most) :]


def number(x: float, percent: bool = False, most: str = "trillion") -> str:
    """From 10,000 on in thousands, millions and so on (up to ``most``) with one decimal, carried on where a thousand of
    the scale below would be said; smaller to two places; below one to two digits."""
    t = values.py_tidy(x)
    a = abs(t)
    if 1 <= a < 10_000 and float(_rounded(a, 2)) >= 10_000:
        a = float(_rounded(a, 2))
    scale = next(((size, word) for size, word in _scales(most) if a >= 10_000 and (a >= size or float(_rounded(a / (size / 1000), 1)) >= 1000)), None)
    if scale:
        said = f"{_rounded(a / scale[0], 1)} {scale[1]}"
    else:
        said = _rounded(a, 2) if a >= 1 or a == 0 else f"{float(f'{a:.2g}'):.10f}".rstrip("0").rstrip(".")
    return f"{'minus ' if t < 0 else ''}{said}{' percent' if percent else ''}"


def number_column(c: Column, most: str = "trillion") -> Column:
    """The same for a column of numbers."""
    a, out = F.abs(c), None
    one = lambda v: F.regexp_replace(F.replace(F.format_number(v, 1), F.lit(",")), r"\.0$", "")
    for size, word in _scales(most):
        hit = (a >= 10_000) & ((a >= size) | (F.round(a / (size / 1000), 1) >= 1000))
        said = F.concat(one(F.round(a / size, 1)), F.lit(f" {word}"))
        out = F.when(hit, said) if out is None else out.when(hit, said)
    two = F.regexp_replace(F.regexp_replace(F.replace(F.format_number(a, 2), F.lit(",")), "0+$", ""), r"\.$", "")
    small = F.regexp_replace(F.format_string("%.2g", a).cast("double").cast("decimal(20,10)").cast("string"), r"\.?0+$", "")
    return F.concat(F.when(c < 0, "minus ").otherwise(""), out.when((a >= 1) | (a == 0), two).otherwise(small))


def amount(x: float, percent: bool = False, most: str = "trillion") -> str:
    """With "about" where rounding changed the figure."""
    said = number(x, percent, most)
    bare = said.removesuffix(" percent").removeprefix("minus ")
    back = values.spoken_number(bare)
    return said if back is not None and values.py_tidy(abs(x)) == back else f"about {said}"


def exact(x: float) -> str:
    return f"{int(x):,}" if x == int(x) and abs(x) < 1e15 else f"{float(f'{x:.15g}'):,.10f}".rstrip("0").rstrip(".")


def date(d: dt.datetime) -> str:
    return f"{names.MONTHS[d.month - 1]} {d.day}, {d.year}" + (f" at {d.hour}:{d.minute:02d}" if d.hour or d.minute else "")


def cell(text: str | None, kind: str, order: str = "mdy", identifier: str | None = None) -> str:
    """One cell, exactly: codes as they stand, dates in words, truth words as yes or no."""
    if values.is_blank(text):
        return "empty"
    if kind == "date" and (d := values.read_date(text, order)):
        return date(d)
    if kind == "boolean" and values.py_truth(text) is not None:
        return "yes" if values.py_truth(text) else "no"
    if kind in ("number", "currency", "percent") and not identifier and (n := values.read_number(text)):
        said = exact(n.value) if abs(n.value) >= 10_000 or n.value != int(n.value) else str(int(n.value))
        return f"{said} percent" if kind == "percent" else said
    return names.clean(text, 120)


def listed(items: list[str], word: str = "and") -> str:
    return items[0] if len(items) == 1 else f"{', '.join(items[:-1])} {word} {items[-1]}" if items else ""


def plural(n: int, one: str, many: str | None = None) -> str:
    return f"{exact(n)} {one if n == 1 else many or one + 's'}"


def within(parts: list[str], budget: int) -> list[str]:
    """As many whole parts as a budget of words holds, one at least."""
    out, words = [], 0
    for p in parts:
        words += len(p.split())
        if out and words > budget:
            break
        out.append(p)
    return out
