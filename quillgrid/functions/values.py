"""Reading cells: each rule once as a column expression, for data, and once in Python, for words of a question.

Cells are text as the file has it. Numbers have a style: ``dot`` and ``comma`` say which mark is the decimal one,
``plain`` has no mark, ``ambiguous`` could be either, and the convention decides.
"""

from __future__ import annotations

import datetime as dt
import re
import unicodedata
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .names import MONTHS

#: White space that is trimmed from cells.
WS = r"[\s   -     　﻿]"
SPACES = " \t\n\x0b\f\r\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
# Currency marks and truth words.
MARK = r"(?:[$£€¥₫]|VNĐ|VND|USD|EUR|GBP|đồng|dong|đ)"
TRUE, FALSE = ("true", "yes", "y", "có"), ("false", "no", "n", "không")
PLACEHOLDER = re.compile(r"^(?:n/?a|n\.a\.|tbd|tbc|tba|-{1,3}|—|–|\?{1,3}|none|nil|null)$", re.I)
ERROR = re.compile(r"^#(?:DIV/0!|N/A|NAME\?|NULL!|NUM!|REF!|VALUE!|SPILL!|CALC!|FIELD!|BLOCKED!|CONNECT!|BUSY!|UNKNOWN!|GETTING_DATA)$", re.I)
SCALES = {"k": 1e3, "thousand": 1e3, "m": 1e6, "mn": 1e6, "mil": 1e6, "million": 1e6, "b": 1e9, "bn": 1e9, "billion": 1e9, "t": 1e12, "tn": 1e12, "trillion": 1e12, "percent": 1.0}

_GROUPS = r"(?:[0-9]{1,3}(?:,[0-9]{3})*|[0-9]{1,2}(?:,[0-9]{2})+,[0-9]{3})"


# ---- column expressions ----------------------------------------------------------------------------------


def trim(c: Column) -> Column:
    return F.trim(c, F.lit(SPACES))


def blank(c: Column) -> Column:
    """Null or nothing but white space; a cell that starts with a visible ASCII character is told by that alone."""
    return c.isNull() | F.when((c >= "!") & (c < "\x7f"), False).otherwise(trim(c) == "")


def tidy(c: Column) -> Column:
    """Rounded to 12 significant digits."""
    return F.when(c.isNotNull(), F.format_string("%.11e", c).cast("double"))


def js_string(c: Column, kind: str) -> Column:
    """A number as people write it: no point after whole numbers, no exponent."""
    if kind in ("double", "float"):
        whole = (c == F.floor(c)) & (F.abs(c) < 1e18)
        return F.when(whole, c.cast("long").cast("string")).otherwise(
            F.when(c.cast("string").contains("E"), F.regexp_replace(c.cast("decimal(38,18)").cast("string"), r"\.?0+$", "")).otherwise(c.cast("string"))
        )
    return c.cast("string")


def _strip_marks(c: Column) -> Column:
    bare = F.regexp_replace(c, rf"(?iu)VNĐ|VND|USD|EUR|GBP|[$£€¥₫%]|{WS}", "")
    return F.regexp_replace(bare, r"(?iu)^đ|(?:đồng|dong|đ)$", "")


def bind(value: Column, use) -> Column:
    """use(value) with value worked out once, however often it is used, and the plan's code kept small."""
    return F.transform(F.array(value), use)[0]


def number_parts(c: Column, convention: str = "dot") -> Column:
    """struct<value double, style string> of a text cell; null where it is no number."""
    paren = rf"(?iu)^{MARK}?{WS}*\({WS}*{MARK}?{WS}*([0-9.,]+{WS}*%?){WS}*\){WS}*{MARK}?%?$"
    r = lambda v, style: F.struct(v.alias("value"), F.lit(style).alias("style"))
    real = lambda x: x.try_cast("double")

    def of_text(s: Column) -> Column:
        inner = F.when(s.contains(")") & ~s.rlike(r"^\((?:19|20)[0-9]{2}\)$"), F.regexp_extract(s, paren, 1)).otherwise("")
        return bind(inner, lambda i: bind(_strip_marks(F.when(i != "", i).otherwise(s)), lambda body: of_body(s, i, body)))

    def of_body(s: Column, inner: Column, body: Column) -> Column:
        negative = (inner != "") | body.startswith("-")
        read = bind(F.regexp_replace(body, "^-", ""), lambda digits: of_digits(s, digits))
        signed = bind(read, lambda x: F.when(x.isNotNull() & ~((inner != "") & (x["value"] == 0)), F.struct((x["value"] * F.when(negative, -1.0).otherwise(1.0)).alias("value"), x["style"].alias("style"))))
        return F.when(body.rlike(r"^-?[0-9.,]*[0-9]$") & ~((inner != "") & body.startswith("-")), signed)

    def of_digits(s: Column, digits: Column) -> Column:
        money = s.rlike(rf"(?iu){MARK}")
        no_commas, no_dots = F.regexp_replace(digits, ",", ""), F.regexp_replace(digits, r"\.", "")
        whole, fraction = F.regexp_extract(digits, r"^([0-9]*)[.,]", 1), F.regexp_extract(digits, r"[.,]([0-9]+)$", 1)

        def one_mark(x: Column) -> Column:
            dot, joined, pointed = digits.contains("."), real(F.concat(x["whole"], x["fraction"])), real(F.concat(F.when(x["whole"] == "", "0").otherwise(x["whole"]), F.lit("."), x["fraction"]))
            could = (F.length(x["fraction"]) == 3) & x["whole"].rlike("^[1-9][0-9]{0,2}$")
            own = F.when(dot, r(pointed, "dot")).otherwise(r(pointed, "comma"))
            other = F.when(dot, r(joined, "comma")).otherwise(r(joined, "dot"))
            grouping = dot if convention == "comma" else ~dot
            return F.when(~could | (~money & dot & s.endswith("%")), own).when(money, other).otherwise(F.when(grouping, r(joined, "ambiguous")).otherwise(r(pointed, "ambiguous")))

        return (
            F.when(digits.rlike("^[0-9]+$"), r(real(digits), "plain"))
            .when(digits.rlike("^[0-9]*[.,][0-9]+$"), bind(F.struct(whole.alias("whole"), fraction.alias("fraction")), one_mark))
            .when(digits.rlike(rf"^{_GROUPS}\.[0-9]+$"), r(real(no_commas), "dot"))
            .when(digits.rlike(r"^[0-9]{1,3}(?:\.[0-9]{3})*,[0-9]+$"), r(real(F.regexp_replace(no_dots, ",", ".")), "comma"))
            .when(digits.rlike(r"^[0-9]{1,3}(?:\.[0-9]{3})+$"), r(real(no_dots), "comma"))
            .when(digits.rlike(rf"^{_GROUPS}$"), r(real(no_commas), "dot"))
        )

    return F.when(c.rlike("[0-9]"), bind(trim(c), of_text))


def number(c: Column, convention: str = "dot") -> Column:
    return number_parts(c, convention)["value"]


def _date(y: Column, m: Column, d: Column, hh=None, mi=None, ss=None) -> Column:
    zero = F.lit(0)
    pick = lambda x: zero if x is None else F.when(x == "", zero).otherwise(x.try_cast("int"))
    seconds = F.lit(0).cast("decimal(16,6)") if ss is None else F.when(ss == "", 0).otherwise(ss.try_cast("decimal(16,6)")).cast("decimal(16,6)")
    return F.try_make_timestamp_ntz(y.try_cast("int"), m.try_cast("int"), d.try_cast("int"), pick(hh), pick(mi), seconds)


def _month(c: Column) -> Column:
    w = F.lower(c)
    out = F.lit(None).cast("int")
    for i, name in enumerate(MONTHS):
        n = name.lower()
        out = F.when(w.isin(n, n[:3], *(["sept"] if i == 8 else [])), i + 1).otherwise(out)
    return out


def date(c: Column, order: str = "mdy") -> Column:
    """A date or instant written as text, as timestamp_ntz in UTC; null where it is none, or no such day exists."""
    return F.when(c.rlike(r"\d"), bind(trim(c), lambda s: _date_of(s, order)))


def _date_of(s: Column, order: str) -> Column:
    iso = r"(?i)^(\d{4})-(\d{1,2})-(\d{1,2})(?:[T ](\d{1,2}):(\d{2})(?::(\d{2}(?:\.\d{1,6})?)\d*)?\s*(Z|[+-]\d{2}:?\d{2})?)?$"
    g = lambda p, i: F.regexp_extract(s, p, i)
    zone = g(iso, 7)
    minutes = (F.substring(zone, 2, 2).try_cast("int") * 60 + F.right(zone, F.lit(2)).try_cast("int")) * F.when(zone.startswith("-"), -1).otherwise(1)
    local = _date(g(iso, 1), g(iso, 2), g(iso, 3), g(iso, 4), g(iso, 5), g(iso, 6))
    iso_value = F.when(zone.rlike("^[+-]"), local - F.make_dt_interval(F.lit(0), F.lit(0), minutes)).otherwise(local)
    ymd = r"^(\d{4})[/.](\d{1,2})[/.](\d{1,2})$"
    num = r"^(\d{1,2})([/\-.])(\d{1,2})[/\-.](\d{4}|\d{2})(?:[T ](\d{1,2}):(\d{2})(?::(\d{2}))?)?$"
    full = lambda y: F.when(F.length(y) == 2, y.try_cast("int") + F.when(y.try_cast("int") < 30, 2000).otherwise(1900)).otherwise(y.try_cast("int"))
    at = lambda m, d: _date(full(g(num, 4)), m, d, g(num, 5), g(num, 6), g(num, 7))
    a, b = g(num, 1), g(num, 3)
    month_first = F.lit(order == "mdy") & (g(num, 2) != ".")
    num_value = F.when(month_first, F.coalesce(at(a, b), at(b, a))).otherwise(F.coalesce(at(b, a), at(a, b)))
    mdy = r"(?i)^([a-z]{3,9})\.?\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+(\d{4})$"
    dmy = r"(?i)^(\d{1,2})(?:st|nd|rd|th)?[\s-]([a-z]{3,9})\.?,?[\s-](\d{4}|\d{2})$"
    return F.when(F.length(s) <= 40, (
        F.when(s.rlike(iso), iso_value)
        .when(s.rlike(ymd), _date(g(ymd, 1), g(ymd, 2), g(ymd, 3)))
        .when(s.rlike(num), num_value)
        .when(s.rlike(mdy), _date(g(mdy, 3), _month(g(mdy, 1)), g(mdy, 2)))
        .when(s.rlike(dmy), _date(full(g(dmy, 3)), _month(g(dmy, 2)), g(dmy, 1)))
    ))


def truth(c: Column) -> Column:
    w = F.lower(trim(c))
    return F.when(w.isin(*TRUE), True).when(w.isin(*FALSE), False)


def phone(c: Column) -> Column:
    """Digits of a phone number: +84 becomes 0, then leading zeros go."""
    digits = F.regexp_replace(F.regexp_replace(trim(c), r"^\+84", "0"), r"\D", "")
    return F.regexp_replace(digits, "^0+", "")


def placeholder(c: Column) -> Column:
    return F.lower(trim(c)).rlike(PLACEHOLDER.pattern)


# ---- the same in Python ----------------------------------------------------------------------------------


@dataclass(frozen=True)
class Number:
    value: float
    style: str


def strip(s: str) -> str:
    return re.sub(f"^{WS}+|{WS}+$", "", s)


def is_blank(v) -> bool:
    return v is None or (isinstance(v, str) and strip(v) == "")


def py_tidy(x: float) -> float:
    return float(f"{x:.11e}")


def read_number(v, convention: str = "dot") -> Number | None:
    if isinstance(v, bool) or v is None or isinstance(v, dt.datetime):
        return None
    if isinstance(v, (int, float)):
        return Number(float(v), "plain") if abs(v) != float("inf") and v == v else None
    s = unicodedata.normalize("NFC", strip(v))
    if not re.search("[0-9]", s):
        return None
    sign = 1.0
    m = re.fullmatch(rf"{MARK}?\s*\(\s*{MARK}?\s*([0-9.,]+\s*%?)\s*\)\s*{MARK}?%?", s, re.I)
    text = s
    if m:
        if re.fullmatch(r"\((?:19|20)[0-9]{2}\)", s):
            return None
        sign, text = -1.0, m[1]
    body = re.sub(rf"VNĐ|VND|USD|EUR|GBP|[$£€¥₫%]|{WS}", "", text, flags=re.I)
    body = re.sub(r"^đ|(?:đồng|dong|đ)$", "", body, flags=re.I)
    if not re.fullmatch(r"-?[0-9.,]*[0-9]", body):
        return None
    if body.startswith("-"):
        if m:
            return None
        sign = -1.0
    digits, money = body.lstrip("-"), bool(re.search(MARK, s, re.I))
    found = _styled(digits, money, s.endswith("%"), convention)
    if found is None or (m and found.value == 0):
        return None
    return Number(found.value * sign, found.style)


def _styled(digits: str, money: bool, percent: bool, convention: str) -> Number | None:
    if digits.isdigit():
        return Number(float(digits), "plain")
    m = re.fullmatch(r"([0-9]*)([.,])([0-9]+)", digits)
    if m:
        whole, mark, fraction = m.groups()
        own, other = ("dot", "comma") if mark == "." else ("comma", "dot")
        pointed, joined = float(f"{whole or '0'}.{fraction}"), float(whole + fraction)
        if not (len(fraction) == 3 and re.fullmatch("[1-9][0-9]{0,2}", whole)):
            return Number(pointed, own)
        if money:
            return Number(joined, other)
        if mark == "." and percent:
            return Number(pointed, "dot")
        return Number(pointed if own == convention else joined, "ambiguous")
    if re.fullmatch(rf"{_GROUPS}\.[0-9]+", digits):
        return Number(float(digits.replace(",", "")), "dot")
    if re.fullmatch(r"[0-9]{1,3}(?:\.[0-9]{3})*,[0-9]+", digits):
        return Number(float(digits.replace(".", "").replace(",", ".")), "comma")
    if re.fullmatch(r"[0-9]{1,3}(?:\.[0-9]{3})+", digits):
        return Number(float(digits.replace(".", "")), "comma")
    if re.fullmatch(_GROUPS, digits):
        return Number(float(digits.replace(",", "")), "dot")
    return None


def spoken_number(text: str, convention: str = "dot") -> float | None:
    """"100 million", "1.5k", "minus 3", "$5": what a number in a question means."""
    found = read_number(text, convention)
    if found:
        return found.value
    s = re.sub(r"^(?:[$£€¥₫]|usd|eur|gbp|vnd)\s*", "", re.sub(r"^minus\s+", "-", strip(text).lower()))
    found = read_number(s)
    if found:
        return found.value
    m = re.fullmatch(r"(-?[0-9,]*\.?[0-9]+)\s*([a-z]+)", s)
    base = read_number(m[1]) if m else None
    return py_tidy(base.value * SCALES[m[2]]) if base and m[2] in SCALES else None


def month_number(word: str) -> int | None:
    w = word.lower().rstrip(".")
    return next((i + 1 for i, n in enumerate(MONTHS) if w == n.lower() or w == n[:3].lower() or (w == "sept" and i == 8)), None)


def read_date(v, order: str = "mdy") -> dt.datetime | None:
    if isinstance(v, dt.datetime):
        return v
    if not isinstance(v, str):
        return None
    s = strip(v)
    if not s or len(s) > 40 or not re.search("[0-9]", s):
        return None

    def make(y, m, d, *time):
        try:
            return dt.datetime(int(y), int(m), int(d), *(int(t or 0) for t in time))
        except (ValueError, TypeError):
            return None

    year = lambda y: int(y) + (2000 if int(y) < 30 else 1900) if len(y) == 2 else int(y)
    m = re.fullmatch(r"(\d{4})-(\d{1,2})-(\d{1,2})(?:[Tt ](\d{1,2}):(\d{2})(?::(\d{2})(?:\.(\d{1,6})\d*)?)?\s*(Z|z|[+-]\d{2}:?\d{2})?)?", s)
    if m:
        local = make(m[1], m[2], m[3], m[4], m[5], m[6], (m[7] or "0").ljust(6, "0"))
        if local and m[8] and m[8] not in "Zz":
            off = int(m[8][1:3]) * 60 + int(m[8][-2:])
            local -= dt.timedelta(minutes=off if m[8][0] == "+" else -off)
        return local
    m = re.fullmatch(r"(\d{4})[/.](\d{1,2})[/.](\d{1,2})", s)
    if m:
        return make(*m.groups())
    m = re.fullmatch(r"(\d{1,2})([/\-.])(\d{1,2})[/\-.](\d{4}|\d{2})(?:[T ](\d{1,2}):(\d{2})(?::(\d{2}))?)?", s)
    if m:
        a, b = (m[1], m[3]) if order == "mdy" and m[2] != "." else (m[3], m[1])
        return make(year(m[4]), a, b, m[5], m[6], m[7]) or make(year(m[4]), b, a, m[5], m[6], m[7])
    m = re.fullmatch(r"([A-Za-z]{3,9})\.?\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+(\d{4})", s)
    if m:
        return make(m[3], month_number(m[1]), m[2])
    m = re.fullmatch(r"(\d{1,2})(?:st|nd|rd|th)?[\s-]([A-Za-z]{3,9})\.?,?[\s-](\d{4}|\d{2})", s)
    return make(year(m[3]), month_number(m[2]), m[1]) if m else None


def month_only(text: str) -> tuple[int, int | None] | None:
    m = re.fullmatch(r"([A-Za-z]{3,9})\.?(?:,?\s+(\d{4}))?", strip(text))
    n = month_number(m[1]) if m else None
    return (n, int(m[2]) if m[2] else None) if n else None


def month_day(text: str, order: str = "mdy") -> tuple[int, int] | None:
    s = re.sub(r"^the\s+", "", strip(text), flags=re.I)
    m = re.fullmatch(r"([A-Za-z]{3,9})\.?\s+(\d{1,2})(?:st|nd|rd|th)?", s)
    n = re.fullmatch(r"(\d{1,2})(?:st|nd|rd|th)?\s+(?:of\s+)?([A-Za-z]{3,9})\.?", s)
    k = re.fullmatch(r"(\d{1,2})([/\-.])(\d{1,2})", s)
    if m or n:
        month, day = (month_number(m[1]), int(m[2])) if m else (month_number(n[2]), int(n[1]))
    elif k:
        month, day = (int(k[3]), int(k[1])) if order == "dmy" or k[2] == "." else (int(k[1]), int(k[3]))
    else:
        return None
    return (month, day) if month and 1 <= month <= 12 and 1 <= day <= 31 else None


def py_truth(v) -> bool | None:
    if isinstance(v, bool):
        return v
    w = strip(v).lower() if isinstance(v, str) else None
    return True if w in TRUE else False if w in FALSE else None
