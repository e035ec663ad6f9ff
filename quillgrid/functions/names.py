"""Names: addresses, slugs, spoken headings, and what a heading says of its column."""

from __future__ import annotations

import re
import unicodedata

MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")


def letters(i: int) -> str:
    """0 is A, 26 is AA."""
    out = ""
    i += 1
    while i:
        i, r = divmod(i - 1, 26)
        out = chr(65 + r) + out
    return out


def a1(row: int, column: int) -> str:
    return f"{letters(column)}{row + 1}"


def merge_range(text: str) -> tuple[int, int, int, int] | None:
    """(top, left, bottom, right) of B2:D5, from 0."""
    m = re.fullmatch(r"\$?([A-Za-z]{1,3})\$?(\d+)(?::\$?([A-Za-z]{1,3})\$?(\d+))?", text.strip())
    if not m:
        return None

    def number(s: str) -> int:
        n = 0
        for c in s.upper():
            n = n * 26 + ord(c) - 64
        return n - 1

    left, top = number(m[1]), int(m[2]) - 1
    right, bottom = (number(m[3]), int(m[4]) - 1) if m[3] else (left, top)
    return min(top, bottom), min(left, right), max(top, bottom), max(left, right)


def clean(text: str, cap: int | None = None) -> str:
    """Control, zero-width and direction marks become spaces, runs of space one; capped at a word with an ellipsis."""
    text = re.sub(r"[\x00-\x1f\x7f-\x9f​-‏‪-‮⁠-⁤⁦-⁩﻿]", " ", text)
    text = re.sub(r"\s+", " ", text).strip()
    if cap is None or len(text) <= cap:
        return text
    cut = text[:cap]
    at = cut.rfind(" ")
    return (cut[:at] if at > cap // 2 else cut).rstrip() + "…"


def norm(text: str) -> str:
    words = re.sub(r"[\W_]+", " ", text.lower().replace("%", " percent ").replace("#", " number ")).strip()
    return words or clean(text).lower()


def slug(name: str, file: bool = True) -> str:
    if file:
        name = re.sub(r"\.[A-Za-z0-9]{1,5}$", "", name)
    flat = unicodedata.normalize("NFD", name.replace("đ", "d").replace("Đ", "D"))
    flat = "".join(c for c in flat if not unicodedata.combining(c)).lower()
    return re.sub(r"[^a-z0-9]+", "-", flat).strip("-") or "table"


def title(name: str) -> str:
    """A file or sheet name as a title: marks between words become spaces, the first letter a capital."""
    words = " ".join(re.sub(r"\.[^.]+$", "", name).replace("_", " ").replace("-", " ").replace(".", " ").split())
    return words[:1].upper() + words[1:] or "Untitled table"


def unique(name: str, taken: set[str], join: str = "-") -> str:
    out, n = name, 2
    while out.lower() in taken:
        out, n = f"{name}{join}{n}", n + 1
    taken.add(out.lower())
    return out


def spoken(heading: str) -> str:
    """snake_case and camelCase as words; short capitals stay; an unnamed heading says its column."""
    m = re.fullmatch(r"Unnamed: (\d+)", heading)
    if m:
        return f"column {int(m[1]) + 1}"
    text = re.sub(r"(?<=[a-zà-ỹ0-9])(?=[A-Z])", " ", heading.replace("_", " "))
    words = [w if len(w) <= 3 and w.isupper() else w.lower() for w in text.split()]
    return " ".join(words)


# Plural endings (of words of so many letters at least) and what they become.
PLURALS = (("ies", "y", 5), ("ches", "ch", 0), ("shes", "sh", 0), ("xes", "x", 0), ("sses", "ss", 0), ("ss", "ss", 0), ("s", "", 4))


def singular(word: str) -> str:
    for ending, other, least in PLURALS:
        if len(word) >= least and word.endswith(ending):
            return word.removesuffix(ending) + other
    return word


def similarity(a: str, b: str) -> float:
    """1 less the edits that make one word the other, as a share of the longer one."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return 1 - row[-1] / max(len(a), len(b), 1)


# Words of a heading that say what kind of figures stand beneath.
AVERAGES = frozenset("average avg mean".split())
SHARES = frozenset("share shares portion allocation allocated split weight weighting ownership owned stake stakes".split())
SHARES_VIETNAMESE = ("tỷ trọng", "tỉ trọng", "tỷ trong", "tỉ trong", "cơ cấu", "cơ câu", "co cấu", "co cau", "cơ cau")
SPEEDS = frozenset("speed velocity mph kph kmh km/h".split())
DISTANCES = frozenset("km kilometre kilometres kilometer kilometers mile miles metre metres meter meters m ft feet yard yards".split())
MOMENTS = frozenset("hour hr h minute min second sec s".split())
STRETCHES = frozenset("hour hr day night shift week fortnight month quarter year annum".split())
ROUND_NUMBERS = frozenset("hundred thousand million".split())
#: Words after "per" that make a figure one of a person, a thing or a measure.
PER_ONE = frozenset(
    """capita head person people individual resident inhabitant citizen adult child employee worker staff fte member
    customer client user patient student pupil visitor guest subscriber household family unit item piece share order
    transaction sale visit game match serving dose kg kgs kilo kilogram gram lb lbs pound ton tonne litre liter gallon
    mile km kilometre kilometer metre meter acre hectare room bed seat trip call click impression view""".split()
)
PER_PERSON = frozenset(("capita", "head"))
OWN_NAME_ENDS = frozenset("name names id code no number".split())


class Heading:
    """A heading's words in order, with percent signs and "per cent" as one mark, and what its "per" is of."""

    def __init__(self, text: str):
        said = unicodedata.normalize("NFC", text).lower()
        said = re.sub(r"\bper\s?cent\b|\bpercentage\b", " % ", said)
        self.words = re.findall(r"km/h|[^\W\d_]+|\d[\d.,]*|%", said)
        self.pairs = list(zip(self.words, self.words[1:], strict=False))

    def any(self, of: frozenset) -> bool:
        return not of.isdisjoint(self.words)

    def follows(self, *one_of_each: frozenset) -> bool:
        """Whether words that belong to these sets, one each, stand side by side."""
        spans = zip(*(self.words[k:] for k in range(len(one_of_each))), strict=False)
        return any(all(w in of for w, of in zip(span, one_of_each, strict=True)) for span in spans)

    def share(self) -> bool:
        joined = f" {' '.join(self.words)} "
        return self.any(SHARES) or ("%", "of") in self.pairs or any(f" {x} " in joined for x in SHARES_VIETNAMESE)

    def speed(self) -> bool:
        return self.any(SPEEDS) or self.follows(DISTANCES, frozenset(("per", "a", "an")), MOMENTS)

    def per(self) -> str | None:
        """The word or number after the first "per" that is not of a stretch of time."""
        return next((b for a, b in self.pairs if a == "per" and b not in STRETCHES and b != "%"), None)

    def own_name(self) -> str:
        """What the rows of a column of this heading are: "store" for "Store names"."""
        words = self.words[:-1] if len(self.words) > 1 and self.words[-1] in OWN_NAME_ENDS else self.words
        return singular(" ".join(words))


def rate(column, others=()) -> str | None:
    """Why the figures of a column have no total, by its heading; None where they have one.

    The verdicts below are asked in their order; one that is None lets the figures add up.
    """
    h = Heading(column.name)
    unit = h.per()
    one = singular(unit) if unit else ""
    rows = {Heading(o.name).own_name() for o in others if o is not column and o.kind in ("text", "category")}
    percent = column.kind == "percent" or "%" in h.words
    verdicts = (
        (h.any(AVERAGES), "already an average"),
        ("median" in h.words, "already a median"),
        (percent and h.share(), None),
        (percent, "a percentage"),
        (h.speed(), "a speed"),
        (h.any(frozenset(("rate", "ratio"))), f"a {next((w for w in h.words if w in ('rate', 'ratio')), '')}"),
        (unit is not None and (unit[0].isdigit() or unit in ROUND_NUMBERS), "a rate"),
        (one in rows, None),
        (unit in PER_ONE, f"a per-{unit} figure"),
        (one in PER_ONE, f"a per-{one} figure"),
    )
    return next((why for holds, why in verdicts if holds), None)


def caution(why: str | None) -> bool:
    """Rates that may be added with a warning: averages, and figures per unit other than per head."""
    if why is None or not (why == "already an average" or why.startswith("a per-")):
        return False
    return why.removeprefix("a per-").removesuffix(" figure") not in PER_PERSON


# Headings of identifiers, phones, row numbers and note references.
_ID_WORDS = r"(?:ids?|zip|zipcode|postcode|postal|sku|ean|upc|isbn|iban|ssn|code|account|acct|passport|(?:order|invoice|account|customer|reference|ref|serial|tracking|policy|member|card|passport|tax)\s*(?:no\.?|nr\.?|number|num|#))"
_PHONE_WORDS = r"(?:phone|telephone|tel|mobile|fax)"
_TAIL = r"\.?(?:\s*(?:no\.?|nr\.?|number|num|#|id))?[\s.:)\]]*$"
IDENTIFIER = re.compile(rf"(?:^|[\W_]){_ID_WORDS}{_TAIL}|(?:^|\s)(?:mã|stk|mst|cccd|cmnd)(?:\s|$)|số tài khoản|căn cước|hộ chiếu", re.I)
PHONE = re.compile(rf"(?:^|[\W_]){_PHONE_WORDS}{_TAIL}|điện thoại|(?:^|\s)(?:sđt|số\s+đt)(?:\s|$)|di động", re.I)
ROW_NUMBER = re.compile(r"^(?:stt|tt|số\s*tt|số\s+thứ\s+tự|thứ\s+tự|no\.?|nr\.?|#|s/n|s\.\s?no\.?|sr\.?\s*no\.?|sl\.?\s*no\.?|serial\s+no\.?)$", re.I)
NOTE_REF = re.compile(r"^(?:notes?|note\s+ref\.?|ref\.?|thuyết\s+minh|ghi\s+chú|chú\s+thích|chú\s+giải|remarks?|comments?|footnotes?)$", re.I)


def identifier_kind(heading: str) -> str | None:
    heading = unicodedata.normalize("NFC", heading)
    return "phone" if PHONE.search(heading) else "code" if IDENTIFIER.search(heading) else None
