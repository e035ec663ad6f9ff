"""Questions in words to tool calls, by rules: conditions, an aggregate, a group, an order, then the column meant."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import functions as F

from ..functions import names, speech, values
from ..model import Filter, QueryError, QuerySpec, Region
from ..operators import composite
from ..plans import catalog as cat
from ..plans import compile
from ..tools import Tools

AGGREGATE_WORDS = (
    ("count", r"\bhow many\b|\bnumber of\b|\bcount\b"),
    ("avg", r"\b(?:average|mean|typical|on average)\b"),
    ("max", r"\b(?:highest|largest|biggest|most|greatest|maximum|max|top|latest|best)\b"),
    ("min", r"\b(?:lowest|smallest|least|fewest|minimum|min|bottom|worst)\b"),
    ("sum", r"\b(?:total|sum|altogether|together|combined|how much|overall|in all)\b"),
)
UNSUPPORTED = re.compile(r"\b(?:median|standard deviation|std ?dev|variance|percentile|quartile|correlation|mode)\b")
COMPARISONS = (
    ("gte", r"(?:at least|no less than|not less than|from|or more)"),
    ("lte", r"(?:at most|no more than|not more than|up to|until|or less)"),
    ("gt", r"(?:more than|greater than|over|above|exceeding|bigger than|higher than|after|later than)"),
    ("lt", r"(?:less than|fewer than|under|below|smaller than|lower than|before|earlier than)"),
)
NUMBER = r"(?:[$£€¥₫]\s*)?-?[\d][\d,.]*\s*(?:k|m|bn|thousand|million|billion|trillion|percent|%)?"
DATE = r"(?:(?:january|february|march|april|may|june|july|august|september|october|november|december|jan|feb|mar|apr|jun|jul|aug|sept?|oct|nov|dec)\.?(?:\s+\d{1,2}(?:st|nd|rd|th)?(?!\w))?(?:,?\s+\d{4})?|\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{2,4})"
WORD_NUMBERS = {"no": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10}
ORDINALS = {"first": 1, "second": 2, "third": 3, "fourth": 4, "fifth": 5, "sixth": 6, "seventh": 7, "eighth": 8, "ninth": 9, "tenth": 10}
MORE = r"(?:more|higher|greater|larger|bigger|later|better)"
LESS = r"(?:less|fewer|lower|smaller|earlier|worse)"
#: Words that say nothing of a table.
SMALL = frozenset("what which where when whose show list tell give many much does have with from that this these those there about please them they".split())
#: Endings of words for the people or the side of a place, with the letters to cut.
PEOPLE = (("ese", 3), ("ern", 3), ("an", 1), ("an", 2), ("n", 1))
#: Words alike enough to be one with a letter amiss.
ALIKE = 0.8
#: Words after "in", "for" or "of" that name no rows.
NOT_VALUES = frozenset("each every total order table sheet file rows records entries figures average everything altogether than between more less over under above below year month quarter week least".split())
WHICH = "Which column do you mean?"
#: What is said without a table, and the answer.
FIXED = (
    (r"(?:cancel|never ?mind|forget (?:it|that))", "All right, I left it."),
    (r"(?:thanks?|thank you)(?: (?:very|so) much)?", "You're welcome."),
    (r"(?:good ?bye|bye)(?: bye)?", "Goodbye."),
    (r"(?:stop|quiet|be quiet)", "Stopped."),
)
PLACES = {"second": 2, "third": 3, "fourth": 4, "fifth": 5, "2nd": 2, "3rd": 3, "4th": 4, "5th": 5}


def fold(text: str) -> str:
    flat = unicodedata.normalize("NFD", text.lower().replace("đ", "d"))
    return "".join(c for c in flat if not unicodedata.combining(c))


def stem(word: str) -> str:
    return names.singular(word)


def _phrases(text: str, most: int = 6) -> set[str]:
    """The phrases of a text of up to so many words, as they are written."""
    at = [m.span() for m in re.finditer(r"\S+", text)]
    ends = [(i, j) for i in range(len(at)) for j in range(i, min(i + most, len(at)))]
    return {text[at[i][0] : at[j][1]].strip(".,;:!?\"'()") for i, j in ends} - {""}


class Router:
    def __init__(self, tools: Tools):
        self.tools, self.table, self.sheet = tools, None, None
        self.last: dict | None = None
        self.last_answer: str | None = None
        self.figure: float | None = None
        self.pending: str | None = None
        self.known: dict[tuple, dict[int, list[str]]] = {}
        self.spoken = ""

    # ---- words to columns and values ----

    def region(self) -> Region:
        return self.tools._region(self.table, self.sheet)

    def columns_in(self, text: str, of=lambda c: True) -> list:
        """Columns named in a text, the best first: whole headings count most, then distinctive words of theirs.

        Words are met as they are; where no heading is, as the long form of a short heading word ("temperature" for
        "Temp"), and then with a letter or so amiss.
        """
        words = {stem(w) for w in re.findall(r"\w+", fold(text))}
        longer = lambda w: 4 <= len(w) <= 5 and any(x.startswith(w) and len(x) >= len(w) + 3 for x in words)
        alike = lambda w: len(w) >= 5 and any(len(x) >= 5 and names.similarity(w, x) >= ALIKE for x in words)
        for meets in (words.__contains__, longer, alike):
            scored = []
            for c in filter(of, self.region().columns):
                own = [stem(w) for w in re.findall(r"\w+", fold(c.name))]
                hit = sum(map(meets, own))
                score = (100 + 10 * len(own)) if hit == len(own) else 10 * hit
                if own and score:
                    scored.append((-score, c.i, c))
            if scored:
                return [c for _, _, c in sorted(scored, key=lambda x: x[:2])]
        return []

    def measure(self, text: str):
        found = self.columns_in(text, lambda c: c.measure)
        if found:
            return found[0]
        own = [c for c in self.region().columns if c.measure]
        if self.last and self.last.get("aggregate_column"):
            return cat.resolve(self.region(), self.last["aggregate_column"])
        if len(own) == 1:
            return own[0]
        raise QueryError(WHICH, f"The columns of numbers are {cat.listing(own)}." if own else "There is no column of numbers.")

    def value_filters(self, text: str) -> tuple[list[Filter], str]:
        """Conditions by values that a column holds, as whole words of the text; several of a column mean any of them.

        Values are looked up by the phrases of the text, so a table of any size is read once and sends back no more
        values than there are phrases.
        """
        text = self._places(text)
        folded, out = fold(text), []
        held = self._values(text, _phrases(text.lower()) | _phrases(fold(text)))
        for c in self._worded():
            hits = []
            for v in sorted(held[c.i], key=len, reverse=True):
                pattern = rf"(?<!\w){re.escape(fold(v.strip()))}(?!\w)"
                if len(v.strip()) > 1 and re.search(pattern, folded):
                    hits.append(v)
                    folded = re.sub(pattern, " ", folded)
            if hits:
                no = re.search(r"\b(?:not|except|without|excluding|other than)\b", folded)
                op = "neq" if no else "eq"
                out.append(Filter(c.name, op, hits[0]) if len(hits) == 1 else Filter(c.name, op, None, tuple(hits)))
        if not out:
            out, folded = self._partly(folded)
        return out, folded

    def _worded(self) -> list:
        return [c for c in self.region().columns if c.kind in ("category", "text") and not c.identifier]

    def _asked(self, folded: str) -> list[str]:
        """Words of a text that may be part of a value: no headings, no words of the question itself."""
        headings = {stem(w) for c in self.region().columns for w in re.findall(r"\w+", fold(c.name))}
        return [w for w in re.findall(r"\w+", folded) if len(w) > 3 and w not in SMALL and stem(w) not in headings and not any(re.search(p, w) for _, p in AGGREGATE_WORDS)]

    def _partly(self, folded: str) -> tuple[list[Filter], str]:
        """A condition by a word that only one value has, such as the brand of a longer name; and the rest of the text."""
        asked = self._asked(folded)
        if not asked:
            return [], folded
        r, own = self.region(), self._worded()
        parts = {c.i: F.split(F.lower(f"c{c.i}"), r"[^\p{L}\p{M}\p{N}_]+") for c in own}
        has = lambda c, w: F.array_contains(parts[c.i], w)
        ends = [f(F.when(has(c, w), values.trim(F.col(f"c{c.i}")))).alias(f"{name}{c.i}_{k}") for c in own for k, w in enumerate(asked) for f, name in ((F.min, "a"), (F.max, "z"))]
        found = r.df.where("not _is_summary").agg(*ends).first() if ends else None
        hits = {(c.name, v) for c in own for k in range(len(asked)) for v in (found[f"a{c.i}_{k}"], found[f"z{c.i}_{k}"]) if v is not None}
        if len(hits) != 1:
            return [], folded
        (column, value), = hits
        told = set(re.findall(r"\w+", fold(value)))
        return [Filter(column, "eq", value)], re.sub(r"\w+", lambda m: " " if m[0] in told else m[0], folded)

    def _places(self, text: str) -> str:
        """The text with words for a place's people or side put as the place, where a value is called that: "Asian" for Asia."""
        bases = {w[:-cut]: w for w in self._asked(fold(text)) for end, cut in PEOPLE if w.endswith(end) and len(w) - cut >= 4}
        found = self._values("people of " + text, set(bases)) if bases else {}
        for v in (v for vs in found.values() for v in vs if fold(v.strip()) in bases):
            text = re.sub(rf"(?<!\w){re.escape(bases[fold(v.strip())])}(?!\w)", v.strip().lower(), text)
        return text

    def _values(self, text: str, said: set[str]) -> dict[int, list[str]]:
        """Values of the columns of words that are one of the phrases said: one pass over the table."""
        r, own = self.region(), self._worded()
        key = (r.id, r.revision, text)
        if key not in self.known:
            held = {c.i: list(c.profile["categories"]) for c in own if c.profile.get("categories")}
            rest = [c for c in own if c.i not in held]
            if rest and said:
                value = lambda c: values.trim(F.col(f"c{c.i}"))
                found = r.df.where("not _is_summary").agg(*(F.collect_set(F.when(F.lower(value(c)).isin(*said), value(c))).alias(f"k{c.i}") for c in rest)).first()
                held |= {c.i: sorted(found[f"k{c.i}"]) for c in rest}
            self.known = {k: v for k, v in self.known.items() if k[:2] == key[:2] and len(self.known) < 8} | {key: {c.i: held.get(c.i, []) for c in own}}
        return self.known[key]

    def _repeats(self, c) -> bool:
        return c.kind in ("category", "text") and c.profile.get("distinct", 0) < c.profile.get("non_empty", 0)

    def comparisons(self, text: str) -> tuple[list[Filter], str]:
        out = []
        m = re.search(rf"\bbetween\s+({NUMBER}|{DATE})\s+and\s+({NUMBER}|{DATE})", text)
        spans = [("gte", m[1], m), ("lte", m[2], m)] if m else []
        m = None if spans else re.search(rf"({NUMBER})\s+or\s+(more|over|above|less|fewer|under|below)\b", text)
        if m:
            spans.append(("gte" if m[2] in ("more", "over", "above") else "lte", m[1], m))
        if not spans:
            for op, words in (*COMPARISONS, ("eq", r"(?:exactly|equal to|equals)")):
                m = re.search(rf"\b{words}\s+({DATE}|{NUMBER})", text)
                if m:
                    spans.append((op, m[1], m))
                    break
        rest = text
        for op, value, m in spans:
            dated = re.fullmatch(DATE, value.strip()) is not None
            before = text[: m.start()]
            pool = [c for c in self.columns_in(before) if (c.kind == "date") == dated and (dated or c.measure)]
            pool = pool or [c for c in self.region().columns if (c.kind == "date" if dated else c.measure)]
            if not pool:
                raise QueryError("There is no column to compare that with.", "Name the column.")
            out.append(Filter(pool[0].name, op, value.strip()))
            rest = rest.replace(m[0], " ")
        m = None if spans else re.search(rf"\b(?:in|on|during)\s+({DATE})", text)
        dates = [c for c in self.region().columns if c.kind == "date"]
        if m and dates:
            out.append(Filter(dates[0].name, "eq", m[1]))
            rest = rest.replace(m[0], " ")
        m = re.search(r"\b(?:no|missing|blank|empty|without(?: an?)?)\s+(\w+)", rest) or re.search(r"\b(\w+)\s+(?:is|are)\s+(?:empty|blank|missing)\b", rest)
        empty = self.columns_in(m[1]) if m else []
        if empty:
            out.append(Filter(empty[0].name, "is_empty"))
            rest = rest.replace(m[0], " ")
        return out, rest

    def row_named(self, text: str) -> tuple[str, str] | None:
        """(column, value) of the one value that a text names; the column that names rows comes first."""
        found, _ = self.value_filters(text)
        own = self.region().columns[self.region().label or 0].name
        found = sorted((f for f in found if f.value), key=lambda f: f.column != own)
        return (found[0].column, found[0].value) if found else None

    # ---- a question to a call ----

    def ask(self, question: str) -> dict:
        text = re.sub(r"[?!.]+$", "", names.clean(question).strip()).lower()
        if self.pending and len(text.split()) <= 4 and self.columns_in(text) and not any(re.search(p, text) for _, p in AGGREGATE_WORDS):
            text = f"{self.pending} {text}"
        self.pending = None
        try:
            out = self.route(text)
        except QueryError as e:
            self.pending = text if e.message == WHICH else None
            out = {"spoken": f"{e.message} {e.next_step}".strip(), "error": True}
        self.spoken = out.get("spoken", self.spoken)
        return out

    def route(self, text: str) -> dict:
        t = self.tools
        if re.fullmatch(r"(?:repeat(?: that)?|say that again|what\?*|huh)", text):
            return {"spoken": self.spoken}
        for words, said in FIXED:
            if re.fullmatch(words, text):
                return {"spoken": said}
        if re.fullmatch(r"(?:start over|reset|start again)", text):
            self.table = self.sheet = self.last = self.last_answer = self.figure = None
            return {"spoken": "Starting over. " + t.table_list()["spoken"]}
        if re.fullmatch(r"help|help me|what can (?:you|i) (?:do|ask|say)", text):
            return {"spoken": f"Ask for totals, averages, counts, the highest or lowest, comparisons or rows. The columns are {cat.listing(self.region().columns)}."}
        if re.search(r"\b(?:what|which|list|how many)\b.*\b(?:tables|files)\b", text):
            return t.table_list()
        m = re.search(r"\b(?:open|use|switch to|go to)\s+(?:the\s+)?(.+)$", text)
        if m and not re.search(r"\brows?\b", m[1]):
            self.table, self.sheet, self.last = m[1].removesuffix(" table").strip(), None, None
            return t.table_describe(self.table)
        if re.fullmatch(r"tell me more|more about (?:it|this|the table)", text):
            return t.table_describe(self.table, self.sheet, "full")
        if re.search(r"\b(?:check|how did you read)\b.*\bhead(?:ing|er)s?\b", text):
            return t.table_structure(self.table, self.sheet)
        if UNSUPPORTED.search(text):
            return {"spoken": f"I can't work out a {UNSUPPORTED.search(text)[0]}. I can count, add, average, and find the highest or lowest."}
        if re.search(r"\bhow do you know\b|\bwhere (?:does|did) (?:that|it) come from\b|^why\b|^explain\b", text) and self.last_answer:
            return t.table_explain(self.last_answer)
        if re.fullmatch(r"(?:more|continue|next|go on)", text) and self.last and self.last.get("cursor"):
            return self._query({**self.last, "cursor": self.last["cursor"]})
        m = re.search(r"\b(\w+)\s+heading rows?\b|\bheading rows?\s+(\d)", text)
        if m:
            word = m[1] or m[2]
            n = WORD_NUMBERS.get(word, int(word) if word.isdigit() else None)
            return t.table_structure(self.table, self.sheet, n)
        m = re.fullmatch(r"(?:bookmark|save)(?: this)?(?: row (\d+))? as (.+)", text)
        if m:
            return t.table_bookmark(m[2], self.table, self.sheet, int(m[1] or 1))
        m = re.fullmatch(r"(?:resume|go back to)(?: (.+))?", text)
        if m:
            return t.table_resume(m[1])
        if re.search(r"\b(?:describe|tell me about|what(?:'s| is) in)\b", text):
            return t.table_describe(self.table, self.sheet, "full" if "more" in text else "brief")
        m = re.search(rf"\b(last|{'|'.join(ORDINALS)}) column\b", text)
        if m:
            own = self.region().columns
            n = len(own) if m[1] == "last" else ORDINALS[m[1]]
            if n > len(own):
                raise QueryError(f"There are only {len(own)} columns.", f"They are {cat.listing(own)}.")
            return {"column": own[n - 1].name, "spoken": f"The {m[1]} column is {own[n - 1].name}."}
        if re.search(r"\bcolumns?\b", text) and re.search(r"\b(?:what|which|list|how many)\b", text):
            return t.table_describe(self.table, self.sheet)
        m = re.match(r"(?:read|show)(?: me)?(?: the)? (?:rows?|first (\d+) rows?)(?: (?:from )?(\d+))?", text)
        if m:
            return t.table_read_rows(self.table, self.sheet, start_row=int(m[2] or 1), limit=int(m[1] or 5))
        m = re.match(r"(?:what|which|list)(?: the)?(?: different| distinct)? (\w+(?: \w+)?) (?:are there|do we have)", text)
        if m and self.columns_in(m[1]):
            c = self.columns_in(m[1])[0]
            found = sorted(x["value"] for x in composite.distinct_values(self.region(), c.name).orderBy("value").limit(25).collect())
            return {"values": found, "spoken": f"{c.name} has {', '.join(found)}."}
        m = re.match(r"compare (.+?) (?:with|to|and|against) (.+)", text)
        if m:
            a, b = self.columns_in(m[1]), self.columns_in(m[2])
            if a and b:
                return t.table_compare(self.table, self.sheet, a[0].name, b[0].name)
        if re.fullmatch(r"(?:which|what) (?:ones|rows)|list them|which are they", text) and self.last:
            return self._query({**self.last, "aggregate": "none", "aggregate_column": None, "group_by": None})
        return self.question(text)

    def against(self, text: str) -> dict | None:
        """Questions that set rows or groups against another row, another group or the last figure."""
        r = self.region()
        m = re.search(rf"\b({MORE}|{LESS})\b(.*)\bthan (?:that|this)$", text)
        if m and self.figure is not None:
            c = self.measure(text)
            return self._query({"filters": [Filter(c.name, "lt" if re.fullmatch(LESS, m[1]) else "gt", repr(self.figure))], "aggregate": "count" if text.startswith("how many") else "none"})
        m = re.search(rf"\bhow much ({MORE}|{LESS})\b(.*)\bthan\b(.+)$", text)
        if m:
            a, b = self.value_filters(m[2])[0], self.value_filters(m[3])[0]
            if a and b and a[0].column == b[0].column and a[0].value and b[0].value:
                c = self.measure(text)
                spec = QuerySpec((Filter(a[0].column, "eq", None, (a[0].value, b[0].value)),), "avg" if names.rate(c, r.columns) else "sum", c.name, a[0].column)
                got = {fold(x["key"]): x["value"] for x in compile.groups(r, spec).collect()}  # two at most but for spelling
                left, right = got.get(fold(a[0].value)), got.get(fold(b[0].value))
                if left is None or right is None:
                    raise QueryError("One of them has no number to compare.")
                self.figure = values.py_tidy(left - right)
                way = "more" if self.figure > 0 else "less" if self.figure < 0 else "the same"
                return {"difference": self.figure, "left": left, "right": right, "spoken": f"{a[0].value} has {speech.amount(abs(self.figure))} {way} than {b[0].value}: {speech.amount(left)} and {speech.amount(right)}."}
        m = re.search(rf"\b({MORE}|{LESS})\b(.*)\bthan\s+(?!\d|average\b|the average\b)(.+)$", text)
        other = self.row_named(m[3]) if m else None
        if m and other:
            dates = [c for c in r.columns if c.kind == "date"]
            c = dates[0] if m[1] in ("later", "earlier") and dates else self.measure(text[: m.start(3)])
            rows = composite.than_row(r, c.name, "lt" if re.fullmatch(LESS, m[1]) else "gt", *other)
            if text.startswith("how many"):
                n = rows.count()
                self.figure = n
                return {"result": n, "spoken": f"{speech.plural(n, 'row')}."}
            return self._named(rows.orderBy("_row"), f"{m[1]} than {other[1]} by {c.name}")
        m = re.search(r"\b(after|before)\s+(\D+)$", text)
        other = self.row_named(m[2]) if m and not re.search(DATE, m[2]) else None
        dates = [c for c in r.columns if c.kind == "date"]
        if other and dates:
            return self._named(composite.than_row(r, dates[0].name, "gt" if m[1] == "after" else "lt", *other).orderBy("_row"), f"{m[1]} {other[1]} by {dates[0].name}")
        m = re.search(r"\bsame\s+(\w+(?:\s\w+)?)\s+as\s+(.+)$", text)
        other = self.row_named(m[2]) if m else None
        if other and self.columns_in(m[1]):
            c = self.columns_in(m[1])[0]
            return self._named(composite.same_group(r, c.name, *other).orderBy("_row"), f"in the same {c.name} as {other[1]}")
        return None

    def arranged(self, text: str) -> dict | None:
        """Questions for all groups in an order, for how many groups there are, and for the best of each group."""
        r = self.region()
        m = re.match(r"(?:rank|sort|order)\s+(?:all\s+)?(?:the\s+)?(\w+(?:\s\w+)?)\s+by\s+(.+)$", text) or re.match(r"(?:the\s+)?(\w+)\s+by\s+(.+?)\s+from\s+", text)
        groups = [c for c in self.columns_in(m[1]) if not c.measure] if m else []
        if groups:
            c = self.measure(m[2])
            order = "asc" if re.search(r"\b(?:lowest|smallest|least) (?:to|first)\b|\bascending\b", text) else "desc"
            return self._query({"aggregate": "avg" if names.rate(c, r.columns) else "sum", "aggregate_column": c.name, "group_by": groups[0].name, "order": order, "limit": 20})
        if re.search(r"\bbreak (?:it|that|this|them|everything)? ?down$|\bbreakdown\b", text):
            by = composite.breakdown(r)
            if by is None:
                raise QueryError("No column of this table repeats.", "Name a column to break it down by.")
            if self.last and self.last.get("aggregate_column"):
                return self._query({**self.last, "group_by": by, "cursor": None})
            c = self.measure(text)
            return self._query({"aggregate": "avg" if names.rate(c, r.columns) else "sum", "aggregate_column": c.name, "group_by": by})
        m = re.match(r"how many (?:different |distinct )?(\w+(?: \w+)?)(?: (?:are there|do we have|are in (?:it|this|the table)))?$", text)
        repeating = [c for c in self.columns_in(m[1]) if self._repeats(c)] if m else []
        if repeating:
            n = composite.count_groups(r, repeating[0].name).first()["groups"]
            self.figure = n
            return {"result": n, "spoken": f"There are {n} in {repeating[0].name}."}
        each = re.search(r"\b(?:in|for|of|per) (?:each|every) (\w+)", text)
        groups = [c for c in self.columns_in(each[1]) if not c.measure] if each else []
        if groups and re.search(r"\b(?:top|bottom) (?:\d+|two|three|four|five|ten)\b", text):
            return {"spoken": "I can rank one list, or name the best of each group, but not several of each group."}
        high = re.search(r"\b(highest|largest|biggest|most|best|lowest|smallest|least|worst)\b", text)
        if groups and high and re.match(r"(?:who|which)\b", text):
            c = self.measure(text.replace(each[0], " "))
            spec = QuerySpec((), "max", c.name, groups[0].name, order="asc" if high[1] in ("lowest", "smallest", "least", "worst") else "desc")
            label, found = r.columns[r.label or 0], composite.best_per_group(r, spec).orderBy("_row").limit(20).collect()
            said = [f"{x['key']} {x[f'c{label.i}']} with {speech.amount(x[f'n{c.i}'])}" for x in found]
            return {"rows": [x[f"c{label.i}"] for x in found], "keys": [x["key"] for x in found], "spoken": f"By {groups[0].name}: {speech.listed(said)}."}
        m = re.match(r"how many\b.*?\b(?:with|has|have|had|in|for) the (highest|largest|biggest|most|best|lowest|smallest|least|worst)\b(.*)$", text)
        groups = [c for c in self.columns_in(text) if self._repeats(c)] if m else []
        if groups:
            c = self.measure(m[2])
            first = composite.top(r, QuerySpec((), "sum", c.name, groups[0].name, order="asc" if m[1] in ("lowest", "smallest", "least", "worst") else "desc"), 1).first()
            if first is not None:
                return self._query({"filters": [Filter(groups[0].name, "eq", first["key"])], "aggregate": "count"})
        return None

    def question(self, text: str) -> dict:
        found = self.against(text) or self.arranged(text)
        if found:
            return found
        conditions, rest = self.comparisons(text)
        follow = self.last is not None and re.match(r"(?:and|what about|how about|only|just)\b", text)
        values_in, left = self.value_filters(rest)
        filters = conditions + values_in
        self._refuse(left)
        aggregate = next((a for a, words in AGGREGATE_WORDS if re.search(words, rest)), None)
        m = re.search(r"\b(?:by|per|for each|in each|for every|broken down by|across)\s+(?:the\s+)?(\w+(?:\s\w+)?)", rest)
        group = next((c.name for c in self.columns_in(m[1]) if not c.measure), None) if m else None
        r = self.region()
        if re.search(r"\b(?:above|below|over|under|more than|less than) (?:the )?average\b", text):
            c = self.measure(text)
            op = "lt" if re.search(r"\b(?:below|under|less than)\b", text) else "gt"
            rows = composite.than_average(r, c.name, op).orderBy("_row")
            return self._named(rows, f"{op == 'gt' and 'above' or 'below'} the average {c.name}")
        if follow:
            kept = [Filter(**f) if isinstance(f, dict) else f for f in self.last.get("filters", ())]
            same = {f.column for f in filters}
            call = {**self.last, "filters": [f for f in kept if f.column not in same] + filters, "cursor": None}
            if aggregate:
                call["aggregate"] = aggregate
            if group:
                call["group_by"] = group
            return self._query(call)
        m = re.search(r"\b(top|bottom|highest|lowest|best|worst)\s+(\d+|two|three|four|five|ten)\b", text)
        if m:
            n = {"two": 2, "three": 3, "four": 4, "five": 5, "ten": 10}.get(m[2]) or int(m[2])
            c = self.measure(text)
            by = group or next((x.name for x in self.columns_in(rest) if not x.measure and x.kind != "date"), None) or r.columns[r.label or 0].name
            order = "asc" if m[1] in ("bottom", "lowest", "worst") else "desc"
            return self._query({"filters": filters, "aggregate": "avg" if names.rate(c, r.columns) else "sum", "aggregate_column": c.name, "group_by": by, "order": order, "limit": min(20, n)})
        m = re.search(rf"\b({'|'.join(PLACES)})[\s-](highest|largest|biggest|lowest|smallest)\b", text)
        if m:
            c = self.measure(text)
            order = "asc" if m[2] in ("lowest", "smallest") else "desc"
            spec = QuerySpec(tuple(filters), "max", c.name, order=order)
            return self._named(composite.nth_place(r, spec, PLACES[m[1]]).orderBy("_row"), f"in {m[1]} place by {c.name}")
        m = re.search(r"\bwhich\s+(\w+)\b.*\b(?:more|less|over|under|at least|at most)\b", text)
        if m and conditions and self.columns_in(m[1]) and self._repeats(self.columns_in(m[1])[0]):
            f = conditions[0]
            spec = QuerySpec(tuple(values_in), "sum", f.column, self.columns_in(m[1])[0].name)
            found = composite.having(r, spec, f.op, values.spoken_number(f.value)).orderBy(F.col("value").desc()).limit(20).collect()
            return {"groups": [x.asDict() for x in found], "spoken": f"{', '.join(x['key'] for x in found) or 'None'}."}
        if aggregate is None and not filters:
            odd = self._unknown(text)
            raise QueryError(f"I don't know {speech.listed([repr(w) for w in odd], 'or')} here." if odd else "I did not understand that.", f"Ask about {cat.listing(r.columns)}.")
        if aggregate is None:
            aggregate = "none"
            named = [c for c in self.columns_in(rest) if c.name not in {f.column for f in filters}]
            if named:
                return self._lookup(named[0], filters)
        call = {"filters": filters, "aggregate": aggregate, "group_by": group}
        if aggregate in ("sum", "avg", "min", "max"):
            c = self.measure(rest)
            if aggregate == "sum" and names.rate(c, r.columns) and not names.caution(names.rate(c, r.columns)):
                call["aggregate"] = "avg"
            call["aggregate_column"] = c.name
            who = re.match(r"(?:which|who|what)\s*(\w*)", text)
            if aggregate in ("max", "min") and who and who[1] and not group:
                asked = [x for x in self.columns_in(who[1]) if self._repeats(x)]
                if asked:
                    call |= {"group_by": asked[0].name, "aggregate": "sum", "order": "asc" if aggregate == "min" else "desc", "limit": 1}
        return self._query(call)

    def _lookup(self, c, filters: list[Filter]) -> dict:
        """A column of the rows that are meant: read out where it is one row."""
        out = self._query({"filters": filters, "aggregate": "none"})
        if out["matched_rows"] == 1:
            text = out["rows"][0][c.name]
            n = values.read_number(text) if c.measure and text is not None else None
            self.figure = n.value if n else self.figure
            out |= {"result": n.value if n else text, "spoken": f"{c.name} is {speech.cell(text, c.kind, c.date_order, c.identifier)}."}
        return out

    def _refuse(self, left: str) -> None:
        """A word at a question's end that names rows, after where, for, from or in, must be a value or a heading: else the
        answer would be about other rows than were asked for. left: the question without the conditions understood."""
        for m in re.finditer(r"\b(?:where|for|from|in)\s+(?:the\s+|all\s+|any\s+|only\s+)?((?:\w+\s*){1,4})$", left):
            odd = [w for w in self._asked(m[1]) if not w.isdigit() and values.month_number(w) is None and w not in NOT_VALUES]
            if odd:
                raise QueryError(f"I don't find {speech.listed([repr(w) for w in odd[:3]], 'or')} in this table.", f"The columns are {cat.listing(self.region().columns)}.")

    def _unknown(self, text: str) -> list[str]:
        """The words of a question that neither the table nor this router knows; three at most are named."""
        headings = {stem(w) for c in self.region().columns for w in re.findall(r"\w+", fold(c.name))}
        return [w for w in re.findall(r"[^\W\d_]+", text) if len(w) > 3 and stem(fold(w)) not in headings and w not in SMALL][:3]

    def _named(self, rows, what: str) -> dict:
        r = self.region()
        label = r.columns[r.label or 0]
        found = [x[f"c{label.i}"] for x in rows.limit(20).collect()]
        return {"rows": found, "spoken": f"{', '.join(map(str, found)) or 'No row'} {'is' if len(found) == 1 else 'are'} {what}."}

    def _query(self, call: dict) -> dict:
        args = {k: v for k, v in call.items() if v is not None}
        out = self.tools.table_query(self.table, self.sheet, **args)
        self.last, self.last_answer = {**call, "cursor": out["cursor"]}, out["answer_id"]
        figure = out["result"] if out["result"] is not None else out["groups"][0]["value"] if out["groups"] else None
        self.figure = figure if figure is not None else self.figure
        return out
