"""Nine tools over a catalog: list, describe, structure, query, explain, read rows, compare, bookmark, resume.

Each returns a dict of results with a ``spoken`` sentence. Answers and bookmarks are kept in a store.
"""

from __future__ import annotations

import secrets
import time
from dataclasses import replace

from pyspark.sql import functions as F
from pyspark.sql import SparkSession

from .functions import names, speech
from .model import Filter, QueryError, QuerySpec, Region
from .operators import composite
from .plans import catalog as cat
from .plans import compile, ingest

WORDS = {"sum": "total", "avg": "average", "min": "lowest", "max": "highest"}
ANSWERS, BOOKMARKS, ANSWER_DAYS, BOOKMARK_DAYS = 50, 100, 7, 90


class Store:
    """Answers and bookmarks of a session: the newest so many, each for so many days."""

    def __init__(self, clock=time.time):
        self.clock, self.seq = clock, 0
        self.answers: dict[str, tuple[float, dict]] = {}
        self.bookmarks: dict[str, tuple[float, dict]] = {}

    def keep(self, answer: dict) -> str:
        self.seq += 1
        key = f"a{self.seq}-{secrets.token_hex(8)}"
        self.answers[key] = (self.clock(), answer)
        while len(self.answers) > ANSWERS:
            self.answers.pop(next(iter(self.answers)))
        return key

    def answer(self, key: str) -> dict:
        at, found = self.answers.get(key, (0, None))
        if found is None or self.clock() - at > ANSWER_DAYS * 86400:
            raise QueryError("That answer is no longer kept.", "Ask the question again.")
        return found

    def mark(self, name: str, value: dict) -> None:
        self.bookmarks.pop(name.lower(), None)
        self.bookmarks[name.lower()] = (self.clock(), value | {"name": name})
        while len(self.bookmarks) > BOOKMARKS:
            self.bookmarks.pop(next(iter(self.bookmarks)))

    def marks(self) -> list[dict]:
        return [v for at, v in reversed(self.bookmarks.values()) if self.clock() - at <= BOOKMARK_DAYS * 86400]


def offset_of(cursor: str | None) -> int:
    try:
        return max(0, int(cursor or 0))
    except ValueError:
        return 0


class Tools:
    def __init__(self, spark: SparkSession, catalog: cat.Catalog, store: Store | None = None):
        self.spark, self.catalog, self.store = spark, catalog, store or Store()
        self.overrides: dict[str, Region] = {}

    def _region(self, table_id=None, sheet=None) -> Region:
        found = self.catalog.locate(table_id, sheet)
        return self.overrides.get(found.id, found)

    def _filters(self, filters) -> tuple[Filter, ...]:
        if len(filters or ()) > 10:
            raise QueryError("That is more than ten conditions.", "Ask with fewer.")
        return tuple(f if isinstance(f, Filter) else Filter(f["column"], f["op"], f.get("value"), tuple(f["values"]) if f.get("values") else None) for f in filters or ())

    def _elsewhere(self, region: Region, e: QueryError) -> QueryError:
        """Names the table that has the column which this one lacks."""
        if e.missing:
            for key, regions in self.catalog.tables.items():
                for r in regions:
                    if r.id != region.id and len(cat.matches(r, e.missing)) == 1:
                        return QueryError(e.message, f"{self.catalog.titles[key]} has it, in {r.title}.", e.missing)
        return e

    def table_list(self, cursor: str | None = None) -> dict:
        at, keys = offset_of(cursor), list(self.catalog.tables)
        page = [{"table_id": k, "title": self.catalog.titles[k], "sheets": sorted({r.sheet for r in rs}), "row_count": sum(r.row_count or 0 for r in rs), "regions": [r.id for r in rs]} for k, rs in list(self.catalog.tables.items())[at : at + 5]]
        more = at + 5 < len(keys)
        said = f"There {'is' if len(keys) == 1 else 'are'} {speech.plural(len(keys), 'table')}: {speech.listed([p['title'] for p in page])}{', and more' if more else ''}."
        return {"tables": page, "more_available": more, "cursor": str(at + 5) if more else None, "spoken": said}

    def table_describe(self, table_id=None, sheet=None, detail="brief", cursor=None) -> dict:
        r = self._region(table_id, sheet)
        at = offset_of(cursor)
        columns = [{"name": c.name, "spoken_name": c.spoken, "header_path": list(c.path), "type": c.kind, "source_column": c.letter, "no_total": names.rate(c, r.columns), **c.profile} for c in r.columns]
        count = r.row_count if r.row_count is not None else r.df.count()
        said = [f"{r.title} has {speech.plural(count - len(r.summary_rows), 'row')} and {speech.plural(len(columns), 'column')}."]
        said.append(f"The columns are {cat.listing(r.columns[at:], 8)}.")
        if r.summary_rows:
            said.append(f"{speech.plural(len(r.summary_rows), 'summary row')} {'is' if len(r.summary_rows) == 1 else 'are'} left out of every figure.")
        if detail == "full":
            said += [f"{c.spoken} is {c.kind}" + (f", from {speech.number(c.profile['min'])} to {speech.number(c.profile['max'])}" if "min" in c.profile else "") + "." for c in r.columns]
        return {"row_count": count, "summary_rows": [i + 1 for i in r.summary_rows], "header_levels": r.structure.get("rows"), "merged_label_cells": len(r.inherited), "columns": columns, "regions": [x.id for x in self.catalog.tables.get(table_id or next(iter(self.catalog.tables)), [])], "cursor": str(at + 8) if at + 8 < len(columns) else None, "spoken": " ".join(said)}

    def table_structure(self, table_id=None, sheet=None, header_rows: int | None = None) -> dict:
        r = self._region(table_id, sheet)
        if header_rows is None:
            s = r.structure
            doubt = " I am not certain of that." if s.get("ambiguous") else ""
            return {"header_rows": s.get("rows"), "why": s.get("why"), "ambiguous": s.get("ambiguous", False), "alternatives": s.get("alternatives", []), "revision": r.revision, "spoken": f"I read {speech.plural(s.get('rows') or 0, 'heading row')}, as {s.get('why')}.{doubt}"}
        if not 0 <= header_rows <= 5:
            raise QueryError("A table has between no and five heading rows.", "Say a number from 0 to 5.")
        if r.raw is None:
            raise QueryError("This table's headings come with its data and can't be read otherwise.")
        before = r.structure.get("rows")
        new = ingest.reread(self.spark, r, header_rows) if header_rows != before else replace(r, structure=r.structure | {"ambiguous": False})
        self.overrides[r.id] = new
        return {"previous_header_rows": before, "changed": header_rows != before, "data_rows": new.row_count, "revision": new.revision, "spoken": f"I now read {speech.plural(header_rows, 'heading row')}. The columns are {cat.listing(new.columns)}."}

    def table_query(self, table_id=None, sheet=None, filters=(), aggregate="none", aggregate_column=None, group_by=None, order="desc", limit=5, cursor=None) -> dict:
        r = self._region(table_id, sheet)
        spec = QuerySpec(self._filters(filters), aggregate, aggregate_column, group_by, order, min(20, max(1, limit)), offset_of(cursor))
        try:
            x = compile.run(r, spec)
        except QueryError as e:
            raise self._elsewhere(r, e) from None
        answer = {"region": r.id, "revision": r.revision, "stamp": r.reading.get("stamp"), "spec": spec, "parts": [self._part(r, x)]}
        out = {"result": x.value, "exact": None if x.value is None else speech.exact(x.value), "matched_rows": x.matched, "rows": x.rows, "winners": x.winners, "winner_count": x.winner_count, "left_out_summary_rows": x.skipped_summary, "unreadable_rows": x.unreadable}
        out |= {"groups": [g | {"exact": None if g["value"] is None else speech.exact(g["value"])} for g in x.groups], "group_count": x.group_count, "provenance": x.cells, "answer_id": self.store.keep(answer), "cursor": None if x.next_offset is None else str(x.next_offset)}
        return out | {"spoken": self._say(r, spec, x)}

    def _part(self, r: Region, x) -> dict:
        return {"name": x.column.name if x.column else "rows", "sheet": r.sheet, "cells": x.cells, "total_cells": x.cell_count, "header_path": list(x.column.path) if x.column else [], "excluded": x.excluded, "excluded_count": x.excluded_count, "winning_cells": [names.a1(int(w["_row"]) + r.first_data_row, x.column.i + r.origin[1]) for w in x.winners] if x.column else []}

    def _condition(self, f: Filter) -> str:
        words = {"eq": "is", "neq": "is not", "gt": "is over", "gte": "is at least", "lt": "is under", "lte": "is at most", "contains": "contains", "is_empty": "is empty", "is_not_empty": "is not empty"}
        return f"{f.column} {words[f.op]} {speech.listed(list(f.values), 'or') if f.values else f.value or ''}".strip()

    def _say(self, r: Region, spec: QuerySpec, x) -> str:
        where = f" where {speech.listed([self._condition(f) for f in spec.filters])}" if spec.filters else ""
        percent = bool(x.column and x.column.kind == "percent")
        if x.matched == 0:
            k = x.first_empty_filter
            said = f"No row matches{where}." if k is None else f"No row has {self._condition(spec.filters[k])}."
        elif spec.group_by:
            parts = [f"{g['key']} {speech.amount(g['value'], percent)}" for g in x.groups]
            kept = speech.within(parts, 90)
            what = "Rows" if spec.aggregate == "count" else f"The {WORDS[spec.aggregate]} {x.column.name}"
            said = f"{what} by {spec.group_by}{where}: {speech.listed(kept)}." + (f" That is {len(kept)} of {x.group_count} groups." if len(kept) < x.group_count else "")
        elif spec.aggregate == "count":
            said = f"{speech.plural(x.matched, 'row')} {'matches' if x.matched == 1 else 'match'}{where}." if spec.filters else f"There are {speech.plural(x.matched, 'row')}."
        elif spec.aggregate == "none":
            rows = ["; ".join(f"{c.spoken} {speech.cell(row[c.name], c.kind, c.date_order, c.identifier)}" for c in r.columns) for row in x.rows]
            said = f"{speech.plural(x.matched, 'row')} match{where}. " + ". ".join(speech.within(rows, 120)) + "."
        elif x.value is None:
            said = f"No row has a number in {x.column.name}{where}."
        else:
            said = f"The {WORDS[spec.aggregate]} {x.column.name}{where} is {speech.amount(x.value, percent)}, from {speech.plural(x.cell_count, 'cell')}."
            if x.winners and r.label is not None:
                who = [str(w[r.columns[r.label].name]) for w in x.winners]
                said = said[:-1] + f", for {speech.listed(who)}" + (f" and {x.winner_count - len(who)} more" if x.winner_count > len(who) else "") + "."
        notes = list(x.notes)
        if x.excluded_count:
            notes.append(f"{speech.plural(x.excluded_count, 'cell')} {'was' if x.excluded_count == 1 else 'were'} left out as empty or not a number.")
        if x.skipped_summary:
            notes.append(f"{speech.plural(x.skipped_summary, 'summary row')} {'was' if x.skipped_summary == 1 else 'were'} not counted.")
        if x.unreadable:
            notes.append(f"{speech.plural(x.unreadable, 'row')} could not be read for this.")
        return " ".join([said, *notes])

    def table_explain(self, answer_id: str, limit: int = 5, window: int = 40) -> dict:
        """What was kept of an answer; nothing is worked out again but the rows around its first cells."""
        a = self.store.answer(answer_id)
        r = next((self.overrides.get(x.id, x) for rs in self.catalog.tables.values() for x in rs if x.id == a["region"]), None)
        parts, grid = a["parts"], []
        p = parts[0]
        if r is not None and p["cells"]:
            first = int("".join(c for c in p["cells"][0] if c.isdigit())) - 1 - r.first_data_row
            low = max(0, first - window // 2)
            grid = [[row["_row"], *(row[f"c{c.i}"] for c in r.columns)] for row in r.df.where(F.col("_row").between(low, low + window - 1)).orderBy("_row").collect()]
        shown = p["cells"][: min(50, max(1, limit))]
        said = f"{p['name']} came from {speech.plural(p['total_cells'], 'cell')}, such as {speech.listed(shown)}." if shown else "No cell was behind that answer."
        if p["excluded_count"]:
            said += f" Left out: {speech.listed([f'{c} ({why})' for c, why in p['excluded'][:3]])}."
        changes = {
            "table_gone": r is None,
            "structure_changed_since": r is None or r.revision != a["revision"],
            "file_changed_since": r is not None and r.reading.get("stamp") != a["stamp"],
        }
        words = {"table_gone": "That table is no longer loaded.", "structure_changed_since": "The headings were read anew since.", "file_changed_since": "The file has changed since, so the cells may hold other figures now."}
        noted = next((words[k] for k in ("table_gone", "file_changed_since", "structure_changed_since") if changes[k]), "")
        return {"parts": parts, **changes, "grid": grid, "spoken": f"{said} {noted}".strip()}

    def table_read_rows(self, table_id=None, sheet=None, columns=(), start_row: int = 1, cursor=None, limit: int = 5) -> dict:
        """Rows as they stand, summary rows included."""
        r = self._region(table_id, sheet)
        if not r.ordered:
            raise QueryError("The rows of this table have no order, so none can be read by its place.", "Register it with a key that orders them.")
        start, limit = (offset_of(cursor) or start_row) if cursor else max(1, start_row), min(10, max(1, limit))
        picked = sorted({c.i for n in columns for c in (cat.matches(r, n) or [cat.resolve(r, n)])}) or [c.i for c in r.columns]
        found = r.df.where(F.col("_row") >= start - 1).orderBy("_row").limit(limit + 1).select("_row", *(f"c{i}" for i in picked)).collect()
        if not found:
            raise QueryError("There is no row that far down.", "Say an earlier row.")
        rows = [{r.columns[i].name: row[f"c{i}"] for i in picked} for row in found[:limit]]
        said = [f"Row {row['_row'] + 1}: " + ", ".join(f"{r.columns[i].spoken} {speech.cell(row[f'c{i}'], r.columns[i].kind, r.columns[i].date_order, r.columns[i].identifier)}" for i in picked) + "." for row in found[:limit]]
        return {"rows": rows, "start_row": start, "returned": len(rows), "total_rows": r.row_count, "summary_rows": [i + 1 for i in r.summary_rows], "columns_not_read": len(r.columns) - len(picked), "cursor": str(start + limit) if len(found) > limit else None, "spoken": " ".join(speech.within(said, 150))}

    def table_compare(self, table_id=None, sheet=None, left_column=None, right_column=None, right_table_id=None, right_sheet=None, aggregate=None, filters=()) -> dict:
        left = self._region(table_id, sheet)
        right = self._region(right_table_id, right_sheet) if right_table_id or right_sheet else left
        row = composite.compare(left, left_column, right, right_column, aggregate, self._filters(filters)).first()
        a, b = cat.resolve(left, left_column), cat.resolve(right, right_column)
        side = lambda c, v: {"name": c.name, "value": v, "exact": None if v is None else speech.exact(v)}
        if row["left_value"] is None or row["right_value"] is None:
            said = "One side has no number to compare."
        elif row["direction"] == "equal":
            said = f"{a.name} and {b.name} are equal, at {speech.amount(row['left_value'])}."
        else:
            share = f", {speech.amount(abs(row['percent']))} percent" if row["percent"] is not None else ""
            said = f"{a.name} is {speech.amount(row['left_value'])} and {b.name} is {speech.amount(row['right_value'])}: {speech.amount(abs(row['difference']))} {row['direction']}{share}."
        key = self.store.keep({"region": left.id, "revision": left.revision, "stamp": left.reading.get("stamp"), "spec": None, "parts": [{"name": c.name, "sheet": r.sheet, "cells": [], "total_cells": 0, "header_path": list(c.path), "excluded": [], "excluded_count": 0} for r, c in ((left, a), (right, b))]})
        return {"left": side(a, row["left_value"]), "right": side(b, row["right_value"]), "difference": row["difference"], "percent_difference": row["percent"], "answer_id": key, "spoken": said}

    def table_bookmark(self, name: str, table_id=None, sheet=None, row: int = 1, note: str | None = None) -> dict:
        r = self._region(table_id, sheet)
        if row < 1 or (r.row_count is not None and row > r.row_count):
            raise QueryError("There is no such row to mark.", "Say a row of the table.")
        self.store.mark(name, {"table_id": table_id, "sheet": sheet, "row": row, "note": (note or "")[:500], "region_id": r.id, "revision": r.revision})
        return {"name": name, "table_id": table_id, "row": row, "spoken": f"Marked row {row} of {r.title} as {names.clean(name, 60)}."}

    def table_resume(self, name: str | None = None) -> dict:
        marks = self.store.marks()
        hit = next((m for m in marks if name is None or m["name"].lower() == name.lower()), None)
        if hit is None:
            raise QueryError("There is no such bookmark." if name else "There are no bookmarks.", "Save one first.")
        r = self._region(hit["table_id"], hit["sheet"])
        read = self.table_read_rows(hit["table_id"], hit["sheet"], start_row=hit["row"], limit=1)
        changed = r.revision != hit["revision"]
        return {"row": hit["row"], "region_id": hit["region_id"], "note": hit["note"], "row_spoken": read["spoken"], "others": [m["name"] for m in marks if m is not hit], "changed_since_saved": changed, "spoken": f"Back at {hit['name']}. {read['spoken']}" + (" The headings were read anew since." if changed else "")}
