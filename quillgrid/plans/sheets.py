"""Many files read side by side: the structure of every table in a DataFrame of cells, by the code that ingest uses.

Cells come from sources/read.py (files parsed by one task each) or from anywhere else. A file's cells meet in one
task, which settles what only the whole file tells (decimal mark, order of dates) and reads each sheet; files are
independent of each other. A row comes back for each table, with what is known of its columns.
"""

from __future__ import annotations


import pandas as pd
from pyspark.sql import DataFrame

from ..functions import names
from ..sources.read import Read, Sheet
from . import ingest

COLUMN = "letter:string,path:array<string>,spoken:string,kind:string,identifier:string,measure:boolean,note:string,date_order:string,non_empty:long,empty:long,distinct:long,non_numeric:long,categories:array<string>,least:double,greatest:double,sum:double,mean:double"
TABLES = f"file string, sheet string, region string, title string, top int, left int, bottom int, right int, header_rows int, ambiguous boolean, label string, records int, summary array<int>, inherited int, convention string, columns array<struct<{COLUMN}>>, warnings array<string>"


def _value(kind: str, text: str, number: float, instant):
    if kind == "number":
        return float(number)
    if kind == "instant":
        return pd.Timestamp(instant).to_pydatetime()
    return text == "true" if kind == "boolean" else text


def _sheets(cells: pd.DataFrame) -> list[Sheet]:
    """The grids of a file's cells; a cell of kind "merge" is no value but a range such as B2:D5."""
    out = []
    for name, own in cells.groupby("sheet", sort=True):
        merged, own = own[own["kind"] == "merge"], own[own["kind"] != "merge"]
        grid = [[None] * (int(own["c"].max()) + 1) for _ in range(int(own["r"].max()) + 1)] if len(own) else []
        for r, c, *v in zip(own["r"], own["c"], own["kind"], own["text"], own["number"], own["instant"], strict=True):
            grid[r][c] = _value(*v)
        out.append(Sheet(name, grid, [m for t in merged["text"] if (m := names.merge_range(t))]))
    return out


def _column(c) -> dict:
    p = c.profile
    told = {"least": p.get("min"), "greatest": p.get("max"), **{k: p.get(k) for k in ("non_empty", "empty", "distinct", "non_numeric", "categories", "sum", "mean")}}
    return {"letter": c.letter, "path": list(c.path), "spoken": c.spoken, "kind": c.kind, "identifier": c.identifier, "measure": c.measure, "note": c.number_note, "date_order": c.date_order, **told}


def _tables(cells: pd.DataFrame) -> pd.DataFrame:
    file, rows = cells["file"].iloc[0], []
    regions, warnings = ingest.build(None, Read(_sheets(cells)), file)
    for r in regions:
        top, left = r.origin
        label = r.columns[r.label].name if r.label is not None else None
        rows.append((file, r.sheet, r.id, r.title, top, left, top + len(r.raw) - 1, left + len(r.columns) - 1, r.structure.get("rows"), bool(r.structure.get("ambiguous")), label, r.row_count - len(r.summary_rows), list(r.summary_rows), len(r.inherited), r.reading["convention"], [_column(c) for c in r.columns], warnings))
    return pd.DataFrame(rows, columns=[x.split()[0] for x in TABLES.split(", ")])


def tables(cells: DataFrame) -> DataFrame:
    """TABLES of cells (file, sheet, r, c, kind, text, number, instant)."""
    return cells.groupBy("file").applyInPandas(_tables, TABLES)


