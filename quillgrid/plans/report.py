"""Files to an index from the command line: ``python -m quillgrid.plans.report FILE... --out FOLDER [--titles FILE]``.

All files are read before anything is written; if one can't be read, nothing is. The report says how each table was
read, so that a wrong reading is seen before it is heard.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from ..functions import speech
from ..model import Region
from ..sources import read as source
from . import ingest
from .catalog import Catalog


def described(r: Region) -> list[str]:
    """A region's reading in lines: headings with their evidence, columns with kinds and figures, rows left out."""
    s = r.structure
    heads = s.get("rows") or 0
    out = [f'  {r.id} "{r.title}": {speech.plural(r.row_count or 0, "row")}, {speech.plural(len(r.columns), "column")}']
    out.append(f"    headings: {speech.plural(heads, 'row')}, {s.get('why')} (evidence {s.get('score', 1):.2f})")
    if s.get("ambiguous"):
        out.append(f"    NOT CERTAIN; else {s.get('alternatives')}")
    for c in r.columns:
        p = c.profile
        more = ""
        if "sum" in p and c.identifier != "row":
            more = f"  sum {speech.exact(p['sum'])}, {speech.exact(p['min'])} to {speech.exact(p['max'])}" + (f", {p['non_numeric']} not numbers" if p.get("non_numeric") else "")
        elif c.identifier == "row":
            more = "  numbers the rows"
        elif p.get("categories"):
            more = "  " + " | ".join(p["categories"][:6]) + (" …" if len(p["categories"]) > 6 else "")
        out.append(f"      {c.letter}  {c.name}  {c.kind}  {p.get('non_empty', 0)} of {p.get('non_empty', 0) + p.get('empty', 0)}{more}")
    if r.summary_rows:
        out.append(f"    left out of figures, sheet rows {', '.join(str(r.first_data_row + i + 1) for i in r.summary_rows)}")
    if r.inherited:
        out.append(f"    {speech.plural(len(r.inherited), 'cell')} filled from merged labels")
    return out


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="quillgrid", description="Reads spreadsheet files into an index.")
    p.add_argument("files", nargs="+")
    p.add_argument("--out")
    p.add_argument("--titles", help="a JSON object of titles by file name")
    a = p.parse_args(argv)
    titles = {}
    if a.titles:
        with open(a.titles, encoding="utf-8") as f:
            titles = json.load(f)
    files, empty = source.expand(a.files)
    wrong = [f"No files match {x}" for x in empty]
    wrong += [f"--titles names {x}, which is not one of the files" for x in titles if x not in {f.rsplit("/", 1)[-1] for f in files}]
    catalog = Catalog()
    spark = spark or SparkSession.builder.appName("quillgrid").getOrCreate()
    for f in files:
        try:
            warnings = ingest.ingest(spark, [f], catalog, titles)
        except Exception as e:  # every file is tried, so that all that is wrong is said at once
            wrong.append(f"{f}: {e}")
            continue
        table = list(catalog.tables)[-1]
        print(f"\n{catalog.titles[table]}")
        for r in catalog.tables[table]:
            print("\n".join(described(r)))
        for w in warnings:
            print(f"  ! {w}")
    if wrong:
        print("\n".join(["", *wrong, "Nothing written."]), file=sys.stderr)
        return 1
    if a.out:
        ingest.save(catalog, a.out)
        print(f"\nwrote {a.out} ({speech.plural(len(catalog.tables), 'table')})")
    return 0


if __name__ == "__main__":
    sys.exit(main())
