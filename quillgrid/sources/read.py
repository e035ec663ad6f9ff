"""Spreadsheet files as grids: delimited text and workbooks, from bytes, on the driver or in a Spark job."""

from __future__ import annotations

import csv
import datetime as dt
import glob
import hashlib
import io
import os
import re
import tempfile
import unicodedata
import zipfile
from dataclasses import dataclass, field
from xml.etree import ElementTree as ET

from ..functions.names import merge_range

SUPPORTED = (".xlsx", ".xlsm", ".csv", ".tsv")
DELIMITERS = ",;\t|"


@dataclass
class Sheet:
    name: str
    grid: list[list]
    merges: list[tuple[int, int, int, int]] = field(default_factory=list)


@dataclass
class Read:
    sheets: list[Sheet]
    warnings: list[str] = field(default_factory=list)
    delimiter: str | None = None


def decode(data: bytes) -> str:
    """UTF-16 by its mark, UTF-8 where valid, else Vietnamese or Western code pages."""
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return data.decode("utf-16")
    try:
        return data.decode("utf-8-sig")
    except UnicodeDecodeError:
        pass
    viet = data.decode("cp1258", "replace")
    if re.search("[ăâđêôơưĂÂĐÊÔƠƯ]", viet) and len(re.findall("[̣̀́̃̉₫ăđơư]", viet)) >= 2:
        return unicodedata.normalize("NFC", viet)
    return data.decode("cp1252", "replace")


def sniff(text: str) -> str:
    """The delimiter by which most of the first 50 lines have the same number of fields, two at least."""
    lines = [x for x in text.splitlines()[:50] if x.strip()]

    def score(d: str) -> int:
        counts: dict[int, int] = {}
        for row in csv.reader(lines, delimiter=d):
            if len(row) >= 2:
                counts[len(row)] = counts.get(len(row), 0) + 1
        return max(counts.values(), default=0)

    return max(DELIMITERS, key=lambda d: (score(d), -DELIMITERS.index(d)))


def delimited(data: bytes, name: str, tab: bool = False) -> Read:
    """Blank lines stay: they part tables. Cells are trimmed text, empty ones None."""
    text = decode(data)
    delimiter = "\t" if tab else sniff(text)
    warnings: list[str] = []
    rows = []
    try:
        for row in csv.reader(io.StringIO(text, newline=""), delimiter=delimiter):
            rows.append([x.strip() or None for x in row])
    except csv.Error as e:
        warnings.append(f"Line {len(rows) + 1} could not be read: {e}.")
    width = max(map(len, rows), default=0)
    return Read([Sheet(name, [r + [None] * (width - len(r)) for r in rows])], warnings, delimiter)


_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships"}
_BUILT_IN = {9: "0%", 10: "0.00%", 14: "m/d/yy", 15: "d-mmm-yy", 16: "d-mmm", 17: "mmm-yy", 18: "h:mm AM/PM", 19: "h:mm:ss AM/PM", 20: "h:mm", 21: "h:mm:ss", 22: "m/d/yy h:mm", 45: "mm:ss", 46: "[h]:mm:ss", 47: "mm:ss.0"}


def tidy_text(x: float) -> str:
    return f"{float(f'{x:.12g}'):.12g}" if abs(x) < 1e12 else str(int(x)) if x == int(x) else repr(x)


def formatted(x: float, code: str, since: dt.datetime):
    """A number as its format means it: percent text, zero-padded codes, times of day, dates."""
    bare = re.sub(r'"[^"]*"|\\.|\[(?![hms])[^\]]*\]', "", code or "")
    if "%" in bare:
        return f"{tidy_text(x * 100)}%"
    if re.fullmatch("0{2,}", bare) and x == int(x) and x >= 0:
        return str(int(x)).zfill(len(bare))
    if re.search("[ymdhs]", bare, re.I) and not re.search("[#0?]", re.sub(r"\.0+", "", bare)):
        has_day = re.search("[yd]", bare, re.I)
        if not has_day or (0 <= x < 1 and re.search("h", bare, re.I)):
            seconds = round(x * 86400)
            if "[h" not in bare.lower():
                seconds %= 86400
            h, m, s = seconds // 3600, seconds // 60 % 60, seconds % 60
            return f"{h:02d}:{m:02d}" + (f":{s:02d}" if s or "s" in bare.lower() else "")
        return since + dt.timedelta(seconds=round(x * 86400))
    return int(x) if x == int(x) and abs(x) < 1e15 else x


def workbook(data: bytes) -> Read:
    """Visible sheets of a workbook; formulas by their stored results, hidden rows and columns included."""
    warnings: list[str] = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        xml = lambda path: ET.fromstring(z.read(path))
        book = xml("xl/workbook.xml")
        rels = {x.get("Id"): x.get("Target") for x in xml("xl/_rels/workbook.xml.rels")}
        pr = book.find("m:workbookPr", _NS)
        since = dt.datetime(1904, 1, 1) if pr is not None and pr.get("date1904") in ("1", "true") else dt.datetime(1899, 12, 30)
        strings = ["".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t") if t is not None) for si in xml("xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in names else []
        codes: list[str] = []
        if "xl/styles.xml" in names:
            styles = xml("xl/styles.xml")
            own = {int(f.get("numFmtId")): f.get("formatCode") for f in styles.iterfind("m:numFmts/m:numFmt", _NS)}
            codes = [own.get(int(x.get("numFmtId", 0)), _BUILT_IN.get(int(x.get("numFmtId", 0)), "")) for x in styles.iterfind("m:cellXfs/m:xf", _NS)]
        sheets = []
        for s in book.iterfind("m:sheets/m:sheet", _NS):
            if s.get("state") in ("hidden", "veryHidden"):
                warnings.append(f"The hidden sheet {s.get('name')} was left out.")
                continue
            target = rels[s.get(f"{{{_NS['r']}}}id")].lstrip("/")
            sheets.append(_sheet(xml(target if target.startswith("xl/") else f"xl/{target}"), s.get("name"), strings, codes, since, warnings))
    return Read(sheets, warnings)


def _sheet(root, name, strings, codes, since, warnings) -> Sheet:
    cells: dict[tuple[int, int], object] = {}
    row_at = 0
    for row in root.iterfind("m:sheetData/m:row", _NS):
        row_at = int(row.get("r", row_at + 1))
        if row.get("hidden") in ("1", "true"):
            warnings.append(f"Row {row_at} of {name} is hidden and was read.")
        col_at = -1
        for c in row.iterfind("m:c", _NS):
            place = merge_range(c.get("r")) if c.get("r") else None
            col_at = place[1] if place else col_at + 1
            v, kind = c.find("m:v", _NS), c.get("t", "n")
            if kind == "inlineStr":
                value = "".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t"))
            elif v is None or v.text is None:
                continue
            elif kind == "s":
                value = strings[int(v.text)]
            elif kind == "b":
                value = v.text == "1"
            elif kind in ("str", "e"):
                value = v.text
            elif kind == "d":
                value = dt.datetime.fromisoformat(v.text.replace("Z", ""))
            else:
                style = int(c.get("s", 0))
                value = formatted(float(v.text), codes[style] if style < len(codes) else "", since)
            cells[row_at - 1, col_at] = value
    merges = [m for m in (merge_range(x.get("ref", "")) for x in root.iterfind("m:mergeCells/m:mergeCell", _NS)) if m]
    height, width = (max((p[k] for p in cells), default=-1) + 1 for k in (0, 1))
    return Sheet(name, [[cells.get((r, c)) for c in range(width)] for r in range(height)], merges)


def read_bytes(data: bytes, name: str) -> Read:
    stem, ext = os.path.splitext(os.path.basename(name))
    if ext.lower() in (".xlsx", ".xlsm"):
        return workbook(data)
    if ext.lower() in (".csv", ".tsv"):
        return delimited(data, stem, ext.lower() == ".tsv")
    raise ValueError(f"{name}: only {', '.join(SUPPORTED)} files can be read")


def read_file(path: str) -> Read:
    with open(path, "rb") as f:
        return read_bytes(f.read(), path)


def stamp(path: str) -> str:
    """By which a file that has changed is told."""
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "md5").hexdigest()


def expand(patterns: list[str]) -> tuple[list[str], list[str]]:
    """Paths of patterns with * ? [..] in any part; and the patterns that match nothing."""
    found, empty = [], []
    for p in patterns:
        hits = sorted(glob.glob(p)) if re.search(r"[*?\[]", p) else [p]
        found += hits
        if not hits:
            empty.append(p)
    return list(dict.fromkeys(found)), empty


CELLS = "file string, sheet string, r int, c int, kind string, text string, number double, instant timestamp_ntz"


def cell_rows(data: bytes, name: str):
    for sheet in read_bytes(data, name).sheets:
        for r, row in enumerate(sheet.grid):
            for c, v in enumerate(row):
                if v is None or (isinstance(v, str) and not v.strip()):
                    continue
                kind = "boolean" if isinstance(v, bool) else "number" if isinstance(v, (int, float)) else "instant" if isinstance(v, dt.datetime) else "text"
                text = ("true" if v else "false") if kind == "boolean" else v.strftime("%Y-%m-%dT%H:%M:%S.000Z") if kind == "instant" else str(v)
                yield name, sheet.name, r, c, kind, text, float(v) if kind == "number" else None, v if kind == "instant" else None


def cells(spark, path: str):
    """All filled cells of the files of a path, a row each: files are read side by side, each by one task."""
    import pandas as pd

    names = [x.split()[0] for x in CELLS.split(", ")]

    def parse(batches):
        for batch in batches:
            for name, data in zip(batch["path"], batch["content"], strict=True):
                rows = list(cell_rows(bytes(data), name))
                for at in range(0, len(rows), 10_000):
                    yield pd.DataFrame(rows[at : at + 10_000], columns=names).astype({"r": "int32", "c": "int32"})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, CELLS)


def shared_folder(spark) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share; where it is unset, as in tests, one of the session's own."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("quillgrid.folder", None)
    if not where:
        where = tempfile.mkdtemp(prefix="quillgrid-")
        spark.conf.set("quillgrid.folder", where)
    return where
