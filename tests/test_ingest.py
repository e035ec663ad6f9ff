import datetime as dt
import io
import random
import zipfile

import pytest

from quillgrid.model import Filter, QueryError, QuerySpec
from quillgrid.operators import grid as g
from quillgrid.plans import compile, ingest
from quillgrid.plans.catalog import Catalog
from quillgrid.sources import read

FLAT = "Region,Rep,Revenue,Closed\nNorth,Anh,12400,2026-07-04\nNorth,Bảo,8150,2026-07-19\nSouth,Chi,21000,2026-08-02\nSouth,Dũng,3900,2026-08-27\nEast,An,15600,2026-09-01\n"


def build(spark, text, name="t.csv"):
    return ingest.build(spark, read.read_bytes(text.encode(), name), name)


def region(spark, text, name="t.csv"):
    return build(spark, text, name)[0][0]


def kinds(r):
    return [c.kind for c in r.columns]


def test_flat(spark):
    r = region(spark, FLAT)
    assert kinds(r) == ["text", "text", "number", "date"] or kinds(r) == ["category", "text", "number", "date"]
    assert r.columns[2].profile["sum"] == 61050 and r.columns[r.label].name == "Rep"
    x = compile.run(r, QuerySpec(aggregate="sum", column="revenue"))
    assert x.value == 61050 and x.cells == ["C2", "C3", "C4", "C5", "C6"]
    assert compile.run(r, QuerySpec((Filter("Revenue", "gt", "10000"),), "count")).value == 3
    x = compile.run(r, QuerySpec(aggregate="sum", column="Revenue", group_by="Region", limit=2))
    assert [(k["key"], k["value"]) for k in x.groups] == [("South", 24900), ("North", 20550)] and x.next_offset == 2


def test_exclusions(spark):
    r = region(spark, FLAT.replace("8150", "").replace("21000", "n/a").replace("3900", "12").replace("15600", "15"))
    x = compile.run(r, QuerySpec(aggregate="sum", column="Revenue"))
    assert x.value == 12427 and x.cell_count == 3 and x.excluded == [("C3", "empty"), ("C4", 'not a number ("n/a")')]


def test_stacked_and_merged_headings(spark):
    r = region(spark, ",Q1,Q2,Q3\nRegion,Revenue,Revenue,Revenue\nNorth,1200,1400,1500\nSouth,900,950,1100\nEast,700,820,910\n")
    assert r.structure["rows"] == 2 and [c.path for c in r.columns] == [("Region",), ("Q1", "Revenue"), ("Q2", "Revenue"), ("Q3", "Revenue")]
    sheet = read.Sheet("Compare", [[None, 2026, None, 2025, None], [None, "Q1", "Q2", "Q1", "Q2"], ["Region"] + ["Revenue"] * 4, ["North", 1200, 1400, 1100, 1000], ["South", 900, 950, 800, 850]], [(0, 1, 0, 2), (0, 3, 0, 4)])
    r = ingest.build(spark, read.Read([sheet]), "c.xlsx")[0][0]
    assert r.columns[1].path == ("2026", "Q1", "Revenue") and r.columns[4].path == ("2025", "Q2", "Revenue")


def test_title_and_vertical_merge(spark):
    rows = [["FY2026 Departmental Budget", None, None], ["Department", "Line item", "Amount"], ["Engineering", "Salaries", 480000], [None, "Tooling", 62000], [None, "Travel", 18000], ["Design", "Salaries", 210000], [None, "Software", 24000]]
    r = ingest.build(spark, read.Read([read.Sheet("Budget", rows, [(2, 0, 4, 0), (5, 0, 6, 0)])]), "b.xlsx")[0][0]
    assert r.title == "FY2026 Departmental Budget" and r.inherited == {"A4": "A3", "A5": "A3", "A7": "A6"}
    assert r.columns[2].profile["sum"] == 794000
    x = compile.run(r, QuerySpec((Filter("Department", "eq", "engineering"),), "sum", "Amount"))
    assert x.value == 560000 and x.matched == 3


def test_three_regions_and_note(spark):
    text = "Product,Units,\nWidget,120,\nGadget,45,\n,,\nRegion,Target,Actual\nNorth,10000,12400\nSouth,9000,3900\n,,\nNote,Status,\nQ3 close,pending,\n"
    regions, _ = build(spark, text)
    assert [r.id.split(".")[1] for r in regions] == ["t1", "t2", "t3"] and regions[2].structure["ambiguous"]
    regions, warnings = build(spark, "Country,Population\nPeru,34352719\nNorway,5474360\nPoland,36685849\n\nSource: a bureau\n")
    assert len(regions) == 1 and regions[0].row_count == 3


def test_summary_rows(spark):
    months = "Month,Rent,Food\n" + "".join(f"{m},1000,{f}\n" for m, f in zip(["Jan", "Feb", "Mar", "Apr", "May", "Jun"], [3000, 3100, 3200, 3300, 3400, 3600], strict=True)) + "Total,6000,19600\nAverage,1000,3266.67\n"
    r = region(spark, months)
    assert r.summary_rows == (6, 7)
    x = compile.run(r, QuerySpec(aggregate="sum", column="Food"))
    assert x.value == 19600 and x.skipped_summary == 2 and compile.run(r, QuerySpec(aggregate="count")).value == 6
    assert g.summary_rows([["N", "a", 1], ["N", "b", 2], ["Subtotal", None, 3], ["S", "c", 4], ["S", "d", 5], ["Sub-total:", None, 9], ["Grand total", None, 12]]) == [2, 5, 6]
    assert g.summary_rows([["C1", 5, "Total"], ["C2", 7, "Partial"]]) == []
    assert g.summary_rows([["Total", 5], ["Total", 7]]) == []


@pytest.mark.parametrize(
    ("text", "kind", "total"),
    [
        ("Item,Price\nA,25.000 ₫\nB,45.000 ₫\nC,77.500 ₫\n", "currency", 147500),
        ('Item,Price\nA,"€1.234,50"\nB,"€10,50"\nC,"€2.000,00"\n', "currency", 3245),
        ("Name;Amount\nA;1,5\nB;2,5\nC;10\n", "number", 14),
        ('Item,X\nA,1.234\nB,"10,5"\nC,2.000\n', "number", 3244.5),
        ('M,Profit\nJan,5000\nFeb,(45)\nMar,"4,560"\n', "number", 9515),
        ("M,Rate\nJan,7.5%\nFeb,2.5%\nMar,1%\n", "percent", 11),
    ],
)
def test_number_conventions(spark, text, kind, total):
    r = region(spark, text)
    assert r.columns[1].kind == kind and r.columns[1].profile["sum"] == total
    assert r.df.agg({"n1": "sum"}).first()[0] == pytest.approx(total)


def test_identifiers_and_rates(spark):
    r = region(spark, "STT,Phone,Code,GDP per capita\n1,0901234567,00123,4347\n2,0912345678,00456,7297\n3,0987654321,00789,4788\n")
    assert [c.identifier for c in r.columns[:3]] == ["row", "phone", "code"]
    with pytest.raises(QueryError, match="no real total"):
        compile.run(r, QuerySpec(aggregate="sum", column="GDP per capita"))
    with pytest.raises(QueryError):
        compile.run(r, QuerySpec(aggregate="sum", column="STT"))


def test_header_override(spark):
    r = region(spark, FLAT)
    again = ingest.reread(spark, r, 0)
    assert again.row_count == 6 and again.revision == 1 and ingest.reread(spark, again, 1).row_count == 5


def test_decode_and_sniff():
    assert read.decode("a\tb".encode("utf-16")) == "a\tb" and read.decode(b"caf\xe9") == "café" and read.decode("﻿x".encode()) == "x"
    assert read.sniff("a;b\n1,5;2\n3,5;4\n") == ";" and read.sniff("a|b\n1|2\n") == "|"
    with pytest.raises(ValueError, match="only"):
        read.read_bytes(b"", "x.pdf")


def xlsx():
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="S" sheetId="1" r:id="a"/><sheet name="H" state="hidden" sheetId="2" r:id="b"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="a" Target="worksheets/sheet1.xml"/><Relationship Id="b" Target="worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>Name</t></si><si><r><t>Ra</t></r><r><t>te</t></r></si><si><t>A</t></si></sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {ns}><numFmts><numFmt numFmtId="164" formatCode="00000"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="10"/><xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="20"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row r="2"><c r="A2" t="s"><v>2</v></c><c r="B2" s="1"><f>1/14</f><v>0.07125</v></c><c r="C2" s="2"><v>46207</v></c><c r="D2" s="3"><v>42</v></c><c r="E2" s="4"><v>0.354166666</v></c><c r="F2" t="b"><v>1</v></c></row></sheetData><mergeCells><mergeCell ref="A2:A4"/></mergeCells></worksheet>')
    return out.getvalue()


def test_workbook(spark, tmp_path):
    x = read.read_bytes(xlsx(), "x.xlsx")
    assert len(x.sheets) == 1 and "hidden sheet H" in x.warnings[0] and x.sheets[0].merges == [(1, 0, 3, 0)]
    assert x.sheets[0].grid == [["Name", "Rate", None, None, None, None], ["A", "7.125%", dt.datetime(2026, 7, 4), "00042", "08:30", True]]
    (tmp_path / "x.xlsx").write_bytes(xlsx())
    (tmp_path / "y.csv").write_text(FLAT)
    found = read.cells(spark, str(tmp_path))
    assert found.groupBy("sheet").count().count() == 2 and found.where("kind = 'instant'").count() == 1


def test_all_or_nothing_and_index(spark, tmp_path):
    (tmp_path / "a.csv").write_text(FLAT)
    (tmp_path / "b.pdf").write_text("x")
    c = Catalog()
    with pytest.raises(ValueError):
        ingest.ingest(spark, [str(tmp_path / "*")], c)
    assert not c.tables
    ingest.ingest(spark, [str(tmp_path / "a.csv")], c)
    ingest.save(c, str(tmp_path / "index"))
    again = ingest.load(spark, str(tmp_path / "index"))
    assert compile.run(again.locate("a"), QuerySpec(aggregate="sum", column="Revenue")).value == 61050
    assert ingest.catalog_frame(spark, again).count() == 4


def test_notes_and_sign_offs(spark):
    table = "Item,Qty,Price\nPen,3,12\nBook,4,30\nLamp,5,90\n"
    for tail, what in (
        ("Prepared by:,Jordan Lee,\nApproved by:,Sam Roe,\n", "Prepared by: Jordan Lee. Approved by: Sam Roe"),
        ("\nNgười lập biểu,,Giám đốc\n\"(Ký, họ tên)\",,\"(Ký, họ tên)\"\nLan,,Minh\n", "Người lập biểu; Giám đốc. Lan; Minh"),
        ("Source:,General ledger,\n", "Source: General ledger"),
        ("Nguồn: phòng kế toán,,\n", "Nguồn: phòng kế toán"),
        (",,Prices include VAT.\n", "Prices include VAT."),
        ("These figures have not been audited and may still change.,,\n", "These figures have not been audited"),
    ):
        regions, warnings = ingest.build(spark, read.read_bytes((table + tail).encode(), "x.csv"), "x.csv")
        assert len(regions) == 1 and regions[0].row_count == 3, tail
        assert regions[0].columns[2].profile["sum"] == 132 and any(what in w for w in warnings), (tail, warnings)
    for tail in ("International Business Machines,,\n", "Received by customer,6,7\n"):
        regions, _ = ingest.build(spark, read.read_bytes((table + tail).encode(), "x.csv"), "x.csv")
        assert regions[0].row_count == 4, tail
    regions, _ = ingest.build(spark, read.read_bytes((table + "\nOrder,Status\n17,Received by customer\n18,Sent\n").encode(), "x.csv"), "x.csv")
    assert len(regions) == 2


def test_report(spark, tmp_path, capsys):
    from quillgrid.plans import report

    (tmp_path / "sales.csv").write_text("Region,Revenue\nNorth,5\nSouth,7\nTotal,12\n")
    out = f"file://{tmp_path}/index"
    assert report.main([f"{tmp_path}/*.csv", "--out", out], spark) == 0
    said = capsys.readouterr().out
    assert "Revenue  number  2 of 2  sum 12, 5 to 7" in said and "left out of figures, sheet rows 4" in said
    assert list(ingest.load(spark, out).tables) == ["sales"]
    assert report.main([f"{tmp_path}/sales.csv", f"{tmp_path}/none.csv", "--out", out + "2"], spark) == 1
    assert "Nothing written" in capsys.readouterr().err and not (tmp_path / "index2").exists()


def headings(text, merges=()):
    rows, _ = g.fill([[c or None for c in line.split(",")] for line in text.split("/")], merges)
    return g.header(rows, (0, 0, len(rows) - 1, len(rows[0]) - 1), merges)


def test_headings_by_what_sets_them_off():
    sure = {
        "Region,Rep,Revenue/North,Anh,12400/North,Bao,8150/South,Chi,21000": 1,
        ",Q1,Q2,Q3/Region,Revenue,Revenue,Revenue/North,1200,1400,1500/South,900,950,1100/East,700,820,910": 2,
        "Name,Score/Anh,n/a/Bao,5/Chi,7/Dan,8".replace("n/a", "tbd"): 1,
        "Name,Paid/A,yes/B,no/C,yes/D,yes": 1,
        "STT,Name,Pay/(1),(2),(3)/1,Anh,500/2,Bao,600/3,Chi,700": 2,
        "Sum of Revenue,Column Labels,/Row Labels,2023,2024/North,1,2/South,3,4": 2,
    }
    for text, n in sure.items():
        found = headings(text)
        assert (found.rows, found.ambiguous) == (n, False), (text, found)
    asked = {
        "Region,2024,2025,2026/North,1,2,3/South,4,5,6": (0, 1),
        "1,2,3/4,5,6/7,8,9": (0, 1),
        "Contact,,Location,/Name,Email,City,Country/Anh,a@x,Hue,VN/Bo,b@x,Hanoi,VN/Chi,c@x,Hue,VN": (2, 1),
        "Note,Status/Q3 close,pending": (1, 0),
        ",Mon,Tue/Anh,Gym,Rest/Bao,Run,Swim": (1, 0),
        "Value,,/Row Labels,2023,2024/North,10,20/South,30,40": (0, 2),
        "a,b": (0, 1),
    }
    for text, (n, other) in asked.items():
        found = headings(text)
        assert found.rows == n and found.ambiguous and found.alternatives[0][0] == other and found.score < g.SURE, (text, found)
    found = headings(",2026,,2025,/,Q1,Q2,Q1,Q2/Region,Revenue,Revenue,Revenue,Revenue/North,1200,1400,1100,1000/South,900,950,800,850", [(0, 1, 0, 2), (0, 3, 0, 4)])
    assert found.rows == 3 and not found.ambiguous


def test_groups_are_summed_up_without_going_through_them_again():
    rng = random.Random(5)
    for n in (1, 2, 1000):
        xs = [rng.choice([rng.uniform(-1e6, 1e6), 1e16, -1e16, 0.1]) for _ in range(n)]
        tally = g.Tally()
        for x in xs:
            tally.add(x)
        assert (tally.n, tally.sum(), tally.least, tally.greatest) == (n, sum(xs), min(xs), max(xs))

    rows = [[f"part {k} Total", k + 0.5] for k in range(500)]
    assert g.summary_rows([*rows, ["Max", 499.5], ["Average", 250.0], ["Sum Total", 125000.0], ["Count", 501]]) == [500, 501, 503]
    assert g.summary_rows([*rows, ["Sum Total", 125000.0], ["Last", 3.0], ["Last Total", 3.0]]) == [500, 502]
