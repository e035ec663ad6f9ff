import pytest

from quillgrid.functions import names, speech, values
from quillgrid.model import QueryError
from quillgrid.nl.router import Router
from quillgrid.plans import ingest
from quillgrid.plans.catalog import Catalog
from quillgrid.sources import read
from quillgrid.tools import Store, Tools

SALES = "Region,Rep,Revenue,Closed\nNorth,Anh,12400,2026-07-04\nNorth,Bảo,8150,2026-07-19\nSouth,Chi,21000,2026-08-02\nSouth,Dũng,3900,2026-08-27\nEast,An,15600,2026-09-01\n"
BUDGET = "Department,Item,Amount\nEngineering,Salaries,480000\nEngineering,Tooling,62000\nDesign,Salaries,210000\nDesign,Software,24000\nTotal,,776000\n"


@pytest.fixture(scope="module")
def tools(spark):
    c = Catalog()
    for name, text in (("sales.csv", SALES), ("budget.csv", BUDGET)):
        c.add(name.split(".")[0], ingest.build(spark, read.read_bytes(text.encode(), name), name)[0])
    return Tools(spark, c)


def test_list_and_describe(tools):
    x = tools.table_list()
    assert [t["title"] for t in x["tables"]] == ["Sales", "Budget"] and x["spoken"] == "There are 2 tables: Sales and Budget."
    d = tools.table_describe("budget", detail="full")
    assert d["summary_rows"] == [5] and d["columns"][2]["sum"] == 776000


def test_query_explain_and_paging(tools):
    x = tools.table_query("sales", aggregate="sum", aggregate_column="Revenue", group_by="Region", limit=2)
    assert x["spoken"].startswith("The total Revenue by Region: South 24.9 thousand and North about 20.6 thousand") and x["cursor"] == "2"
    assert tools.table_query("sales", aggregate="sum", aggregate_column="Revenue", group_by="Region", limit=2, cursor="2")["groups"][0]["key"] == "East"
    x = tools.table_query("sales", aggregate="max", aggregate_column="Revenue")
    assert x["result"] == 21000 and x["winners"][0]["Rep"] == "Chi"
    e = tools.table_explain(x["answer_id"])
    assert e["parts"][0]["winning_cells"] == ["C4"] and len(e["grid"]) == 5
    with pytest.raises(QueryError) as error:
        tools.table_query("sales", aggregate="sum", aggregate_column="Amount")
    assert "Budget has it" in error.value.next_step
    x = tools.table_query("sales", filters=[{"column": "Revenue", "op": "gt", "value": "1 million"}], aggregate="count")
    assert x["spoken"] == "No row has Revenue is over 1 million."


def test_rows_bookmarks_compare_structure(tools):
    x = tools.table_read_rows("budget", start_row=4, limit=2)
    assert x["returned"] == 2 and x["rows"][1]["Amount"] == "776000" and x["cursor"] is None
    with pytest.raises(QueryError):
        tools.table_read_rows("budget", start_row=99)
    tools.table_bookmark("here", "sales", row=3)
    assert "Chi" in tools.table_resume()["row_spoken"]
    assert tools.table_compare("sales", None, "Revenue", "Amount", right_table_id="budget")["difference"] == 61050 - 776000
    assert not tools.table_structure("sales")["ambiguous"]
    tools.table_structure("sales", header_rows=0)
    assert tools.table_describe("sales")["row_count"] == 6
    tools.table_structure("sales", header_rows=1)
    assert tools.table_describe("sales")["row_count"] == 5


def test_store_expires():
    now = [0.0]
    s = Store(lambda: now[0])
    key = s.keep({"x": 1})
    for i in range(60):
        s.keep({"x": i})
    with pytest.raises(QueryError):
        s.answer(key)
    key = s.keep({"x": 2})
    now[0] = 8 * 86400
    with pytest.raises(QueryError):
        s.answer(key)


@pytest.mark.parametrize(
    ("question", "check"),
    [
        ("What is the total revenue?", lambda x: x["result"] == 61050),
        ("how many rows in the north", lambda x: x["result"] == 2),
        ("average revenue by region", lambda x: x["groups"][0] == {"key": "East", "value": 15600.0, "row_count": 1, "exact": "15,600"}),
        ("Who has the highest revenue?", lambda x: x["winners"][0]["Rep"] == "Chi"),
        ("total revenue over 10000", lambda x: x["result"] == 49000),
        ("total revenue in August", lambda x: x["result"] == 24900),
        ("total revenue of Bao and Chi", lambda x: x["result"] == 29150),
        ("top 2 regions by revenue", lambda x: [g["key"] for g in x["groups"]] == ["South", "North"]),
        ("second highest revenue", lambda x: x["rows"] == ["An"]),
        ("which region has the highest revenue", lambda x: x["groups"][0]["key"] == "South"),
        ("which rows are above average revenue", lambda x: x["rows"] == ["Anh", "Chi", "An"]),
        ("how many closed after August 15, 2026", lambda x: x["result"] == 2),
        ("what is the median revenue", lambda x: "can't work out a median" in x["spoken"]),
        ("which tables are there", lambda x: "Budget" in x["spoken"]),
        ("who has more revenue than Bảo", lambda x: x["rows"] == ["Anh", "Chi", "An"]),
        ("how many have less revenue than Anh", lambda x: x["result"] == 2),
        ("who closed after Chi", lambda x: x["rows"] == ["Dũng", "An"]),
        ("who is in the same region as Chi", lambda x: x["rows"] == ["Dũng"]),
        ("how many regions are there", lambda x: x["result"] == 3),
        ("rank the regions by revenue", lambda x: [g["key"] for g in x["groups"]] == ["South", "North", "East"]),
        ("regions by revenue from lowest to highest", lambda x: [g["key"] for g in x["groups"]] == ["East", "North", "South"]),
        ("who has the highest revenue in each region", lambda x: x["rows"] == ["Anh", "Chi", "An"]),
        ("which region made more than 20000", lambda x: {g["key"] for g in x["groups"]} == {"North", "South"}),
        ("how many rows has the region with the highest revenue", lambda x: x["result"] == 2),
        ("how much more did South make than North", lambda x: x["difference"] == 4350),
        ("total revenue of 12400 or more", lambda x: x["result"] == 49000),
        ("how many revenue exactly 12400", lambda x: x["result"] == 1),
        ("how many with no revenue", lambda x: x["result"] == 0),
        ("what is the revenue of Chi", lambda x: x["result"] == 21000 and x["spoken"] == "Revenue is 21,000."),
        ("when was the closed date of Bảo", lambda x: "July 19, 2026" in x["spoken"]),
        ("what is the third column", lambda x: x["column"] == "Revenue"),
        ("what is the last column", lambda x: x["column"] == "Closed"),
        ("breakdown of revenue", lambda x: [g["key"] for g in x["groups"]] == ["South", "North", "East"]),
        ("top 2 reps in each region", lambda x: "not several of each group" in x["spoken"]),
        ("tell me more", lambda x: "revenue is number" in x["spoken"]),
        ("never mind", lambda x: x["spoken"] == "All right, I left it."),
        ("help", lambda x: "Revenue" in x["spoken"]),
        ("zebra giraffe", lambda x: x["error"] and "zebra" in x["spoken"]),
    ],
)
def test_questions(tools, question, check):
    r = Router(tools)
    r.table = "sales"
    x = r.ask(question)
    assert check(x), x


def test_follow_up_and_why(tools):
    r = Router(tools)
    r.table = "sales"
    r.ask("total revenue in the north")
    assert r.ask("what about the south")["result"] == 24900
    assert "C4" in r.ask("how do you know")["spoken"]
    assert r.ask("which ones")["matched_rows"] == 2


def test_than_that_and_pending(spark, tools):
    r = Router(tools)
    r.table = "sales"
    r.ask("average revenue")
    assert r.ask("how many have more revenue than that")["result"] == 3
    c = Catalog()
    c.add("two", ingest.build(spark, read.read_bytes(b"Shop,Rent,Wages\nMatcha 100g,10,20\nCocoa bar,30,40\nTea,50,60\n", "two.csv"), "two.csv")[0])
    r = Router(Tools(spark, c))
    assert r.ask("what is the total")["spoken"].startswith("Which column do you mean?")
    assert r.ask("wages")["result"] == 120
    assert r.ask("rent of matcha")["result"] == 10


def test_a_scale_is_carried_on_only_where_a_thousand_of_it_would_be_said():
    assert [speech.number(x) for x in (999499, 999518, 999770, 999949.9, 999950, -999949, 999.9499e6, 999.95e6)] == ["999.5 thousand", "999.5 thousand", "999.8 thousand", "999.9 thousand", "1 million", "minus 999.9 thousand", "999.9 million", "1 billion"]
    assert speech.amount(3_700_074, most="thousand") == "about 3700.1 thousand" and speech.amount(3_700_074) == "about 3.7 million"


def test_speech_and_names():
    assert speech.number(999950) == "1 million" and speech.number(12345) == "12.3 thousand" and speech.number(-0.0123) == "minus 0.012" and speech.number(1234.5) == "1234.5"
    assert speech.amount(24900) == "24.9 thousand" and speech.amount(20550) == "about 20.6 thousand"
    assert names.letters(27) == "AB" and names.merge_range("B2:D5") == (1, 1, 4, 3) and names.slug("Bảng lương đ.csv") == "bang-luong-d"
    assert names.spoken("totalRevenue_USD") == "total revenue USD" and names.clean("a​b\n c") == "a b c"


def test_values_agree(spark):
    """The column expressions read what the Python twins read."""
    from pyspark.sql import functions as F

    texts = ["1", "1.5", "1,5", "1.234", "1,234", "1,234.5", "1.234,5", "1,23,456", "(2,300)", "($219.99)", "(2025)", "(45)", "12e3", "NaN", "1d", "-5", "5-", "$1,234", "25.000 ₫", "7.125%", "€ 10", "1.2.3", "", "  ", None, "n/a", "-(5)", "0.5", ".5", "٣"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for convention in ("dot", "comma"):
        got = [(r[0], r[1]) for r in df.select("t", values.number(F.col("t"), convention)).collect()]
        want = [(t, n.value if t is not None and (n := values.read_number(t, convention)) else None) for t in texts]
        assert got == want
    dates = ["2026-07-04", "2026-7-4T08:30", "2026-07-04T10:00:00+07:00", "7/4/26", "13/4/2026", "4.7.2026", "July 4, 2026", "4 Jul 2026", "4th July 2026", "31 Feb 2020", "2026/07/04", "x", "2026-02-30", None, "Sept 3 2020", "1/2/30"]
    df = spark.createDataFrame([(t,) for t in dates], "t string")
    for order in ("mdy", "dmy"):
        got = [r[0] for r in df.select(values.date(F.col("t"), order)).collect()]
        assert got == [values.read_date(t, order) if t else None for t in dates]
    xs = [0.0, 5.0, 0.0123, 1234.5, 10000.0, 12345.0, 999950.0, 2.5e6, -3.2e9]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    assert [r[0] for r in df.select(speech.number_column(F.col("x"))).collect()] == [speech.number(x) for x in xs]


def test_messages(tools):
    import json
    import threading
    import urllib.request

    from quillgrid import serve

    def call(name, **arguments):
        return serve.handle(tools, {"jsonrpc": "2.0", "id": 1, "method": "tools/call", "params": {"name": name, "arguments": arguments}})

    assert len(serve.handle(tools, {"jsonrpc": "2.0", "id": 1, "method": "tools/list"})["result"]["tools"]) == 9
    assert serve.handle(tools, {"jsonrpc": "2.0", "method": "notifications/initialized"}) is None
    x = call("table_query", table_id="sales", aggregate="sum", aggregate_column="Revenue")["result"]
    assert x["structuredContent"]["result"] == 61050 and not x["isError"]
    assert call("table_query", table_id="nowhere")["result"]["isError"]
    for wrong in ({"limit": 21}, {"limit": True}, {"aggregate": "median"}, {"colour": "red"}, {"filters": [{"op": "eq"}]}, {"filters": [{"column": "a", "op": "eq"}] * 11}):
        assert call("table_query", **wrong)["error"]["code"] == -32602, wrong
    assert call("table_drop")["error"]["code"] == -32602 and call("table_explain")["error"]["code"] == -32602
    assert serve.handle(tools, [])["error"]["code"] == -32600
    s = serve.server(tools, port=0)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    request = urllib.request.Request(f"http://127.0.0.1:{s.server_port}/mcp", json.dumps({"jsonrpc": "2.0", "id": 7, "method": "ping"}).encode())
    with urllib.request.urlopen(request, timeout=20) as answer:
        assert json.loads(answer.read()) == {"jsonrpc": "2.0", "id": 7, "result": {}}
    s.shutdown()


def test_conditions_of_large_and_registered_tables(spark):
    """Values are looked up however many rows there are; what is not found is said, not left out."""
    rows = [(i, f"Item {i}", ("Building", "Máy móc", "Auto parts")[i % 3], float(i)) for i in range(3000)]
    c = Catalog()
    c.register("stock", spark.createDataFrame(rows, "k long, item string, sort string, price double"), order_by="k", label="item")
    router = Router(Tools(spark, c))
    assert router.ask("how many rows where sort is building")["result"] == 1000
    assert router.ask("total price for auto parts")["result"] == sum(r[3] for r in rows if r[2] == "Auto parts")
    assert router.ask("average price where sort is Máy móc")["matched_rows"] == 1000
    assert router.ask("price of item 77")["result"] == 77.0
    x = router.ask("average price where sort is zanzibar")
    assert x.get("error") and "zanzibar" in x["spoken"]
    assert router.ask("average price")["matched_rows"] == 3000


def test_read_again_keeps_marks_and_order(spark, tmp_path):
    """Another count of heading rows changes no figure and no date of a file with decimal commas and days first."""
    text = "Item;Price;Closed\na;2.500;05/04/2026\nb;1.250.000;23/04/2026\nc;3,5;01/02/2026\n"
    region = ingest.build(spark, read.read_bytes(text.encode(), "x.csv"), "x.csv")[0][0]
    again = ingest.reread(spark, region, 1)
    row = lambda r: r.df.orderBy("_row").select("n1", "d2").collect()
    assert row(region) == row(again) and row(region)[0].n1 == 2500 and row(region)[0].d2.month == 4
    assert again.revision == 1 and again.columns[2].date_order == "dmy"
    without = ingest.reread(spark, region, 0)
    assert without.df.orderBy("_row").select("c1").collect()[1].c1 in ("2500", "2.500") and without.row_count == 4


def test_a_broken_save_leaves_the_one_before(spark, tmp_path):
    c, where = Catalog(), str(tmp_path / "index")
    c.add("sales", ingest.build(spark, read.read_bytes(SALES.encode(), "sales.csv"), "sales.csv")[0])
    ingest.save(c, where)
    first = ingest.load(spark, where)
    broken = Catalog()
    broken.add("sales", ingest.build(spark, read.read_bytes(BUDGET.encode(), "budget.csv"), "budget.csv")[0])
    broken.add("bad", [broken.tables["sales"][0].__class__("b", "B", [], None)])
    with pytest.raises(AttributeError):
        ingest.save(broken, where)
    assert [x.name for x in ingest.load(spark, where).tables["sales"][0].columns] == [x.name for x in first.tables["sales"][0].columns]
    broken.tables.pop("bad")
    ingest.save(broken, where)
    assert ingest.load(spark, where).tables["sales"][0].columns[2].name == "Amount" and first.tables["sales"][0].df.count() == 5


def test_explain_tells_of_changed_files(spark, tmp_path):
    path = tmp_path / "sales.csv"
    path.write_text(SALES)
    c = Catalog()
    ingest.ingest(spark, [str(path)], c)
    t = Tools(spark, c)
    key = t.table_query("sales", aggregate="sum", aggregate_column="Revenue")["answer_id"]
    assert not any(t.table_explain(key)[k] for k in ("table_gone", "structure_changed_since", "file_changed_since"))
    path.write_text(SALES.replace("12400", "12500"))
    again = Catalog()
    ingest.ingest(spark, [str(path)], again)
    t.catalog = again
    x = t.table_explain(key)
    assert x["file_changed_since"] and not x["structure_changed_since"] and "changed since" in x["spoken"]
    t.catalog = Catalog()
    assert t.table_explain(key)["table_gone"]
