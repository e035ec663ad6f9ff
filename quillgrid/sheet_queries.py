"""Queries over sheets: tables of the data laid out as people lay out sheets, and read back by the code of ingest.

Each layout has a file for a nation (or the like) with a title, headings, records, totals and notes. The SQL says from
the tables alone what must have been found.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .plans import sheets
from .registry import query, read
from .sources import read as source


def cells_of(rows: DataFrame) -> DataFrame:
    """(file, r, v: array of texts) as cells of one sheet."""
    cells = rows.select("file", F.lit("Sheet1").alias("sheet"), F.col("r").cast("int").alias("r"), F.posexplode("v").alias("c", "text")).where("text is not null")
    return cells.select("file", "sheet", "r", "c", F.lit("text").alias("kind"), "text", F.lit(None).cast("double").alias("number"), F.lit(None).cast("timestamp_ntz").alias("instant"))


def line(df: DataFrame, r, *texts) -> DataFrame:
    """One row of a sheet for each row of df (file, ...)."""
    text = lambda x: x.cast("string") if isinstance(x, Column) else F.lit(x).cast("string")
    return df.select("file", (r if isinstance(r, Column) else F.lit(r)).alias("r"), F.array(*map(text, texts)).alias("v"))


def laid(*lines: DataFrame) -> DataFrame:
    return cells_of(reduce(DataFrame.unionByName, lines))


def accounts(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """(records, files): the customers of each nation, numbered, and each nation with what sums them up."""
    c = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    c = c.select(F.col("n_name").alias("file"), "c_custkey", "c_name", "c_mktsegment", F.col("c_acctbal").cast("decimal(18,2)").alias("bal"))
    records = c.withColumn("k", F.row_number().over(Window.partitionBy("file").orderBy("c_custkey")))
    files = c.groupBy("file").agg(F.count("*").alias("n"), F.sum("bal").alias("total"), F.round(F.avg("bal"), 2).alias("mean"))
    return records, files


def account_sheets(spark, sf_dir) -> DataFrame:
    """A title, headings, a record for each customer, a total, an average, and a note under a blank row."""
    records, files = accounts(spark, sf_dir)
    return laid(
        line(files, 0, F.concat(F.lit("Accounts of "), "file"), None, None),
        line(files, 1, "Name", "Segment", "Balance"),
        line(records, F.col("k") + 1, F.col("c_name"), F.col("c_mktsegment"), F.col("bal")),
        line(files, F.col("n") + 2, "Total", None, F.col("total")),
        line(files, F.col("n") + 3, "Average", None, F.col("mean")),
        line(files, F.col("n") + 5, "Source: ledger of the bank", None, None),
    )


ACCOUNTS = "(SELECT n_name AS file, c_custkey, c_name, c_mktsegment, CAST(c_acctbal AS DECIMAL(18, 2)) AS bal FROM customer JOIN nation ON c_nationkey = n_nationkey)"
_FILES = f"(SELECT file, CAST(count(*) AS INTEGER) AS n FROM {ACCOUNTS} GROUP BY 1)"


@query(f"SELECT file, 'Accounts of ' || file AS title, 1 AS top, 0 AS \"left\", n + 3 AS bottom, 2 AS \"right\", n AS records FROM {_FILES}")
def sheet_tables(spark, sf_dir):
    """Where each table lies, with its title and how many records it has."""
    return sheets.tables(account_sheets(spark, sf_dir)).select("file", "title", "top", "left", "bottom", "right", "records")


@query(f"SELECT file, 1 AS header_rows, false AS ambiguous, 'Name' AS label, [n, n + 1] AS summary FROM {_FILES}")
def sheet_headings_and_summaries(spark, sf_dir):
    """Heading rows, the column that names records, and the rows of a bare total and of an average."""
    return sheets.tables(account_sheets(spark, sf_dir)).select("file", "header_rows", "ambiguous", "label", "summary")


def columns(found: DataFrame, *fields: str) -> DataFrame:
    return found.select("file", F.explode("columns").alias("c")).select("file", *(F.col(f"c.{f}").alias(f) for f in fields))


@query(f"""SELECT file, 'A' AS letter, 'name' AS spoken, 'text' AS kind, CAST(count(*) AS BIGINT) AS non_empty, CAST(count(DISTINCT c_name) AS BIGINT) AS "distinct", CAST(NULL AS DOUBLE) AS least, CAST(NULL AS DOUBLE) AS greatest, CAST(NULL AS DOUBLE) AS "sum" FROM {ACCOUNTS} GROUP BY 1
UNION ALL SELECT file, 'B', 'segment', CASE WHEN count(DISTINCT c_mktsegment) < count(*) AND count(DISTINCT c_mktsegment) <= 0.5 * count(*) THEN 'category' ELSE 'text' END, count(*), count(DISTINCT c_mktsegment), NULL, NULL, NULL FROM {ACCOUNTS} GROUP BY 1
UNION ALL SELECT file, 'C', 'balance', 'number', count(*), count(DISTINCT bal), min(bal), max(bal), CAST(sum(bal) AS DOUBLE) FROM {ACCOUNTS} GROUP BY 1""")
def sheet_profiles(spark, sf_dir):
    """Kinds and figures of all columns; summary rows are left out of them."""
    found = columns(sheets.tables(account_sheets(spark, sf_dir)), "letter", "spoken", "kind", "non_empty", "distinct", "least", "greatest", "sum")
    return found.withColumn("sum", F.round("sum", 2))


@query(f"SELECT file, list(DISTINCT c_mktsegment ORDER BY c_mktsegment) AS categories FROM {ACCOUNTS} GROUP BY 1 HAVING count(DISTINCT c_mktsegment) <= 0.5 * count(*)")
def sheet_categories(spark, sf_dir):
    found = columns(sheets.tables(account_sheets(spark, sf_dir)), "letter", "kind", "categories")
    return found.where("kind = 'category'").select("file", "categories")


@query(f"SELECT DISTINCT file, ['A note was left out: Source: ledger of the bank'] AS warnings FROM {ACCOUNTS}")
def sheet_notes(spark, sf_dir):
    return sheets.tables(account_sheets(spark, sf_dir)).select("file", "warnings")


@query(f"""WITH s AS (SELECT file, c_mktsegment AS seg, count(*) AS n FROM {ACCOUNTS} GROUP BY 1, 2),
e AS (SELECT file, CAST(sum(n) OVER (PARTITION BY file ORDER BY seg) + row_number() OVER (PARTITION BY file ORDER BY seg) - 1 AS INTEGER) AS pos FROM s)
SELECT file, list_append(list(pos ORDER BY pos), max(pos) + 1) AS summary FROM e GROUP BY 1""")
def summary_group_totals(spark, sf_dir):
    """Records by segment, each group closed by "<segment> Total" that its figures confirm, all by a grand total."""
    records, files = accounts(spark, sf_dir)
    groups = records.groupBy("file", "c_mktsegment").agg(F.count("*").alias("n"), F.sum("bal").alias("total"))
    by = Window.partitionBy("file").orderBy("c_mktsegment")
    groups = groups.withColumn("end", F.sum("n").over(by) + F.row_number().over(by))
    placed = records.withColumn("g", F.dense_rank().over(by) - 1).withColumn("k", F.row_number().over(Window.partitionBy("file").orderBy("c_mktsegment", "c_custkey")))
    ends = groups.groupBy("file").agg(F.max("end").alias("end"), F.sum("total").alias("total"))
    cells = laid(
        line(files, 0, "Segment", "Name", "Balance"),
        line(placed, F.col("k") + F.col("g"), F.col("c_mktsegment"), F.col("c_name"), F.col("bal")),
        line(groups, F.col("end"), F.concat("c_mktsegment", F.lit(" Total")), None, F.col("total")),
        line(ends, F.col("end") + 1, "Grand Total", None, F.col("total")),
    )
    return sheets.tables(cells).select("file", "summary")


@query(f"""WITH s AS (SELECT file, count(*) FILTER (bal >= 0) AS a, count(*) FILTER (bal < 0) AS b FROM {ACCOUNTS} GROUP BY 1)
SELECT file, [CAST(a AS INTEGER), CAST(a + b + 1 AS INTEGER), CAST(a + b + 2 AS INTEGER)] AS summary FROM s WHERE a > 0 AND b > 0""")
def summary_net(spark, sf_dir):
    """A total of what comes in, one of what goes out, and a net row that is the one less the other."""
    records, _ = accounts(spark, sf_dir)
    sides = records.withColumn("out", (F.col("bal") < 0).cast("int")).withColumn("amount", F.abs("bal"))
    both = sides.groupBy("file").agg(F.count_if(F.col("out") == 0).alias("a"), F.count_if(F.col("out") == 1).alias("b"), F.sum(F.when(F.col("out") == 0, F.col("amount"))).alias("into"), F.sum(F.when(F.col("out") == 1, F.col("amount"))).alias("outof")).where("a > 0 and b > 0")
    placed = sides.join(both.select("file"), "file").withColumn("k", F.row_number().over(Window.partitionBy("file").orderBy("out", "c_custkey")))
    cells = laid(
        line(both, 0, "Name", "Amount"),
        line(placed, F.col("k") + F.col("out"), F.col("c_name"), F.col("amount")),
        line(both, F.col("a") + 1, "Total income", F.col("into")),
        line(both, F.col("a") + F.col("b") + 2, "Total expenses", F.col("outof")),
        line(both, F.col("a") + F.col("b") + 3, "Net result", F.col("into") - F.col("outof")),
    )
    return sheets.tables(cells).select("file", "summary")


@query(f"SELECT file, CAST([] AS INTEGER[]) AS summary, n AS records FROM {_FILES}")
def summary_told_by_figures(spark, sf_dir):
    """Labels that only sound like totals ("BUILDING Total") are records where the figures don't add up."""
    records, files = accounts(spark, sf_dir)
    cells = laid(line(files, 0, "Account", "Balance"), line(records, F.col("k"), F.concat("c_mktsegment", F.lit(" "), F.col("k").cast("string"), F.lit(" Total")), F.col("bal") + 1000000 * F.col("k").cast("long")))
    return sheets.tables(cells).select("file", "summary", "records")


@query("SELECT n_name AS file, CAST([] AS INTEGER[]) AS summary, 3 AS records FROM nation")
def summary_all_rows(spark, sf_dir):
    """Where every row would be a summary, none is."""
    n = read(spark, sf_dir, "nation").select(F.col("n_name").alias("file"), "n_nationkey")
    cells = laid(line(n, 0, "Item", "Amount"), line(n, 1, "Total", F.col("n_nationkey") + 1), line(n, 2, "Grand total", F.col("n_nationkey") + 5), line(n, 3, "Subtotal", F.col("n_nationkey") + 2))
    return sheets.tables(cells).select("file", "summary", "records")


_HALF = """SELECT o_orderpriority AS p, sum(o_totalprice) FILTER (year(o_orderdate) = 1995) AS a, sum(o_totalprice) FILTER (year(o_orderdate) = 1996) AS b FROM orders GROUP BY 1"""


def pivot(spark, sf_dir) -> DataFrame:
    """Sales by priority in two halves of two years, a row each, a file for each order status."""
    o = read(spark, sf_dir, "orders").where(F.year("o_orderdate").isin(1995, 1996)).withColumn("k", (F.year("o_orderdate") - 1995) * 2 + F.when(F.month("o_orderdate") > 6, 1).otherwise(0))
    found = o.groupBy(F.col("o_orderstatus").alias("file"), "o_orderpriority").agg(*(F.coalesce(F.sum(F.when(F.col("k") == i, F.col("o_totalprice").cast("decimal(18,2)"))), F.lit(0).cast("decimal(28,2)")).alias(f"q{i}") for i in range(4)))
    return found.withColumn("r", F.row_number().over(Window.partitionBy("file").orderBy("o_orderpriority")))


_PATHS = """SELECT file, unnest(['A', 'B', 'C', 'D', 'E']) AS letter, unnest([['Priority'], ['1995', 'H1'], ['1995', 'H2'], ['1996', 'H1'], ['1996', 'H2']]) AS path
FROM (SELECT DISTINCT o_orderstatus AS file FROM orders WHERE year(o_orderdate) IN (1995, 1996))"""


@query(_PATHS)
def heading_paths_merged(spark, sf_dir):
    """Years over halves by merged cells: each column has the path of both."""
    found = pivot(spark, sf_dir)
    files = found.select("file").distinct()
    cells = laid(line(files, 0, None, "1995", None, "1996", None), line(files, 1, "Priority", "H1", "H2", "H1", "H2"), line(found, F.col("r") + 1, F.col("o_orderpriority"), *(F.col(f"q{i}") for i in range(4))))
    merges = cells.select("file", "sheet").distinct().select("file", "sheet", F.lit(0).alias("r"), F.explode(F.array(F.lit("B1:C1"), F.lit("D1:E1"))).alias("text"))
    cells = cells.unionByName(merges.withColumns({"c": F.lit(0), "kind": F.lit("merge"), "number": F.lit(None).cast("double"), "instant": F.lit(None).cast("timestamp_ntz")}))
    return columns(sheets.tables(cells), "letter", "path")


@query(_PATHS)
def heading_paths_carried(spark, sf_dir):
    """The same without merges: a year stands over the columns to its right that are named beneath."""
    found = pivot(spark, sf_dir)
    files = found.select("file").distinct()
    cells = laid(line(files, 0, None, "1995", None, "1996", None), line(files, 1, "Priority", "H1", "H2", "H1", "H2"), line(found, F.col("r") + 1, F.col("o_orderpriority"), *(F.col(f"q{i}") for i in range(4))))
    return columns(sheets.tables(cells), "letter", "path")


@query("SELECT n_name AS file, unnest(['A', 'B', 'C', 'D']) AS letter, unnest([['Item'], ['Amount'], ['Amount 2'], ['Amount 3']]) AS path FROM nation")
def heading_names_unique(spark, sf_dir):
    """Columns of one heading are told apart by numbers."""
    n = read(spark, sf_dir, "nation").select(F.col("n_name").alias("file"), "n_nationkey")
    rows = [line(n, r, f"item {r}", F.col("n_nationkey") + r, F.col("n_nationkey") * 2 + r, F.col("n_nationkey") * 3 + r) for r in range(1, 5)]
    return columns(sheets.tables(laid(line(n, 0, "Item", "Amount", "Amount", "Amount"), *rows)), "letter", "path")


@query("SELECT n_name AS file, 2 AS header_rows, 4 AS records FROM nation")
def heading_column_numbers(spark, sf_dir):
    """A row of (1), (2), (3) beneath the headings numbers the columns and is no record."""
    n = read(spark, sf_dir, "nation").select(F.col("n_name").alias("file"), "n_nationkey")
    rows = [line(n, r + 1, f"item {r}", F.col("n_nationkey") + r, F.col("n_nationkey") * 2 + r) for r in range(1, 5)]
    return sheets.tables(laid(line(n, 0, "Item", "Base", "Bonus"), line(n, 1, "(1)", "(2)", "(3)"), *rows)).select("file", "header_rows", "records")


@query("SELECT n_name AS file, unnest([0, 4]) AS \"left\", unnest([1, 5]) AS \"right\", unnest(['Name', 'Contact']) AS label FROM nation")
def split_side_by_side(spark, sf_dir):
    """Two tables of words beside each other are parted at the blank columns between them."""
    n = read(spark, sf_dir, "nation").select(F.col("n_name").alias("file"), "n_nationkey")
    rows = [line(n, r, F.concat("file", F.lit(f" {r}")), F.col("n_nationkey") + r, None, None, f"person {r}", f"town {r % 2}") for r in range(1, 6)]
    return sheets.tables(laid(line(n, 0, "Name", "Units", None, None, "Contact", "Town"), *rows)).select("file", "left", "right", "label")


@query("SELECT n_name AS file, 0 AS \"left\", 3 AS \"right\" FROM nation")
def split_spacer_joined(spark, sf_dir):
    """A block of figures behind a spacer column goes on with the records to its left."""
    n = read(spark, sf_dir, "nation").select(F.col("n_name").alias("file"), "n_nationkey")
    rows = [line(n, r, F.concat("file", F.lit(f" {r}")), F.col("n_nationkey") + r, None, F.col("n_nationkey") * r) for r in range(1, 6)]
    return sheets.tables(laid(line(n, 0, "Name", "Units", None, "Price"), *rows)).select("file", "left", "right")


@query("""SELECT n_name AS file, CASE WHEN n_nationkey % 2 = 0 AND count(*) > 1 THEN 'comma' ELSE 'dot' END AS convention, CAST(round(sum(s_acctbal), 2) AS DOUBLE) AS sum
FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal >= 0 GROUP BY 1, n_nationkey""")
def numbers_by_file(spark, sf_dir):
    """Half of the files write 1.234,50, the others 1,234.50: the file's own numbers settle which, if there are two."""
    s = read(spark, sf_dir, "supplier").join(read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).where("s_acctbal >= 0")
    us = F.format_number(F.col("s_acctbal").cast("decimal(18,2)"), 2)
    s = s.select(F.col("n_name").alias("file"), "s_name", F.when(F.col("n_nationkey") % 2 == 0, F.translate(us, ",.", ".,")).otherwise(us).alias("price"), F.row_number().over(Window.partitionBy("n_name").orderBy("s_suppkey")).alias("k"))
    found = sheets.tables(laid(line(s.select("file").distinct(), 0, "Name", "Price"), line(s, F.col("k"), F.col("s_name"), F.col("price"))))
    return found.select("file", "convention", F.round(F.element_at("columns", 2)["sum"], 2).alias("sum"))


@query("SELECT n_name AS file, CAST(CASE WHEN n_nationkey % 3 = 0 THEN 2500.0 ELSE 2.5 END AS DOUBLE) AS least FROM nation")
def numbers_ambiguous(spark, sf_dir):
    """2.500 beside 1.250.000 or 3,5 is two thousand five hundred; beside 1.25 it is two and a half."""
    n = read(spark, sf_dir, "nation").select(F.col("n_name").alias("file"), "n_nationkey")
    many = F.when(F.col("n_nationkey") % 3 == 0, "1.250.000").otherwise("11.25")
    cells = laid(line(n, 0, "Item", "Weight"), line(n, 1, "a", many), line(n, 2, "b", "2.500"), line(n, 3, "c", many), line(n, 4, "d", "10.500"))
    return sheets.tables(cells).select("file", F.element_at("columns", 2)["least"].alias("least"))


@query("SELECT n_name AS file, CAST(CASE n_nationkey % 4 WHEN 0 THEN 45000 WHEN 1 THEN 45 WHEN 2 THEN 45000 ELSE 1.125 END AS DOUBLE) AS least FROM nation")
def numbers_by_heading(spark, sf_dir):
    """45.000 is forty-five thousand under a currency or a Vietnamese heading of money, else forty-five; rates keep decimals."""
    n = read(spark, sf_dir, "nation").select(F.col("n_name").alias("file"), (F.col("n_nationkey") % 4).alias("k"))
    pick = lambda *x: F.element_at(F.array(*map(F.lit, x)), (F.col("k") + 1).cast("int"))
    cells = laid(line(n, 0, pick("Item", "Item", "Tên hàng", "Tên hàng"), pick("Price (VND)", "Weight", "Thành tiền", "Tỷ lệ phí")), *(line(n, r, f"item {r}", pick("45.000", "45.000", "45.000", "1.125")) for r in range(1, 4)))
    return sheets.tables(cells).select("file", F.element_at("columns", 2)["least"].alias("least"))


@query("SELECT n_name AS file, CASE WHEN n_nationkey % 3 = 2 THEN 'mdy' ELSE 'dmy' END AS date_order FROM nation")
def dates_by_file(spark, sf_dir):
    """Dates that could be either are day first in a file in Vietnamese or with money in euros, else month first."""
    n = read(spark, sf_dir, "nation").select(F.col("n_name").alias("file"), (F.col("n_nationkey") % 3).alias("k"))
    pick = lambda *x: F.element_at(F.array(*map(F.lit, x)), (F.col("k") + 1).cast("int"))
    cells = laid(line(n, 0, pick("Thời gian", "Day", "Day"), "Price"), *(line(n, r, f"0{r}/04/2026", pick("1", "€5", "$5")) for r in range(1, 4)))
    return columns(sheets.tables(cells), "letter", "date_order").where("letter = 'A'").select("file", "date_order")


@query("SELECT n_name AS file, 'date' AS kind, CASE WHEN n_nationkey % 2 = 0 THEN 'dmy' ELSE 'mdy' END AS date_order FROM nation")
def dates_by_column(spark, sf_dir):
    """05/04/2026 is read by the dates beside it of which only one reading is a day."""
    n = read(spark, sf_dir, "nation").select(F.col("n_name").alias("file"), "n_nationkey")
    sure = F.when(F.col("n_nationkey") % 2 == 0, "23/04/2026").otherwise("04/23/2026")
    cells = laid(line(n, 0, "Item", "Closed"), line(n, 1, "a", "05/04/2026"), line(n, 2, "b", sure), line(n, 3, "c", "06/07/2026"))
    return columns(sheets.tables(cells), "letter", "kind", "date_order").where("letter = 'B'").select("file", "kind", "date_order")


@query("""SELECT n_name AS file, unnest(['A', 'B', 'C', 'D', 'E', 'F', 'G', 'H']) AS letter, unnest(['number', 'text', 'text', 'currency', 'percent', 'boolean', 'mixed', 'category']) AS kind,
unnest(['row', 'phone', 'code', NULL, NULL, NULL, NULL, NULL]) AS identifier, unnest([false, false, false, true, true, false, false, false]) AS measure FROM nation""")
def kinds_of_columns(spark, sf_dir):
    """Row numbers, phones, codes with leading zeros, money, shares, truth words, columns of two kinds, categories."""
    n = read(spark, sf_dir, "nation").select(F.col("n_name").alias("file"), "n_nationkey")
    key = F.lpad(F.col("n_nationkey").cast("string"), 2, "0")
    rows = [line(n, r, str(r), F.concat(F.lit(f"09012345{r}"), key), F.concat(F.lit(f"00{r}"), key), F.concat(F.lit("$"), F.col("n_nationkey") + r), f"{r}.5%", "yes" if r % 2 else "no", "late" if r % 2 else str(r), f"kind {r % 2}") for r in range(1, 7)]
    return columns(sheets.tables(laid(line(n, 0, "No.", "Phone", "Batch", "Price", "Margin", "Paid", "Entry", "Sort"), *rows)), "letter", "kind", "identifier", "measure")


@query(f"SELECT CAST(count(*) AS BIGINT) AS records, CAST(sum(bal) AS DOUBLE) AS sum, CAST(count(DISTINCT file) AS BIGINT) AS files FROM {ACCOUNTS}")
def files_read_side_by_side(spark, sf_dir):
    """The sheets written as files, parted by semicolons, and read by a task each: decoded, sniffed, cut into cells, read."""
    records, files = accounts(spark, sf_dir)
    rows = line(files, 0, "Name", "Segment", "Balance").unionByName(line(records, F.col("k"), F.col("c_name"), F.col("c_mktsegment"), F.col("bal")))
    path = f"{source.shared_folder(spark)}/files-{uuid.uuid4().hex}"
    # By a hash of the name: dealt out by the name itself, this step would be left out, as both sides of the union already are, and each side coalesced its partitions on its own.
    rows = rows.repartition(F.xxhash64("file")).sortWithinPartitions("file", "r").select("file", *(F.col("v")[i].alias(f"v{i}") for i in range(3)))
    rows.write.partitionBy("file").option("sep", ";").csv(path)
    found = sheets.tables(source.cells(spark, f"{path}/*")).select("file", "records", F.element_at("columns", 3)["sum"].alias("sum"))
    return found.agg(F.sum("records").alias("records"), F.round(F.sum("sum"), 2).alias("sum"), F.count("*").alias("files"))
