"""The library's own queries over whole tables, each beside the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import values
from .model import Filter, QuerySpec, Region
from .operators import composite, structure
from .plans import compile
from .plans.catalog import region_of
from .registry import ORACLES, QUERIES, query, read, tidy
from .streaming import windows


def orders(spark, sf_dir, **more) -> Region:
    return region_of(read(spark, sf_dir, "orders"), "orders", order_by="o_orderkey", **more)


def events(spark, sf_dir, **more) -> Region:
    return region_of(read(spark, sf_dir, "events"), "events", order_by="event_id", **more)


def customers(spark, sf_dir, **more) -> Region:
    return region_of(read(spark, sf_dir, "customer"), "customer", order_by="c_custkey", label="c_name", **more)


def holed(spark, sf_dir) -> Region:
    """Orders whose status is blank in every 7th, whose price is blank in every 7th and n/a in every 11th."""
    df = read(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 7 == 0, F.lit("")).otherwise(F.col("o_orderstatus")).alias("status"),
        F.when(F.col("o_orderkey") % 7 == 0, F.lit(" ")).when(F.col("o_orderkey") % 11 == 0, F.lit("n/a")).otherwise(F.col("o_totalprice").cast("string")).alias("price"),
        "o_totalprice",
    )
    return region_of(df, "holed", order_by="o_orderkey", kinds={"price": "number"})


HOLED = """SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE o_orderstatus END AS status,
  CASE WHEN o_orderkey % 7 = 0 OR o_orderkey % 11 = 0 THEN NULL ELSE o_totalprice END AS price, o_orderkey % 7 = 0 AS blank_price FROM orders"""


def spec(*filters, aggregate="none", column=None, group_by=None, order="desc", limit=5, offset=0) -> QuerySpec:
    return QuerySpec(tuple(Filter(*f) for f in filters), aggregate, column, group_by, order, limit, offset)


def keys(region: Region, *filters) -> DataFrame:
    return compile.matching(region, spec(*filters)).select(F.col("_row").alias("row"))


GROUP_COLUMNS = ("key", "value", "row_count")

# ---- aggregates -------------------------------------------------------------------------------------------


def _grouped(name: str, how: str, sql: str) -> None:
    def f(spark, sf_dir):
        return compile.groups(orders(spark, sf_dir), spec(aggregate=how, column="o_totalprice", group_by="o_orderstatus")).select(*GROUP_COLUMNS)

    QUERIES[f"agg_{how}_by_group"] = f
    ORACLES[f"agg_{how}_by_group"] = f"SELECT o_orderstatus AS key, {sql} AS value, CAST(count(o_totalprice) AS BIGINT) AS row_count FROM orders GROUP BY 1"


def _scalar(how: str, sql: str) -> None:
    def f(spark, sf_dir):
        t = compile.totals(orders(spark, sf_dir), spec(("o_orderstatus", "eq", "f"), aggregate=how, column="o_totalprice"))
        return t.select("matched", "value")

    QUERIES[f"agg_{how}"] = f
    ORACLES[f"agg_{how}"] = f"SELECT CAST(count(*) AS BIGINT) AS matched, {sql} AS value FROM orders WHERE lower(o_orderstatus) = 'f'"


for _how, _sql in {"sum": tidy("sum(o_totalprice)"), "avg": tidy("sum(o_totalprice) / count(o_totalprice)"), "min": "min(o_totalprice)", "max": "max(o_totalprice)"}.items():
    _grouped(_how, _how, _sql)
    _scalar(_how, _sql)


@query("SELECT CAST(count(*) AS BIGINT) AS matched, CAST(count(*) AS DOUBLE) AS value FROM events WHERE event_type = 'click'")
def agg_count(spark, sf_dir):
    return compile.totals(events(spark, sf_dir), spec(("event_type", "eq", "Click"), aggregate="count")).select("matched", "value")


@query(f"SELECT CASE WHEN status = '' THEN '(blank)' ELSE status END AS key, CAST(count(*) AS DOUBLE) AS value, CAST(count(*) AS BIGINT) AS row_count FROM ({HOLED}) GROUP BY 1")
def agg_count_by_group_blank(spark, sf_dir):
    return compile.groups(holed(spark, sf_dir), spec(aggregate="count", group_by="status")).select(*GROUP_COLUMNS)


@query(f"SELECT status AS key, {tidy('sum(price)')} AS value, CAST(count(*) AS BIGINT) AS row_count FROM ({HOLED}) WHERE price IS NOT NULL GROUP BY 1")
def agg_group_without_numbers(spark, sf_dir):
    return compile.groups(holed(spark, sf_dir), spec(aggregate="sum", column="price", group_by="status")).select(*GROUP_COLUMNS)


@query("SELECT o_orderkey AS row, o_totalprice AS value FROM orders WHERE o_totalprice = (SELECT max(o_totalprice) FROM orders)")
def agg_winners(spark, sf_dir):
    return compile.winners(orders(spark, sf_dir), spec(aggregate="max", column="o_totalprice")).select(F.col("_row").alias("row"), F.col("n3").alias("value"))


def _pages(name: str, order: str, limit: int, offset: int) -> None:
    def f(spark, sf_dir):
        s = spec(aggregate="count", group_by="o_orderpriority", order=order, limit=limit, offset=offset)
        return compile.ordered(compile.groups(orders(spark, sf_dir), s), s).select("key", "value")

    QUERIES[name] = f
    way = "ASC" if order == "asc" else "DESC"
    ORACLES[name] = f"SELECT key, value FROM (SELECT o_orderpriority AS key, CAST(count(*) AS DOUBLE) AS value, min(o_orderkey) AS first_row FROM orders GROUP BY 1) ORDER BY value {way} NULLS LAST, first_row LIMIT {limit} OFFSET {offset}"


_pages("agg_group_order_asc", "asc", 3, 0)
_pages("agg_group_page", "desc", 2, 2)


@query("""SELECT key, value, CAST(row_number() OVER (ORDER BY value DESC, first_row) AS BIGINT) AS pos
FROM (SELECT o_orderpriority AS key, CAST(count(*) AS DOUBLE) AS value, min(o_orderkey) AS first_row FROM orders GROUP BY 1)""")
def agg_group_order(spark, sf_dir):
    from pyspark.sql import Window

    found = compile.groups(orders(spark, sf_dir), spec(aggregate="count", group_by="o_orderpriority"))
    w = Window.orderBy(F.col("value").desc_nulls_last(), "first_row")  # over groups, not rows
    return found.select("key", "value", F.row_number().over(w).cast("long").alias("pos"))


@query(f"""SELECT CAST(count(*) AS BIGINT) AS matched, CAST(count(*) FILTER (blank_price) AS BIGINT) AS empty_cells,
CAST(count(*) FILTER (price IS NULL AND NOT blank_price) AS BIGINT) AS odd_cells, CAST(count(price) AS BIGINT) AS numbers, {tidy('sum(price)')} AS value FROM ({HOLED})""")
def agg_exclusions(spark, sf_dir):
    return compile.totals(holed(spark, sf_dir), spec(aggregate="sum", column="price")).select("matched", "empty_cells", "odd_cells", "numbers", "value")


@query(f"SELECT o_orderkey AS row, 'C' || CAST(o_orderkey + 2 AS VARCHAR) AS address, CASE WHEN blank_price THEN 'empty' ELSE 'not a number (\"n/a\")' END AS reason FROM ({HOLED}) WHERE price IS NULL")
def excluded_cells(spark, sf_dir):
    return compile.excluded(holed(spark, sf_dir), spec(aggregate="sum", column="price")).select(F.col("_row").alias("row"), "address", "reason")


@query(f"""SELECT CAST(count(*) FILTER (o_orderkey % 10 <> 0) AS BIGINT) AS matched, CAST(count(*) FILTER (o_orderkey % 10 = 0) AS BIGINT) AS skipped,
{tidy('sum(o_totalprice) FILTER (o_orderkey % 10 <> 0)')} AS value FROM orders WHERE o_totalprice > 1000""")
def agg_summary_rows_skipped(spark, sf_dir):
    region = orders(spark, sf_dir, summary=F.col("o_orderkey") % 10 == 0)
    return compile.totals(region, spec(("o_totalprice", "gt", "1k"), aggregate="sum", column="o_totalprice")).select("matched", "skipped", "value")


# ---- rows -------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey AS row, o_orderstatus AS status, o_totalprice AS price FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 20 OFFSET 40")
def list_rows_page(spark, sf_dir):
    found = compile.listing(orders(spark, sf_dir), spec(("o_orderstatus", "eq", "F"), limit=20, offset=40))
    return found.select(F.col("_row").alias("row"), F.col("c2").alias("status"), F.col("n3").alias("price"))


@query("SELECT event_id AS row, event_type, value FROM events WHERE event_id >= 100 ORDER BY event_id LIMIT 10")
def read_rows(spark, sf_dir):
    df = events(spark, sf_dir).df.where("_row >= 100").orderBy("_row").limit(10)
    return df.select(F.col("_row").alias("row"), F.col("c3").alias("event_type"), F.col("n4").alias("value"))


@query("SELECT 'D' || CAST(o_orderkey + 2 AS VARCHAR) AS address FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 200")
def explain_cells(spark, sf_dir):
    s = spec(("o_orderstatus", "eq", "F"), aggregate="sum", column="o_totalprice")
    return compile.evidence(orders(spark, sf_dir), s).orderBy("_row").limit(200).select("address")


# ---- filters ----------------------------------------------------------------------------------------------


def _filter(name: str, table: str, where: str, *filters) -> None:
    of, key = {"orders": (orders, "o_orderkey"), "events": (events, "event_id"), "customer": (customers, "c_custkey")}[table]
    QUERIES[f"filter_{name}"] = lambda spark, sf_dir: keys(of(spark, sf_dir), *filters)
    ORACLES[f"filter_{name}"] = f"SELECT {key} AS row FROM {table} WHERE {where}"


_P = "CAST(printf('%.11e', o_totalprice) AS DOUBLE)"
_filter("eq_text", "customer", "lower(c_mktsegment) = 'building'", ("c_mktsegment", "eq", "Building"))
_filter("neq_text", "customer", "lower(c_mktsegment) <> 'building'", ("c_mktsegment", "neq", "BUILDING"))
_filter("gt_number", "orders", f"{_P} > 200000", ("o_totalprice", "gt", "200 thousand"))
_filter("gte_number", "orders", f"{_P} >= 200000", ("o_totalprice", "gte", "$200,000"))
_filter("lt_number", "orders", f"{_P} < 2000", ("o_totalprice", "lt", "2k"))
_filter("lte_number", "orders", f"{_P} <= 2000", ("o_totalprice", "lte", "2000"))
_filter("between", "orders", f"{_P} >= 1000 AND {_P} <= 50000", ("o_totalprice", "gte", "1000"), ("o_totalprice", "lte", "50k"))
_filter("and", "orders", f"o_orderstatus = 'O' AND {_P} > 100000 AND o_orderdate >= TIMESTAMP '1997-01-01'", ("o_orderstatus", "eq", "o"), ("o_totalprice", "gt", "100000"), ("o_orderdate", "gte", "1997-01-01"))
_filter("contains", "customer", "contains(lower(c_name), '00001')", ("c_name", "contains", "00001"))
_filter("in", "customer", "lower(c_mktsegment) IN ('building', 'machinery')", ("c_mktsegment", "eq", None, ("building", "MACHINERY")))
_filter("text_order", "customer", "lower(c_mktsegment) >= 'furniture'", ("c_mktsegment", "gte", "Furniture"))
_filter("month", "orders", "month(o_orderdate) = 8", ("o_orderdate", "eq", "August"))
_filter("month_year", "orders", "month(o_orderdate) = 8 AND year(o_orderdate) = 1996", ("o_orderdate", "eq", "Aug 1996"))
_filter("not_month", "orders", "month(o_orderdate) <> 8", ("o_orderdate", "neq", "August"))
_filter("month_day", "orders", "month(o_orderdate) = 7 AND day(o_orderdate) = 4", ("o_orderdate", "eq", "the 4th of July"))
_filter("month_bound_gt", "orders", "o_orderdate >= TIMESTAMP '1998-09-01'", ("o_orderdate", "gt", "August 1998"))
_filter("month_bound_gte", "orders", "o_orderdate >= TIMESTAMP '1998-08-01'", ("o_orderdate", "gte", "August 1998"))
_filter("month_bound_lt", "orders", "o_orderdate < TIMESTAMP '1998-08-01'", ("o_orderdate", "lt", "August 1998"))
_filter("month_bound_lte", "orders", "o_orderdate < TIMESTAMP '1998-09-01'", ("o_orderdate", "lte", "August 1998"))
_filter("shared_year", "events", "ts >= TIMESTAMP '2024-01-15'", ("ts", "gte", "January 15"))
_filter("day_instant", "orders", "o_orderdate = TIMESTAMP '1996-01-02'", ("o_orderdate", "eq", "January 2, 1996"))


@query(f"SELECT o_orderkey AS row FROM ({HOLED}) WHERE status = ''")
def filter_is_empty(spark, sf_dir):
    return keys(holed(spark, sf_dir), ("status", "is_empty"))


@query(f"SELECT o_orderkey AS row FROM ({HOLED}) WHERE status <> ''")
def filter_is_not_empty(spark, sf_dir):
    return keys(holed(spark, sf_dir), ("status", "is_not_empty"))


@query(f"""SELECT CAST(count(*) FILTER (status = '' OR lower(status) NOT IN ('f', 'o')) AS BIGINT) AS not_in_rows,
CAST(count(*) FILTER (status <> '' AND lower(status) <> 'f') AS BIGINT) AS neq_rows FROM ({HOLED})""")
def filter_not_in_blank_quirk(spark, sf_dir):
    r = holed(spark, sf_dir)
    not_in, neq = compile.outcome(r, Filter("status", "neq", None, ("F", "O"))), compile.outcome(r, Filter("status", "neq", "F"))
    return r.df.agg(F.count_if(not_in).alias("not_in_rows"), F.count_if(neq).alias("neq_rows"))


@query("""SELECT CAST(count(*) FILTER (o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0 AND o_totalprice > 1000) AS BIGINT) AS matched,
CAST(count(*) FILTER (o_orderkey % 7 <> 0 AND o_orderkey % 11 = 0) AS BIGINT) AS unread FROM orders WHERE o_orderkey % 7 = 0 OR lower(o_orderstatus) = 'f'
AND o_orderkey % 7 <> 0""")
def filter_unreadable_report(spark, sf_dir):
    return compile.totals(holed(spark, sf_dir), spec(("status", "eq", "F"), ("price", "gt", "1000"))).select("matched", "unread")


@query("SELECT coalesce(bool_or(o_totalprice > 1e8), false) AS any_0, coalesce(bool_or(lower(o_orderstatus) = 'f'), false) AS any_1, CAST(count(*) FILTER (o_totalprice > 1e8 AND lower(o_orderstatus) = 'f') AS BIGINT) AS matched FROM orders")
def filter_first_empty(spark, sf_dir):
    t = compile.totals(orders(spark, sf_dir), spec(("o_totalprice", "gt", "100 million"), ("o_orderstatus", "eq", "F")))
    return t.select("any_0", "any_1", "matched")


@query("SELECT event_id AS row FROM events WHERE event_id % 4 < 2")
def filter_boolean_words(spark, sf_dir):
    words = F.element_at(F.array(*map(F.lit, ("Yes", " TRUE ", "no", "không"))), (F.col("event_id") % 4 + 1).cast("int"))
    df = read(spark, sf_dir, "events").select("event_id", words.alias("flag"))
    return keys(region_of(df, "flags", order_by="event_id", kinds={"flag": "boolean"}), ("flag", "eq", "y"))


@query("SELECT c_custkey AS row FROM customer WHERE c_custkey % 1000 = 42")
def filter_phone(spark, sf_dir):
    n = F.lpad((F.col("c_custkey") % 1000).cast("string"), 6, "0")
    text = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("+84 90-1"), n)).otherwise(F.concat(F.lit("(0901) "), n))
    df = read(spark, sf_dir, "customer").select("c_custkey", text.alias("phone"))
    return keys(region_of(df, "phones", order_by="c_custkey"), ("phone", "eq", "0901000042"))


@query("SELECT o_orderkey AS row FROM orders WHERE (o_orderkey % 3 = 0 AND o_orderkey > 9000)")
def filter_mixed_number(spark, sf_dir):
    k = F.col("o_orderkey")
    cell = F.when(k % 3 == 0, k.cast("string")).when(k % 3 == 1, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.lit("late"))
    df = read(spark, sf_dir, "orders").select("o_orderkey", cell.alias("entry"))
    return keys(region_of(df, "mixed", order_by="o_orderkey", kinds={"entry": "mixed"}), ("entry", "gt", "9000"))


# ---- several steps in one plan ----------------------------------------------------------------------------


@query(f"""WITH s AS (SELECT {tidy('sum(l_extendedprice)')} AS l, {tidy('sum(l_quantity)')} AS r FROM lineitem)
SELECT l AS left_value, r AS right_value, {tidy('l - r')} AS difference, 'more' AS direction, {tidy('(l - r) / r * 100')} AS percent FROM s""")
def compare_columns(spark, sf_dir):
    r = region_of(read(spark, sf_dir, "lineitem"), "lineitem")
    return composite.compare(r, "l_extendedprice", r, "l_quantity")


@query(f"""WITH s AS (SELECT (SELECT {tidy('sum(c_acctbal) / count(c_acctbal)')} FROM customer) AS l, (SELECT {tidy('sum(s_acctbal) / count(s_acctbal)')} FROM supplier) AS r)
SELECT l AS left_value, r AS right_value, {tidy('l - r')} AS difference, CASE WHEN l > r THEN 'more' ELSE 'less' END AS direction, {tidy('(l - r) / abs(r) * 100')} AS percent FROM s""")
def compare_tables(spark, sf_dir):
    return composite.compare(customers(spark, sf_dir), "c_acctbal", region_of(read(spark, sf_dir, "supplier"), "supplier"), "s_acctbal", "avg")


@query(f"SELECT key, value FROM (SELECT c_mktsegment AS key, {tidy('sum(c_acctbal)')} AS value FROM customer GROUP BY 1) WHERE value > 1000000")
def having_sum(spark, sf_dir):
    return composite.having(customers(spark, sf_dir), spec(aggregate="sum", column="c_acctbal", group_by="c_mktsegment"), "gt", 1e6).select("key", "value")


def _top(name: str, order: str) -> None:
    def f(spark, sf_dir):
        found = composite.top(orders(spark, sf_dir), spec(aggregate="sum", column="o_totalprice", group_by="o_custkey", order=order), 20)
        return found.select("key", "value")

    QUERIES[name] = f
    way = "ASC" if order == "asc" else "DESC"
    ORACLES[name] = f"SELECT CAST(o_custkey AS VARCHAR) AS key, {tidy('sum(o_totalprice)')} AS value FROM orders GROUP BY o_custkey ORDER BY value {way}, min(o_orderkey) LIMIT 20"


_top("top_n", "desc")
_top("bottom_n", "asc")


@query("SELECT l_orderkey AS k, l_quantity AS value FROM lineitem WHERE l_quantity = (SELECT DISTINCT l_quantity FROM lineitem ORDER BY 1 DESC LIMIT 1 OFFSET 2)")
def nth_place(spark, sf_dir):
    r = region_of(read(spark, sf_dir, "lineitem"), "lineitem")
    found = composite.nth_place(r, spec(aggregate="max", column="l_quantity"), 3)
    return found.select(F.col("c0").cast("long").alias("k"), F.col("n4").alias("value"))


@query("SELECT o_orderpriority AS key, o_orderkey AS row, o_totalprice AS value FROM orders QUALIFY rank() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC) = 1")
def argmax_per_group(spark, sf_dir):
    found = composite.best_per_group(orders(spark, sf_dir), spec(aggregate="max", column="o_totalprice", group_by="o_orderpriority"))
    return found.select("key", F.col("_row").alias("row"), F.col("n3").alias("value"))


@query("SELECT c_custkey AS row FROM customer WHERE c_acctbal > (SELECT c_acctbal FROM customer WHERE c_custkey = 42)")
def than_row(spark, sf_dir):
    return composite.than_row(customers(spark, sf_dir), "c_acctbal", "gt", "c_custkey", "42").select(F.col("_row").alias("row"))


@query("SELECT o_orderkey AS row FROM orders WHERE o_orderdate > (SELECT o_orderdate FROM orders WHERE o_orderkey = 42)")
def later_than_row(spark, sf_dir):
    return composite.than_row(orders(spark, sf_dir), "o_orderdate", "gt", "o_orderkey", "42").select(F.col("_row").alias("row"))


@query("SELECT o_orderkey AS row FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)")
def than_average(spark, sf_dir):
    return composite.than_average(orders(spark, sf_dir), "o_totalprice").select(F.col("_row").alias("row"))


@query("SELECT c_custkey AS row FROM customer WHERE c_mktsegment = (SELECT c_mktsegment FROM customer WHERE c_custkey = 42) AND c_custkey <> 42")
def same_group_as(spark, sf_dir):
    return composite.same_group(customers(spark, sf_dir), "c_mktsegment", "c_custkey", "42").select(F.col("_row").alias("row"))


@query("SELECT DISTINCT event_type AS value FROM events")
def distinct_values(spark, sf_dir):
    return composite.distinct_values(events(spark, sf_dir), "event_type")


@query("SELECT CAST(count(DISTINCT o_custkey) AS BIGINT) AS groups FROM orders")
def count_distinct_groups(spark, sf_dir):
    return composite.count_groups(orders(spark, sf_dir), "o_custkey")


@query(f"SELECT CAST(count(*) AS BIGINT) AS matched, {tidy('sum(c_acctbal)')} AS value FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def rows_combined(spark, sf_dir):
    s = spec(("c_mktsegment", "eq", None, ("Building", "Machinery")), aggregate="sum", column="c_acctbal")
    return compile.totals(customers(spark, sf_dir), s).select("matched", "value")


@query(f"""SELECT CAST(count(price) + count(*) FILTER (price IS NULL AND NOT blank_price) AS BIGINT) AS non_empty,
CAST(count(DISTINCT price) + max(CASE WHEN price IS NULL AND NOT blank_price THEN 1 ELSE 0 END) AS BIGINT) AS "distinct", CAST(count(*) FILTER (blank_price) AS BIGINT) AS empty,
CAST(count(*) FILTER (price IS NULL AND NOT blank_price) AS BIGINT) AS non_numeric, min(price) AS least, max(price) AS greatest, {tidy('sum(price)')} AS sum, {tidy('avg(price)')} AS mean FROM ({HOLED})""")
def profile_column(spark, sf_dir):
    return composite.profile(holed(spark, sf_dir), "price")


@query(f"SELECT o_custkey, o_orderkey, {tidy('sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey)')} AS running FROM orders")
def summary_rows_running_sum(spark, sf_dir):
    df = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return composite.running_totals(df, "o_custkey", "o_orderkey", "o_totalprice").select("o_custkey", "o_orderkey", "running")


# ---- structure --------------------------------------------------------------------------------------------


@query("""WITH f AS (SELECT user_id AS sheet, event_id AS r FROM events WHERE event_id % 5 <> 0), g AS (SELECT sheet, r, r - row_number() OVER (PARTITION BY sheet ORDER BY r) AS isle FROM f)
SELECT sheet, min(r) AS first_row, max(r) AS last_row, CAST(count(*) AS BIGINT) AS filled FROM g GROUP BY sheet, isle""")
def structure_islands(spark, sf_dir):
    cells = read(spark, sf_dir, "events").where("event_id % 5 <> 0").select(F.col("user_id").alias("sheet"), F.col("event_id").alias("r"))
    return structure.islands(cells, ["sheet"], "r").select("sheet", "first_row", "last_row", "filled")


@query("""WITH m AS (SELECT n_nationkey AS id, n_nationkey * 60 AS top, n_nationkey * 60 + 9 AS bottom, n_name AS value FROM nation)
SELECT o_orderkey AS r, CASE WHEN o_orderkey % 2 = 0 THEN coalesce(value, '') ELSE o_orderstatus END AS value, o_orderkey % 2 = 0 AND value IS NOT NULL AS inherited
FROM orders LEFT JOIN m ON o_orderkey BETWEEN top AND bottom""")
def structure_merge_fill(spark, sf_dir):
    cells = read(spark, sf_dir, "orders").select(F.lit("s").alias("sheet"), F.col("o_orderkey").alias("r"), F.lit(0).alias("c"), F.when(F.col("o_orderkey") % 2 == 0, "").otherwise(F.col("o_orderstatus")).alias("value"))
    n = F.col("n_nationkey")
    merges = read(spark, sf_dir, "nation").select(F.lit("s").alias("sheet"), (n * 60).alias("top"), (n * 60 + 9).alias("bottom"), F.lit(0).alias("left"), F.lit(0).alias("right"), F.col("n_name").alias("anchor"))
    return structure.fill_merges(cells, merges).select("r", "value", "inherited")


# ---- scalar functions -------------------------------------------------------------------------------------


@query(f"SELECT event_id, {tidy('value * 1.1')} AS x FROM events")
def fn_tidy(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", values.tidy(F.col("value") * 1.1).alias("x"))


@query("""SELECT o_orderkey, CASE o_orderkey % 8 WHEN 5 THEN NULL WHEN 6 THEN -round(o_totalprice, 2) WHEN 7 THEN NULL ELSE round(o_totalprice, 2) END AS x FROM orders""")
def fn_read_number(spark, sf_dir):
    """The same prices in several writings: plain, $1,234.50, 1.234,50 €, 1234.50%, EUR, 12e3, (1,234.50), n/a."""
    p, k = F.round("o_totalprice", 2), F.col("o_orderkey") % 8
    us = F.format_number(p, 2)
    eu = F.translate(us, ",.", ".,")
    bare = F.format_string("%.2f", p)
    text = F.when(k == 0, bare).when(k == 1, F.concat(F.lit("$"), us)).when(k == 2, F.concat(eu, F.lit(" €"))).when(k == 3, F.concat(bare, F.lit(" %"))).when(k == 4, F.concat(F.lit("EUR "), us))
    text = text.when(k == 5, F.lit("12e3")).when(k == 6, F.concat(F.lit("("), us, F.lit(")"))).otherwise("n/a")
    return read(spark, sf_dir, "orders").select("o_orderkey", text.alias("text")).select("o_orderkey", values.number(F.col("text")).alias("x"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 8 = 7 THEN NULL ELSE o_orderdate END AS d FROM orders")
def fn_parse_date(spark, sf_dir):
    k, d = F.col("o_orderkey") % 8, F.col("o_orderdate")
    forms = ["yyyy-MM-dd", "yyyy/MM/dd", "M/d/yyyy", "d.M.yyyy", "MMMM d, yyyy", "d MMM yyyy", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"]
    text = F.lit("31 Feb 2020")
    for i, form in enumerate(forms):
        text = F.when(k == i, F.date_format(d, form)).otherwise(text)
    return read(spark, sf_dir, "orders").select("o_orderkey", text.alias("text")).select("o_orderkey", values.date(F.col("text")).alias("d"))


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN false ELSE NULL END AS b FROM events")
def fn_truth(spark, sf_dir):
    words = F.element_at(F.array(*map(F.lit, ("Có", " no", "Y", "FALSE", "maybe"))), (F.col("event_id") % 5 + 1).cast("int"))
    return read(spark, sf_dir, "events").select("event_id", values.truth(words).alias("b"))


@query("SELECT event_id, event_id % 4 <> 0 AS blank FROM events")
def fn_blank(spark, sf_dir):
    words = F.element_at(F.array(F.lit("x"), F.lit(""), F.lit("  ﻿"), F.lit(None).cast("string")), (F.col("event_id") % 4 + 1).cast("int"))
    return read(spark, sf_dir, "events").select("event_id", values.blank(words).alias("blank"))


@query("SELECT DISTINCT l_quantity AS q, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS s FROM lineitem")
def fn_js_string(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("q"), values.js_string(F.col("l_quantity"), "double").alias("s")).distinct()


# ---- streams ----------------------------------------------------------------------------------------------


@query(f"""SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type AS key, CAST(count(*) AS BIGINT) AS n, {tidy('sum(value)')} AS value FROM events GROUP BY 1, 2""")
def stream_tumbling(spark, sf_dir):
    """Hourly sums by a streaming query over the events table, run until all is read."""
    return windows.windowed(spark, f"{sf_dir}/events.parquet", "ts", "event_type", "value", "1 hour")


@query(f"""SELECT time_bucket(INTERVAL 1 HOUR, ts) - to_hours(back) AS start, event_type AS key, CAST(count(*) AS BIGINT) AS n, {tidy('sum(value)')} AS value
FROM events, (VALUES (0), (1), (2)) AS b(back) GROUP BY 1, 2""")
def stream_sliding(spark, sf_dir):
    """Sums over three hours, each hour anew: an event counts in three windows."""
    return windows.windowed(spark, f"{sf_dir}/events.parquet", "ts", "event_type", "value", "3 hours", "1 hour")


@query("""WITH e AS (SELECT user_id AS key, ts, CASE WHEN ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 12 HOUR THEN 1 ELSE 0 END AS fresh FROM events),
s AS (SELECT key, ts, sum(fresh) OVER (PARTITION BY key ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT key, min(ts) AS start, max(ts) + INTERVAL 12 HOUR AS "end", CAST(count(*) AS BIGINT) AS n FROM s GROUP BY key, k""")
def stream_sessions(spark, sf_dir):
    """A user's events without a gap of twelve hours are one session."""
    return windows.in_sessions(spark, f"{sf_dir}/events.parquet", "ts", "user_id", "12 hours")


from . import sheet_queries, tool_queries  # noqa: E402, F401
