"""Every query with SQL beside it gives that SQL's rows; engine answers over random rows give DuckDB's."""

import glob
import os
import random

import duckdb
import pandas as pd
import pytest

from quillgrid import queries as library
from quillgrid.model import Filter, QuerySpec
from quillgrid.plans import compile
from quillgrid.plans.catalog import region_of

DATA = os.environ.get("QUILLGRID_TEST_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM read_parquet('{path}')")
    return c


def plain(v):
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return None if isinstance(v, float) and v != v else float(f"{v:.9e}") if isinstance(v, float) else v


def rows(columns: list[str], found) -> list[tuple]:
    """Rows in any order, their values by the names of their columns."""
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


def by_spark(df) -> list[tuple]:
    return rows(df.columns, df.collect())


def by_duck(con, sql: str) -> list[tuple]:
    found = con.execute(sql)
    return rows([d[0] for d in found.description], found.fetchall())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the given tables are not here")
@pytest.mark.parametrize("name", sorted(library.ORACLES))
def test_query_gives_the_rows_of_its_sql(spark, duck, name):
    got = library.QUERIES[name](spark, DATA)
    assert sorted(got.columns) == sorted(d[0] for d in duck.execute(f"SELECT * FROM ({library.ORACLES[name]}) LIMIT 0").description)
    assert by_spark(got) == by_duck(duck, library.ORACLES[name])


def same_over(spark, folder, name: str, customers: str) -> bool:
    """Whether a query gives its SQL's rows over customers made by SQL, of eight nations."""
    con = duckdb.connect()
    tables = {"customer": f"SELECT c_custkey, 'Customer#' || c_custkey AS c_name, c_nationkey, CAST(c_acctbal AS DOUBLE) AS c_acctbal, 'BUILDING' AS c_mktsegment FROM ({customers})", "nation": "SELECT CAST(range AS INTEGER) AS n_nationkey, 'NATION_' || range AS n_name, 0 AS n_regionkey FROM range(8)"}
    for table, sql in tables.items():
        con.execute(f"COPY ({sql}) TO '{folder}/{table}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    return by_spark(library.QUERIES[name](spark, str(folder))) == by_duck(con, library.ORACLES[name])


def test_figures_of_many_records_outgrow_an_integer(spark, tmp_path):
    assert same_over(spark, tmp_path, "summary_told_by_figures", "SELECT range AS c_custkey, CAST(range // 2200 AS INTEGER) AS c_nationkey, range % 97 / 100 AS c_acctbal FROM range(2300)")


def test_a_file_is_written_by_one_task_however_partitions_are_coalesced(spark, tmp_path):
    small = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k"}
    for k, v in small.items():
        spark.conf.set(k, v)
    try:
        assert same_over(spark, tmp_path, "files_read_side_by_side", "SELECT range AS c_custkey, CAST(range % 8 AS INTEGER) AS c_nationkey, range % 97 / 100 AS c_acctbal FROM range(2000)")
    finally:
        for k in small:
            spark.conf.unset(k)


def test_amounts_are_said_in_thousands_at_any_size(spark, tmp_path):
    assert same_over(spark, tmp_path, "say_amount", "SELECT range * 9 + 1 AS c_custkey, 0 AS c_nationkey, 0 AS c_acctbal FROM range(100000)")


def test_numbers_short_of_a_million_are_said_in_thousands(spark, tmp_path):
    assert same_over(spark, tmp_path, "say_number", "SELECT range AS c_custkey, 0 AS c_nationkey, (range - 50) / 100 + CASE WHEN range % 2 = 0 THEN 999.5 ELSE -9999.5 END AS c_acctbal FROM range(100) UNION ALL SELECT 100 + range, 0, 5000000 + range / 4 FROM range(4)")


NAMES = ["North", "south", "East", " West ", "", None]


def cases(n: int):
    """Random conditions beside their SQL, with an aggregate and sometimes a group."""
    rng = random.Random(7)
    blank = "(g IS NULL OR trim(g) = '')"
    for _ in range(n):
        filters, sql = [], []
        for _ in range(rng.randint(0, 3)):
            x, word = rng.randint(-40, 40), rng.choice(["north", "South", "west", "nowhere"])
            low = word.lower()
            f, s = rng.choice(
                [
                    (Filter("figure", "gt", str(x)), f"coalesce(x > {x}, false)"),
                    (Filter("figure", "lte", str(x)), f"coalesce(x <= {x}, false)"),
                    (Filter("figure", "eq", str(x)), f"coalesce(x = {x}, false)"),
                    (Filter("figure", "neq", str(x)), f"coalesce(x <> {x}, false)"),
                    (Filter("figure", "is_empty"), "x IS NULL"),
                    (Filter("place", "eq", word), f"(NOT {blank} AND lower(trim(g)) = '{low}')"),
                    (Filter("place", "neq", word), f"(NOT {blank} AND lower(trim(g)) <> '{low}')"),
                    (Filter("place", "neq", None, (word, "east")), f"({blank} OR lower(trim(g)) NOT IN ('{low}', 'east'))"),
                    (Filter("place", "contains", "st"), f"(NOT {blank} AND contains(lower(g), 'st'))"),
                    (Filter("place", "is_not_empty"), f"NOT {blank}"),
                ]
            )
            filters.append(f)
            sql.append(s)
        yield tuple(filters), " AND ".join(sql) or "true", rng.choice(["count", "sum", "avg", "min", "max"]), rng.random() < 0.5


def test_random_questions_give_the_rows_of_sql(spark):
    rng = random.Random(5)
    table = [(k, rng.choice(NAMES), None if rng.random() < 0.15 else float(rng.randint(-50, 50)) / rng.choice([1, 2, 4])) for k in range(400)]
    t = pd.DataFrame(table, columns=["k", "g", "x"])  # noqa: F841
    df = spark.createDataFrame(table, "k long, place string, figure double").repartition(3)
    r, con = region_of(df, "t", order_by="k"), duckdb.connect()
    con.register("t", t)
    for filters, where, how, grouped in cases(25):
        spec = QuerySpec(filters, how, None if how == "count" else "figure", "place" if grouped else None)
        value = "count(*)::DOUBLE" if how == "count" else f"{how}(x)"
        if grouped:
            some = where if how == "count" else f"({where}) AND x IS NOT NULL"
            want = by_duck(con, f"SELECT CASE WHEN g IS NULL OR trim(g) = '' THEN '(blank)' ELSE g END AS key, {value} AS value, count(*) AS row_count, min(k) AS first_row FROM t WHERE {some} GROUP BY 1")
            assert by_spark(compile.groups(r, spec)) == want, (filters, how)
        else:
            want = by_duck(con, f"SELECT {value} AS value, count(*) AS matched FROM t WHERE {where}")
            assert by_spark(compile.totals(r, spec).select("value", "matched")) == want, (filters, how)


def pushed(df) -> str:
    """The filters that the plan hands to its scan."""
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "2000")  # whole, not cut
    plan = df._jdf.queryExecution().executedPlan().toString()
    return " ".join(x.split("]")[0] for x in plan.split("PushedFilters: [")[1:])


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the given tables are not here")
@pytest.mark.parametrize(
    "filters, want",
    [
        ((("o_totalprice", "gt", "200 thousand"),), "GreaterThanOrEqual(o_totalprice"),
        ((("o_totalprice", "eq", "1000"),), "LessThanOrEqual(o_totalprice"),
        ((("o_totalprice", "gte", "1000"), ("o_totalprice", "lte", "50k")), "LessThanOrEqual(o_totalprice"),
        ((("o_totalprice", "eq", None, ("1000", "2000")),), "Or(And(GreaterThanOrEqual(o_totalprice"),
        ((("o_orderdate", "eq", "January 2, 1996"),), "EqualTo(o_orderdate"),
        ((("o_orderdate", "eq", "Aug 1996"),), "LessThan(o_orderdate"),
        ((("o_orderdate", "gt", "August 1998"),), "GreaterThanOrEqual(o_orderdate"),
        ((("o_custkey", "eq", "42"),), "o_custkey"),
        ((("o_orderstatus", "eq", "f"),), "IsNotNull(o_orderstatus"),
        ((("o_orderstatus", "eq", None, ("f", "o")),), "IsNotNull(o_orderstatus"),
        ((("o_orderdate", "is_empty"),), "IsNull(o_orderdate"),
    ],
)
def test_filters_reach_the_scan(spark, filters, want):
    region = library.orders(spark, DATA)
    assert want in pushed(compile.matching(region, library.spec(*filters)).select("_row")), filters


def test_typed_identifiers_are_met_as_numbers(spark):
    df = spark.createDataFrame([(1, 9007199254740993), (2, 9007199254740992), (3, None), (4, 42)], "k long, account_id long")
    region = region_of(df, "t", order_by="k")
    assert region.columns[1].identifier == "code" and region.columns[1].typed == "integer"
    keys = lambda *f: [r._row for r in compile.matching(region, QuerySpec((Filter("account_id", *f),))).orderBy("_row").collect()]
    assert keys("eq", "9007199254740993") == [1] and keys("neq", "42") == [1, 2] and keys("is_empty") == [3]
    assert keys("eq", None, ("42", "9007199254740992")) == [2, 4] and keys("eq", "042") == []
