"""Registered queries against their SQL on small odd tables."""

import duckdb
import pytest

from corvane.plans import registry
from tests.test_queries import plain

QUERIES, SQL = registry.queries(), registry.oracle_sql()
TEXTS = ["", None, "\n", "\n\n", "a\r\nb", "a\rb\nc", "a\x0bb\x0cc\n d\x85e f g", "a\n\xa0\nb", "　x　\n\n y ", "a\n\t\nb\t", "a\n\n\nb\n", " ", "a\n   \nb\n"]


def same(spark, folder, name, **tables):
    con = duckdb.connect()
    for table, select in tables.items():
        con.execute(f"copy ({select}) to '{folder}/{table}.parquet' (format parquet)")
        con.execute(f"create view {table} as select * from '{folder}/{table}.parquet'")
    got, want = QUERIES[name](spark, str(folder)).toPandas(), con.sql(SQL[name]).df()
    assert len(want) > 0
    assert plain(got) == plain(want)


def documents():
    quote = lambda x: "null" if x is None else " || ".join(f"chr({ord(c)})" for c in x) or "''"
    return " union all ".join(f"select {i}::bigint as doc_id, ({quote(x)})::varchar as text" for i, x in enumerate(TEXTS))


@pytest.mark.parametrize("name", ["context_window", "next_nonempty"])
def test_lines_of_odd_texts(spark, tmp_path, name):
    same(spark, tmp_path, name, documents=documents())


def test_links_whose_ids_repeat(spark, tmp_path):
    # 1 * 1,000,000 + 1,000,005 is 2 * 1,000,000 + 5
    part = "select p_partkey::bigint as p_partkey, p_name from (values (5, 'small bolt'), (1000005, 'red nut'), (7, 'Same'), (8, 'same')) t(p_partkey, p_name)"
    lineitem = "select l_orderkey::bigint as l_orderkey, l_partkey::bigint as l_partkey from (values (1, 1000005), (2, 5), (2, 5), (3, 7), (3, 8), (4, 7)) t(l_orderkey, l_partkey)"
    same(spark, tmp_path, "repair_by_name", part=part, lineitem=lineitem)
