"""Queries that once held a part of their job run over whole tables: at the larger scale, against their SQL."""

from pathlib import Path

import duckdb
import pytest

from eventloom.plans import registry
from test_queries import rows

Q, SQL = registry.queries(), registry.oracle_sql()
SF = "/root/testdata/sf0.01"
WHOLE = ["i07_overlap", "g42_correlated_list", "f15_timelines", "f16_process_timelines", "f17_timeline_summary", "f18_row_text", "f19_text_events", "f22_context", "f23_contexts", "f27_dictionary"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", WHOLE)
def test_whole(spark, duck, name):
    df, cursor = Q[name](spark, SF), duck.execute(SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, df.collect()) == rows(columns, cursor.fetchall())


def test_timelines_of_all_entities(spark, duck):
    count = "SELECT id::VARCHAR AS id, count(*) AS n FROM (SELECT user_id AS id FROM events UNION ALL SELECT o_custkey FROM orders) GROUP BY 1"
    want = dict(duck.execute(count).fetchall())
    assert max(want.values()) <= 5000
    assert {r.id: r.events for r in Q["f17_timeline_summary"](spark, SF).collect()} == want
