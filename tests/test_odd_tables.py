"""Queries against their SQL on tables changed so that odd rows occur."""

import os

import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test data")


def against_sql(spark, folder, name, **changed):
    """Rows of a query and of its SQL over the smallest tables, of which some are ``changed`` to the SQL given."""
    import duckdb

    con = duckdb.connect()
    for t in os.listdir(SMALL):
        table = t.removesuffix(".parquet")
        if table in changed:
            con.execute(f"copy ({changed[table].format(f"'{SMALL}/{t}'")}) to '{folder}/{t}' (format parquet)")
        else:
            os.symlink(f"{SMALL}/{t}", f"{folder}/{t}")
        con.execute(f"create view {table} as select * from '{folder}/{t}'")
    want = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    rows = lambda found: sorted((tuple(repr(x) for x in r) for r in found), key=repr)
    return rows(entry.queries()[name](spark, str(folder)).select(*columns).collect()), rows(want.fetchall())


def test_a_theme_without_a_melody_has_no_overlap(spark, tmp_path):
    got, want = against_sql(spark, tmp_path, "theme_ngram_overlap", lineitem="select * from {} where not (l_returnflag = 'N' and l_suppkey % 2 = 0)")
    assert got == want and any(r.count("None") == 3 for r in want)


def test_a_gap_in_percent_of_zero(spark, tmp_path):
    got, want = against_sql(spark, tmp_path, "curve_summary", events="select * replace (case when user_id % 2 = 0 then 0.0 when event_id % 3 = 0 then 0.0 else value end as value) from {}")
    assert got == want and {"inf", "nan"} <= {x for r in want for x in r}
