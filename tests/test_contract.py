"""The driver's contract, on the smallest tables."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"


def test_queries_are_listed_without_a_session():
    """Nothing may make a column when it is imported: who lists the queries has no Spark context yet."""
    told = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(*e.queries()); e.oracle_sql()"], cwd=Path(entry.__file__).parent, capture_output=True, text=True, timeout=120)
    assert told.returncode == 0, told.stderr
    names = told.stdout.split()
    assert set(names) == set(entry.queries()) and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)) and "pipeline" in names


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test data")
def test_entry_has_rows(spark):
    assert entry.entry(spark).count() == 10


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test data")
@pytest.mark.parametrize("name", ["interval_histogram", "chord_metrics", "bar_rhythm_jsd", "lcs_max_stats", "derived_status", "split_80_10_10", "slice_bars", "slice_downbeats", "failures_report", "scalar_features", "mgeval_distances"])
def test_queries_match_their_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in os.listdir(SMALL):
        con.execute(f"create view {t.removesuffix('.parquet')} as select * from '{SMALL}/{t}'")
    got, want = entry.queries()[name](spark, SMALL), con.execute(entry.oracle_sql()[name])
    columns = sorted(got.columns)
    held = [d[0] for d in want.description]
    assert sorted(held) == columns
    norm = lambda r: tuple(round(x, 6) if isinstance(x, float) else x for x in r)
    a = sorted((norm(r) for r in got.select(*columns).collect()), key=repr)
    b = sorted((norm([r[held.index(c)] for c in columns]) for r in want.fetchall()), key=repr)
    assert a == b
