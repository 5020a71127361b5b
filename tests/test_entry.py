import os

import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert "core_pass_by_method" in entry.queries()


@pytest.mark.skipif(not os.path.exists(FOLDER), reason="no test tables")
def test_sql_agrees(spark):
    """Every query with SQL gives the rows of its SQL; lists and decimals aren't among their types."""
    import duckdb

    con = duckdb.connect()
    for file in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {file[:-8]} AS SELECT * FROM '{FOLDER}/{file}'")
    plain = lambda v: float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    for name, sql in entry.oracle_sql().items():
        df = entry.queries()[name](spark, FOLDER)
        columns = sorted(df.columns)
        got = sorted(str([plain(r[c]) for c in columns]) for r in df.collect())
        cursor = con.execute(sql)
        names = [x[0] for x in cursor.description]
        assert sorted(names) == columns, name
        want = sorted(str([plain(dict(zip(names, r))[c]) for c in columns]) for r in cursor.fetchall())
        assert got == want, name


@pytest.mark.skipif(not os.path.exists(FOLDER), reason="no test tables")
def test_flagship(spark):
    assert entry.entry(spark).count() > 0
