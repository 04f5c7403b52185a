"""Every registered query that has SQL gives the rows of that SQL."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    text = lambda v: "~" if v is None else f"{v:.6g}" if isinstance(v, float) else bytes(v).hex() if isinstance(v, (bytes, bytearray)) else str(v)
    return sorted("|".join(text(r[k]) for k in order) for r in rows)


from scanfold import catalog  # noqa: E402


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    df = entry.queries()[name](spark, FOLDER)
    got = canonical([tuple(r) for r in df.collect()], df.columns)
    rel = con.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert got == canonical(rel.fetchall(), rel.columns)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
def test_entry(spark):
    assert entry.entry(spark).count() > 0
