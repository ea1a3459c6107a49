import duckdb
import pytest

import __spark_entry__ as entry
from rasterflow.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    return f"{value:.6g}" if isinstance(value, float) else str(value)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert entry.oracle_sql().keys() <= entry.queries().keys()


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    found = entry.queries()[name](spark, DATA)
    expected = con.execute(catalog.ORACLE_SQL[name])
    names = [c[0] for c in expected.description]
    assert sorted(names) == sorted(found.columns)
    key = lambda row: tuple(map(plain, row))
    assert sorted(key([r[n] for n in names]) for r in found.collect()) == sorted(map(key, expected.fetchall()))


def test_both_file_plans(spark):
    a, b = (entry.queries()[n](spark, DATA) for n in ("jpeg_files", "jpeg_files_relational"))
    assert sorted(map(tuple, a.select("image_id", "n_bytes", "md5").collect())) == sorted(map(tuple, b.select("image_id", "n_bytes", "md5").collect()))
