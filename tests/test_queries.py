"""Every registered query of the engine against its SQL, on the smallest tables."""

from collections import Counter

import duckdb
import pytest

from tidelog import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, db, name):
    df = catalog.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = [tuple(r) for r in df.select(*columns).collect()]
    if name not in catalog.oracle_sql():
        assert got
        return
    r = db.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == columns
    want = [tuple(row[names.index(c)] for c in columns) for row in r.fetchall()]
    text = lambda rows: sorted(rows, key=lambda r: [(x is None, str(x)) for x in r])
    assert text(got) == text(want)


@pytest.mark.parametrize("name", ["letters_parked", "letters_retried"])
def test_more_letters_than_a_queue_holds_by_default(spark, tmp_path, name):
    spark.range(55_000).selectExpr("id AS o_orderkey", "id % 9 AS o_custkey", "'F' AS o_orderstatus", "DATE '2024-01-01' AS o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    df = catalog.queries()[name](spark, str(tmp_path))
    got = Counter(tuple(r) for r in df.collect())
    c = duckdb.connect()
    c.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    assert got == Counter(c.execute(f"SELECT {', '.join(df.columns)} FROM ({catalog.oracle_sql()[name]})").fetchall())


def test_entry_registers_everything():
    import __spark_entry__ as e

    assert set(catalog.queries()) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
