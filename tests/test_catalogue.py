import duckdb
import pytest

from verdigris.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return c


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    value = lambda v: None if v is None or v != v else round(float(v), 6) + 0.0 if type(v).__name__ in ("float", "Decimal") else v
    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sql, name):
    df = catalogue.QUERIES[name](spark, DATA)
    rows = df.collect()
    if name in catalogue.ORACLES:
        got = sql.sql(catalogue.ORACLES[name])
        assert sorted(df.columns) == sorted(got.columns)
        assert canonical(rows, df.columns) == canonical(got.fetchall(), got.columns)


def test_entry_and_registry():
    import __spark_entry__ as e

    assert set(catalogue.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
