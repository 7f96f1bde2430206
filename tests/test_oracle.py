"""Every query of the engine against its SQL in DuckDB."""

from __future__ import annotations

import duckdb
import pytest

from ravelin import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def values(frame, columns):
    return sorted(tuple(repr(v.item() if hasattr(v, "item") else v) for v in row) for row in frame[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, duck, name):
    got = catalog.queries()[name](spark, SF).toPandas()
    want = duck.execute(catalog.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert values(got, columns) == values(want, columns)


#: Queries with a model or an index, which SQL can't follow. Those that train are run by the tests of their modules.
@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql()) - {"plan_train_predict", "mdl5_tune"}))
def test_rows(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    frame = __spark_entry__.entry(spark)
    assert frame.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
