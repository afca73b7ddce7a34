"""The Spark stand-in views equal the fixture SQL run in DuckDB (both sides start from the same rows)."""

import duckdb
import pytest

from scorelab.plans.checks import fingerprint
from scorelab.plans.views import BASE_TABLES, VIEW_SQL, view, with_views

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in BASE_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(VIEW_SQL))
def test_view_equals_fixture_sql(spark, duck, name):
    a = fingerprint(view(spark, SF, name).toPandas())[:3]
    b = fingerprint(duck.execute(with_views(f"SELECT * FROM {name}", name)).df())[:3]
    assert a == b
