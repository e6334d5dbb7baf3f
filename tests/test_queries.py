"""Every query against its SQL in DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from tesselite import queries as q

SF = "/root/testdata/sf0.001"
KINDS = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean"}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _rows(rows):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows), key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(q.QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = q.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = duck.sql(q.ORACLE_SQL[name])
    assert sorted(want.columns) == columns
    kinds = dict(zip(want.columns, map(str, want.types), strict=True))
    assert {c: KINDS[kinds[c]] for c in columns} == {c: k for c, k in df.dtypes}
    at = [want.columns.index(c) for c in columns]
    assert _rows(df.select(*columns).collect()) == _rows([r[i] for i in at] for r in want.fetchall())


def test_no_query_multiplies_all_rows(spark):
    for name in ("bbox_tiles", "surface_columns", "shaded_tiles", "tile_serving", "markers_blurred"):
        plan = q.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
