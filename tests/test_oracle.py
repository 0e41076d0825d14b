"""Every registered query with a SQL twin must give the same rows as DuckDB (sf0.001)."""

import datetime as dt
import decimal
import math

import pytest

from souk.plans.registry import load_all

QUERIES = load_all()
TYPE_MAP = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE",
            "boolean": "BOOLEAN", "timestamp": "TIMESTAMP WITH TIME ZONE", "timestamp_ntz": "TIMESTAMP",
            "float": "FLOAT", "decimal": "DECIMAL"}
WITH_SQL = sorted(k for k, q in QUERIES.items() if q.sql)


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("key", WITH_SQL)
def test_matches_sql(spark, sf, duck, key):
    q = QUERIES[key]
    df = q.build(spark, sf)
    res = duck.execute(q.sql)
    dcols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(dcols)
    dtypes = {d[0]: str(d[1]).split("(")[0] for d in res.description}
    for f in df.schema.fields:
        assert TYPE_MAP.get(f.dataType.simpleString().split("(")[0]) == dtypes[f.name], f.name
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows(dcols, res.fetchall())


def test_every_query_has_a_doc():
    assert all(q.doc for q in QUERIES.values())
