"""The driver contract in __spark_entry__.py."""

import importlib.util
import os

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _entry():
    spec = importlib.util.spec_from_file_location("spark_entry", os.path.join(ROOT, "__spark_entry__.py"))
    m = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(m)
    return m


def test_entry_runs_flagship(spark):
    m = _entry()
    df = m.entry(spark)
    assert df.columns[:3] == ["product", "seller", "date"]
    assert df.count() > 0


def test_every_sql_key_has_a_builder_and_aliases():
    m = _entry()
    qs, sqls = m.queries(), m.oracle_sql()
    assert set(sqls) <= set(qs)
    assert len(qs) >= 100
    for k, sql in sqls.items():
        assert "(" not in k and sql.strip(), k
