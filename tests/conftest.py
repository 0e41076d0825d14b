import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = os.environ.get("SOUK_TEST_SF", "/root/testdata/sf0.001")
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from souk.session import get_spark, checkpoint_dir
    s = get_spark("local[*]", shuffle_partitions=8)
    checkpoint_dir(s)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def duck():
    import duckdb
    from souk.sources.tables import TABLES, table_path
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(SF, t)}')")
    return con
