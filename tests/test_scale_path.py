"""Every rolling price query must give the same rows whatever the blocks: with blocks of a few rows
nearly every window crosses blocks, with one block for all nothing is carried."""

import pytest
from souk.operators import series
from souk.plans.registry import load_all
from tests.test_oracle import _rows

PRICE_KEYS = sorted(k for k, q in load_all().items()
                    if q.sql and ("roll_n" in q.sql or "roll_sum_c" in q.sql or "s14" in q.sql))


@pytest.mark.parametrize("key", PRICE_KEYS)
def test_small_blocks_match_sql(spark, sf, duck, key, monkeypatch):
    monkeypatch.setattr(series, "BLOCK_ROWS", 3)
    q = load_all()[key]
    df = q.build(spark, sf)
    res = duck.execute(q.sql)
    dcols = [d[0] for d in res.description]
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows(dcols, res.fetchall())


def test_shared_folder_is_required_off_local_mode():
    from souk.session import checkpoint_dir

    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError):
        checkpoint_dir(Session())
