"""Results must not depend on the session time zone (ticks are UTC wall clocks)."""

import pytest

from souk.plans.registry import load_all
from tests.test_oracle import _rows

KEYS = ["str_02_daily_ticks", "str_02_tick_flags", "fn_08_date_formats", "agg_18_anomalies_by_weekday",
        "agg_24_monthly_trend", "prj_19_anomaly_report"]


@pytest.mark.parametrize("key", KEYS)
def test_same_result_in_another_time_zone(spark, sf, duck, key):
    other = spark.newSession()
    other.conf.set("spark.sql.session.timeZone", "America/New_York")
    q = load_all()[key]
    df = q.build(other, sf)
    res = duck.execute(q.sql)
    dcols = [d[0] for d in res.description]
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows(dcols, res.fetchall())
