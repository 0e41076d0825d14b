"""Column expressions shared by the operators.

Money is carried as BIGINT cents. Sums of cents are exact on any partitioning, so rolling
and grouped means agree bit-for-bit with other engines; doubles appear only at the edge.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference application's behaviour.
NEGATIVE, NEUTRAL, POSITIVE = "Negative", "Neutral", "Positive"
SENTIMENTS = (POSITIVE, NEUTRAL, NEGATIVE)
ALL_STORES = "All Stores"
FAKE_FLAG_SCORE = 0.85          # score given by the fake-discount rule
FAKE_RATIO_NUM, FAKE_RATIO_DEN = 9, 10   # actual >= 0.9 x rolling mean
ROLLING_ROWS = 7                # rolling mean window of the price analysis
ROLLING_ROWS_LONG = 14          # rolling mean window of the isolation-forest job
DEAL_PENALTY = 30               # deal score penalty when any best deal is fake
CONFIDENCE_BASE, CONFIDENCE_MOD = 88.5, 110   # checksum "confidence" of an anomaly


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def cents(x) -> Column:
    """Quantise a money amount to BIGINT cents, half-to-even (Python's round)."""
    return F.rint(col(x) * 100).cast("bigint")


def money(c) -> Column:
    """BIGINT cents back to a DOUBLE amount."""
    return col(c).cast("double") / 100


def round_half_even(x, places: int) -> Column:
    """Python ``round(x, n)`` on doubles: half-to-even on the scaled value."""
    scale = float(10 ** places)
    return F.rint(col(x) * scale) / scale


def round_half_up(x, places: int) -> Column:
    """JavaScript ``Math.round`` / ``toFixed`` style rounding used by the pages."""
    scale = float(10 ** places)
    return F.floor(col(x) * scale + 0.5) / scale


def safe_ratio(num, den) -> Column:
    """num / den as DOUBLE, NULL when den is 0 or NULL (ANSI mode would raise)."""
    return F.try_divide(col(num).cast("double"), col(den).cast("double"))


def discount_pct(claimed_c, actual_c) -> Column:
    """FN-13: (claimed - actual) / claimed * 100, 0 when the list price is 0 or missing."""
    return F.coalesce(safe_ratio(col(claimed_c) - col(actual_c), claimed_c) * 100, F.lit(0.0))


def sentiment_of_rating(rating, null_as: str | None = None) -> Column:
    """FN-03: <=2 Negative, 3 Neutral, otherwise Positive. ``null_as`` is the policy for a
    missing rating (the reference's pandas jobs end up with Positive; SQL gives NULL)."""
    r = col(rating)
    out = (F.when(r.isNull(), F.lit(null_as))
           .when(r <= 2, F.lit(NEGATIVE))
           .when(r == 3, F.lit(NEUTRAL))
           .otherwise(F.lit(POSITIVE)))
    return out


def label_of_rating(rating) -> Column:
    """FN-04: rating -> class id 0 (Negative) / 1 (Neutral) / 2 (Positive)."""
    r = col(rating)
    return F.when(r.isNull(), F.lit(None).cast("int")).when(r <= 2, 0).when(r == 3, 1).otherwise(2)


def name_of_label(label, default: str = POSITIVE) -> Column:
    """FN-05: class id -> name, unknown ids fall back to ``default``."""
    m = F.create_map(F.lit(0), F.lit(NEGATIVE), F.lit(1), F.lit(NEUTRAL), F.lit(2), F.lit(POSITIVE))
    return F.coalesce(F.try_element_at(m, col(label).cast("int")), F.lit(default))


def optional_eq(c, value, sentinel: str | None = ALL_STORES) -> Column:
    """PRJ-05: equality filter that is a no-op for None or the 'all' sentinel."""
    if value is None or (sentinel is not None and value == sentinel):
        return F.lit(True)
    return col(c) == F.lit(value)


def all_of(*preds: Column) -> Column:
    """PRJ-03: conjunction of optional predicates."""
    preds = [p for p in preds if p is not None]
    return reduce(lambda a, b: a & b, preds, F.lit(True))


def contains_ci(c, needle: str) -> Column:
    """PRJ-06: SQL ``LIKE '%needle%'`` with case-insensitive ASCII match; user ``%``/``_``
    keep their wildcard meaning as in the reference."""
    return col(c).ilike(f"%{needle}%")


def rlike_ci(c, pattern: str) -> Column:
    """PRJ-07: case-insensitive regex search, NULL text -> false."""
    return F.coalesce(col(c).rlike(f"(?i){pattern}"), F.lit(False))


def code_point_sum(c) -> Column:
    """Sum of the code points of a string (used by FN-19)."""
    chars = F.split(col(c), "")
    return F.aggregate(F.transform(chars, lambda ch: F.ascii(ch).cast("bigint")), F.lit(0).cast("bigint"),
                       lambda acc, x: acc + x)


def checksum_confidence(date_col, seller_col) -> Column:
    """FN-19: 88.5 + (sum of code points of 'YYYY-MM-DD' || seller mod 110) / 10."""
    s = F.concat(F.date_format(col(date_col), "yyyy-MM-dd"), col(seller_col))
    return F.lit(CONFIDENCE_BASE) + F.pmod(code_point_sum(s), F.lit(CONFIDENCE_MOD)).cast("double") / 10


def money_text(c_cents) -> Column:
    """FN-20 helper: BIGINT cents -> 'd.dd' without float formatting."""
    c = col(c_cents)
    sign = F.when(c < 0, F.lit("-")).otherwise(F.lit(""))
    a = F.abs(c)
    return F.concat(sign, ((a - a % 100) / 100).cast("bigint").cast("string"), F.lit("."),
                    F.lpad((a % 100).cast("string"), 2, "0"))


def weekday_sun0(d) -> Column:
    """FN-23: JavaScript getDay(): Sunday = 0 .. Saturday = 6."""
    return F.dayofweek(col(d)) - 1


def softmax(arr) -> Column:
    """FN-22: softmax of an ARRAY of logits (max-shifted for stability)."""
    a = col(arr)
    m = F.array_max(a)
    e = F.transform(a, lambda x: F.exp(x.cast("double") - m))
    total = F.aggregate(e, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(e, lambda x: x / total)


def argmax(arr) -> Column:
    """FN-22: 0-based index of the largest element (first on ties)."""
    return (F.array_position(col(arr), F.array_max(col(arr))) - 1).cast("int")


def py_float_text(c_cents) -> Column:
    """Python ``str(x)`` of a non-negative money amount given in cents ('1234.0', '1234.5',
    '1234.56'), built from integers rather than float formatting."""
    c = col(c_cents)
    whole = ((c - c % 100) / 100).cast("bigint").cast("string")
    frac = c % 100
    tail = (F.when(frac == 0, F.lit("0"))
             .when(frac % 10 == 0, (frac / 10).cast("bigint").cast("string"))
             .otherwise(F.lpad(frac.cast("string"), 2, "0")))
    return F.concat(whole, F.lit("."), tail)


def utc_instant(ntz) -> Column:
    """A TIMESTAMP_NTZ wall clock read as UTC, whatever the session time zone."""
    return F.convert_timezone(F.lit("UTC"), F.current_timezone(), col(ntz)).cast("timestamp")


def utc_wall_clock(ts) -> Column:
    """The UTC wall clock (TIMESTAMP_NTZ) of a TIMESTAMP instant."""
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), col(ts).cast("timestamp_ntz"))
