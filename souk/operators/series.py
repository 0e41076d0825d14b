"""Ordered-series primitives (WIN-*).

A price series is keyed by (product, seller) and ordered by (date, tie). There are few keys
(hundreds) and a key may hold a large share of all rows, so a plain
``Window.partitionBy(keys)`` would put a whole series into one task. The primitives here
keep every task bounded:

* ``rolling_rows``   last-N-rows sums/counts. Each series is cut into blocks of about equal
                     volume, at places found from its row counts per day; a block's first rows
                     get what they lack from the last rows of the blocks before, so the result
                     is exact wherever the cuts fall.
* ``top_k``          ``row_number() <= k``; Spark plans a partial WindowGroupLimit before
                     the shuffle, so a hot key ships at most k rows per map task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 1 << 20     # rows of a block, about; the most is twice that (see ``block_cuts``)
LEAST_LONG = -(1 << 63)


def _cols(xs) -> list[Column]:
    return [F.col(x) if isinstance(x, str) else x for x in xs]


def _place(df: DataFrame, order: Sequence[str]) -> tuple[Column, Column]:
    """Where a row is along ``order``: its day, and a number that does not fall within the day."""
    if df.schema[order[0]].dataType.typeName() == "date":
        return F.col(order[0]), F.col(order[1]).cast("bigint") if len(order) > 1 else F.lit(0).cast("bigint")
    return F.to_date(F.col(order[0])), F.unix_micros(order[0])


def day_counts(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows of each (key, day), with the least and largest place in the day: what cuts are made from."""
    day, fine = _place(df, order)
    return df.groupBy(*keys, day.alias("_day")).agg(F.count(F.lit(1)).alias("_n"), F.min(fine).alias("_lo"), F.max(fine).alias("_hi"))


def block_cuts(days: DataFrame, keys: Sequence[str], bound: int | None = None) -> DataFrame:
    """Cuts of each key by volume: (keys, _month, _base, _cuts). ``_cuts`` are the places (day, number)
    in that month where a new block begins, ``_base`` how many the key has before it. Only keys with
    cuts are listed: a series of at most ``bound`` rows is one block and needs none.

    A block begins with the day that starts beyond the next multiple of ``bound``, so it holds at most
    ``bound`` rows and its last day. A day of more than ``bound`` rows is a run of blocks of its own, cut at
    equal steps of the place within the day. The windows here run over days, which the calendar bounds.
    """
    bound = bound or BLOCK_ROWS
    series = Window.partitionBy(*keys).orderBy("_day")
    started = days.withColumn("_start", F.coalesce(F.sum("_n").over(series.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    step = F.floor(F.col("_start") / bound)
    before = started.withColumns({"_step": step, "_was": F.lag(step).over(series), "_heavy": F.col("_n") > bound,
                                  "_after": F.coalesce(F.lag(F.col("_n") > bound).over(series), F.lit(False))})
    begins = F.col("_was").isNotNull() & ((F.col("_step") != F.col("_was")) | F.col("_heavy") | F.col("_after"))
    parts = F.ceil(F.col("_n") / bound).cast("int")
    width = F.col("_hi").cast("decimal(20,0)") - F.col("_lo") + 1
    inside = F.transform(F.sequence(F.lit(1), parts - 1), lambda i: F.struct(
        F.col("_day").alias("day"), (F.col("_lo") + F.floor(width * i / parts)).cast("bigint").alias("at")))
    first = F.array(F.struct(F.col("_day").alias("day"), F.lit(LEAST_LONG).cast("bigint").alias("at")))
    none = F.slice(first, 1, 0)
    found = before.select(*keys, F.trunc("_day", "month").alias("_month"),
                          F.concat(F.when(begins, first).otherwise(none), F.when(F.col("_heavy"), inside).otherwise(none)).alias("_c"))
    months = found.groupBy(*keys, "_month").agg(F.array_sort(F.flatten(F.collect_list("_c"))).alias("_cuts"))
    along = Window.partitionBy(*keys).orderBy("_month").rowsBetween(Window.unboundedPreceding, -1)
    counted = months.withColumn("_base", F.coalesce(F.sum(F.size("_cuts")).over(along), F.lit(0)))
    return counted.where((F.size("_cuts") > 0) | (F.col("_base") > 0)).select(*keys, "_month", "_base", "_cuts")


def _all_of(df: DataFrame) -> Column:
    """Always true, and reads every column: an exchange that two branches share must have the same
    columns in both, and the optimiser would prune them from one."""
    return F.xxhash64(*df.columns) >= LEAST_LONG


def rolling_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int,
                 sums: dict[str, str], count_col: str | None = "_cnt", cuts: DataFrame | None = None) -> DataFrame:
    """Sums over the last ``n`` rows (current included) of each key in ``order``.

    ``sums`` maps output column -> input column. ``count_col`` receives the number of rows
    in the frame (``min(position, n)``), which is what a rolling mean with ``min_periods=1``
    divides by. ``order`` must be unique per row (end it with a tie-break) and begin with a date, then
    an integer, or with a timestamp; neither may be NULL. ``cuts`` are the ``block_cuts`` of these keys,
    or of a table that these rows are part of; without them they are made from the rows, in one more
    pass over keys and order. Rows move once: the blocks and what is carried from block to block are
    read from one exchange. Carried rows are at most n-1 a block, and none where nothing is cut.
    """
    keys, order = list(keys), list(order)
    day, fine = _place(df, order)
    cuts = block_cuts(day_counts(df, keys, order), keys) if cuts is None else cuts
    at = cuts.select(F.struct(*keys, "_month").alias("_at"), "_base", "_cuts")
    place = F.struct(day.alias("day"), fine.alias("at"))
    block = F.coalesce(F.col("_base") + F.size(F.filter("_cuts", lambda c: c <= place)), F.lit(0)).cast("bigint")
    own = df.columns
    rows = (df.join(at, F.struct(*keys, F.trunc(day, "month").alias("_month")) == F.col("_at"), "left")
              .select(*own, F.struct(*keys, block.alias("_block")).alias("_id")).repartition("_id"))
    w = Window.partitionBy("_id").orderBy(*order)
    inputs = list(dict.fromkeys(sums.values()))
    frame = w.rowsBetween(-(n - 1), 0)
    out = rows.select("*", F.row_number().over(w).alias("_rn"), *[F.sum(c).over(frame).alias(f"_s_{o}") for o, c in sums.items()])
    # The last rows of each block, oldest first, of series that are cut at all; then what a block is
    # given: the last rows of the one before it, and of earlier ones where that has too few.
    split = cuts.select(F.struct(*keys).alias("_of")).distinct()
    value = F.struct(*inputs) if inputs else F.struct(F.lit(0).alias("_none"))
    held = rows.join(split, F.struct(*keys) == F.col("_of")).select(*rows.columns, F.lead(F.lit(1)).over(w).alias("_next"),
                       F.array_compact(F.array(*[F.lag(value, k).over(w) for k in range(n - 2, 0, -1)], value)).alias("_tail"))
    series = Window.partitionBy(*[f"_id.{k}" for k in keys]).orderBy("_id._block")
    tails = held.where(F.col("_next").isNull() & _all_of(rows)).select("_id", "_tail")
    carried = tails.select(F.col("_id").alias("_to"), F.flatten(F.collect_list("_tail").over(series.rowsBetween(-(n - 1), -1))).alias("_before")).where(F.size("_before") > 0)
    out = out.join(carried, F.col("_id") == F.col("_to"), "left")
    lacking = F.greatest(F.lit(n) - F.col("_rn"), F.lit(0))
    taken = F.least(lacking, F.coalesce(F.size("_before"), F.lit(0)))
    last = F.slice("_before", F.size("_before") - taken + 1, taken)

    def total(o, c):
        more = F.filter(F.transform(last, lambda x: x[c]), lambda x: x.isNotNull())
        plus = F.when(F.size(more) > 0, F.aggregate(more, F.lit(0).cast(out.schema[f"_s_{o}"].dataType), lambda a, x: a + x))
        return F.when(taken > 0, F.coalesce(F.col(f"_s_{o}") + plus, F.col(f"_s_{o}"), plus)).otherwise(F.col(f"_s_{o}")).alias(o)

    return out.select(*own, *[total(o, c) for o, c in sums.items()],
                      *([(F.least(F.col("_rn"), F.lit(n)) + taken).cast("bigint").alias(count_col)] if count_col else []))


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence, k: int, rank_col: str | None = None) -> DataFrame:
    """First ``k`` rows of each key in ``order`` (WIN-07, WIN-08, AGG-09)."""
    rn = rank_col or "_rn"
    if not keys:
        # Global top-k: TakeOrderedAndProject keeps k rows per task; rank the k survivors.
        head = df.orderBy(*_cols(order)).limit(k)
        return head.withColumn(rn, F.row_number().over(Window.orderBy(*_cols(order)))) if rank_col else head
    w = Window.partitionBy(*keys).orderBy(*_cols(order))
    out = df.withColumn(rn, F.row_number().over(w)).filter(F.col(rn) <= k)
    return out if rank_col else out.drop(rn)


def forward_fill(df: DataFrame, keys: Sequence[str], order: Sequence, value: str, out: str | None = None) -> DataFrame:
    """WIN-05: carry the last non-NULL ``value`` forward; leading gaps stay NULL.
    Meant for day spines, whose groups are bounded by the number of days."""
    w = Window.partitionBy(*keys).orderBy(*_cols(order)).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out or value, F.last(value, ignorenulls=True).over(w))
