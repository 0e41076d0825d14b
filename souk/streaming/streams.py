"""Structured Streaming jobs (STR-01, STR-02).

STR-01 review ingest: file source -> stream-static joins (labels, parent products) -> (with
``scored_ingest_stream``) labels of saved models -> new reviews of each micro-batch, by an anti join
with the landed table. Nothing is kept as state: the table itself says which ids have come.

STR-02 price tick monitor: ticks -> daily tumbling aggregates per seller (update mode), and 7-tick
rolling means with flags: ``flags_of_ticks`` over landed ticks, or ``run_tick_flags``, which with each
micro-batch emits the flags of its ticks and of those whose mean a late tick has changed.

Tables have one folder for each epoch, written over if the epoch is replayed. The checkpoint lies in the
table's folder unless the caller says otherwise; a stopped stream resumes, and a table whose
checkpoint is not there is refused, since its epochs would be written over.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from souk.functions.exprs import FAKE_RATIO_DEN, FAKE_RATIO_NUM, ROLLING_ROWS, utc_instant, utc_wall_clock  # noqa: F401
from souk.operators.models import load_models, score_sentiment
from souk.operators.series import rolling_rows
from souk.sources import views as V
from souk.sources.changes import new_table_path
from souk.sources.tables import read, table_path
from souk.sources.versions import path_exists

DOC_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
EVENT_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def _file_stream(spark: SparkSession, sf_dir: str, table: str, schema: str, files_per_trigger: int = 1, bytes_per_trigger: int | None = None) -> DataFrame:
    """The files of a table's dataset as they arrive, so many to a micro-batch, or, if that is given, as many
    as have ``bytes_per_trigger`` together (one at least). The path is written as a pattern, of one name,
    because a stream takes a plain path for a folder, and a dataset may be one file."""
    path = table_path(sf_dir, table)
    limit = ("maxBytesPerTrigger", bytes_per_trigger) if bytes_per_trigger else ("maxFilesPerTrigger", files_per_trigger)
    return spark.readStream.schema(schema).option(*limit).parquet(f"{path[:-1]}[{path[-1]}]")


ID_RANGE = 1 << 20      # ids of one partition of a table of unique rows
RANGES = 1000           # id ranges of a micro-batch up to which the landed table is pruned to them


def _with(schema: StructType, **more: str) -> StructType:
    """A copy of ``schema`` with partition columns."""
    out = StructType(list(schema.fields))
    for name, kind in more.items():
        out.add(name, kind)
    return out


def epoch_path(out: str, epoch: int) -> str:
    return os.path.join(out, f"epoch={epoch}")


def land_batch(out: str) -> Callable[[DataFrame, int], None]:
    """Write a micro-batch as the folder of its epoch."""
    def land(batch: DataFrame, epoch: int):
        batch.write.mode("overwrite").parquet(epoch_path(out, epoch))
    return land


def land_new(out: str, key: str) -> Callable[[DataFrame, int], None]:
    """Write the rows of a micro-batch whose ``key`` (a whole number) no earlier epoch has, one for each
    key; rows without a key are left out. The table is partitioned by range of the key, so a batch of
    new keys reads few of the landed ones."""
    def land(batch: DataFrame, epoch: int):
        spark = batch.sparkSession
        rows = batch.filter(F.col(key).isNotNull()).dropDuplicates([key]).withColumn("id_range", F.floor(F.col(key) / ID_RANGE)).persist()
        try:
            landed = spark.read.schema(_with(rows.schema, epoch="integer")).parquet(out).filter(F.col("epoch") < epoch)
            ranges = [r[0] for r in rows.select("id_range").distinct().limit(RANGES + 1).collect()]
            if len(ranges) <= RANGES:       # prunes partitions; the anti join decides
                landed = landed.filter(F.col("id_range").isin(ranges))
            new = rows.join(landed.select(key), key, "left_anti").select(*rows.columns)
            new.write.mode("overwrite").partitionBy("id_range").parquet(epoch_path(out, epoch))
        finally:
            rows.unpersist()
    return land


def run_to_table(df: DataFrame, name: str, out: str | None = None, checkpoint: str | None = None, mode: str = "append",
                 unique: str | None = None) -> str:
    """Run a stream over all that has arrived, into ``out``: one folder for each epoch, written over
    if the epoch is replayed. The same ``out`` given again resumes the stream, with the checkpoint in
    it (or the one given); a table with epochs and without its checkpoint is refused. With
    ``unique``, only the first row of each value of that column lands."""
    spark = df.sparkSession
    out = out or new_table_path(spark, name)
    # No epoch yet is an empty table, too.
    empty = epoch_path(out, -1) + ("/id_range=-1" if unique else "")
    spark.createDataFrame([], df.schema).write.mode("overwrite").parquet(empty)
    run_stream(df, out, land_new(out, unique) if unique else land_batch(out), checkpoint, mode)
    return out


def run_stream(df: DataFrame, out: str, land: Callable[[DataFrame, int], None], checkpoint: str | None = None, mode: str = "append",
               first: str | None = None):
    """Run a stream to the end of what has arrived, each micro-batch through ``land``. ``first`` is the
    folder of the first epoch, whose presence without a checkpoint means that another stream wrote here."""
    spark = df.sparkSession
    checkpoint = checkpoint or os.path.join(out, "_checkpoint")
    if path_exists(spark, first or epoch_path(out, 0)) and not path_exists(spark, checkpoint):
        raise ValueError(f"{out} holds epochs, but their checkpoint {checkpoint} is not there; they would be written over")
    query = (df.writeStream.foreachBatch(land).outputMode(mode).option("checkpointLocation", checkpoint)
               .trigger(availableNow=True).start())
    query.awaitTermination()
    return query


BATCH_BYTES = 1 << 30      # fixed value: files of a micro-batch of the review ingest


def review_ingest_stream(spark: SparkSession, sf_dir: str, bytes_per_trigger: int | None = None) -> DataFrame:
    """STR-01 transformation: validated and labelled review rows. Repeated ids go when a micro-batch
    lands (``unique``), so the stream has no state and no review is late. A micro-batch is a file, whose few
    row groups leave most of a cluster idle, unless ``bytes_per_trigger`` says more; what lands is the same."""
    docs = _file_stream(spark, sf_dir, "documents", DOC_SCHEMA, bytes_per_trigger=bytes_per_trigger)
    labels = read(spark, sf_dir, "labels", "doc_id", "quality", "toxic")
    rev = V.reviews_from(docs.select("doc_id", "text", "lang", "source"), labels)
    # Parent check: the product must exist in the catalogue.
    parents = read(spark, sf_dir, "part", "p_brand").select(F.col("p_brand").alias("product")).distinct()
    return rev.join(parents, "product", "left_semi")


def scored_ingest_stream(spark: SparkSession, sf_dir: str, models_path: str) -> DataFrame:
    """STR-01 with scoring: every accepted review also gets the label of each saved model slot (a
    narrow transform of the stream; the models are read, not fitted)."""
    reviews = review_ingest_stream(spark, sf_dir, BATCH_BYTES)
    return score_sentiment(reviews.withColumn("text", F.col("review_text")), load_models(models_path), keep=tuple(reviews.columns))


def run_review_ingest(spark: SparkSession, sf_dir: str, out_path: str | None = None, checkpoint: str | None = None) -> str:
    return run_to_table(review_ingest_stream(spark, sf_dir, BATCH_BYTES), "reviews-stream", out_path, checkpoint, unique="id")


def ticks_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks: seller = event type, actual price = value, claimed price = value x (1 + k%)
    with k from the JSON props; both in BIGINT cents."""
    ev = _file_stream(spark, sf_dir, "events", EVENT_SCHEMA)
    return tick_columns(ev)


def tick_columns(ev: DataFrame) -> DataFrame:
    k = F.coalesce(F.get_json_object("props", "$.k").cast("int"), F.lit(0))
    return ev.select("event_id", utc_instant("ts").alias("ts"), F.col("event_type").alias("seller"),
                     F.rint(F.col("value") * 100).cast("bigint").alias("actual_c"),
                     F.rint(F.col("value") * (F.lit(100) + k)).cast("bigint").alias("claimed_c"))


def daily_ticks(ticks: DataFrame) -> DataFrame:
    """STR-02 (windowed part): daily tumbling aggregates per seller, for update mode: a window is
    emitted again when ticks reach it, however late. State: one row for each day and seller."""
    return (ticks.groupBy(F.window("ts", "1 day").alias("w"), "seller")
                 .agg(F.count(F.lit(1)).alias("ticks"), F.sum("actual_c").alias("sum_c"),
                      F.min("actual_c").alias("min_c"), F.max("actual_c").alias("max_c"))
                 .select(F.col("w.start").alias("day"), "seller", "ticks", "sum_c", "min_c", "max_c"))
    # ``day`` is the window start instant; callers read it as a UTC date (``utc_wall_clock``).


def newest_windows(table: DataFrame) -> DataFrame:
    """Each window of a ``daily_ticks`` table as last emitted."""
    values = ["ticks", "sum_c", "min_c", "max_c"]
    return (table.groupBy("day", "seller").agg(F.max_by(F.struct(*values), "epoch").alias("v"))
                 .select("day", "seller", *[f"v.{c}" for c in values]))


def flags_of_ticks(ticks: DataFrame) -> DataFrame:
    """STR-02 (rolling part) over the landed ticks: 7-tick rolling mean per seller in time order and
    the fake-discount flag, whatever the order of arrival. A task holds one seller's hour."""
    rolled = rolling_rows(ticks, ["seller"], ["ts", "event_id"], ROLLING_ROWS, {"roll_sum_c": "actual_c"}, count_col="roll_n")
    return rolled.withColumn("is_manipulation", (F.col("claimed_c") > F.col("actual_c")) & (
        F.col("actual_c") * FAKE_RATIO_DEN * F.col("roll_n") >= F.col("roll_sum_c") * FAKE_RATIO_NUM))


def run_tick_flags(ticks: DataFrame, out: str | None = None) -> str:
    """STR-02 (flags as ticks arrive), into ``out``: with each micro-batch the flags of its ticks, and
    again those of up to 6 later ticks of a seller whose mean a late tick has changed. ``newest_flags``
    of the table equals ``flags_of_ticks`` over all ticks, whatever the order of arrival.

    Ticks land by day. What is affected is found from counts by (seller, hour), which the calendar
    bounds: the hours that the batch touches, and those that begin within 6 ticks of one. Only these hours and
    the 6 ticks before them are read again, by their days. Windows over ticks are ``rolling_rows``, so no
    task holds a seller. A tick without time or seller lands and has no flag.
    """
    spark, reach = ticks.sparkSession, ROLLING_ROWS - 1
    out = out or new_table_path(spark, "tick-flags")
    hour = F.date_trunc("hour", "ts").alias("hour")

    def land(batch: DataFrame, epoch: int):
        batch.withColumn("day", F.to_date("ts")).write.mode("overwrite").partitionBy("day").parquet(epoch_path(f"{out}/ticks", epoch))
        counts = batch.filter("ts IS NOT NULL AND seller IS NOT NULL").groupBy("seller", hour).agg(F.count(F.lit(1)).alias("n"))
        counts.write.mode("overwrite").parquet(epoch_path(f"{out}/hours", epoch))
        hours = (spark.read.schema("seller string, hour timestamp, n long, epoch int").parquet(f"{out}/hours").filter(F.col("epoch") <= epoch)
                 .groupBy("seller", "hour").agg(F.sum("n").alias("n"), F.max("epoch").alias("newest")))
        along = Window.partitionBy("seller").orderBy("hour")
        before, after = along.rowsBetween(Window.unboundedPreceding, -1), along.rowsBetween(1, Window.unboundedFollowing)
        placed = hours.withColumn("end", F.sum("n").over(along)).withColumns({"start": F.col("end") - F.col("n"), "touched": F.col("newest") == epoch})
        emit = F.col("touched") | (F.col("start") < F.max(F.when(F.col("touched"), F.col("end"))).over(before) + reach)
        placed = placed.withColumn("emit", F.coalesce(emit, F.lit(False)))
        context = F.col("end") > F.min(F.when(F.col("emit"), F.col("start"))).over(after) - reach
        needed = placed.withColumn("needed", F.col("emit") | F.coalesce(context, F.lit(False))).filter("needed").select(
            F.col("seller").alias("_seller"), F.col("hour").alias("_hour"), "emit").persist()
        try:
            days = [r[0] for r in needed.select(F.to_date("_hour")).distinct().limit(RANGES + 1).collect()]
            landed = spark.read.schema(_with(batch.schema, day="date", epoch="integer")).parquet(f"{out}/ticks").filter(F.col("epoch") <= epoch)
            if len(days) <= RANGES:         # prunes partitions; the join decides
                landed = landed.filter(F.col("day").isin(days))
            near = landed.join(needed, (F.col("seller") == F.col("_seller")) & (F.date_trunc("hour", "ts") == F.col("_hour"))).drop("_seller", "_hour", "day", "epoch")
            flags_of_ticks(near).filter("emit").drop("emit").write.mode("overwrite").parquet(epoch_path(f"{out}/flags", epoch))
        finally:
            needed.unpersist()

    flagged = flags_of_ticks(spark.createDataFrame([], ticks.schema))
    flagged.write.mode("overwrite").parquet(epoch_path(f"{out}/flags", -1))
    run_stream(ticks, out, land, first=epoch_path(f"{out}/ticks", 0))
    return out


def newest_flags(spark: SparkSession, out: str) -> DataFrame:
    """Each tick's flag as last emitted."""
    table = spark.read.parquet(f"{out}/flags")
    values = [c for c in table.columns if c not in ("event_id", "seller", "epoch")]
    newest = table.groupBy("seller", "event_id").agg(F.max_by(F.struct(*values), "epoch").alias("v"))
    return newest.select("seller", "event_id", *[f"v.{c}" for c in values])
