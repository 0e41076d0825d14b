import os

import pytest
from pyspark.sql import functions as F

from souk.plans.registry import load_all
from souk.sources import views as V
from souk.sources.tables import read
from souk.streaming import streams as S


def split_copy(spark, sf, tmp_path, *tables, n=5):
    """The tables of ``sf`` with ``tables`` as folders of part files, dealt out of time order."""
    os.makedirs(tmp_path, exist_ok=True)
    for name in tables:
        read(spark, sf, name).repartition(n).write.parquet(str(tmp_path / f"{name}.parquet"))
    for name in {"documents", "labels", "part", "events"} - set(tables):
        os.symlink(os.path.join(sf, f"{name}.parquet"), tmp_path / f"{name}.parquet")
    return str(tmp_path)


def test_streams_equal_batch_whatever_the_files(spark, sf, tmp_path):
    d = split_copy(spark, sf, tmp_path, "events", "documents")
    for key in ("str_01_review_ingest", "str_02_daily_ticks", "str_02_tick_flags", "str_02_flags_as_they_change"):
        one, parts = (load_all()[key].build(spark, x) for x in (sf, d))
        assert one.count() == parts.count() > 0
        assert one.exceptAll(parts).count() == 0
    days = load_all()["str_02_daily_ticks"].build(spark, d)
    assert days.agg(F.sum("ticks")).first()[0] == read(spark, sf, "events").count()


def test_stream_resumes(spark, sf, tmp_path):
    """Files that arrive after a stop are added; those already taken are not taken again."""
    d, more = tmp_path / "in" / "events.parquet", read(spark, sf, "events")
    more.where("event_id % 2 = 0").write.parquet(str(d))
    out, ckpt = str(tmp_path / "out"), str(tmp_path / "ckpt")
    for odd in (False, True, False):
        if odd:
            more.where("event_id % 2 = 1").write.mode("append").parquet(str(d))
        S.run_to_table(S.ticks_stream(spark, str(tmp_path / "in")), "ticks", out, ckpt)
    got = spark.read.parquet(out)
    assert got.count() == got.select("event_id").distinct().count() == more.count()


def test_review_ingest_stream_equals_batch(spark, sf):
    got = spark.read.parquet(S.run_review_ingest(spark, sf))
    want = V.reviews(spark, sf)
    assert got.count() == want.count()
    assert got.select("id", "product", "sentiment").exceptAll(want.select("id", "product", "sentiment")).count() == 0


def test_scored_ingest_equals_batch_scores(spark, sf, tmp_path):
    """New reviews get the labels that a batch run of the same saved models gives them."""
    from souk.plans.q_models import saved_sentiment_models
    d, path = split_copy(spark, sf, tmp_path, "documents"), saved_sentiment_models(spark, sf)
    got = spark.read.parquet(S.run_to_table(S.scored_ingest_stream(spark, d, path), "reviews-scored", unique="id"))
    want = load_all()["ml_01_sentiment_scores"].build(spark, sf)
    labels = ["id", "product", "sentiment_bert", "sentiment_roberta", "sentiment_lstm"]
    assert got.count() == want.count() > 0
    assert got.select(labels).exceptAll(want.select(labels)).count() == 0


def test_scored_ingest_takes_small_files_together(spark, sf, tmp_path):
    """Each file was a micro-batch of its own, read by as many tasks as it has row groups."""
    from souk.operators import models as M
    d, path = split_copy(spark, sf, tmp_path / "in", "documents", n=12), M.save_models(M.fixed_sentiment(), str(tmp_path / "models"))
    got = spark.read.parquet(S.run_to_table(S.scored_ingest_stream(spark, d, path), "reviews-scored", unique="id"))
    assert got.agg(F.max("epoch")).first()[0] == 0
    want = load_all()["str_01_fixed_scored_ingest"].build(spark, sf)
    assert got.count() == want.count() > 0 and got.select(want.columns).exceptAll(want).count() == 0
    few = S._file_stream(spark, d, "documents", S.DOC_SCHEMA, bytes_per_trigger=1)      # less than a file: one at a time
    query = S.run_stream(few, str(tmp_path / "out"), S.land_batch(str(tmp_path / "out")))
    assert spark.read.schema(S._with(few.schema, epoch="integer")).parquet(str(tmp_path / "out")).agg(F.max("epoch")).first()[0] == 11, query.recentProgress


def files_in_order(spark, path, frame, column, n, newest_first):
    """``frame`` as n files that a stream takes one by one, by ``column``, newest first or last."""
    cuts = frame.approxQuantile(column, [i / n for i in range(1, n)], 0) if n > 1 else []
    edges = [None, *cuts, None]
    parts = [frame.where((F.col(column) >= a if a is not None else F.lit(True)) & (F.col(column) < b if b is not None else F.lit(True)))
             for a, b in zip(edges, edges[1:], strict=False)]
    for k, part in enumerate(reversed(parts) if newest_first else parts):
        part.coalesce(1).write.mode("append").parquet(path)
        for f in os.listdir(path):
            if f.startswith("part-") and os.stat(os.path.join(path, f)).st_mtime > 2e9 or not f.startswith("part-"):
                continue
            os.utime(os.path.join(path, f), (2_000_000_001 + k, 2_000_000_001 + k))


def test_flags_follow_late_ticks(spark, sf, tmp_path):
    """Newest files first: every file but the first brings ticks older than all landed ones, whose
    flags and those of the ticks after them must end as a batch over all ticks has them."""
    ev = read(spark, sf, "events").withColumn("_t", F.unix_micros(F.col("ts").cast("timestamp")))
    files_in_order(spark, str(tmp_path / "events.parquet"), ev, "_t", 5, newest_first=True)
    out = S.run_tick_flags(S.ticks_stream(spark, str(tmp_path)), str(tmp_path / "out"))
    cols = ["seller", "event_id", "actual_c", "claimed_c", "roll_sum_c", "roll_n", "is_manipulation"]
    got = S.newest_flags(spark, out).select(*cols)
    want = S.flags_of_ticks(S.tick_columns(read(spark, sf, "events"))).select(*cols)
    assert got.count() == want.count() > 0 and got.exceptAll(want).count() == 0
    table = spark.read.parquet(f"{out}/flags")
    again = table.groupBy("event_id").count().where("count > 1").count()
    assert 0 < again < 0.2 * got.count()          # only the flags near a late tick are emitted again
    assert table.agg(F.max("epoch")).first()[0] == 4


def test_a_second_run_keeps_what_has_landed(spark, sf, tmp_path):
    """Another, smaller run into a table adds to it; without the table's checkpoint it is refused."""
    more = read(spark, sf, "events")
    for name, part in (("a", more.where("event_id % 10 > 0")), ("b", more.where("event_id % 10 = 0"))):
        part.write.parquet(str(tmp_path / name / "events.parquet"))
    out = str(tmp_path / "out")
    S.run_to_table(S.ticks_stream(spark, str(tmp_path / "a")), "ticks", out)
    landed = spark.read.parquet(out).count()
    with pytest.raises(ValueError, match="checkpoint"):
        S.run_to_table(S.ticks_stream(spark, str(tmp_path / "b")), "ticks", out, str(tmp_path / "another"))
    assert spark.read.parquet(out).count() == landed == more.where("event_id % 10 > 0").count()
    more.where("event_id % 10 = 0").write.mode("append").parquet(str(tmp_path / "a" / "events.parquet"))
    S.run_to_table(S.ticks_stream(spark, str(tmp_path / "a")), "ticks", out)
    assert spark.read.parquet(out).count() == more.count()


def test_ingest_keeps_no_state_and_lands_each_id_once(spark, sf, tmp_path):
    """Files that repeat ids, of their own and of earlier ones: each lands once, and no operator of the
    stream holds state, however many batches there are."""
    d = split_copy(spark, sf, tmp_path / "in", "documents")
    docs = read(spark, sf, "documents")
    for _ in range(3):
        docs.where("doc_id % 2 = 0").unionByName(docs.where("doc_id % 3 = 0")).repartition(2).write.mode("append").parquet(os.path.join(d, "documents.parquet"))
    stream = S.review_ingest_stream(spark, d)
    out = str(tmp_path / "out")
    spark.createDataFrame([], stream.schema).write.parquet(S.epoch_path(out, -1) + "/id_range=-1")
    query = S.run_stream(stream, out, S.land_new(out, "id"))
    assert len(query.recentProgress) > 8
    assert all(not p["stateOperators"] for p in query.recentProgress)
    got = spark.read.parquet(out)
    assert got.count() == got.select("id").distinct().count() == V.reviews(spark, sf).count()


def test_a_replayed_epoch_lands_the_same_rows(spark, tmp_path):
    out = str(tmp_path / "t")
    batches = [spark.createDataFrame([(i, f"a{i}") for i in (1, 2, 2, 1 << 21, None)], "id long, x string"), spark.createDataFrame([(2, "late"), (3, "c")], "id long, x string")]
    spark.createDataFrame([], "id long, x string").write.parquet(S.epoch_path(out, -1) + "/id_range=-1")
    land = S.land_new(out, "id")
    for epoch in (0, 1, 1, 0):
        land(batches[epoch], epoch)
    assert sorted(tuple(r) for r in spark.read.parquet(out).select("id", "x").collect()) == [(1, "a1"), (2, "a2"), (3, "c"), (1 << 21, f"a{1 << 21}")]
