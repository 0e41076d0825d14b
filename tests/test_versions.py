"""Versioned tables and stored results: old or new, never a part; reuse and invalidation by key."""

import os

import pytest
from pyspark.sql import functions as F

from souk.session import scratch_path
from souk.sources.versions import ConcurrentWrite, KeyedResults, VersionedTable, file_state, reused


def _rows(df):
    return sorted(map(tuple, df.collect()))


def test_reload_replaces_the_table_and_keeps_readers(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"))
    assert t.current() is None
    with pytest.raises(FileNotFoundError):
        t.read()
    t.overwrite(spark.range(5))
    before = t.read()
    t.overwrite(t.read().filter("id > 2").withColumn("more", F.lit("x")))     # it may read itself, its columns may change
    assert _rows(before) == [(i,) for i in range(5)] and _rows(t.read()) == [(3, "x"), (4, "x")]
    t.overwrite(t.read().limit(0))
    assert t.read().columns == ["id", "more"] and _rows(t.read()) == []
    assert t.clean() == 2 and _rows(t.read()) == []


def test_a_broken_write_changes_nothing(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"))
    t.overwrite(spark.range(100))
    broken = spark.range(100).repartition(4).withColumn("x", F.when(F.col("id") == 77, F.raise_error(F.lit("lost"))).otherwise(F.col("id")))
    with pytest.raises(Exception, match="lost"):
        t.overwrite(broken)
    assert _rows(t.read()) == [(i,) for i in range(100)]
    t.write_version(spark.range(3))                                   # the data is there, its commit is not
    assert t.read().count() == 100
    with open(os.path.join(t.path, "_commits", f"{2:020d}"), "w") as f:
        f.write('{"version": "v-')                                    # a commit broken off while it was written
    assert t.read().count() == 100
    t.overwrite(spark.range(7))
    assert t.read().count() == 7 and t.current()["n"] == 3


def test_of_two_writers_one_wins(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"))
    t.overwrite(spark.range(1))
    base = t.base()
    mine, theirs = t.write_version(spark.range(2)), t.write_version(spark.range(3))
    schema = spark.range(1).schema.json()
    t.commit(base, version=theirs, schema=schema)
    with pytest.raises(ConcurrentWrite):
        t.commit(base, version=mine, schema=schema)
    assert t.read().count() == 3


def test_results_are_reused_while_the_files_are_the_same(spark, tmp_path):
    built = []

    def build():
        built.append(1)
        return spark.read.parquet(path).groupBy((F.col("id") % 3).alias("k")).count()

    path = str(tmp_path / "in")
    spark.range(30).write.parquet(path)
    name = f"test-{os.path.basename(tmp_path)}-{os.getpid()}"
    for _ in range(2):
        assert _rows(reused(spark, name, file_state(spark, path), build)) == [(0, 10), (1, 10), (2, 10)]
    assert len(built) == 1
    spark.range(3).write.mode("append").parquet(path)
    assert _rows(reused(spark, name, file_state(spark, path), build)) == [(0, 11), (1, 11), (2, 11)]
    assert len(built) == 2


def test_two_sessions_that_build_one_result_end_with_one(spark, tmp_path):
    name = f"race-{os.path.basename(tmp_path)}-{os.getpid()}"

    def build():
        if len(built) < 1:
            built.append(1)
            reused(spark, name, "s", build)          # the other session is quicker
        return spark.range(4)

    built = []
    assert reused(spark, name, "s", build).count() == 4
    table = VersionedTable(spark, scratch_path(spark, f"results/{name}"))
    assert [c["n"] for c in table.commits()] == [1]


def _partitions_read(df):
    """Partitions that the scan will read, after pruning."""
    return df._jdf.queryExecution().sparkPlan().collectLeaves().apply(0).selectedPartitions().partitionCount()


def test_keyed_results_follow_the_rows_of_each_key(spark, tmp_path):
    path, analysed = str(tmp_path / "in"), []

    def frame():
        return spark.read.schema("k string, v long").parquet(path)

    def analyse(rows):
        out = rows.groupBy("k").agg(F.sum("v").alias("s"))
        analysed.append(out.count())
        return out

    store = KeyedResults(spark, str(tmp_path / "store"), "k")
    rows = spark.range(40).select(F.concat(F.lit("k"), F.col("id") % 4).alias("k"), F.col("id").alias("v"))
    rows.unionByName(spark.createDataFrame([(None, 5)], "k string, v long")).write.parquet(path)
    assert store.refresh(file_state(spark, path), frame(), analyse) == 5
    first = _rows(store.read("k1"))
    files = sorted(os.path.join(d, f) for d, _, fs in os.walk(store.path) for f in fs)
    assert store.refresh(file_state(spark, path), frame(), analyse) == 0 and analysed == [5]
    assert files == sorted(os.path.join(d, f) for d, _, fs in os.walk(store.path) for f in fs)        # nothing was written
    assert _partitions_read(store.read("k1")) == 1

    spark.createDataFrame([("k2", 1000), ("new", 1)], "k string, v long").write.mode("append").parquet(path)
    assert store.refresh(file_state(spark, path), frame(), analyse) == 2 and analysed == [5, 2]
    want = frame().groupBy("k").agg(F.sum("v").alias("s"))
    assert {tuple(r) for r in store.read().select("k", "s").collect()} == {tuple(r) for r in want.collect()}
    assert _rows(store.read("k1")) == first and _partitions_read(store.read("k2")) == 1
    assert _rows(store.read("none of these")) == []

    kept = frame().where("k <> 'k3' OR k IS NULL").collect()
    spark.createDataFrame(kept, "k string, v long").write.mode("overwrite").parquet(path)              # a key goes
    assert store.refresh(file_state(spark, path), frame(), analyse) == 0
    assert "k3" not in {r.k for r in store.read().collect()}
