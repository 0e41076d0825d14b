"""Tables that change in place: versioned folders and a commit file written last.

A version's data is written to a folder of its own; the commit that names it is a small file
created afterwards, never replaced. A reader takes the newest complete commit, so it sees the old
table or the new one, and a write that breaks off changes nothing. Commits carry the state of the
input files a result was made from, which is how stored results are reused (SRC-17).
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from souk.session import scratch_path


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def file_state(spark: SparkSession, *paths: str) -> str:
    """A hash of the files under ``paths`` (name, length, time of change). The listing is a Spark
    job over file metadata; no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths)).select("path", "length", "modificationTime")
    n, mark = files.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64(*files.columns))).first()
    return f"{n}x{(mark or 0) & (1 << 64) - 1:016x}"


def name_of(path: str) -> str:
    """A short name for what is stored about the tables of a folder."""
    return hashlib.sha1(path.encode()).hexdigest()[:12]


class ConcurrentWrite(Exception):
    """Another writer has committed first; this write has changed nothing."""


class VersionedTable:
    """A Parquet table under ``path`` whose content is replaced as a whole (SRC-07)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def commits(self) -> list[dict]:
        """Complete commits, oldest first. One that was broken off while it was written is none."""
        fs, folder = _fs(self.spark, f"{self.path}/_commits")
        if not fs.exists(folder):
            return []
        out = []
        for f in sorted(fs.listStatus(folder), key=lambda f: f.getPath().getName()):
            stream = fs.open(f.getPath())
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            stream.close()
            try:
                out.append(json.loads(text) | {"n": int(f.getPath().getName())})
            except ValueError:
                pass
        return out

    def current(self) -> dict | None:
        return (self.commits() or [None])[-1]

    def read(self) -> DataFrame:
        """The table as last committed; later commits do not change a frame already read."""
        now = self.current()
        if now is None:
            raise FileNotFoundError(f"no committed table in {self.path}")
        schema = StructType.fromJson(json.loads(now["schema"]))
        return self.spark.read.schema(schema).parquet(f"{self.path}/{now['version']}")

    def write_version(self, df: DataFrame, partition_by: Sequence[str] = ()) -> str:
        """Data of a version that nobody sees before it is committed."""
        version = f"v-{uuid.uuid4().hex}"
        writer = df.write.partitionBy(*partition_by) if partition_by else df.write
        writer.parquet(f"{self.path}/{version}")
        return version

    def commit(self, base: int, **facts) -> int:
        """Make commit ``base + 1``; fails if another writer has made it."""
        n = base + 1
        fs, p = _fs(self.spark, f"{self.path}/_commits/{n:020d}")
        try:
            out = fs.create(p, False)
        except Exception as e:  # noqa: BLE001 - py4j wraps FileAlreadyExistsException
            raise ConcurrentWrite(f"commit {n} of {self.path} exists") from e
        out.write(bytearray(json.dumps(facts).encode()))
        out.close()
        return n

    def overwrite(self, df: DataFrame, partition_by: Sequence[str] = (), base: int | None = None, **facts) -> int:
        """Replace the table by ``df`` (which may read the table itself); returns the commit number. Fails
        if anybody has committed since ``base``, which is taken now unless it is given."""
        base = self.base() if base is None else base
        version = self.write_version(df, partition_by)
        return self.commit(base, version=version, schema=df.schema.json(), **facts)

    def base(self) -> int:
        """The newest commit number taken, by complete commits or broken ones."""
        fs, folder = _fs(self.spark, f"{self.path}/_commits")
        return max((int(f.getPath().getName()) for f in fs.listStatus(folder)), default=0) if fs.exists(folder) else 0

    def clean(self, keep: int = 1) -> int:
        """Delete versions other than the last ``keep`` committed ones; returns how many. Run it when
        no writer is active."""
        fs, folder = _fs(self.spark, self.path)
        kept = {c["version"] for c in self.commits()[-keep:]}
        old = [f.getPath() for f in fs.listStatus(folder) if f.getPath().getName().startswith("v-") and f.getPath().getName() not in kept]
        for p in old:
            fs.delete(p, True)
        return len(old)


def reused(spark: SparkSession, name: str, state: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The stored result ``name`` for this state of its inputs, built and written if it is not there. If
    another session commits the same state meanwhile, its result is taken."""
    table = VersionedTable(spark, scratch_path(spark, f"results/{name}"))
    while True:
        base, now = table.base(), table.current()
        if now is not None and now["state"] == state:
            return table.read()
        try:
            table.overwrite(build(), base=base, state=state)
        except ConcurrentWrite:
            continue


class KeyedResults:
    """A stored analysis of a table, by key (SRC-17): reused while the input files are the same, and
    computed again only for the keys whose rows have changed when they are not.

    ``index`` (one row per key: its rows, a mark of their content, the version that holds its result)
    and data (partitioned by version and key) are both written before the commit that names them.
    """

    def __init__(self, spark: SparkSession, path: str, key: str):
        self.spark, self.path, self.key = spark, path, key
        self.table = VersionedTable(spark, path)

    def _index(self, commit: dict) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{commit['version']}")

    def refresh(self, state: str, rows: DataFrame, analyse: Callable[[DataFrame], DataFrame]) -> int:
        """Bring the store up to ``rows``, whose files have ``state``; returns how many keys were
        analysed: none if the state is the stored one. ``analyse`` may be given the rows of some keys
        only and must keep the key column. A key that has gone leaves the index, so it is not read.
        If another session commits meanwhile, what it has stored counts."""
        while True:
            try:
                return self._refresh(state, rows, analyse)
            except ConcurrentWrite:
                continue

    def _refresh(self, state: str, rows: DataFrame, analyse: Callable[[DataFrame], DataFrame]) -> int:
        base, now = self.table.base(), self.table.current()
        if now is not None and now["state"] == state:
            return 0
        key, made = self.key, uuid.uuid4().hex
        marks = rows.groupBy(key).agg(F.count(F.lit(1)).alias("rows"), F.bit_xor(F.xxhash64(*rows.columns)).alias("mark"),
                                      F.sum(F.xxhash64(*rows.columns).cast("decimal(38,0)")).alias("total"))
        if now is None:
            index = marks.withColumn("made", F.lit(made))
        else:
            old = self._index(now).select(F.col(key).alias("_key"), F.struct("rows", "mark", "total").alias("_was"), F.col("made").alias("_made"))
            same = F.col("_was").eqNullSafe(F.struct("rows", "mark", "total"))
            index = (marks.join(old, F.col(key).eqNullSafe(F.col("_key")), "left")
                          .select(*marks.columns, F.when(same, F.col("_made")).otherwise(made).alias("made")))
        version = self.table.write_version(index)
        changed = self._index({"version": version}).where(F.col("made") == made).select(F.col(key).alias("_key"))
        n = changed.count()
        result = analyse(rows.join(changed, F.col(key).eqNullSafe(F.col("_key")), "left_semi"))
        if n:
            result.write.partitionBy(key).parquet(f"{self.path}/data/made={made}")
        self.table.commit(base, version=version, state=state, schema=result.schema.json())
        return n

    def read(self, value=None) -> DataFrame:
        """The result of one key (one partition is read), or of all."""
        now = self.table.current()
        schema = StructType.fromJson(json.loads(now["schema"])).add("made", "string")
        data = self.spark.read.schema(schema).parquet(f"{self.path}/data")
        index = self._index(now).select(F.col(self.key).alias("_key"), F.col("made").alias("_made"))
        if value is None:
            there = F.col(self.key).eqNullSafe(F.col("_key")) & (F.col("made") == F.col("_made"))
            return data.join(index, there, "left_semi").drop("made")
        row = index.where(F.col("_key") == value).first()
        return data.where((F.col("made") == (row["_made"] if row else "")) & (F.col(self.key) == value)).drop("made")
