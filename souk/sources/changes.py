"""Table changes as pure functions old -> new (SRC-05..17).

Each change returns the new table state as a DataFrame (joins, not row loops); ``write_table``
persists it to a new path, ``versions.VersionedTable`` in place of the old table.
Every change is a set operation over the whole table: the reference's per-row UPDATE loops
and N+1 queries become one join each.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from souk.session import scratch_path


def insert_if_absent(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """SRC-08 + JOIN-03: append rows of ``new`` whose key is not in ``old`` (first per key)."""
    fresh = new.dropDuplicates([key]).join(old.select(key), key, "left_anti")
    return old.unionByName(fresh, allowMissingColumns=True)


def keyed_update(old: DataFrame, updates: DataFrame, keys: Sequence[str], columns: Sequence[str],
                 order: Sequence[str] = ()) -> DataFrame:
    """SRC-09 / SRC-10 + JOIN-09: set ``columns`` from ``updates`` where the key matches (to NULL,
    too); other rows keep their values. A key that holds a NULL matches nothing, as in SQL. Of several updates for one key the last by ``order`` wins
    (without it, or in a tie, the one of the largest values)."""
    value = F.struct(*[F.col(c) for c in columns])
    u = updates.groupBy(*keys).agg(F.max_by(value, F.struct(*[F.col(c) for c in order], *[F.col(c) for c in columns])).alias("_new"))
    j = old.join(u, list(keys), "left")
    return j.withColumns({c: F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)) for c in columns}).drop("_new")


def rewrite_where(df: DataFrame, pred: Column, values: dict[str, Column]) -> DataFrame:
    """SRC-11: ``UPDATE t SET c = v WHERE pred`` as conditional columns."""
    for c, v in values.items():
        df = df.withColumn(c, F.when(pred, v).otherwise(F.col(c)))
    return df


def lookup_ids(rows: DataFrame, names: DataFrame, name: str, out: str) -> DataFrame:
    """JOIN-04: the id of each row's ``name`` in a dictionary of (id, name); rows whose name is not in it
    are left out. A name that stands for several ids is that of the least."""
    ids = names.groupBy(F.col("name").alias("_name")).agg(F.min("id").alias(out))
    return rows.join(ids, F.col(name) == F.col("_name")).drop("_name")


def delete_keys(df: DataFrame, doomed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """SRC-14: delete rows whose key is listed (anti join)."""
    return df.join(doomed.select(*keys).distinct(), list(keys), "left_anti")


def cascade_delete(children: dict[str, tuple[DataFrame, str]], doomed_parent_keys: DataFrame,
                   parent_key: str) -> dict[str, DataFrame]:
    """SRC-15: delete the children of deleted parents (one anti join per child table)."""
    k = doomed_parent_keys.select(F.col(parent_key).alias("_pk")).distinct()
    return {name: child.join(k, child[fk] == k["_pk"], "left_anti") for name, (child, fk) in children.items()}


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """SRC-16: child rows whose parent does not exist."""
    p = parent.select(F.col(parent_key).alias("_pk")).distinct()
    return child.join(p, child[child_key] == p["_pk"], "left_anti")


def with_parent(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """SRC-16 + JOIN-02: child rows whose parent exists (semi join)."""
    p = parent.select(F.col(parent_key).alias("_pk")).distinct()
    return child.join(p, child[child_key] == p["_pk"], "left_semi")


def new_table_path(spark, name: str) -> str:
    """A fresh location under the shared checkpoint folder (never a machine-local dir)."""
    return scratch_path(spark, f"tables/{name}-{uuid.uuid4().hex[:12]}")


def write_table(df: DataFrame, path: str, mode: str = "overwrite", partition_by: Sequence[str] = (),
                fmt: str = "parquet", **options) -> str:
    """SRC-05 / SRC-06 / SRC-07: write (overwrite or append), optionally partitioned."""
    w = df.write.mode(mode).format(fmt)
    for k, v in options.items():
        w = w.option(k, v)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)
    return path
