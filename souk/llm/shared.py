"""Helpers that several text operators share: scratch tables, shipped files, word splitting.

Intermediate tables are Parquet in the shared folder of ``spark.checkpoint.dir`` (never a
machine-local folder on a cluster), so a lost executor costs a re-read and nothing else.
They stay until ``clean_scratch`` is called, because lazily evaluated results read them.
"""

from __future__ import annotations

import json
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from souk.session import scratch_path

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
SLICE_BYTES = 4 << 20


def scratch(spark: SparkSession, name: str) -> str:
    return scratch_path(spark, f"llm/{name}-{uuid.uuid4().hex}")


def store(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, fixes the rows."""
    path = scratch(df.sparkSession, name)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clean_scratch(spark: SparkSession) -> None:
    """Delete every intermediate table and shipped file. Call once results are written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_path(spark, "llm"))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ship(spark: SparkSession, name: str, payload: bytes) -> str:
    """Write a bounded model file to the shared folder and register it with Spark, which copies
    it to each executor (also to ones that join later). Returns the name for ``shipped``."""
    name = f"{name}-{uuid.uuid4().hex}"
    target = scratch_path(spark, f"llm/{name}")
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
    for at in range(0, len(payload), 1 << 20):
        out.write(bytearray(payload[at:at + (1 << 20)]))
    out.close()
    spark.sparkContext.addFile(target)
    return name


def shipped(name: str) -> str:
    """Path of a shipped file on this executor."""
    return SparkFiles.get(name)


def crc_mod(key: str, n: int) -> Column:
    """crc32 of the key as text, modulo ``n``; a null key counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % n


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES):
    """Cut a batch into runs of rows of about ``limit`` text bytes (one row at least)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    total, start = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(n)
    if len(sizes) > start:
        yield batch.slice(start)


def words(column: pa.Array, lower: bool = True):
    """Words (runs of other than ASCII white space) of each text as codes into the distinct ones.

    Returns (codes, bounds, distinct): the words of row i are ``codes[bounds[i]:bounds[i+1]]``.
    A null text has no words; ``lower`` changes A-Z only.
    """
    column = pc.fill_null(column, "")
    parts = pc.ascii_split_whitespace(pc.ascii_lower(column) if lower else column)
    bounds = parts.offsets.to_numpy().astype(np.int64)
    bounds -= bounds[0]
    coded = parts.flatten().dictionary_encode()
    codes, distinct = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
    none = distinct.index("").as_py()
    if none >= 0:
        keep = codes != none
        bounds = np.concatenate(([0], np.cumsum(keep)))[bounds]
        codes = codes[keep]
    return codes, bounds, distinct




def pack_arrays(arrays: dict[str, np.ndarray]) -> bytes:
    """One file image of named arrays, 64-byte aligned, for ``map_arrays``."""
    head, at, parts = [], 0, []
    for name, a in arrays.items():
        a = np.ascontiguousarray(a)
        head.append([name, a.dtype.str, list(a.shape), at])
        raw = a.tobytes()
        parts.append(raw + bytes(-len(raw) % 64))
        at += len(parts[-1])
    top = json.dumps(head).encode()
    return len(top).to_bytes(8, "little") + top + bytes(-(len(top) + 8) % 64) + b"".join(parts)


def map_arrays(path: str) -> dict[str, np.ndarray]:
    """Memory-map the arrays of ``pack_arrays``: pages are read as they are touched."""
    return read_arrays(np.memmap(path, np.uint8, "r"))


def read_arrays(raw: np.ndarray) -> dict[str, np.ndarray]:
    """The arrays of a file image, as views of its bytes."""
    size = int.from_bytes(raw[:8].tobytes(), "little")
    head = json.loads(raw[8:8 + size].tobytes())
    base = 8 + size + -(size + 8) % 64
    out = {}
    for name, dtype, shape, at in head:
        n = int(np.prod(shape)) * np.dtype(dtype).itemsize
        out[name] = raw[base + at:base + at + n].view(dtype).reshape(shape)
    return out


def gather(starts: np.ndarray, sizes: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Concatenate ``values[s:s+n]`` for all (s, n)."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.repeat(starts - (ends - sizes), sizes) + np.arange(total)]
