"""Mixing sources to target weights: repetition rates per source, hash-seeded copies per document."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.llm.shared import WORD, partitions, store

SEED = "mix-1"


def source_targets(sized: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """One row per source: (source, source_size, target).

    Sources are numbered by code point (null last) through a range partitioning with offsets, so
    no task sees all of them. Targets fill by weight up to ``cap`` times the source's size; each
    round is one aggregate whose few sums go to the driver, until no further source is full.
    """
    spark = sized.sparkSession
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranged = store(totals.repartitionByRange(min(32, partitions(spark)), F.col("source").asc_nulls_last())
                         .sortWithinPartitions(F.col("source").asc_nulls_last())
                         .withColumn("part", F.spark_partition_id())
                         .withColumn("at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "sources")
    counts = {r["part"]: r["n"] for r in ranged.groupBy("part").agg(F.count("*").alias("n")).collect()}
    first, before = {}, 0
    for part in sorted(counts):
        first[part], before = before, before + counts[part]
    if not first:
        return ranged.select("source", "source_size", F.lit(0.0).alias("target"))
    start = F.create_map(*[F.lit(x) for kv in first.items() for x in kv])
    turn = F.pmod(start[F.col("part")] + F.col("at"), F.lit(len(weights))).cast("int")
    table = ranged.select("source", "source_size",
                          F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1).alias("weight"),
                          (F.lit(float(cap)) * F.col("source_size")).alias("most"))
    everything = table.agg((F.lit(float(share)) * F.sum("source_size")).alias("words")).first()["words"]
    level, full = 0.0, -1
    while True:
        over = F.col("most") < F.col("weight") * F.lit(level)
        row = table.agg(F.sum(F.when(over, F.col("most")).otherwise(0.0)).alias("held"),
                        F.sum(F.when(over, 0.0).otherwise(F.col("weight"))).alias("open"),
                        F.count(F.when(over, 1)).alias("full")).first()
        if row["full"] == full or not row["open"]:
            break
        full, level = row["full"], (everything - row["held"]) / row["open"]
    return table.select("source", "source_size", F.least("most", F.col("weight") * F.lit(level)).alias("target"))


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0,
        seed: str = SEED) -> DataFrame:
    """Per document: ``doc`` (all its columns), size, source_size, target, copies, taken.

    A document's size is its number of words. ``copies`` is floor(rate) plus one more with the
    probability of the rate's fraction, decided by a hash of ``seed`` and doc_id, so reruns agree
    and repeated rows of one doc_id fare alike. Null text: size 0. Null source: a source of its
    own, last. Null doc_id: hashed as the empty text. A source without words: target 0, no copies.
    Columns of ``docs`` keep their names inside ``doc`` whatever they are called.
    """
    sized = docs.select(F.struct("*").alias("doc"), F.col("source").alias("source"),
                        F.col("doc_id").cast("string").alias("key"),
                        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    targets = source_targets(sized, weights, share, cap).withColumnRenamed("source", "of_source")
    joined = sized.join(targets, F.col("source").eqNullSafe(F.col("of_source")), "left")
    rate = F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))
    drawn = F.md5(F.concat(F.lit(seed + ":"), F.coalesce("key", F.lit(""))).cast("binary"))
    draw = F.conv(F.substring(drawn, 1, 8), 16, 10).cast("double") / float(1 << 32)
    copies = F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)
    return (joined.withColumn("copies", copies.cast("int"))
                  .select("doc", "size", "source_size", "target", "copies",
                          (F.col("copies") * F.col("size")).cast("long").alias("taken")))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document as often as ``mix`` decides, with the columns of ``docs``."""
    return (mix(docs, **options).select(F.explode(F.array_repeat("doc", F.col("copies"))).alias("doc"))
            .select("doc.*"))


def mix_report(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken for every document. A null text has size 0, null is a
    source of its own, repeated rows are drawn alike, an empty table gives an empty one."""
    return mix(docs.select("doc_id", "text", "source")).select(
        "doc.doc_id", "size", "source_size", "target", "taken")


MIX_SQL = r"""
WITH sized AS (
    SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
    FROM documents),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighted AS (
    SELECT source, source_size, 2.0::DOUBLE * source_size AS most,
           [3.0, 1.0, 2.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)]::DOUBLE AS weight
    FROM totals),
filled AS (
    SELECT *, coalesce(sum(most) OVER before, 0) AS held, (SELECT sum(weight) FROM weighted) - coalesce(sum(weight) OVER before, 0) AS open
    FROM weighted WINDOW before AS (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (
    SELECT max(lv) AS lv FROM (
        SELECT (1.5::DOUBLE * (SELECT sum(source_size) FROM totals) - held) / open AS lv, most / weight AS ratio FROM filled)
    WHERE ratio >= lv),
targets AS (SELECT source, source_size, least(most, weight * (SELECT lv FROM level)) AS target FROM weighted),
drawn AS (
    SELECT s.doc_id, s.size, t.source_size, t.target,
           CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
           CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(s.doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS draw
    FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST((floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM drawn"""
