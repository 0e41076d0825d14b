"""Order MinHash fingerprints, in DataFrame expressions only.

A text's k-mers are its runs of ``k`` words, each numbered by its occurrence. Sketch j gives
every numbered k-mer a random value and selects ``length`` minimal ones, one from each of as
many random classes (so a streaming minimum per class selects them), puts them back in text
order and hashes the tuple. Two texts agree in a sketch if they share the selected k-mers and
their order, which is what makes the likeness follow the edit distance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from souk.llm.shared import SPACE, partitions

K, LENGTH, SKETCHES = 2, 2, 64
BLOCK = 16               # sketches drawn in one row; more would make one compiled method too long
PLACE_BITS = 28          # a text holds under 2**28 words; the other 36 bits are hash
HEX = 8                  # digits of a sketch in the fingerprint
LAST = (1 << 63) - 1


def numbered_kmers(text: Column, k: int) -> Column:
    """Sorted array of (hash of the k-mer, place), packed into longs. A text of fewer than k words
    has one k-mer, the whole; one without words has none."""
    words = F.array_remove(F.split(text, SPACE), "")

    def hashes(ws):
        parts = lambda w, i: F.xxhash64(w, *[F.get(ws, i + n) for n in range(1, k)])
        packed = lambda w, i: F.shiftleft(parts(w, i), PLACE_BITS).bitwiseOR(i.cast("long"))
        return F.sort_array(F.transform(F.slice(ws, F.lit(1), F.greatest(F.size(ws) - (k - 1), F.lit(1))), packed))

    return F.element_at(F.transform(F.array(words), hashes), 1)


def sketches(rows: DataFrame, keys: list[str], kmer: str = "kmer", length: int = LENGTH, m: int = SKETCHES) -> DataFrame:
    """Fingerprint per group of ``keys`` from exploded packed k-mers (null: no k-mers)."""
    place = (1 << PLACE_BITS) - 1
    size = min(m, BLOCK)
    blocks = -(-m // size)
    numbered = rows.withColumn("gram", F.shiftright(kmer, PLACE_BITS))
    numbered = numbered.withColumn("occurrence", F.row_number().over(Window.partitionBy(*keys, "gram").orderBy(kmer)))
    numbered = numbered.withColumn("block", F.explode(F.array(*[F.lit(b) for b in range(blocks)])))
    values = [F.when(F.col(kmer).isNotNull(), F.xxhash64("gram", "occurrence", F.col("block") * size + j)).alias(f"h{j}") for j in range(size)]
    drawn = numbered.select(*keys, "block", F.col(kmer).bitwiseAND(F.lit(place)).alias("place"), *values)
    least = [F.min(F.when(F.pmod(F.col(f"h{j}"), F.lit(length)) == c,
                          F.col(f"h{j}").bitwiseAND(F.lit(~place)).bitwiseOR(F.col("place")))).alias(f"m{j}_{c}")
             for j in range(size) for c in range(length)]
    chosen = drawn.groupBy(*keys, "block").agg(*least)
    ordered = [F.sort_array(F.array(*[F.struct(F.col(f"m{j}_{c}").bitwiseAND(F.lit(place)).alias("at"),
                                               F.col(f"m{j}_{c}").bitwiseAND(F.lit(~place)).alias("h")) for c in range(length)]))
               for j in range(size)]
    hexed = [F.right(F.lpad(F.hex(F.xxhash64(F.transform(o, lambda x: F.coalesce(x["h"], F.lit(0))))), 16, "0"), F.lit(HEX)) for o in ordered]
    parts = chosen.select(*keys, "block", F.concat(*hexed).alias("part"))
    whole = parts.groupBy(*keys).agg(*[F.max(F.when(F.col("block") == b, F.col("part"))).alias(f"p{b}") for b in range(blocks)])
    return whole.select(*keys, F.substr(F.concat(*[F.col(f"p{b}") for b in range(blocks)]), F.lit(1), F.lit(HEX * m)).alias("fingerprint"))


def likeness(a: str, b: str, m: int = SKETCHES) -> Column:
    """Share of equal sketches, 0 to 1."""
    return sum(F.when(F.substring(a, 1 + HEX * j, HEX) == F.substring(b, 1 + HEX * j, HEX), 1).otherwise(0)
               for j in range(m)) / float(m)


def with_next(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """Rows (bucket, place, halo, doc_id, whole, next): each text with that of the next document.

    Rows are ordered by doc_id (null last), equal ids by text; the last is followed by the first.
    Ranges of doc_id go to buckets; the first row of each bucket is also sent, as ``halo``, to the
    bucket before it, so every successor is found inside one bucket and no text moves twice.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    buckets = buckets or 4 * n
    base = docs.select("doc_id", F.coalesce("doc_id", F.lit(LAST)).cast("long").alias("key"),
                       F.coalesce("text", F.lit("")).alias("whole"))
    cuts = base.agg(F.percentile_approx("key", [i / buckets for i in range(1, buckets)] or [0.5], 10_000).alias("q")).first()["q"] or []

    def bucket(starts):
        return F.size(F.filter(F.array(*[F.lit(int(x)) for x in starts]).cast("array<bigint>"), lambda x: x <= F.col("key")))

    # The first id really present in each range: one row a bucket.
    starts = sorted(r["first"] for r in base.groupBy(bucket(sorted(set(cuts))).alias("b")).agg(F.min("key").alias("first")).collect())
    at = bucket(starts)
    first = F.col("key") == F.get(F.array(*[F.lit(int(x)) for x in starts]).cast("array<bigint>"), F.col("b") - 1)
    here = F.struct(F.col("b").alias("bucket"), F.lit(False).alias("halo"))
    there = F.struct(F.when(F.col("b") > 1, F.col("b") - 1).otherwise(F.lit(len(starts))).alias("bucket"), F.lit(True).alias("halo"))
    dealt = (base.withColumn("b", at)
                 .withColumn("to", F.explode(F.when(first, F.array(here, there)).otherwise(F.array(here))))
                 .select("to.bucket", "to.halo", "doc_id", "whole")
                 .repartition(2 * n, "bucket"))
    # All columns of the exchange are read by every branch above it, so that it runs only once.
    order = Window.partitionBy("bucket").orderBy("halo", F.col("doc_id").asc_nulls_last(), "whole")
    return dealt.select("bucket", F.row_number().over(order).alias("place"), "halo", "doc_id", "whole",
                        F.lead("whole").over(order).alias("next"))


def fingerprints(docs: DataFrame, k: int = K, length: int = LENGTH, m: int = SKETCHES) -> DataFrame:
    """Per document: its fingerprint and that of its edited text, whose last floor(n/2) code points
    are replaced by the first as many of the next document's text, with their likeness.

    Null text counts as empty; a text without words has the fingerprint of no k-mers. Repeated
    rows give repeated results. Other columns are not read.
    """
    followed = with_next(docs)
    half = F.floor(F.length("whole") / 2).cast("int")
    texts = followed.select(
        "bucket", "place", "halo", "doc_id", "whole", F.length("whole").cast("long").alias("n_chars"),
        F.concat(F.substr("whole", F.lit(1), F.length("whole") - half),
                 F.substr(F.coalesce("next", F.lit("")), F.lit(1), half)).alias("edited"))
    facts = texts.select("bucket", "place", "halo", "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"))
    both = texts.select("bucket", F.explode(F.array(
        F.struct((F.col("place") * 2).alias("id"), numbered_kmers(F.col("whole"), k).alias("kmers")),
        F.struct((F.col("place") * 2 + 1).alias("id"), numbered_kmers(F.col("edited"), k).alias("kmers")))).alias("t"))
    rows = both.select("bucket", "t.id", F.explode_outer("t.kmers").alias("kmer"))
    drawn = sketches(rows, ["bucket", "id"], length=length, m=m)
    own = Window.partitionBy("bucket").orderBy("id")
    drawn = drawn.select("bucket", "id", "fingerprint", F.lead("fingerprint", 1).over(own).alias("edited_fingerprint"),
                         F.lead("fingerprint", 2).over(own).alias("next_fingerprint")).where("id % 2 = 0")
    drawn = drawn.select(F.col("bucket").alias("fb"), F.floor(F.col("id") / 2).cast("int").alias("fp"),
                         "fingerprint", "edited_fingerprint", "next_fingerprint")
    return (facts.where("NOT halo").join(drawn, (F.col("bucket") == F.col("fb")) & (F.col("place") == F.col("fp")))
                 .select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
                         likeness("fingerprint", "edited_fingerprint", m).alias("near_edited"),
                         likeness("fingerprint", "next_fingerprint", m).alias("near_next")))
