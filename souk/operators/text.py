"""Text jobs (ML-07, ML-08, ML-10, ML-11, ML-12, AGG-22).

Language detection is stop-word voting as a row expression over the whole text: no shuffle, no
join, checkable in SQL.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from souk.functions.exprs import label_of_rating, rlike_ci
from souk.operators.reviews import WORD_SPLIT

# Frequent function words per language; a word listed for two languages is
# left out of both. Ties between languages resolve in the order of this table.
STOP_WORDS = {
    "en": ("the", "of", "and", "to", "is", "that", "it", "for", "was", "on", "with", "this", "are", "from"),
    "de": ("der", "die", "und", "den", "von", "zu", "das", "mit", "sich", "auf", "für", "ist", "nicht", "dem"),
    "fr": ("le", "et", "les", "des", "du", "une", "pour", "est", "qui", "par", "dans", "sur", "pas", "avec"),
    "es": ("el", "y", "los", "del", "las", "por", "con", "su", "una", "para", "al", "lo", "se", "no"),
}
LANG_ORDER = tuple(STOP_WORDS)
SAMPLE_SEED = 42


def with_language(df: DataFrame, text_col: str) -> DataFrame:
    """ML-11: add ``detected``, the language whose stop words are most in the text; NULL when none
    occurs. The stop words of a text are filtered once, then counted by language."""
    every = [w for ws in STOP_WORDS.values() for w in ws]

    def hits(words):
        return F.size(F.filter("_stops", lambda t: t.isin(*words))).alias("hits")

    found = df.withColumn("_stops", F.filter(F.split(F.lower(F.col(text_col)), WORD_SPLIT), lambda t: t.isin(every)))
    votes = [F.struct(hits(ws), F.lit(-i).alias("prio"), F.lit(lang).alias("lang"))
             for i, (lang, ws) in enumerate(STOP_WORDS.items())]
    found = found.withColumn("_best", F.greatest(*votes))
    return found.withColumn("detected", F.when(F.col("_best.hits") > 0, F.col("_best.lang"))).drop("_stops", "_best")


def detect_language(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """ML-11: (id, detected) for every document."""
    return with_language(docs.select(id_col, text_col), text_col).select(id_col, "detected")


def drop_non_english(reviews: DataFrame, min_len: int = 3) -> DataFrame:
    """ML-11 'delete' policy + SRC-14: delete reviews detected as another language; short
    texts and undetectable ones are kept."""
    long_enough = F.length(F.regexp_replace("review_text", r"^\s+|\s+$", "")) >= min_len
    doomed = F.coalesce(long_enough & (F.col("detected") != "en"), F.lit(False))
    return with_language(reviews, "review_text").filter(~doomed).drop("detected")


def confusion(truth_pred: DataFrame, truth: str, pred: str) -> DataFrame:
    return truth_pred.groupBy(F.col(truth).alias("truth"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def accuracy_f1(truth_pred: DataFrame, truth: str, pred: str) -> DataFrame:
    """AGG-22: accuracy and support-weighted F1 (one row)."""
    return metrics(confusion(truth_pred, truth, pred))


def evaluate(rows: DataFrame, truth: str, preds: dict[str, Column]) -> DataFrame:
    """ML-05 + AGG-22: accuracy and weighted F1 of several predictions of one truth, from one pass over
    the rows: counts by (model, truth, prediction), then metrics of those few counts."""
    named = F.explode(F.array(*[F.struct(F.lit(k).alias("model"), c.alias("pred")) for k, c in preds.items()])).alias("_p")
    counts = (rows.select(F.col(truth).alias("truth"), named).groupBy("_p.model", "truth", "_p.pred").agg(F.count(F.lit(1)).alias("n")))
    return metrics(counts, ["model"])


def metrics(counts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Accuracy and support-weighted F1 of confusion counts (truth, pred, n), for each of ``keys``."""
    # Each cell of the confusion table counts once for its true and once for its predicted class.
    right, n = F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0).alias("tp"), F.col("n")
    cell = F.array(F.struct(F.col("truth").alias("cls"), n.alias("support"), right, F.lit(0).cast("bigint").alias("predicted")),
                   F.struct(F.col("pred").alias("cls"), F.lit(0).cast("bigint").alias("support"), F.lit(0).cast("bigint").alias("tp"), n.alias("predicted")))
    per = (counts.select(*keys, F.inline(cell)).groupBy(*keys, "cls")
           .agg(F.sum("support").alias("support"), F.sum("tp").alias("tp"), F.sum("predicted").alias("predicted")))
    p = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("predicted")), F.lit(0.0))
    r = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("support")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
    per = per.withColumn("f1", f1)
    total = F.sum("support")
    out = per.groupBy(*keys).agg((F.sum("tp") / total).alias("accuracy"), (F.sum(F.col("f1") * F.col("support")) / total).alias("weighted_f1"),
                  total.alias("rows"))
    return out.select(*keys, F.round(F.col("accuracy"), 6).alias("accuracy"), F.round(F.col("weighted_f1"), 6).alias("weighted_f1"), "rows")


def sample_key(id_col: str, seed: int = SAMPLE_SEED):
    return F.md5(F.concat(F.col(id_col).cast("string"), F.lit(str(seed))))


def deterministic_sample(df: DataFrame, id_col: str, n: int, seed: int = SAMPLE_SEED) -> DataFrame:
    """ML-07: ``n = min(N, len)`` rows in a seeded pseudo-random order; the same rows on any
    partitioning (partial top-n per task, then a final top-n)."""
    return df.orderBy(sample_key(id_col, seed), F.col(id_col)).limit(n)


def hash_bucket(id_col: str, seed: int = SAMPLE_SEED, buckets: int = 100):
    """Stable bucket 0..buckets-1 from the id (first 32 bits of md5)."""
    return F.pmod(F.conv(F.substring(sample_key(id_col, seed), 1, 8), 16, 10).cast("bigint"), F.lit(buckets))


def split(df: DataFrame, id_col: str, train_pct: int = 80, seed: int = SAMPLE_SEED) -> DataFrame:
    """ML-08: train/test assignment by hash bucket - stable under repartitioning and
    recomputation, unlike ``randomSplit``."""
    return df.withColumn("split", F.when(hash_bucket(id_col, seed) < train_pct, F.lit("train")).otherwise(F.lit("test")))


def word_tokens(text):
    return F.filter(F.split(text, r"\s+"), lambda t: t != "")


def truncate_tokens(df: DataFrame, text_col: str, max_tokens: int = 128) -> DataFrame:
    """ML-12: every text as consecutive pieces of up to ``max_tokens`` word tokens (one row each, ``part``
    from 0); the first is the truncated text. A text without words has one empty piece."""
    cut = df.withColumn("_toks", word_tokens(F.coalesce(F.col(text_col), F.lit("")))).withColumn("n_tokens", F.size("_toks"))
    last = F.floor(F.greatest(F.col("n_tokens") - 1, F.lit(0)) / max_tokens).cast("int")
    return (cut.withColumn("part", F.explode(F.sequence(F.lit(0), last)))
               .withColumn("truncated", F.array_join(F.slice("_toks", F.col("part") * max_tokens + 1, max_tokens), " ")).drop("_toks"))


def training_set(reviews: DataFrame, brand_pattern: str, id_col: str = "id", language: DataFrame | None = None) -> DataFrame:
    """ML-10: rated reviews with text, brand filter, English only ('keep' policy of ML-11),
    label 0/1/2. If no English review is left, the brand-filtered rows are used instead.
    ``language`` (id, detected) is what ``detect_language`` has found, where it is stored; the flag
    then costs a look at that small table instead of a second detection over the texts."""
    base = (reviews.dropna(subset=["review_text", "review_rating"])
                   .filter(rlike_ci("product", brand_pattern)))
    found = with_language(base, "review_text") if language is None else base.join(language.select(F.col(language.columns[0]).alias(id_col), "detected"), id_col, "left")
    tagged = found.withColumn("_en", F.coalesce(F.col("detected") == "en", F.lit(False)))
    any_en = tagged.agg(F.bool_or("_en").alias("_any")).scalar()
    kept = tagged.withColumn("_any", any_en).filter(F.col("_en") | ~F.coalesce(F.col("_any"), F.lit(False)))
    return kept.select(id_col, F.col("review_text").alias("text"), label_of_rating("review_rating").alias("label"))


def name_of_label_col(c: str):
    """Class id -> sentiment name (NULL stays NULL)."""
    from souk.functions.exprs import name_of_label
    return F.when(F.col(c).isNotNull(), name_of_label(c))
