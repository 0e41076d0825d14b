"""Quality rules as a short-circuit cascade, in DataFrame expressions only.

The base counts are always computed (callers report them). The other rules run in the order
of rejection per cost, both estimated on a bounded sample, inside one CASE that stops at the
first failure. The order changes only the time: a document is kept if it passes every rule.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.llm.shared import SPACE, WORD

SAMPLE_ROWS = 2000
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """A document passes if ``passes`` (SQL over the columns of ``base_counts``) is true."""
    name: str
    passes: str


RULES = (
    Rule("symbols", "n_symbols <= 0.2 * n_words"),
    Rule("repeated_lines", "n_dup_lines <= greatest(2, 0.3 * size(lines))"),
    Rule("word_length", "word_chars BETWEEN 2 * n_words AND 15 * n_words"),
    Rule("letters", "length(regexp_replace(whole, '[^\\\\p{L}]', '')) >= 0.6 * word_chars"),
    Rule("shouting", "length(regexp_replace(whole, '[^\\\\p{Lu}]', '')) <= 0.5 * word_chars"),
    Rule("vocabulary", "size(array_distinct(words)) >= least(0.1 * n_words, 200)"),
    Rule("stutter", "size(filter(words, (w, i) -> i > 0 AND w = get(words, i - 1))) <= 0.2 * n_words"),
)


def _let(value: str, name: str, body: str) -> str:
    """Bind an expression once for several uses in ``body``."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _window_hashes(n: int) -> str:
    parts = ", ".join(["w", *[f"get(words, i + {k})" for k in range(1, n)]])
    return f"transform(slice(words, 1, greatest(size(words) - {n - 1}, 0)), (w, i) -> xxhash64({parts}))"


def _covered(n: int) -> str:
    """Words inside windows (given by their hashes ``grams``) that occur twice or more: sort the
    (hash, place) pairs, keep those equal to a neighbour, add up the union of their spans."""
    twice = ("filter(s, (x, j) -> (j > 0 AND get(s, j - 1).h = x.h) "
             "OR coalesce(get(s, j + 1).h = x.h, false))")
    spans = f"aggregate(transform(p, (q, j) -> CAST(least({n}, coalesce(get(p, j + 1) - q, {n})) AS BIGINT)), 0L, (a, b) -> a + b)"
    found = _let(f"sort_array(transform({twice}, x -> x.i))", "p", spans)
    whole = _let("sort_array(transform(grams, (h, i) -> struct(h AS h, i AS i)))", "s", found)
    return f"CASE WHEN size(array_distinct(grams)) = size(grams) THEN 0L ELSE {whole} END"


def _settled(df: DataFrame) -> DataFrame:
    """The same rows and columns behind a one-row generator, through which the optimizer moves no
    filter: a filter on a computed column must not compute it again, with all that it is made of."""
    return df.select(F.inline(F.array(F.struct("*"))))


def base_counts(docs: DataFrame, window: int = 5) -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed to ``doc``
    (a struct of all columns, so that names cannot clash) and the arrays the rules read.

    Null or empty text: all counts 0, base_failed. Windows are equal if their 64-bit hashes are.
    """
    split = docs.select(F.struct("*").alias("doc"), F.coalesce(F.col("text"), F.lit("")).alias("whole"))
    split = split.select("doc", "whole",
                         F.array_remove(F.split("whole", SPACE), "").alias("words"),
                         F.filter(F.split("whole", "\n"), lambda x: x.rlike(WORD)).alias("lines"))
    counted = _settled(split).select(
        "*", F.size("words").cast("long").alias("n_words"),
        F.length(F.concat_ws("", "words")).cast("long").alias("word_chars"),
        (F.length("whole") - F.length(F.translate("whole", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr(_window_hashes(window)).alias("grams"))
    repeated = _settled(counted).select("*", F.expr(_covered(window)).alias("n_repeat_words")).drop("grams")
    return _settled(repeated).withColumn("base_failed", F.expr("n_words < 10 OR 100 * n_repeat_words > 20 * n_words"))


CLOCK = "java_method('java.lang.System', 'nanoTime')"
PASSES = 2               # each sampled row is timed so often; the least time of a rule counts, so a pause does not


def timed_rules(rows: DataFrame, rules) -> DataFrame:
    """``rows`` with ``t``: nanoseconds of each rule, and ``kept``: whether it passed. One array holds
    clock readings with the rules' values between them (an array's elements are made in order); two
    readings with nothing between them give what a reading costs, which is taken off."""
    between = ", ".join(f"CAST(coalesce({r.passes}, false) AS STRING), {CLOCK}" for r in rules)
    read = _settled(rows.select("row", F.expr(f"array({CLOCK}, {CLOCK}, {between})").alias("seen")))
    at = lambda i: F.get("seen", F.lit(i)).cast("bigint")
    empty = at(1) - at(0)
    return read.select("row", F.array(*[at(2 * i + 3) - at(2 * i + 1) - empty for i in range(len(rules))]).alias("t"),
                       F.array(*[F.get("seen", F.lit(2 * i + 2)) == "true" for i in range(len(rules))]).alias("kept"))


def order_rules(docs: DataFrame, rules=RULES, sample_rows: int = SAMPLE_ROWS) -> list[tuple[Rule, float, float]]:
    """(rule, seconds a row, share rejected) by falling rejection per cost, measured by one job on a
    random sample of about ``sample_rows`` documents. A rule's cost is the time spent inside its
    expression, the least of ``PASSES`` evaluations of a row, so neither scheduling nor warming up is
    in it. Ties keep the given order, and so do an empty sample and rules that reject nothing."""
    rules = list(rules)
    share = min(1.0, sample_rows / max(docs.count(), 1))
    sample = base_counts(docs.sample(share, seed=11)).drop("doc").withColumn("row", F.monotonically_increasing_id())
    again = sample.withColumn("pass", F.explode(F.sequence(F.lit(1), F.lit(PASSES))))
    least = timed_rules(again, rules).groupBy("row").agg(
        *[F.min(F.get("t", F.lit(i))).alias(f"t{i}") for i in range(len(rules))],
        *[F.first(F.get("kept", F.lit(i))).alias(f"k{i}") for i in range(len(rules))])
    got = least.agg(*[F.avg(F.greatest(f"t{i}", F.lit(0))).alias(f"t{i}") for i in range(len(rules))],
                    *[F.avg(F.when(F.col(f"k{i}"), 0.0).otherwise(1.0)).alias(f"k{i}") for i in range(len(rules))]).first()
    measured = [(r, (got[f"t{i}"] or 0.0) / 1e9, got[f"k{i}"] or 0.0) for i, r in enumerate(rules)]
    return sorted(measured, key=lambda m: -m[2] / max(m[1], 1e-9))


def cascade(docs: DataFrame, rules=RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``doc``, the base counts, base_failed, and kept: no base failure and every rule passed.
    A rule that gives null counts as failed."""
    ordered = [m[0] for m in order_rules(docs, rules, sample_rows)]
    verdict = " ".join(f"WHEN NOT coalesce({r.passes}, false) THEN false" for r in ordered)
    return base_counts(docs).withColumn("kept", F.expr(f"CASE WHEN base_failed THEN false {verdict} ELSE true END"))


def rules_report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, the base counts, base_failed and kept. Null, empty and blank texts have
    counts of 0 and fail; repeated rows give repeated results; an empty table gives an empty result.
    Other columns are not read. The dearest count, n_repeat_words, is reported for every document and
    so stands outside the cascade."""
    return cascade(docs.select("doc_id", "text")).select(
        "doc.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


RULES_SQL = r"""
WITH split AS (
    SELECT doc_id, coalesce(text, '') AS whole, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
           list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
    FROM documents),
counted AS (
    SELECT *, CAST(len(words) AS BIGINT) AS n_words,
           CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
           CAST(length(whole) - length(translate(whole, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
           CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines
    FROM split),
grams AS (
    SELECT doc_id, rn, i, list_slice(words, i, i + 4) AS gram
    FROM (SELECT *, row_number() OVER () AS rn FROM counted), unnest(range(1, greatest(n_words - 3, 1))) AS u(i)),
twice AS (SELECT doc_id, rn, i FROM grams QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1),
spans AS (SELECT doc_id, least(5, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 5)) AS n FROM twice),
repeated AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_repeat_words FROM spans GROUP BY doc_id),
base AS (
    SELECT c.*, coalesce(r.n_repeat_words, 0) AS n_repeat_words,
           n_words < 10 OR 100 * coalesce(r.n_repeat_words, 0) > 20 * n_words AS base_failed
    FROM counted c LEFT JOIN repeated r USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND n_symbols <= 0.2 * n_words AND n_dup_lines <= greatest(2, 0.3 * len(lines))
       AND word_chars BETWEEN 2 * n_words AND 15 * n_words
       AND length(regexp_replace(whole, '[^\p{L}]', '', 'g')) >= 0.6 * word_chars
       AND length(regexp_replace(whole, '[^\p{Lu}]', '', 'g')) <= 0.5 * word_chars
       AND len(list_distinct(words)) >= least(0.1 * n_words, 200)
       AND len(list_filter(words, lambda w, i: i > 1 AND w = words[i - 1])) <= 0.2 * n_words AS kept
FROM base"""
