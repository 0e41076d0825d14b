"""Text-job queries over documents / reviews."""

from __future__ import annotations

from pyspark.sql import functions as F

from souk.operators import text as T
from souk.plans.registry import register
from souk.sources import views as V
from souk.sources.tables import read, table_path
from souk.sources.versions import file_state, name_of, reused

STOPS_SQL = "SELECT * FROM (VALUES " + ", ".join(
    f"('{w}', '{lang}', {i})" for i, (lang, ws) in enumerate(T.STOP_WORDS.items()) for w in ws) + ") sw(word, lang, prio)"
DETECT_SQL = r"""
    SELECT d.doc_id, b.detected FROM documents d LEFT JOIN (
      SELECT doc_id, arg_max(lang, (hits, -prio)) AS detected FROM (
        SELECT t.doc_id, sw.lang, sw.prio, count(*) AS hits
        FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\p{L}]+')) AS word FROM documents) t
        JOIN sw ON t.word = sw.word GROUP BY 1, 2, 3)
      GROUP BY doc_id) b ON d.doc_id = b.doc_id"""
DETECT_CTES = {"sw": STOPS_SQL, "det": DETECT_SQL}
BRAND_PATTERN = r"brand#(1|2)$"


def _detected(spark, sf_dir):
    return T.with_language(read(spark, sf_dir, "documents", "doc_id", "text", "lang"), "text").select("doc_id", "detected", "lang")


@register("ml_11_language_detect", V.with_views("""
    SELECT d.doc_id, det.detected, d.lang FROM documents d JOIN det USING (doc_id)""", extra=DETECT_CTES))
def ml_11_language_detect(spark, sf_dir):
    """ML-11: stop-word language detection over whole texts (NULL = undetectable)."""
    return _detected(spark, sf_dir)


@register("agg_22_accuracy_f1", V.with_views("""
    SELECT round(CAST(sum(tp) AS DOUBLE) / sum(support), 6) AS accuracy,
           round(sum(f1 * support) / sum(support), 6) AS weighted_f1, CAST(sum(support) AS BIGINT) AS rows
    FROM (
      SELECT s.cls, s.support, COALESCE(t.tp, 0) AS tp, COALESCE(p.predicted, 0) AS predicted,
             COALESCE(2 * pr * rc / NULLIF(pr + rc, 0), 0.0) AS f1
      FROM (SELECT truth AS cls, sum(n) AS support FROM c GROUP BY truth) s
      LEFT JOIN (SELECT truth AS cls, sum(n) AS tp FROM c WHERE truth IS NOT DISTINCT FROM pred GROUP BY truth) t USING (cls)
      LEFT JOIN (SELECT pred AS cls, sum(n) AS predicted FROM c GROUP BY pred) p USING (cls),
      LATERAL (SELECT COALESCE(CAST(COALESCE(t.tp, 0) AS DOUBLE) / NULLIF(p.predicted, 0), 0.0) AS pr,
                      COALESCE(CAST(COALESCE(t.tp, 0) AS DOUBLE) / NULLIF(s.support, 0), 0.0) AS rc))""",
    extra=dict(DETECT_CTES, c="SELECT d.lang AS truth, det.detected AS pred, count(*) AS n FROM documents d JOIN det USING (doc_id) GROUP BY 1, 2")))
def agg_22_accuracy_f1(spark, sf_dir):
    """AGG-22: accuracy and weighted F1 of the language detector against documents.lang."""
    return T.accuracy_f1(_detected(spark, sf_dir), "lang", "detected")


@register("src_14_delete_non_english", V.with_views(r"""
    SELECT r.id, r.product, r.lang FROM reviews r JOIN det ON r.id = det.doc_id
    WHERE NOT (length(regexp_replace(r.review_text, '^\s+|\s+$', '', 'g')) >= 3 AND det.detected IS NOT NULL
               AND det.detected <> 'en')""", "reviews", extra=DETECT_CTES))
def src_14_delete_non_english(spark, sf_dir):
    """SRC-14 + ML-11 (delete policy): drop reviews detected as non-English."""
    return T.drop_non_english(V.reviews(spark, sf_dir)).select("id", "product", "lang")


@register("ml_07_sample", V.with_views("""
    SELECT id, product, review_rating FROM reviews ORDER BY md5(CAST(id AS VARCHAR) || '42'), id LIMIT 100""", "reviews"))
def ml_07_sample(spark, sf_dir):
    """ML-07: deterministic seeded sample of min(100, rows) reviews."""
    r = V.reviews(spark, sf_dir, with_text=False)
    return T.deterministic_sample(r, "id", 100).select("id", "product", "review_rating")


@register("ml_08_split", V.with_views("""
    SELECT id, CASE WHEN CAST('0x' || substr(md5(CAST(id AS VARCHAR) || '42'), 1, 8) AS BIGINT) % 100 < 80
                    THEN 'train' ELSE 'test' END AS split
    FROM reviews""", "reviews"))
def ml_08_split(spark, sf_dir):
    """ML-08: 80/20 train/test split by hash bucket of the id."""
    return T.split(V.reviews(spark, sf_dir, with_text=False), "id", 80).select("id", "split")


@register("ml_12_truncate", V.with_views(r"""
    SELECT doc_id, CAST(len(toks) AS INTEGER) AS n_tokens, CAST(part AS INTEGER) AS part,
           array_to_string(toks[part * 128 + 1:part * 128 + 128], ' ') AS truncated
    FROM (SELECT doc_id, toks, unnest(range(0, greatest(len(toks) - 1, 0) // 128 + 1)) AS part
          FROM (SELECT doc_id, list_filter(regexp_split_to_array(COALESCE(text, ''), '\s+'), lambda t: t <> '') AS toks FROM documents))"""))
def ml_12_truncate(spark, sf_dir):
    """ML-12: every text in pieces of 128 word tokens."""
    d = read(spark, sf_dir, "documents", "doc_id", "text")
    return T.truncate_tokens(d, "text", 128).select("doc_id", "n_tokens", "part", "truncated")


@register("ml_10_training_set", V.with_views(f"""
    SELECT id, text, label FROM (
      SELECT r.id, r.review_text AS text,
             CASE WHEN review_rating <= 2 THEN 0 WHEN review_rating = 3 THEN 1 ELSE 2 END AS label,
             COALESCE(det.detected = 'en', false) AS en
      FROM reviews r LEFT JOIN det ON r.id = det.doc_id
      WHERE r.review_text IS NOT NULL AND r.review_rating IS NOT NULL
        AND COALESCE(regexp_matches(r.product, '(?i){BRAND_PATTERN}'), false))
    WHERE en OR NOT (SELECT COALESCE(bool_or(COALESCE(det.detected = 'en', false)), false)
                     FROM reviews r LEFT JOIN det ON r.id = det.doc_id
                     WHERE r.review_text IS NOT NULL AND r.review_rating IS NOT NULL
                       AND COALESCE(regexp_matches(r.product, '(?i){BRAND_PATTERN}'), false))""",
    "reviews", extra=DETECT_CTES))
def ml_10_training_set(spark, sf_dir):
    """ML-10 + FN-04: the sentiment training set (brand filter, English only, 0/1/2 labels)."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    state = file_state(spark, table_path(sf_dir, "documents"))
    language = reused(spark, f"language-{name_of(sf_dir)}", state, lambda: T.detect_language(docs, "doc_id", "text"))
    return T.training_set(V.reviews(spark, sf_dir), BRAND_PATTERN, language=language)


@register("fn_05_label_names", V.with_views("""
    SELECT name, count(*) AS reviews FROM (
      SELECT CASE CASE WHEN review_rating <= 2 THEN 0 WHEN review_rating = 3 THEN 1 WHEN review_rating > 3 THEN 2 END
                  WHEN 0 THEN 'Negative' WHEN 1 THEN 'Neutral' ELSE 'Positive' END AS name
      FROM reviews) GROUP BY name""", "reviews"))
def fn_05_label_names(spark, sf_dir):
    """FN-04 + FN-05: rating -> class id -> name, unknown ids default to Positive."""
    from souk.functions.exprs import label_of_rating, name_of_label
    r = V.reviews(spark, sf_dir, with_text=False)
    return r.groupBy(name_of_label(label_of_rating("review_rating")).alias("name")).agg(F.count(F.lit(1)).alias("reviews"))
