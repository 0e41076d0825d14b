"""Model queries: weak labels and sentences are SQL-checked, and so is what models of given weights score,
update and measure; fitted models take the same path and are checked on rows and by the tests (planted
outliers, F1 against a majority baseline, truth that the model never saw)."""

from __future__ import annotations

from pyspark.sql import functions as F

from souk.functions.exprs import argmax, money_text, round_half_even, softmax
from souk.operators import models as M
from souk.operators import prices as P
from souk.operators import text as T
from souk.operators.reviews import with_model_columns
from souk.plans.q_prices import ROLL7, SCORED_CTES, TIE_SQL
from souk.plans.registry import register
from souk.session import scratch_path
from souk.sources import changes as C
from souk.sources import views as V
from souk.sources.tables import read, table_path
from souk.sources.versions import file_state, name_of, reused

WEAK_SQL = """CASE WHEN claimed_c * 10 * roll_n >= roll_sum_c * 13 AND claimed_c * 10 * roll_n <= roll_sum_c * 20
                        AND abs(actual_c * roll_n - roll_sum_c) * 50 <= roll_sum_c THEN 1
                   WHEN actual_c * 10 * roll_n >= roll_sum_c * 5 AND actual_c * 10 * roll_n <= roll_sum_c * 8
                        AND claimed_c >= actual_c THEN 0
                   WHEN claimed_c = actual_c AND abs(actual_c * roll_n - roll_sum_c) * 50 <= roll_sum_c THEN 0 END"""


@register("ml_09_weak_labels", V.with_views(f"""
    SELECT product, seller, count(*) FILTER (WHERE wl = 1) AS fake, count(*) FILTER (WHERE wl = 0) AS genuine,
           count(*) FILTER (WHERE wl IS NULL) AS unlabelled
    FROM (SELECT *, {WEAK_SQL} AS wl FROM r) GROUP BY product, seller""", "prices", extra={"r": ROLL7}))
def ml_09_weak_labels(spark, sf_dir):
    """ML-09: weak fake/genuine labels from price ratios to the rolling mean."""
    s = P.with_rolling_mean(V.prices(spark, sf_dir), cuts=P.price_cuts(spark, sf_dir)).withColumn("wl", M.weak_label())
    return s.groupBy("product", "seller").agg(
        F.count_if(F.col("wl") == 1).alias("fake"), F.count_if(F.col("wl") == 0).alias("genuine"),
        F.count_if(F.col("wl").isNull()).alias("unlabelled"))


def _money_sql(c):
    return f"CAST(({c}) // 100 AS VARCHAR) || '.' || lpad(CAST(({c}) % 100 AS VARCHAR), 2, '0')"


@register("fn_20_price_sentences", V.with_views(f"""
    SELECT product, seller, {TIE_SQL},
           'Product: ' || product || '. Seller: ' || seller || '. Historical average price: $' || {_money_sql('avg_c')}
             || '. Today''s actual selling price: $' || {_money_sql('actual_c')}
             || '. Claimed original discount price: $' || {_money_sql('claimed_c')} || '.' AS sentence,
           {_money_sql('claimed_c - actual_c')} AS inflation_text
    FROM (SELECT *, CAST(round_even(CAST(roll_sum_c AS DOUBLE) / roll_n, 0) AS BIGINT) AS avg_c FROM r)""",
    "prices", extra={"r": ROLL7}))
def fn_20_price_sentences(spark, sf_dir):
    """FN-20 + FN-28: every quote as the model's input sentence (money from cents)."""
    r = P.with_rolling_mean(V.prices(spark, sf_dir), cuts=P.price_cuts(spark, sf_dir))
    avg_c = F.rint(F.col("roll_sum_c").cast("double") / F.col("roll_n")).cast("bigint")
    sentence = F.concat(F.lit("Product: "), "product", F.lit(". Seller: "), "seller",
                        F.lit(". Historical average price: $"), money_text(avg_c),
                        F.lit(". Today's actual selling price: $"), money_text("actual_c"),
                        F.lit(". Claimed original discount price: $"), money_text("claimed_c"), F.lit("."))
    return r.select("product", "seller", *P.ORDER, sentence.alias("sentence"),
                    money_text(F.col("claimed_c") - F.col("actual_c")).alias("inflation_text"))


@register("fn_22_softmax_argmax", V.with_views("""
    SELECT vec_id, list_position(embedding, list_max(embedding)) - 1 AS argmax,
           round(list_max(p), 6) AS p_max, round(p[2], 6) AS p_class1
    FROM (SELECT vec_id, embedding,
                 list_transform(e, lambda x: x / list_sum(e)) AS p
          FROM (SELECT vec_id, embedding,
                       list_transform(embedding, lambda x: exp(CAST(x AS DOUBLE) - CAST(list_max(embedding) AS DOUBLE))) AS e
                FROM embeddings))"""))
def fn_22_softmax_argmax(spark, sf_dir):
    """FN-22: softmax, arg-max and one class probability over model output vectors."""
    e = read(spark, sf_dir, "embeddings", "vec_id", "embedding")
    p = softmax("embedding")
    return e.select("vec_id", argmax("embedding").alias("argmax"), F.round(F.array_max(p), 6).alias("p_max"),
                    F.round(F.element_at(p, 2), 6).alias("p_class1"))


# ------------------------------------------------------------------ models: fitted (rows only) and given (SQL)

def _sentiment_data(spark, sf_dir):
    r = V.reviews(spark, sf_dir)
    lab = r.select("id", F.col("review_text").alias("text"), "review_rating",
                   T.label_of_rating("review_rating").alias("label"), "product")
    return T.split(lab, "id", 80)


def _saved(spark, path, fit):
    """Folder of models, fitted and saved if it is not there: ``fit`` writes into it, a marker file comes
    last, so a fit that was broken off is done again."""
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SAVED")
    fs = done.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(done):
        fit(path)
        fs.create(done, True).close()
    return path


def saved_sentiment_models(spark, sf_dir) -> str:
    """Folder of the sentiment slots fitted on these tables, once for each state of their files, under
    the shared checkpoint folder; every query that scores loads them."""
    state = file_state(spark, table_path(sf_dir, "documents"), table_path(sf_dir, "labels"))

    def fit(path):
        train = _sentiment_data(spark, sf_dir).filter((F.col("split") == "train") & F.col("label").isNotNull())
        M.save_models(M.fit_sentiment(train), path)

    return _saved(spark, scratch_path(spark, f"models/sentiment-words-{state}"), fit)


def _sentiment_models(spark, sf_dir):
    return _sentiment_data(spark, sf_dir), M.load_models(saved_sentiment_models(spark, sf_dir))


@register("ml_01_sentiment_scores")
def ml_01_sentiment_scores(spark, sf_dir):
    """ML-01 + ML-05: three fitted sentiment slots score every review."""
    data, models = _sentiment_models(spark, sf_dir)
    return M.score_sentiment(data, models, keep=("id", "product"))


@register("ml_05_sentiment_eval")
def ml_05_sentiment_eval(spark, sf_dir):
    """ML-05 + AGG-22: held-out accuracy and weighted F1 of each slot and of the majority class."""
    data, models = _sentiment_models(spark, sf_dir)
    return _evaluated(data.filter((F.col("split") == "test") & F.col("label").isNotNull()), models)


def _evaluated(labelled, models):
    """Every labelled row scored once; all metrics from the counts of that one pass."""
    scored = M.score_sentiment(labelled, models, keep=("id", "label")).withColumn("truth", T.name_of_label_col("label"))
    return T.evaluate(scored, "truth", {**{k: F.col(f"sentiment_{k}") for k in M.MODEL_SLOTS}, "majority": F.lit("Positive")})


@register("ml_02_rescore_update")
def ml_02_rescore_update(spark, sf_dir):
    """ML-02 + SRC-10: re-score the whole review table and update the label columns by id."""
    return _rescored(spark, sf_dir, *_sentiment_models(spark, sf_dir))


def _rescored(spark, sf_dir, data, models):
    table = with_model_columns(V.reviews(spark, sf_dir, with_text=False))
    new = M.score_sentiment(data, models, keep=("id",))
    cols = [f"sentiment_{k}" for k in M.MODEL_SLOTS]
    return C.keyed_update(table, new, ["id"], cols).select("id", "product", "sentiment", *cols)


FIXED_CLASS = ", ".join(f"CASE {M.fixed_class_sql(k)} WHEN 0.0 THEN 'Negative' WHEN 1.0 THEN 'Neutral' ELSE 'Positive' END AS sentiment_{k}" for k in M.MODEL_SLOTS)
FIXED_SQL = f"SELECT id, product, sentiment, review_rating, {FIXED_CLASS} FROM (SELECT *, COALESCE(review_text, '') AS text FROM reviews)"


@register("ml_01_fixed_model_scores", V.with_views("SELECT id, product, sentiment_bert, sentiment_roberta, sentiment_lstm FROM f", "reviews", extra={"f": FIXED_SQL}))
def ml_01_fixed_model_scores(spark, sf_dir):
    """ML-01: three slots of given weights score every review, by the same operator as the fitted ones."""
    return M.score_sentiment(_sentiment_data(spark, sf_dir), M.fixed_sentiment(), keep=("id", "product"))


@register("ml_02_fixed_rescore_update", V.with_views("""
    SELECT id, product, sentiment, sentiment_bert, sentiment_roberta, sentiment_lstm FROM f""", "reviews", extra={"f": FIXED_SQL}))
def ml_02_fixed_rescore_update(spark, sf_dir):
    """ML-02 + SRC-10: the stored label columns, which differ, replaced by id by those of given models."""
    return _rescored(spark, sf_dir, _sentiment_data(spark, sf_dir), M.fixed_sentiment())


def _f1_sql(keys, counts):
    """Accuracy and weighted F1 from confusion counts (keys, truth, pred, n), as SQL."""
    return f"""
    SELECT {keys}, round(sum(tp) / sum(support), 6) AS accuracy, round(sum(f1 * support) / sum(support), 6) AS weighted_f1, CAST(sum(support) AS BIGINT) AS rows
    FROM (SELECT *, CASE WHEN support + predicted > 0 THEN CAST(2 * tp AS DOUBLE) / (support + predicted) ELSE 0 END AS f1
          FROM (SELECT {keys}, cls, sum(s)::DOUBLE AS support, sum(t)::DOUBLE AS tp, sum(p)::DOUBLE AS predicted
                FROM (SELECT {keys}, truth AS cls, n AS s, CASE WHEN truth = pred THEN n ELSE 0 END AS t, 0 AS p FROM ({counts})
                      UNION ALL SELECT {keys}, pred, 0, 0, n FROM ({counts})) GROUP BY ALL)) GROUP BY {keys}"""


@register("ml_05_fixed_eval", V.with_views(_f1_sql("model", "SELECT * FROM c"), "reviews", extra={"f": FIXED_SQL, "c": " UNION ALL ".join(f"""
    SELECT '{k}' AS model, sentiment AS truth, {p} AS pred, count(*) AS n FROM f WHERE review_rating IS NOT NULL GROUP BY ALL"""
    for k, p in (*((k, f"sentiment_{k}") for k in M.MODEL_SLOTS), ("majority", "'Positive'")))}))
def ml_05_fixed_eval(spark, sf_dir):
    """ML-05 + AGG-22: the evaluation of slots of given weights over every labelled review, in one pass."""
    return _evaluated(_sentiment_data(spark, sf_dir).filter(F.col("label").isNotNull()), M.fixed_sentiment())


def _made_price_rows(spark, sf_dir):
    """Scored quotes with their features, weak label (price ratios, ML-09), truth (list price, FN-27) and split.
    The list price comes with the quote: one join with the products."""
    s = M.price_features(P.scored(V.prices(spark, sf_dir, base=True), P.price_cuts(spark, sf_dir))).withColumn("label", M.weak_label())
    s = s.withColumn("truth", (F.col("claimed_c") > F.col("actual_c")) & (F.col("actual_c") >= F.col("base_c")))
    s = T.split(s.withColumn("_key", F.concat_ws("|", *[F.col(c).cast("string") for c in V.PRICE_TIE])), "_key", 85)
    return s.select("product", "seller", *P.ORDER, "claimed_c", "actual_c", "roll_sum_c", "roll_n", *M.FEATURES, "is_manipulation", "label", "truth", "split")


def _price_rows(spark, sf_dir):
    """The rows of ``_made_price_rows``, joined and rolled once for each state of the price files and stored:
    fits, scores and evaluations all read them."""
    return reused(spark, f"price-rows-{name_of(sf_dir)}", file_state(spark, *P.price_tables(spark, sf_dir)), lambda: _made_price_rows(spark, sf_dir))


def saved_price_models(spark, sf_dir) -> str:
    """Folder of two price models, each fitted on its labels of the 85 % split, once for each state of the
    price files: ``truth`` on those of the list price (FN-27), ``weak`` on those of price ratios (ML-09)."""
    state = file_state(spark, *P.price_tables(spark, sf_dir))

    def fit(path):
        train = _price_rows(spark, sf_dir).filter("split = 'train'")
        M.save_models({"weak": M.fit_price_model(train.filter("label IS NOT NULL")),
                       "truth": M.fit_price_model(train.withColumn("label", F.col("truth").cast("int")))}, path)

    return _saved(spark, scratch_path(spark, f"models/prices-{state}"), fit)


def _price_model(spark, sf_dir, name="truth"):
    return M.load_models(saved_price_models(spark, sf_dir), [name])[name]


@register("ml_03_price_model_scores")
def ml_03_price_model_scores(spark, sf_dir):
    """ML-03: every quote scored by the saved fake-discount model of the true labels (rule fallback)."""
    return _scored_by(_price_rows(spark, sf_dir), _price_model(spark, sf_dir))


def _scored_by(rows, model):
    return M.score_price_model(rows, model).select("product", "seller", *P.ORDER, F.round("model_prob", 6).alias("model_prob"), "final_flag", "is_manipulation")


@register("ml_03_fixed_model_scores", V.with_views(f"""
    SELECT product, seller, {TIE_SQL}, round(p, 6) AS model_prob, COALESCE(p > 0.5, is_manipulation) AS final_flag, is_manipulation
    FROM (SELECT *, {M.fixed_price_sql()} AS p FROM (
        SELECT *, CAST(actual_c AS DOUBLE) / (CAST(roll_sum_c AS DOUBLE) / roll_n) AS f_actual_avg, CAST(claimed_c AS DOUBLE) / actual_c AS f_claimed_actual,
               CAST(claimed_c AS DOUBLE) / (CAST(roll_sum_c AS DOUBLE) / roll_n) AS f_claimed_avg FROM s))""", "prices", extra=SCORED_CTES))
def ml_03_fixed_model_scores(spark, sf_dir):
    """ML-03: every quote scored by a price model of given weights."""
    return _scored_by(_price_rows(spark, sf_dir), M.fixed_price_model())


@register("ml_06_price_model_eval")
def ml_06_price_model_eval(spark, sf_dir):
    """ML-06: accuracy and F1 on the held-out 15 % of the two saved models, the fake-discount rule and the
    larger class: against the truth (FN-27, from the list price, which is no feature), and against
    the weak labels, which are thresholds on the features themselves."""
    models = M.load_models(saved_price_models(spark, sf_dir), ("truth", "weak"))
    test = _price_rows(spark, sf_dir).filter("split = 'test'")
    for name, model in models.items():
        test = M.score_price_model(test, model).withColumnRenamed("final_flag", f"by_{name}").drop("model_prob")
    by = {"truth_model": F.col("by_truth").cast("string"), "weak_model": F.col("by_weak").cast("string"), "rule": F.col("is_manipulation").cast("string"),
          "always": F.lit("true")}
    truth = T.evaluate(test.withColumn("t", F.col("truth").cast("string")), "t", by).withColumn("target", F.lit("truth"))
    weak = T.evaluate(test.filter("label IS NOT NULL").withColumn("t", (F.col("label") == 1).cast("string")), "t", by)
    return truth.unionByName(weak.withColumn("target", F.lit("weak_label")))


FOREST_FEATURES = ["x_actual", "x_claimed", "rolling_avg_14"]


def _forest_rows(spark, sf_dir):
    r = P.rolling_mean_long(V.prices(spark, sf_dir), P.price_cuts(spark, sf_dir, ["product"]))
    return r.withColumns({"x_actual": F.col("actual_c").cast("double") / 100, "x_claimed": F.col("claimed_c").cast("double") / 100})


@register("ml_04_isolation_forest")
def ml_04_isolation_forest(spark, sf_dir):
    """ML-04 + FN-15: isolation forest over (actual, claimed, 14-row mean), contamination
    0.10, seed 42; a flagged row is a fake discount when the rule confirms it. The rows, the node table, the
    scores and the cut are made once for each state of the price files and stored: every row is scored once."""
    state, name = file_state(spark, *P.price_tables(spark, sf_dir)), name_of(sf_dir)
    keep = ["product", "seller", *P.ORDER, *FOREST_FEATURES, "rule_flag"]
    rows = reused(spark, f"forest-rows-{name}", state, lambda: _forest_rows(spark, sf_dir).select(*keep))
    nodes = reused(spark, f"forest-{name}", state, lambda: M.grow_forest(rows, FOREST_FEATURES, ["product", "seller", *P.ORDER]))
    scored = reused(spark, f"forest-scores-{name}", state, lambda: M.score_isolation_forest(rows, M.trees_of(nodes), FOREST_FEATURES).drop(*FOREST_FEATURES))
    cut = reused(spark, f"forest-cut-{name}", state, lambda: M.cut_of(scored))
    out = M.flagged(scored, cut)
    return out.select("product", "seller", *P.ORDER, round_half_even("if_score", 6).alias("if_score"), "anomaly",
                      ((F.col("anomaly") == -1) & F.col("rule_flag")).alias("is_manipulation"))


# Three small trees (tree, node, feature, threshold, left, right, size); feature -1 is a leaf.
FIXED_FOREST = [(0, 0, 0, 1200.0, 1, 2, 256), (0, 1, 1, 1000.0, 3, 4, 150), (0, 2, 2, 1300.0, 5, 6, 106), (0, 3, -1, 0.0, -1, -1, 40), (0, 4, -1, 0.0, -1, -1, 110),
                (0, 5, -1, 0.0, -1, -1, 2), (0, 6, -1, 0.0, -1, -1, 104), (1, 0, 2, 1250.0, 1, 2, 256), (1, 1, -1, 0.0, -1, -1, 1), (1, 2, 0, 1500.0, 3, 4, 255),
                (1, 3, 1, 1100.0, 5, 6, 200), (1, 4, -1, 0.0, -1, -1, 55), (1, 5, -1, 0.0, -1, -1, 3), (1, 6, -1, 0.0, -1, -1, 197), (2, 0, -1, 0.0, -1, -1, 256)]


@register("ml_04_fixed_forest", V.with_views(f"""
    SELECT product, seller, {TIE_SQL}, round(pow(2, -avg(depth + CASE WHEN size > 2 THEN 2 * (ln(size - 1) + 0.5772156649) - 2.0::DOUBLE * (size - 1) / size
                                                                       WHEN size = 2 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)
                                                       / (2 * (ln(255) + 0.5772156649) - 2.0::DOUBLE * 255 / 256)), 6) AS if_score
    FROM walk WHERE feature = -1 GROUP BY ALL""", "prices", extra={
    "x": f"""SELECT product, seller, {TIE_SQL}, [CAST(actual_c AS DOUBLE) / 100, CAST(claimed_c AS DOUBLE) / 100,
                    CAST(SUM(actual_c) OVER w AS DOUBLE) / COUNT(*) OVER w / 100] AS v FROM prices
             WINDOW w AS (PARTITION BY product ORDER BY {TIE_SQL} ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)""",
    "nodes": "SELECT * FROM (VALUES " + ", ".join(map(str, FIXED_FOREST)) + ") n(tree, node, feature, threshold, l, r, size)",
    "walk": """SELECT x.*, n.*, 0 AS depth FROM x JOIN nodes n ON n.node = 0
               UNION ALL SELECT w.product, w.seller, w.date, w.order_key, w.line_no, w.part_id, w.supp_id, w.v, n.*, w.depth + 1
               FROM walk w JOIN nodes n ON n.tree = w.tree AND n.node = CASE WHEN w.v[w.feature + 1] < w.threshold THEN w.l ELSE w.r END
               WHERE w.feature >= 0"""}).replace("WITH ", "WITH RECURSIVE ", 1))
def ml_04_fixed_forest(spark, sf_dir):
    """ML-04: scores of every quote under a given forest, by the operator that walks the grown ones."""
    nodes = spark.createDataFrame([(t, n, f, float(x), a, b, size) for t, n, f, x, a, b, size in FIXED_FOREST], M.FOREST)
    out = M.score_isolation_forest(_forest_rows(spark, sf_dir), M.trees_of(nodes), FOREST_FEATURES)
    return out.select("product", "seller", *P.ORDER, F.round("if_score", 6).alias("if_score"))
