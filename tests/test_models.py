import glob
import os

import numpy as np
from pyspark.sql import functions as F

from souk.operators import models as M
from souk.plans.registry import load_all
from tests.conftest import SF01


def test_isolation_forest_ranks_planted_outliers(spark):
    rng = np.random.default_rng(0)
    normal = rng.normal(100.0, 2.0, size=(2000, 3))
    planted = np.array([[300.0, 300.0, 250.0], [10.0, 500.0, 400.0], [400.0, 20.0, 350.0]])
    rows = [(i, *map(float, x)) for i, x in enumerate(np.vstack([normal, planted]))]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double")
    nodes = spark.createDataFrame(M.grow_forest(df, ["a", "b", "c"], ["id"]).collect(), M.FOREST)
    assert nodes.count() <= M.IF_TREES * (2 * M.IF_SAMPLE - 1) and nodes.select("tree").distinct().count() == M.IF_TREES
    out = M.flag_anomalies(df, nodes, M.forest_cut(df, nodes, ["a", "b", "c"]), ["a", "b", "c"])
    top = [r.id for r in out.orderBy(F.desc("if_score")).limit(3).collect()]
    assert set(top) == {2000, 2001, 2002}
    share = out.filter(F.col("anomaly") == -1).count() / out.count()
    assert 0.08 <= share <= 0.12


def test_price_model_learns_the_rule(spark, sf):
    rows = {(r.target, r.model): r for r in load_all()["ml_06_price_model_eval"].build(spark, sf).collect()}
    assert set(rows) == {(t, m) for t in ("truth", "weak_label") for m in ("truth_model", "weak_model", "rule", "always")}
    assert rows["weak_label", "weak_model"].accuracy >= 0.9
    assert rows["truth", "truth_model"].weighted_f1 > max(rows["truth", m].weighted_f1 for m in ("rule", "always", "weak_model"))
    assert rows["truth", "rule"].rows > rows["weak_label", "rule"].rows > 0


def test_each_slot_beats_the_majority_class(spark):
    ev = {r.model: r.weighted_f1 for r in load_all()["ml_05_sentiment_eval"].build(spark, SF01).collect()}
    assert min(ev[k] for k in M.MODEL_SLOTS) > ev["majority"] + 0.05


def test_sentiment_slots_and_fallback(spark, sf):
    out = load_all()["ml_01_sentiment_scores"].build(spark, sf)
    assert out.columns == ["id", "product", "sentiment_bert", "sentiment_roberta", "sentiment_lstm"]
    vals = {r[0] for r in out.select("sentiment_lstm").distinct().collect()}
    assert vals <= {"Positive", "Neutral", "Negative"}
    ev = {r.model: r for r in load_all()["ml_05_sentiment_eval"].build(spark, sf).collect()}
    assert set(ev) == {"bert", "roberta", "lstm", "majority"}
    assert all(0.0 <= r.accuracy <= 1.0 for r in ev.values()) and len({r.rows for r in ev.values()}) == 1


def test_fixed_models_are_saved_and_loaded_like_fitted_ones(spark, sf, tmp_path):
    from souk.sources import views as V
    reviews = V.reviews(spark, sf).withColumn("text", F.col("review_text"))
    given = M.fixed_sentiment()
    loaded = M.load_models(M.save_models(given, str(tmp_path)))
    a, b = (M.score_sentiment(reviews, m).collect() for m in (given, loaded))
    assert sorted(a) == sorted(b) and len({tuple(r)[1:] for r in a}) > 3


def test_models_are_fitted_once_and_loaded(spark, sf):
    from souk.plans import q_models as Q
    path = Q.saved_sentiment_models(spark, sf)
    before = {p: os.stat(p).st_mtime_ns for p in glob.glob(f"{path.removeprefix('file:')}/*/metadata/part-*")}
    assert len(before) == 3
    assert Q.saved_sentiment_models(spark, sf) == path
    load_all()["ml_02_rescore_update"].build(spark, sf).count()
    assert before == {p: os.stat(p).st_mtime_ns for p in before}


def _keyword_model():
    """A tiny stand-in for an outside model: logits from word hits (numpy only)."""
    import numpy as np

    def predict(texts):
        out = []
        for t in texts:
            t = str(t).lower()
            out.append([t.count(" not "), t.count(" the ") * 0.0, t.count(" is ")])
        return np.asarray(out, dtype=np.float32)
    return predict


def test_outside_model_slot(spark, sf):
    from souk.functions.exprs import argmax, softmax
    from souk.sources import views as V
    r = V.reviews(spark, sf).select("id", "review_text")
    logits = M.outside_model(_keyword_model, "review_text", 3)
    out = r.select("id", logits.alias("logits")).select("id", argmax("logits").alias("cls"),
                                                        F.array_max(softmax("logits")).alias("p"))
    rows = out.collect()
    assert len(rows) == r.count()
    assert all(0 <= x.cls <= 2 and 0.0 < x.p <= 1.0 for x in rows)


def test_accuracy_f1_matches_mllib(spark, sf):
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    from souk.operators import text as T
    from souk.sources.tables import read
    truth = read(spark, sf, "documents", "doc_id", "lang")
    det = T.detect_language(read(spark, sf, "documents", "doc_id", "text"), "doc_id", "text")
    j = truth.join(det, "doc_id").fillna({"detected": "none"})
    ours = T.accuracy_f1(j, "lang", "detected").first()
    codes = {c: float(i) for i, c in enumerate(["en", "de", "fr", "es", "none"])}
    m = F.create_map(*[x for k, v in codes.items() for x in (F.lit(k), F.lit(v))])
    num = j.select(m[F.col("lang")].alias("label"), m[F.col("detected")].alias("prediction"))
    ev = MulticlassClassificationEvaluator(labelCol="label", predictionCol="prediction")
    assert abs(ev.setMetricName("accuracy").evaluate(num) - ours.accuracy) < 1e-6
    assert abs(ev.setMetricName("f1").evaluate(num) - ours.weighted_f1) < 1e-6


def test_price_rows_are_joined_and_rolled_once(spark, sf):
    """Each fit, score and evaluation made the rows again: about twenty joins, each with its broadcast."""
    from souk.plans import q_models as Q
    rows = Q._price_rows(spark, sf)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Window" not in plan and "Exchange" not in plan
    made = Q._made_price_rows(spark, sf)
    assert rows.columns == made.columns and rows.exceptAll(made).count() == 0 and made.exceptAll(rows).count() == 0
    assert rows.groupBy("split").count().count() == 2


def test_every_row_is_scored_once_and_as_a_plain_walk_scores_it(spark, sf, monkeypatch):
    """The rows were rolled for each step and scored twice, for the cut and for the flags."""
    from souk.plans import q_models as Q
    calls = []
    score = M.score_isolation_forest
    monkeypatch.setattr(M, "score_isolation_forest", lambda *a, **k: calls.append(1) or score(*a, **k))
    monkeypatch.setattr(Q, "name_of", lambda path: "scored-once")
    out = load_all()["ml_04_isolation_forest"].build(spark, sf)
    assert len(calls) == 1 and "Python" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.count() == Q._forest_rows(spark, sf).count()

    rng = np.random.default_rng(5)
    X = rng.lognormal(3, 1, size=(400, 3))
    for seed in range(5):
        tree = dict(zip(("feature", "threshold", "left", "right", "size"), map(np.array, M._grow(X[:256], np.random.default_rng(seed), 8)), strict=True))
        want = []
        for row in X:
            node = depth = 0
            while tree["feature"][node] >= 0:
                node, depth = tree["left" if row[tree["feature"][node]] < tree["threshold"][node] else "right"][node], depth + 1
            want.append(depth + M._c(tree["size"][node]))
        assert (M._path_lengths(X.T.ravel(), len(X), M._steps(tree)) == np.array(want)).all()


def test_a_fit_sends_no_more_for_more_files(spark, sf):
    """A pass of a fit had a task, and a result for the driver, for each piece of the input."""
    from souk.plans import q_models as Q
    train = Q._sentiment_data(spark, sf).filter("label IS NOT NULL")
    tasks = []
    plain = M.Pipeline.fit
    M.Pipeline.fit = lambda self, rows, *a: tasks.append((rows.rdd.getNumPartitions(), "text" in rows.columns)) or plain(self, rows, *a)
    try:
        models = M.fit_sentiment(train.repartition(40), slots=("bert", "roberta"))
    finally:
        M.Pipeline.fit = plain
    assert len(tasks) == 2 and all(n <= M.FIT_TASKS and not texts for n, texts in tasks)
    whole = M.sentiment_pipelines()["roberta"].fit(M.class_weights(train.select("text", F.col("label").cast("double").alias("label")).dropna(), "label"))
    a, b = (M.score_sentiment(train, {"roberta": m}).collect() for m in (whole, models["roberta"]))
    assert sorted(a) == sorted(b)


def test_scoring_quotes_reads_the_stored_rows(spark, sf):
    """The scores joined and rolled the quotes again, after the fits had."""
    plan = load_all()["ml_03_fixed_model_scores"].build(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Window" not in plan


def test_slots_share_the_words_of_a_text(spark, sf, monkeypatch):
    """Each slot cut every text into words for itself: three times a row."""
    from souk.plans import q_models as Q
    data, models = Q._sentiment_models(spark, sf)
    cuts, plain = [], M.RegexTokenizer.transform
    monkeypatch.setattr(M.RegexTokenizer, "transform", lambda self, *a: cuts.append(self.getOutputCol()) or plain(self, *a))
    out = M.score_sentiment(data, models)
    assert cuts == ["words"]
    for k in M.MODEL_SLOTS:
        alone = models[k].transform(data.select("id", F.coalesce("text", F.lit("")).alias("text")))
        alone = alone.select("id", M.name_of_label(F.col(f"pred_{k}")).alias("label"))
        assert out.select("id", f"sentiment_{k}").exceptAll(alone).count() == 0 and alone.count() == out.count() > 0
