"""Models (ML-01..06, ML-09): sentiment classifiers, the fake-discount classifier, weak
labels and an isolation forest.

The reference scored single rows with pretrained transformer weights that are not part of
its checkout; here each slot is an MLlib pipeline fitted on the tables (distributed fit and
transform), plus an isolation forest (not in MLlib) built from Spark pieces:

* trees grow on a seeded sample, one ``applyInPandas`` group per tree (256 rows each),
* the forest is a node table of at most ``trees x (2 x 256 - 1)`` rows whatever the data size, which is
  stored, and broadcast to score with,
* every row is scored in Arrow batches by ``mapInPandas`` (vectorised numpy walk),
* the anomaly threshold is the contamination quantile of all scores (``percentile_approx``), found
  and stored with the fit.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier, NaiveBayes
from pyspark.ml.feature import HashingTF, IDF, Normalizer, RegexTokenizer, SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from souk.functions.exprs import FAKE_RATIO_DEN, FAKE_RATIO_NUM, name_of_label
from souk.session import scratch_path

# Isolation forest settings of the reference job (contamination 0.10, seed 42)
# and the standard sub-sample size / tree count of the algorithm.
IF_CONTAMINATION, IF_SEED, IF_TREES, IF_SAMPLE = 0.10, 42, 100, 256
MODEL_SLOTS = ("bert", "roberta", "lstm")


# ------------------------------------------------------------------ sentiment (ML-01, 02, 05)

def _tokens(text_col: str, out: str) -> RegexTokenizer:
    """Words, and runs of other signs, which tell junk from prose."""
    return RegexTokenizer(inputCol=text_col, outputCol=out, pattern=r"\p{L}+|[^\p{L}\s]+", gaps=False, toLowercase=True)


def _out(slot: str) -> dict:
    return dict(predictionCol=f"pred_{slot}", rawPredictionCol=f"raw_{slot}", probabilityCol=f"prob_{slot}")


WIDE, NARROW = 1 << 16, 1 << 10      # hashed words of the linear models and of the perceptron


def _words(slot: str, text_col: str) -> list:
    """A slot's stages that need no fit: the words of a text and their hashed counts. Slots name what
    they share alike, and ``score_sentiment`` makes it once."""
    out, width = ("words_narrow", NARROW) if slot == "lstm" else ("words_wide", WIDE)
    return [_tokens(text_col, "words"), HashingTF(inputCol="words", outputCol=out, numFeatures=width)]


WORDS = ("words", "words_wide", "words_narrow")


def _fitted(slot: str, label_col: str) -> list:
    """A slot's stages after ``_words``."""
    return {"bert": [IDF(inputCol="words_wide", outputCol="idf_bert", minDocFreq=5), Normalizer(inputCol="idf_bert", outputCol="x_bert", p=1.0),
                     LogisticRegression(featuresCol="x_bert", labelCol=label_col, weightCol="weight", maxIter=100, regParam=0.003, **_out("bert"))],
            "roberta": [NaiveBayes(featuresCol="words_wide", labelCol=label_col, weightCol="weight", smoothing=1.0, **_out("roberta"))],
            "lstm": [MultilayerPerceptronClassifier(featuresCol="words_narrow", labelCol=label_col, layers=[NARROW, 16, 3], maxIter=60, seed=IF_SEED,
                                                    **_out("lstm"))]}[slot]


def sentiment_pipelines(text_col: str = "text", label_col: str = "label") -> dict[str, Pipeline]:
    """Three model slots over the same text: logistic regression on TF-IDF, naive Bayes on
    term counts, a small perceptron on hashed counts. Column names are per slot but for the words that
    slots share, so the three chain on one DataFrame (``score_sentiment``; no joins back by id)."""
    return {k: Pipeline(stages=_words(k, text_col) + _fitted(k, label_col)) for k in MODEL_SLOTS}


FIT_TASKS = 12      # fixed value: tasks of a pass over the training counts


def fit_sentiment(train: DataFrame, text_col: str = "text", label_col: str = "label",
                  slots=MODEL_SLOTS) -> dict[str, PipelineModel]:
    """ML-05: fit each slot (MLlib fits are distributed over the training rows).

    The texts are cut into words once, and only labels and hashed counts are kept, in the shared folder. A fit
    makes some hundred passes; in each, every task sends its result to the driver and a gradient as wide as
    the model to the task that adds them up. So a pass has a fixed number of tasks, whatever the table's
    size; MLlib caches their rows in blocks, on disk if need be."""
    t = class_weights(train.select(text_col, F.col(label_col).cast("double").alias(label_col)).dropna(), label_col)
    slots = [k for k in MODEL_SLOTS if k in slots]
    counted = t
    for k in MODEL_SLOTS:
        counted = _transformed(counted, PipelineModel(_words(k, text_col)))
    path = scratch_path(t.sparkSession, f"models/counts-{uuid.uuid4().hex}")
    counted.select(label_col, "weight", *WORDS[1:]).write.parquet(path)
    rows = t.sparkSession.read.parquet(path).coalesce(FIT_TASKS)
    out = {}
    for k in slots:
        words = _words(k, text_col)
        own = rows.select(label_col, "weight", words[-1].getOutputCol())
        out[k] = PipelineModel(words + Pipeline(stages=_fitted(k, label_col)).fit(own).stages)
    return out


def class_weights(train: DataFrame, label_col: str, power: float = 0.5) -> DataFrame:
    """Adds ``weight``: (rows / (classes x rows of the class)) ** power, so that a class of few rows is not
    drowned by the largest; one aggregate of as many rows as there are classes."""
    counts = train.groupBy(label_col).agg(F.count(F.lit(1)).alias("_n"))
    share = counts.withColumn("weight", F.pow(F.sum("_n").over(Window.partitionBy()) / (F.count(F.lit(1)).over(Window.partitionBy()) * F.col("_n")), F.lit(power)))
    return train.join(F.broadcast(share.drop("_n")), label_col)


def save_models(models: dict[str, PipelineModel], path: str) -> str:
    """Save each slot's fitted pipeline in a folder of its own under ``path`` (shared storage)."""
    for name, model in models.items():
        model.write().overwrite().save(f"{path}/{name}")
    return path


def load_models(path: str, slots=MODEL_SLOTS) -> dict[str, PipelineModel]:
    """The saved slots under ``path``."""
    return {k: PipelineModel.load(f"{path}/{k}") for k in slots}


def _transformed(df: DataFrame, model: PipelineModel) -> DataFrame:
    """``model.transform`` without the words that another slot has made already."""
    for stage in model.stages:
        made = stage.getOutputCol() if stage.hasParam("outputCol") else None
        if made not in WORDS or made not in df.columns:
            df = stage.transform(df)
    return df


def score_sentiment(df: DataFrame, models: dict[str, PipelineModel], text_col: str = "text",
                    keep: tuple = ("id",)) -> DataFrame:
    """ML-01: three label columns; a missing slot falls back to the first model's label. Every text is cut
    into words once, whatever the number of slots."""
    out = df.select(*keep, F.coalesce(text_col, F.lit("")).alias(text_col))
    present = [k for k in MODEL_SLOTS if k in models]
    for k in present:
        out = _transformed(out, models[k])
    labels = {k: name_of_label(F.col(f"pred_{k}")) for k in present}
    first = labels[present[0]]
    return out.select(*keep, *[labels.get(k, first).alias(f"sentiment_{k}") for k in MODEL_SLOTS])


# Words whose numbers in a text the fixed models weigh, and each slot's weight of each
# word for the classes 0, 1, 2, then the classes' offsets.
FIXED_WORDS = (" the ", " de ", " der ", "license")
FIXED_WEIGHTS = {"bert": ((1, 0, 2), (3, 1, 0), (0, 2, 1), (9, 0, 0), (0, 3, 2)),
                 "roberta": ((0, 1, 2), (1, 2, 1), (2, 0, 0), (0, 7, 0), (4, 0, 3)),
                 "lstm": ((2, 2, 1), (0, 1, 3), (1, 1, 2), (0, 0, 5), (1, 6, 0))}


def fixed_class_sql(slot: str, text_col: str = "text") -> str:
    """The class that a slot's fixed linear model gives a text, as SQL (the same in both dialects)."""
    number = [f"(length({text_col}) - length(replace({text_col}, '{w}', ''))) / {len(w)}" for w in FIXED_WORDS]
    score = [" + ".join(f"{w[k]} * {n}" for w, n in zip(FIXED_WEIGHTS[slot], [*number, "1"], strict=True)) for k in range(3)]
    return f"CASE WHEN {score[0]} >= {score[1]} AND {score[0]} >= {score[2]} THEN 0.0 WHEN {score[1]} >= {score[2]} THEN 1.0 ELSE 2.0 END"


def fixed_sentiment(text_col: str = "text") -> dict[str, PipelineModel]:
    """Slots with given weights instead of fitted ones: they are scored, saved and loaded like any
    others, and what comes out can be said in SQL."""
    return {k: PipelineModel([SQLTransformer(statement=f"SELECT *, CAST({fixed_class_sql(k, text_col)} AS DOUBLE) AS pred_{k} FROM __THIS__")]) for k in MODEL_SLOTS}


# ------------------------------------------------------------------ price model (ML-03, 06, 09)

def weak_label(sum_c: str = "roll_sum_c", n: str = "roll_n"):
    """ML-09: labels from price ratios to the rolling mean (avg = sum / n), in integers:
    claimed 1.3..2.0 x avg with actual within 2% of avg -> 1; actual 0.5..0.8 x avg -> 0;
    claimed = actual within 2% of avg -> 0; anything else -> NULL."""
    s, k = F.col(sum_c), F.col(n)
    c10, a10 = F.col("claimed_c") * 10 * k, F.col("actual_c") * 10 * k
    near = F.abs(F.col("actual_c") * k - s) * 50 <= s
    return (F.when((c10 >= s * 13) & (c10 <= s * 20) & near, F.lit(1))
             .when((a10 >= s * 5) & (a10 <= s * 8) & (F.col("claimed_c") >= F.col("actual_c")), F.lit(0))
             .when((F.col("claimed_c") == F.col("actual_c")) & near, F.lit(0)))


def price_features(scored_df: DataFrame) -> DataFrame:
    """Ratio features of a quote against its own rolling mean (scale free)."""
    avg = F.col("roll_sum_c").cast("double") / F.col("roll_n")
    return (scored_df.withColumn("f_actual_avg", F.try_divide(F.col("actual_c").cast("double"), avg))
                     .withColumn("f_claimed_actual", F.try_divide(F.col("claimed_c").cast("double"), F.col("actual_c")))
                     .withColumn("f_claimed_avg", F.try_divide(F.col("claimed_c").cast("double"), avg)))


FEATURES = ["f_actual_avg", "f_claimed_actual", "f_claimed_avg"]


def fit_price_model(train: DataFrame, label_col: str = "label") -> PipelineModel:
    """ML-06: logistic regression on the ratio features."""
    pipe = Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="features", handleInvalid="keep"),
                            LogisticRegression(labelCol=label_col, maxIter=100)])
    t = train.dropna(subset=FEATURES + [label_col])
    return pipe.fit(t.withColumn(label_col, F.col(label_col).cast("double")))


# Offset and weights of FEATURES of a given price model.
FIXED_PRICE = (-6.0, 2.5, 1.5, 1.75)


def fixed_price_sql() -> str:
    """The probability of class 1 under ``FIXED_PRICE`` (the same text in both dialects)."""
    terms = " + ".join(f"({w}) * {f}" for w, f in zip(FIXED_PRICE[1:], FEATURES, strict=True))
    return f"1.0 / (1.0 + exp(-(({FIXED_PRICE[0]}) + {terms})))"


def fixed_price_model() -> PipelineModel:
    """A price model with given weights."""
    p = fixed_price_sql()
    return PipelineModel([SQLTransformer(statement=f"SELECT *, CAST({p} AS DOUBLE) AS _p1, CAST(1.0 - {p} AS DOUBLE) AS _p0 FROM __THIS__"),
                          VectorAssembler(inputCols=["_p0", "_p1"], outputCol="probability", handleInvalid="keep"),
                          SQLTransformer(statement="SELECT *, CASE WHEN _p1 > 0.5 THEN 1.0D ELSE 0.0D END AS prediction FROM __THIS__")])


def score_price_model(df: DataFrame, model: PipelineModel | None) -> DataFrame:
    """ML-03: probability of class 1 (fake) and the flag; rows the model cannot score (and
    every row when no model is given) fall back to the fake-discount rule."""
    rule = (F.col("claimed_c") > F.col("actual_c")) & (
        F.col("actual_c") * FAKE_RATIO_DEN * F.col("roll_n") >= F.col("roll_sum_c") * FAKE_RATIO_NUM)
    if model is None:
        return df.withColumn("model_prob", F.lit(None).cast("double")).withColumn("final_flag", rule)
    cols = df.columns
    scored = model.transform(df)               # a narrow transform: no join back needed
    prob = vector_to_array("probability")[1]
    usable = ~F.isnan(prob)
    return scored.select(*cols, F.when(usable, prob).alias("model_prob"),
                         F.when(usable, F.col("prediction") == 1).alias("_model_flag")) \
                 .withColumn("final_flag", F.coalesce("_model_flag", rule)).drop("_model_flag")


# ------------------------------------------------------------------ isolation forest (ML-04)

def _c(n):
    """Average path length of an unsuccessful search in a binary tree of n points."""
    n = np.asarray(n, dtype="float64")
    out = np.where(n > 2, 2.0 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2.0 * (n - 1) / np.maximum(n, 1), 0.0)
    return np.where(n == 2, 1.0, out)


def _grow(X: np.ndarray, rng: np.random.Generator, limit: int):
    """Grow one isolation tree; returns node arrays (feature, threshold, left, right, size)."""
    feat, thr, left, right, size = [], [], [], [], []
    stack = [(np.arange(len(X)), 0, -1, False)]
    while stack:
        idx, depth, parent, is_right = stack.pop()
        node = len(feat)
        feat.append(-1); thr.append(0.0); left.append(-1); right.append(-1); size.append(len(idx))
        if parent >= 0:
            (right if is_right else left)[parent] = node
        if depth >= limit or len(idx) <= 1:
            continue
        sub = X[idx]
        lo, hi = sub.min(axis=0), sub.max(axis=0)
        cand = np.flatnonzero(hi > lo)
        if len(cand) == 0:
            continue
        q = int(rng.choice(cand))
        p = float(rng.uniform(lo[q], hi[q]))
        feat[node], thr[node] = q, p
        mask = sub[:, q] < p
        stack.append((idx[~mask], depth + 1, node, True))
        stack.append((idx[mask], depth + 1, node, False))
    return feat, thr, left, right, size


def _grow_group(features: list[str], seed: int, sample: int):
    limit = int(math.ceil(math.log2(max(sample, 2))))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        pdf = pdf.sort_values("_k").head(sample)   # deterministic, at most `sample` rows
        X = pdf[features].to_numpy(dtype="float64")
        f, t, l, r, s = _grow(X, np.random.default_rng(seed + tree), limit)
        return pd.DataFrame({"tree": tree, "node": np.arange(len(f)), "feature": f, "threshold": t,
                             "left": l, "right": r, "size": s})
    return grow


FOREST = "tree int, node int, feature int, threshold double, left int, right int, size int"


def grow_forest(df: DataFrame, features: list[str], id_cols: list[str], trees: int = IF_TREES,
                sample: int = IF_SAMPLE, seed: int = IF_SEED) -> DataFrame:
    """The forest as a node table (``FOREST``): at most trees x (2 x sample - 1) rows. Each tree draws about
    ``min(sample, n)`` rows by a seeded hash (the algorithm's own sub-sampling - scoring later covers
    every row). The root of each tree tells by its size how many rows it was grown from."""
    key = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in id_cols], F.lit(str(seed))))
    base = df.select(*features, key.alias("_k")).dropna()
    n = base.count()
    psi = max(2, min(sample, n))
    scale = 1 << 31
    # One draw for all sizes: each tree keeps a row with p = psi / n, by a seeded hash.
    thr = int(psi / max(n, 1) * scale)
    member = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)),
                      lambda t: F.pmod(F.xxhash64(F.col("_k"), t), F.lit(scale)) < thr)
    picked = base.withColumn("tree", F.explode(member))
    return picked.groupBy("tree").applyInPandas(_grow_group(features, seed, psi), FOREST)


def trees_of(nodes: DataFrame) -> list[dict]:
    """The trees of a node table as arrays (bounded: see ``grow_forest``)."""
    pdf = nodes.toPandas().sort_values(["tree", "node"])
    return [{k: g[k].to_numpy() for k in ("feature", "threshold", "left", "right", "size")} for _, g in pdf.groupby("tree")]


def _steps(tree: dict) -> tuple:
    """A tree for ``_path_lengths``: feature and threshold of each node, its two next nodes (a leaf's are
    itself), the path length of ending there, and the depth of the tree."""
    leaf, own = tree["feature"] < 0, np.arange(len(tree["feature"]))
    step = np.stack([np.where(leaf, own, tree["left"]), np.where(leaf, own, tree["right"])], axis=1).astype(np.intp)
    depth = np.zeros(len(own))
    level, deep = np.zeros(1, np.intp), 0
    while len(level):
        depth[level] = deep
        level, deep = step[level[~leaf[level]]].ravel(), deep + 1
    return np.where(leaf, 0, tree["feature"]).astype(np.intp), tree["threshold"], step.ravel(), depth + _c(tree["size"]), deep - 1


def _path_lengths(columns: np.ndarray, n: int, tree: tuple) -> np.ndarray:
    """The path length of each of ``n`` rows, whose features lie one after the other in ``columns``. All rows
    take as many steps as the tree is deep; one that has reached its leaf stays there."""
    feature, threshold, step, length, deep = tree
    offset, rows = feature * n, np.arange(n)
    node = np.zeros(n, np.intp)
    for _ in range(deep):
        right = ~(np.take(columns, np.take(offset, node) + rows) < np.take(threshold, node))
        node = np.take(step, 2 * node + right)
    return length[node]


def score_isolation_forest(df: DataFrame, forest: list[dict], features: list[str], sample: int = IF_SAMPLE,
                           out: str = "if_score") -> DataFrame:
    """Anomaly score 2^(-E[h(x)] / c(sample)) for every row (Arrow batches)."""
    try:
        bc = df.sparkSession.sparkContext.broadcast(forest)   # bounded: trees x (2 x sample - 1) nodes
        get_forest = lambda: bc.value
    except Exception:  # noqa: BLE001 - Spark Connect: ship the (small) forest with the function
        get_forest = lambda: forest
    cn = float(_c(sample))
    from pyspark.sql.types import DoubleType, StructField, StructType
    schema = StructType(list(df.schema.fields) + [StructField(out, DoubleType())])

    def run(batches):
        trees = [_steps(t) for t in get_forest()]
        for pdf in batches:
            X = pdf[features].to_numpy(dtype="float64")
            ok = ~np.isnan(X).any(axis=1)
            h = np.zeros(len(X))
            if ok.any():
                columns, n = X[ok].T.ravel(), int(ok.sum())
                h[ok] = np.mean([_path_lengths(columns, n, t) for t in trees], axis=0)
            s = np.where(ok, np.power(2.0, -h / cn), np.nan)
            yield pdf.assign(**{out: s})
    return df.mapInPandas(run, schema)


def forest_cut(df: DataFrame, nodes: DataFrame, features: list[str], contamination: float = IF_CONTAMINATION, sample: int = IF_SAMPLE) -> DataFrame:
    """One row (cut): the score that the top ``contamination`` share of all rows reach. Part of the fit,
    and stored with the nodes, so that flagging a table scores it once."""
    return cut_of(score_isolation_forest(df.select(*features), trees_of(nodes), features, sample), contamination)


def cut_of(scored: DataFrame, contamination: float = IF_CONTAMINATION) -> DataFrame:
    """``forest_cut`` of rows that have their score."""
    return scored.agg(F.percentile_approx("if_score", 1 - contamination, 10000).alias("cut"))


def flag_anomalies(df: DataFrame, nodes: DataFrame, cut: DataFrame, features: list[str], sample: int = IF_SAMPLE) -> DataFrame:
    """ML-04 with a stored model: the score of every row and anomaly -1 from the cut on, else 1. Nothing
    runs while the plan is built but reading the node table."""
    return flagged(score_isolation_forest(df, trees_of(nodes), features, sample), cut)


def flagged(scored: DataFrame, cut: DataFrame) -> DataFrame:
    """``flag_anomalies`` of rows that have their score."""
    return scored.withColumn("anomaly", F.when(F.col("if_score") >= cut.select("cut").scalar(), F.lit(-1)).otherwise(F.lit(1)))


# ------------------------------------------------------------------ outside model slot (ML-01/03)

INFERENCE_BATCH = 16   # fixed value: the reference's inference batch size


def outside_model(make_predict, text_col: str, classes: int, batch_size: int = INFERENCE_BATCH):
    """A pluggable slot for a model that lives outside Spark (e.g. an ONNX session): the
    ``make_predict()`` factory is called once per Python worker and gets numpy batches of
    ``batch_size`` texts (Arrow batches), returning a (batch, classes) array of logits.
    Returns a Column of logits; ``functions.exprs.softmax``/``argmax`` turn it into labels."""
    from pyspark.ml.functions import predict_batch_udf
    from pyspark.sql.types import ArrayType, FloatType
    udf = predict_batch_udf(make_predict, return_type=ArrayType(FloatType()), batch_size=batch_size,
                            input_tensor_shapes=None)
    return udf(F.col(text_col))
