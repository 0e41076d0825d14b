"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are the distinct hashed n-grams (bytes, A-Z lower case, white space as one blank) of a
text. Each is scaled by the log ratio of its share in toxic and other labelled texts; a
logistic regression is trained on the scaled features of a bounded sample of labelled rows.
Scoring reads every text whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.llm.shared import crc_mod, slices

BUCKET_BITS = 20
SIZES = (4, 6)
TRAIN_ROWS = 5000        # at most so many labelled rows fit the model
FOLDS = 5                # fold 0 is held out
UNTRAINED = -3.0         # log odds of every text if no row is labelled
FOLD = bytes(32 if i in (9, 10, 11, 12, 13, 32) else i + 32 if 65 <= i <= 90 else i for i in range(256))


def ngrams(text: bytes, seen: np.ndarray) -> np.ndarray:
    """Distinct hashed n-grams of a text. ``seen``: scratch array of 2**BUCKET_BITS integers."""
    b = np.frombuffer(b" " + text.translate(FOLD) + b" ", np.uint8).astype(np.uint32)
    found, shift = [], np.uint32(32 - BUCKET_BITS)
    for n in SIZES:
        if len(b) < n:
            continue
        h = np.zeros(len(b) - n + 1, np.uint32) + np.uint32(n)
        for i in range(n):
            h = (h ^ b[i:len(b) - n + 1 + i]) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
        found.append((h * np.uint32(0x85EBCA77)) >> shift)
    if not found:
        return np.zeros(0, np.int64)
    h = np.concatenate(found)
    at = np.arange(len(h))
    seen[h] = at
    return h[seen[h] == at].astype(np.int64)


def train(features: list[np.ndarray], labels: np.ndarray, epochs: int = 5, rate: float = 2.0, decay: float = 1e-6):
    """(weights by bucket with the ratios multiplied in, intercept)."""
    size = 1 << BUCKET_BITS
    counts = np.ones((2, size))
    for x, y in zip(features, labels, strict=True):
        counts[int(y), x] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    ratio[(counts[0] + counts[1]) <= 4] = 0        # an n-gram of one or two texts says nothing
    ratio = np.clip(ratio, -4, 4)
    weights, energy = np.full(size, 0.0), np.full(size, 1.0)
    shift, shift_energy, order = 0.0, 1.0, np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(features)):
            x = features[i]
            r = ratio[x]
            scale = 1 / np.sqrt(max(len(x), 1))
            z = shift + scale * float(weights[x] @ r)
            error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[i]
            g = error * scale * r + decay * weights[x]
            energy[x] += g * g
            weights[x] -= rate * g / np.sqrt(energy[x])
            shift_energy += error * error
            shift -= rate * error / np.sqrt(shift_energy)
    return (weights * ratio).astype(np.float32), shift


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> tuple[np.ndarray, float]:
    """Fit on at most ``train_rows`` labelled documents outside fold 0, the first by a hash of
    doc_id. The sample meets in one task; its one result row holds 2**BUCKET_BITS weights.
    Without a labelled row no text speaks for a rejection: the weights are zero and the
    intercept is ``UNTRAINED``. A null text is fitted as empty; of repeated ids the least text."""
    sample = (labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (crc_mod("doc_id", FOLDS) != 0))
              .groupBy("doc_id").agg(F.max("toxic").alias("label"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows))
    rows = (docs.select(F.col("doc_id").alias("id"), "text").join(F.broadcast(sample), F.col("id") == F.col("doc_id"))
            .groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label")))

    def fitted(batches):
        seen, features, marks = np.zeros(1 << BUCKET_BITS, np.int64), [], []
        for batch in batches:
            for text, mark in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
                features.append(ngrams((text or "").encode(), seen).astype(np.int32))
                marks.append(mark)
        if features:
            weights, shift = train(features, np.array(marks, float))
            yield pa.record_batch([pa.array([weights.tobytes()], pa.binary()), pa.array([shift])], names=["weights", "shift"])

    model = rows.orderBy(F.xxhash64("doc_id"), "doc_id").coalesce(1).mapInArrow(fitted, "weights binary, shift double").collect()
    if not model:
        return np.zeros(1 << BUCKET_BITS, np.float32), UNTRAINED
    return np.frombuffer(model[0]["weights"], np.float32), model[0]["shift"]


def scored(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """Add ``score`` (0 to 1) in place of text. Null and empty texts have the features of none."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)        # 2**BUCKET_BITS floats, whatever the data
    others = [c for c in docs.columns if c != "text"]

    def score(batches):
        (weights, shift), seen = shared.value, np.zeros(1 << BUCKET_BITS, np.int64)
        for batch in batches:
            for part in slices(batch):
                out = []
                for text in part.column("text").to_pylist():
                    x = ngrams((text or "").encode(), seen)
                    out.append(shift + float(weights[x].sum(dtype=np.float64)) / np.sqrt(max(len(x), 1)))
                score = 1 / (1 + np.exp(-np.clip(np.array(out), -30, 30)))
                yield pa.record_batch([*[part.column(c) for c in others], pa.array(score)], names=[*others, "score"])

    return docs.mapInArrow(score, docs.select(*others).withColumn("score", F.lit(0.0)).schema)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Per document: doc_id, held_out (its fold took no part in the fit), score, predicted.

    Null and empty texts get the score of a text without n-grams, a null doc_id hashes as the
    empty text, repeated rows give repeated results, an empty table an empty one. Texts are read
    whole, however long. Other columns are not read, nor can their names clash."""
    own = docs.select("doc_id", "text")
    return (scored(own, fit(own, labels)).withColumn("held_out", crc_mod("doc_id", FOLDS) == 0)
            .select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted")))


def clean_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents whose score is under ``threshold``, with all their columns.

    Null and empty texts are judged like any other, repeated rows stay or go together, and without
    a labelled row every document stays."""
    model = fit(docs.select("doc_id", "text"), labels)
    rows = docs.select(F.struct("*").alias("doc"), F.col("text").alias("text"))
    return scored(rows, model).where(F.col("score") < threshold).select("doc.*")
