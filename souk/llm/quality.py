"""Quality: histogram gradient-boosted trees over document statistics.

Trees are grown on binned statistics of a bounded sample of labelled rows and flattened into
arrays (feature, threshold, children, value); scoring walks all rows of a batch through each
tree together, one numpy step per level.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.llm.shared import crc_mod, slices

TRAIN_ROWS = 12000       # at most so many labelled rows fit the model
FOLDS = 5                # fold 0 is held out
BINS = 64
SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
STATS = ("n_words", "word_length", "symbols", "upper", "digits", "stops", "other_bytes", "distinct_words", "top_word",
         "stutter", "distinct_pairs", "distinct_lines", "line_words", "longest_word", "exclaims", "single_letters")


def statistics(text: bytes) -> list[float]:
    """The STATS of one text; shares of an empty text are 0."""
    by_byte = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    words, n_bytes = text.lower().split(), max(len(text), 1)
    n = max(len(words), 1)
    lines = [x for x in text.split(b"\n") if x.strip()]
    letters = max(int(by_byte[65:91].sum() + by_byte[97:123].sum() + by_byte[128:].sum()), 1)
    lengths = list(map(len, words))
    top = Counter(words).most_common(1)
    return [len(words), sum(lengths) / n, by_byte[SYMBOLS].sum() / n, by_byte[65:91].sum() / letters,
            by_byte[48:58].sum() / n_bytes, (by_byte[46] + by_byte[33] + by_byte[63]) / n, by_byte[128:].sum() / n_bytes,
            len(set(words)) / n, top[0][1] / n if top else 0, sum(map(bytes.__eq__, words, words[1:])) / n,
            len(set(zip(words, words[1:], strict=False))) / n, len(set(lines)) / max(len(lines), 1),
            len(words) / max(len(lines), 1), max(lengths, default=0), by_byte[33] / n, lengths.count(1) / n]


def grow(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, least: int = 8, ridge: float = 1.0):
    """Boosted trees for log loss. Returns (start, feature, threshold, left, right, value, roots)."""
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    share = np.clip(y.mean(), 0.01, 0.99)
    start = float(np.log(share / (1 - share)))
    z = np.full(len(y), start)
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def node():
        for a in (feature, left, right):
            a.append(0)
        threshold.append(0.0)
        value.append(0.0)
        return len(feature) - 1

    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        g, h = y - p, p * (1 - p)
        roots.append(node())
        work = [(roots[-1], np.arange(len(y)), 0)]
        while work:
            at, rows, level = work.pop()
            gs, hs = g[rows].sum(), h[rows].sum()
            best = (1e-6, -1, 0)
            for f, e in enumerate(edges if level < depth and len(rows) >= 2 * least else []):
                if not len(e):
                    continue
                b = binned[rows, f]
                gl = np.cumsum(np.bincount(b, g[rows], len(e) + 1))[:-1]
                hl = np.cumsum(np.bincount(b, h[rows], len(e) + 1))[:-1]
                nl = np.cumsum(np.bincount(b, minlength=len(e) + 1))[:-1]
                gain = gl**2 / (hl + ridge) + (gs - gl)**2 / (hs - hl + ridge) - gs**2 / (hs + ridge)
                gain[(nl < least) | (len(rows) - nl < least)] = -1
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], f, k)
            if best[1] < 0:
                value[at] = rate * gs / (hs + ridge)
                left[at] = right[at] = at
                z[rows] += value[at]
                continue
            feature[at], threshold[at] = best[1], edges[best[1]][best[2]]
            go = binned[rows, best[1]] <= best[2]
            left[at], right[at] = node(), node()
            work += [(left[at], rows[go], level + 1), (right[at], rows[~go], level + 1)]
    as_array = lambda a, t: np.array(a, t)
    return (start, as_array(feature, np.int32), as_array(threshold, float), as_array(left, np.int32),
            as_array(right, np.int32), as_array(value, float), as_array(roots, np.int32), depth)


def walk(model, x: np.ndarray) -> np.ndarray:
    """Score of each row of statistics: all rows step down a tree together; a leaf is its own child."""
    start, feature, threshold, left, right, value, roots, depth = model
    z, rows = np.full(len(x), start), np.arange(len(x))
    for root in roots:
        at = np.full(len(x), root)
        for _ in range(depth):
            at = np.where(x[rows, feature[at]] <= threshold[at], left[at], right[at])
        z += value[at]
    return 1 / (1 + np.exp(-z))


def with_statistics(docs: DataFrame) -> DataFrame:
    """``docs`` with the array column ``stats`` in place of text. A null text counts as empty."""
    others = [c for c in docs.columns if c != "text"]

    def counted(batches):
        for batch in batches:
            for part in slices(batch):
                stats = np.array([statistics((t or "").encode()) for t in part.column("text").to_pylist()], float)
                flat = pa.FixedSizeListArray.from_arrays(pa.array(stats.ravel()), len(STATS)).cast(pa.list_(pa.float64()))
                yield pa.record_batch([*[part.column(c) for c in others], flat], names=[*others, "stats"])

    return docs.mapInArrow(counted, docs.select(*others).withColumn("stats", F.array(F.lit(0.0))).schema)


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS):
    """Fit on at most ``train_rows`` labelled documents outside fold 0, the first by a hash of
    doc_id: their statistics (a few numbers each) go to the driver. None without labelled rows."""
    sample = (labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (crc_mod("doc_id", FOLDS) != 0))
              .groupBy("doc_id").agg(F.min("quality").alias("label"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows))
    rows = (docs.select(F.col("doc_id").alias("id"), "text").join(F.broadcast(sample), F.col("id") == F.col("doc_id"))
            .groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label")))
    found = with_statistics(rows).select("doc_id", "label", "stats").toPandas().sort_values("doc_id")
    if not len(found):
        return None
    return grow(np.stack(found["stats"].to_numpy()), found["label"].to_numpy(float))


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Per document: doc_id, held_out (its fold took no part in the fit), score, predicted.
    Without any labelled row every score is 0.5."""
    own = docs.select("doc_id", "text")
    shared = docs.sparkSession.sparkContext.broadcast(fit(own, labels))       # trees of bounded number and depth

    def score(batches):
        for batch in batches:
            x = batch.column("stats").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATS))
            p = walk(shared.value, x) if shared.value is not None else np.full(len(x), 0.5)
            yield pa.record_batch([batch.column("doc_id"), pa.array(p)], names=["doc_id", "score"])

    schema = own.select("doc_id").withColumn("score", F.lit(0.0)).schema
    return (with_statistics(own).mapInArrow(score, schema).withColumn("held_out", crc_mod("doc_id", FOLDS) == 0)
            .select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted")))
