"""Quality classifier: a generalised additive model with pairwise interactions (Lou et al., 2013)."""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import combinations
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import cut, remainder, small_batches, some, table

NAMES = ("words", "word_bytes", "symbols", "digits", "capitals", "shouts", "stops", "distinct", "stutter", "lines", "line_words", "dup_lines", "beyond_ascii", "pipes", "longest", "space")
#: Labelled rows that are learned from at most, about: a hash of doc_id chooses them where there are more.
SAMPLE = 40_000
#: Bins of a feature and of each side of a pair; rounds of boosting and their rate; pairs kept.
BINS, PAIR_BINS, ROUNDS, PAIR_ROUNDS, RATE, PAIRS = 24, 8, 120, 40, 0.15, 8
THRESHOLD = 0.3
SYMBOLS, SHOUTS, STOPS = b"#*$%&|<>~^_=+@", b"!?", b".,;:"


def features(text: str | None) -> list[float]:
    """Counts and shares of a whole text; all zero for null and empty texts."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    if not raw:
        return [0.0] * len(NAMES)
    of = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x.strip()]
    n, size = max(1, len(words)), len(raw)
    share = lambda chars: float(of[list(chars)].sum()) / size
    return [
        math.log1p(len(words)), (size - len(lines)) / n, share(SYMBOLS), float(of[48:58].sum()) / size, float(of[65:91].sum()) / size, share(SHOUTS), share(STOPS),
        len(set(words)) / n, sum(map(eq, words, words[1:])) / n, math.log1p(len(lines)), math.log1p(n / max(1, len(lines))), 1 - len(set(lines)) / max(1, len(lines)),
        float(of[128:].sum()) / size, share(b"|"), math.log1p(max(map(len, words), default=0)), share(b" \t\n\r\v\f"),
    ]


def _tree(gain: np.ndarray, weight: np.ndarray, leaves: int = 3) -> np.ndarray:
    """Value of each bin in a shallow regression tree over ordered bins: the best cuts, one after the other."""
    g, w = np.concatenate([[0], np.cumsum(gain)]), np.concatenate([[0], np.cumsum(weight)])
    ends = [0, len(gain)]
    term = lambda a, b: (g[b] - g[a]) ** 2 / (w[b] - w[a] + 1)
    for _ in range(leaves - 1):
        best = max(((term(a, c) + term(c, b) - term(a, b), c) for a, b in zip(ends, ends[1:], strict=False) for c in range(a + 1, b)), default=(0, 0))
        if best[0] <= 1e-9:
            break
        ends = sorted([*ends, best[1]])
    out = np.zeros(len(gain))
    for a, b in zip(ends, ends[1:], strict=False):
        out[a:b] = (g[b] - g[a]) / (w[b] - w[a] + 1)
    return out


@dataclass
class Additive:
    """Lookup tables: one for each feature, one for each chosen pair of features."""

    edges: list[np.ndarray]
    coarse: list[np.ndarray]
    base: float
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]

    def bins(self, x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(edges)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 by adding up bins."""
        if not len(x):
            return np.zeros(0)
        b, c = self.bins(x, self.edges), self.bins(x, self.coarse)
        z = np.full(len(x), self.base)
        for k, t in enumerate(self.tables):
            z += t[b[:, k]]
        for i, j, t in self.pairs:
            z += t[c[:, i], c[:, j]]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    return [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(x.shape[1])]


def fit(x: np.ndarray, y: np.ndarray) -> Additive:
    """Cyclic boosting: round after round each feature in turn gets a shallow tree on what is left; then the pairs that explain most of the rest do."""
    rate = min(max(y.mean(), 1e-3), 1 - 1e-3) if len(y) else 0.5
    base = math.log(rate / (1 - rate))
    if not len(y) or y.min() == y.max():
        return Additive([np.zeros(0)] * len(NAMES), [np.zeros(0)] * len(NAMES), base, [np.zeros(1)] * len(NAMES), [])
    edges, coarse = _edges(x, BINS), _edges(x, PAIR_BINS)
    model = Additive(edges, coarse, base, [np.zeros(len(e) + 1) for e in edges], [])
    b, c = model.bins(x, edges), model.bins(x, coarse)
    z = np.full(len(y), base)
    for _ in range(ROUNDS):
        for k, t in enumerate(model.tables):
            if len(t) > 1:
                p = 1 / (1 + np.exp(-z))
                step = RATE * np.clip(_tree(np.bincount(b[:, k], y - p, len(t)), np.bincount(b[:, k], p * (1 - p), len(t))), -4, 4)
                t += step
                z += step[b[:, k]]
    p = 1 / (1 + np.exp(-z))
    ranked = []
    for i, j in combinations(range(x.shape[1]), 2):
        shape = (len(coarse[i]) + 1, len(coarse[j]) + 1)
        cell = c[:, i] * shape[1] + c[:, j]
        g, w = np.bincount(cell, y - p, shape[0] * shape[1]), np.bincount(cell, p * (1 - p), shape[0] * shape[1])
        ranked.append(((g**2 / (w + 1)).sum(), i, j, shape, cell))
    model.pairs = [(i, j, np.zeros(shape)) for _, i, j, shape, _ in sorted(ranked, key=lambda r: -r[0])[:PAIRS]]
    cells = {(i, j): cell for _, i, j, _, cell in ranked}
    for _ in range(PAIR_ROUNDS):
        for i, j, t in model.pairs:
            p = 1 / (1 + np.exp(-z))
            g, w = (np.bincount(cells[i, j], v, t.size).reshape(t.shape) for v in (y - p, p * (1 - p)))
            along = np.stack([_tree(g[r], w[r], 2) for r in range(t.shape[0])])  # a tree that first cuts the one feature at each bin, then the other
            step = RATE * np.clip(along, -4, 4)
            t += step
            z += step.ravel()[cells[i, j]]
    return model


def train(rows: DataFrame, label: str) -> Additive:
    """Fit on rows(doc_id, x array<double>, and the label column), one a doc_id and in its order, so that reruns agree."""
    got = rows.select("doc_id", "x", label).toArrow().sort_by("doc_id")
    x = np.array(got["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False), float).reshape(got.num_rows, len(NAMES))
    return fit(x, got[label].to_numpy().astype(float))


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs.

    Learned from labels of documents whose crc32(doc_id as text) mod 5 isn't 0; a score sees the text alone.
    Null and empty texts have the score of all-zero features. Labels that are null, or of no document, count
    for nothing; of rows that repeat a doc_id one is learned from. Without any label, or with one value only, every
    score is the base rate's (a half without any). Repeated rows come back as often as they are there. No rows give no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)

    @F.pandas_udf("array<double>")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([features(t) for t in texts], dtype=object)

    measured = cut(docs.select("doc_id", of(F.col("text")).alias("x")))
    marks = cut(labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (remainder(F.col("doc_id"), 5) != 0)).groupBy("doc_id").agg(F.max(label).alias("_y")))
    learned = measured.join(F.broadcast(some(marks, SAMPLE, "doc_id")), "doc_id")  # SAMPLE rows, about
    learned = learned.groupBy("doc_id").agg(F.min("_y").alias("_y"), F.min_by("x", F.xxhash64("x")).alias("x"))
    sent = spark.sparkContext.broadcast(train(learned, "_y"))

    @F.pandas_udf("double")
    def score(xs: pd.Series) -> pd.Series:
        return pd.Series(sent.value.score(np.stack(xs.tolist()) if len(xs) else np.zeros((0, len(NAMES)))))

    out = measured.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), score("x").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document (see classify)."""
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
