"""Toxicity: a factorization machine over hashed terms (Rendle, 2010)."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import cut, remainder, small_batches, some, table

#: Values of the term hash: each has a weight and factors of its own, none is left out.
SPACE = 1 << 20
#: Labelled rows that the machine is fitted on at most, about: a hash of doc_id chooses them where there are more.
SAMPLE = 8_000
#: Factors of a term; passes over the sample; rows of a step; its rate; the first sum of squared gradients; penalty of a weight, and of a term's factors as a group; spread of the first factors; weight of a toxic row.
FACTORS, EPOCHS, BATCH, RATE, FIRST, LASSO, GROUP_LASSO, SPREAD, TOXIC = 8, 12, 128, 0.1, 1e-2, 1e-3, 4e-2, 0.1, 3.0
THRESHOLD = 0.5
#: A term that occurs once in so many words (or in a shorter text) has value 1; it rises with the root of its rate.
PER = 64
#: Bytes of a stem: inflected and compound insults share their beginning.
STEMS = (4, 5, 6)
#: Characters hashed at a time, and words whose hashes a worker keeps: both bound memory.
BLOCK, MEMO = 1 << 22, 1 << 17
#: Bytes of a term: letters, digits and whatever is beyond ASCII, in lower case; the rest parts terms.
_BYTES = bytes(b if b >= 128 else ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(256))
_MEMO: dict[bytes, tuple[int, ...]] = {}


def _hashes(word: bytes) -> tuple[int, ...]:
    """Hash of a word and of the stems that it begins with; -1 for a stem that it is too short for."""
    return (crc32(word) % SPACE, *(crc32(b"%s-" % word[:n]) % SPACE if len(word) > n else -1 for n in STEMS))


def hashed(texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of texts: the first and one past the last, then for each term of a text its place in the block, hash and value, in that order."""
    at = 0
    while at < len(texts):
        to, chars, each, n_words = at, 0, [], []
        while to < len(texts) and (to == at or chars + len(texts[to] or "") <= BLOCK):
            words = (texts[to] or "").encode("utf-8", "surrogatepass").translate(_BYTES).split()
            each.append(Counter(words))
            n_words.append(len(words))
            chars, to = chars + len(texts[to] or ""), to + 1
        if len(_MEMO) > MEMO:
            _MEMO.clear()
        rows = []
        for word in chain.from_iterable(each):
            known = _MEMO.get(word)
            if known is None:
                known = _MEMO[word] = _hashes(word)
            rows.append(known)
        ids = np.array(rows, np.int64).reshape(len(rows), 1 + len(STEMS))
        doc = np.repeat(np.arange(to - at), [len(c) for c in each])
        count = np.fromiter(chain.from_iterable(c.values() for c in each), np.float64, len(rows))
        there = ids >= 0
        keys, back = np.unique((doc[:, None] * SPACE + ids)[there], return_inverse=True)
        total = np.bincount(back, np.broadcast_to(count[:, None], ids.shape)[there], len(keys))
        doc = keys // SPACE
        value = np.sqrt(total * PER / np.maximum(PER, np.array(n_words, float))[doc])
        yield at, to, doc, (keys % SPACE).astype(np.int32), value.astype(np.float32)
        at = to


@dataclass
class Machine:
    """A weight and factors for every value of the hash; zero for those that no row of the sample has."""

    bias: float
    weight: np.ndarray
    factor: np.ndarray  # FACTORS by SPACE

    def __getstate__(self) -> tuple:
        used = np.flatnonzero((self.weight != 0) | self.factor.any(axis=0))
        return self.bias, used, self.weight[used], self.factor[:, used]

    def __setstate__(self, state: tuple) -> None:
        self.bias, used, weight, factor = state
        self.weight, self.factor = np.zeros(SPACE, np.float32), np.zeros((FACTORS, SPACE), np.float32)
        self.weight[used], self.factor[:, used] = weight, factor

    def logits(self, n: int, doc: np.ndarray, ids: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Bias, the weighted values, and for every two terms the inner product of their factors times their values."""
        z = self.bias + np.bincount(doc, self.weight[ids] * value, n)
        for row in self.factor:
            v = row[ids] * value
            z += 0.5 * (np.bincount(doc, v, n) ** 2 - np.bincount(doc, v * v, n))
        return z

    def score(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros(len(texts))
        for at, to, doc, ids, value in hashed(texts):
            out[at:to] = 1 / (1 + np.exp(-np.clip(self.logits(to - at, doc, ids, value), -30, 30)))
        return out


def fit(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray) -> Machine:
    """AdaGrad on the log loss with proximal steps. rows: hashes and values of a document's terms.

    The penalties, not a choice of terms, keep the noise of rare terms out: a weight, or a term's factors together,
    go to zero unless the gradient holds them. Steps follow the order of rows, which the caller fixes.
    """
    rng = np.random.default_rng(11)
    rate = min(max(float(y.mean()), 1e-3), 1 - 1e-3) if len(y) else 0.5
    model = Machine(math.log(rate / (1 - rate)), np.zeros(SPACE, np.float32), np.zeros((FACTORS, SPACE), np.float32))
    if not len(y) or y.min() == y.max():
        return model
    steps = []
    for at in range(0, len(y), BATCH):
        part = rows[at : at + BATCH]
        ids = np.concatenate([i for i, _ in part]).astype(np.int32)
        used, back = np.unique(ids, return_inverse=True)
        steps.append((at, used, back.astype(np.int32), np.repeat(np.arange(len(part), dtype=np.int32), [len(i) for i, _ in part]), np.concatenate([v for _, v in part]).astype(np.float32)))
    seen = np.unique(np.concatenate([s[1] for s in steps]))
    model.factor[:, seen] = rng.normal(0, SPREAD, (FACTORS, len(seen)))
    past_w, past_v, past_b = np.full(SPACE, FIRST, np.float32), np.full(SPACE, FIRST, np.float32), 1e-2
    for _ in range(EPOCHS):
        for k in rng.permutation(len(steps)):
            at, used, back, doc, value = steps[k]
            want = y[at : at + BATCH]
            n, m = len(want), len(used)
            v = model.factor[:, used]
            vx = [row[back] * value for row in v]
            total = [np.bincount(doc, x, n) for x in vx]
            z = model.bias + np.bincount(doc, model.weight[used][back] * value, n) + 0.5 * sum(t * t - np.bincount(doc, x * x, n) for t, x in zip(total, vx, strict=True))
            off = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - want) * np.where(want > 0, TOXIC, 1.0) / n
            g = (off[doc] * value).astype(np.float32)
            gw = np.bincount(back, g, m).astype(np.float32)
            gv = np.stack([np.bincount(back, g * (t.astype(np.float32)[doc] - x), m) for t, x in zip(total, vx, strict=True)]).astype(np.float32)
            past_w[used] += gw * gw
            past_v[used] += (gv * gv).mean(axis=0)
            past_b += off.sum() ** 2
            step = RATE / np.sqrt(past_w[used])
            w = model.weight[used] - step * gw
            model.weight[used] = np.sign(w) * np.maximum(np.abs(w) - step * LASSO, 0)
            step = RATE / np.sqrt(past_v[used])
            v = v - step * gv
            model.factor[:, used] = v * np.maximum(1 - step * GROUP_LASSO / (np.sqrt((v * v).sum(axis=0)) + 1e-12), 0)
            model.bias -= RATE * off.sum() / math.sqrt(past_b)
    return model


def classify(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs.

    Learned from labels of documents whose crc32(doc_id as text) mod 5 isn't 0, SAMPLE of them at most, so
    their marks go to every executor and no text is shuffled; a score sees the text alone, all of it. Null and
    empty texts have the score of no term. Labels that are null, or of no document, count for nothing; of rows that repeat
    a doc_id one is learned from, the one whose text has the least hash. With one class only every score is the
    base rate's (a half without labels). Repeated rows come back as often as they are there. No rows give no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)

    @F.pandas_udf("ids array<int>, value array<float>")
    def of(texts: pd.Series) -> pd.DataFrame:
        ids, value = [], []
        for at, to, doc, i, v in hashed(texts.tolist()):
            ends = np.searchsorted(doc, np.arange(1, to - at))
            ids += np.split(i, ends)
            value += np.split(v, ends)
        return pd.DataFrame({"ids": pd.Series(ids, dtype=object), "value": pd.Series(value, dtype=object)})

    marks = cut(labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (remainder(F.col("doc_id"), 5) != 0)).groupBy("doc_id").agg(F.max(label).cast("int").alias("_y")))
    found = docs.select("doc_id", "text").join(F.broadcast(some(marks, SAMPLE, "doc_id")), "doc_id")  # SAMPLE rows, about
    found = found.select("doc_id", "_y", F.xxhash64("text").alias("_h"), of("text").alias("_t"))
    rows = cut(found.groupBy("doc_id").agg(F.min("_y").alias("y"), F.min_by("_t", "_h").alias("t"))).select("doc_id", "y", "t.ids", "t.value").toArrow().sort_by("doc_id").combine_chunks()
    terms = [(i.values.to_numpy(), v.values.to_numpy()) for i, v in zip(rows["ids"], rows["value"], strict=True)]
    sent = spark.sparkContext.broadcast(fit(terms, rows["y"].to_numpy().astype(float)))

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(sent.value.score(texts.tolist()), dtype="float64")

    out = docs.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), score("text").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity score of every document (see classify)."""
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
