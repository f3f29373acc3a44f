"""Language identification by interpolated Kneser-Ney character models."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import cut, most_frequent, remainder, small_batches, table

#: Characters of an n-gram: four of 16 bits make a 64-bit key.
ORDER = 4
#: Cells (n-grams, or contexts, and languages that have them) that every executor gets at most, 16 bytes each or less: beyond, the rarer ones are joined.
CELLS = 3_000_000
#: One in so many of the learnable rows calibrates.
FOLDS = 10
#: Characters counted or scored at a time.
BLOCK = 1 << 20
#: Steps of the margin in the calibration, and their width in nats a character.
STEPS, STEP = 64, 1 / 16
#: A text is rejected if its language is likelier wrong than right, or its cross-entropy lies so many deviations above its language's mean.
FAR = 8.0


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point: itself in 16 bits if a letter (letters beyond 16 bits share one value), else a space."""
    out = np.full(0x110000, 32, np.uint16)
    for c in range(0x110000):
        if not 0xD800 <= c < 0xE000 and chr(c).isalpha():
            out[c] = c if c < 0xFFFD else 0xFFFD
    return out


def codes(text: str | None) -> np.ndarray:
    """A text in lower case: letters, and one space for whatever stands between, before and after them. Empty without a letter."""
    raw = _letters()[np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
    raw = np.concatenate([[np.uint16(32)], raw, [np.uint16(32)]])
    kept = raw[1:][(raw[1:] != 32) | (raw[:-1] != 32)]
    return kept if len(kept) > 1 else kept[:0]


def grams(stream: np.ndarray) -> np.ndarray:
    """Key of the 4-gram that ends at each character; before the first there are spaces."""
    c = np.concatenate([np.full(ORDER - 1, 32, np.uint64), stream.astype(np.uint64)])
    return (c[:-3] << np.uint64(48)) | (c[1:-2] << np.uint64(32)) | (c[2:-1] << np.uint64(16)) | c[3:]


def _blocks(texts: list[str | None]) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """Texts as codes, in blocks of about BLOCK characters."""
    at, out, n = [], [], 0
    for k, text in enumerate(texts):
        at.append(k)
        out.append(codes(text))
        n += len(out[-1])
        if n >= BLOCK:
            yield at, out
            at, out, n = [], [], 0
    if at:
        yield at, out


def count_grams(labelled: DataFrame) -> DataFrame:
    """(lang, test, gram, n) over all rows of labelled(lang, test boolean, text)."""
    small_batches(labelled.sparkSession)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[str, bool], list[np.ndarray]] = {}
        n = 0

        def flush() -> Iterator[pd.DataFrame]:
            for (lang, test), parts in held.items():
                keys, found = np.unique(np.concatenate(parts), return_counts=True)
                yield pd.DataFrame({"lang": lang, "test": test, "gram": keys.view(np.int64), "n": found.astype(np.int64)})

        for batch in batches:
            for lang, test, text in zip(batch["lang"], batch["test"], batch["text"], strict=True):
                own = codes(text)
                if len(own):
                    held.setdefault((lang, test), []).append(grams(own))
                    n += len(own)
                if n >= 4 * BLOCK:
                    yield from flush()
                    held, n = {}, 0
        yield from flush()

    found = labelled.select("lang", "test", "text").mapInPandas(count, "lang string, test boolean, gram long, n long")
    return found.groupBy("lang", "test", "gram").agg(F.sum("n").alias("n"))


def kneser_ney(counts: DataFrame) -> DataFrame:
    """(kind, key, lang, w, n): the interpolated Kneser-Ney models of all languages of counts(lang, gram, n) as weights that add up.

    The highest order counts occurrences, each lower one the characters that a suffix follows; the discount of an
    order and language is n1 / (n1 + 2 n2) over all its n-grams (0.75 where one of them is 0). An n-gram that a
    language has seen weighs what its log probability is above that of backing off from it, and a context
    the log of its back-off share; kind 0 is what any character has at least. The log probability of a text is then
    the sum of what it has of each kind: 2 to 5 for n-grams of length 1 to 4, 6 to 8 for contexts of length 1 to 3.
    n counts occurrences. Every step is an aggregation or a join on a language's n-gram: nothing is cut off.
    """
    levels = [counts.selectExpr("lang", "gram as key", "n as c", "n")]
    for bits in (48, 32, 16):
        low = levels[-1].selectExpr("lang", f"key & {(1 << bits) - 1}L as key", "n").groupBy("lang", "key").agg(F.count("*").alias("c"), F.sum("n").alias("n"))
        levels.append(cut(low) if bits == 48 else low)
    ones = [x.groupBy("lang").agg(F.count_if(F.col("c") == 1).alias("one"), F.count_if(F.col("c") == 2).alias("two"), F.sum("c").alias("sum"), F.count("*").alias("types")).withColumn("o", F.lit(4 - k)) for k, x in enumerate(levels)]
    share = "if(one > 0 and two > 0, one / (one + 2 * two), 0.75d) as d"
    stats = cut(ones[0].unionByName(ones[1]).unionByName(ones[2]).unionByName(ones[3]).selectExpr("lang", "o", "sum", "types", share))
    least = stats.where("o = 1").selectExpr("lang", "ln(d * types / sum / 65536) as floor", "d", "sum")
    model = least.selectExpr("0 as kind", "0L as key", "lang", "floor as w", "0L as n")
    below = (levels[3].join(least, "lang").selectExpr("lang", "key", "n", "ln(greatest(c - d, 0d) / sum + exp(floor)) as p", "floor"))
    model = model.unionByName(below.selectExpr("2 as kind", "key", "lang", "p - floor as w", "n"))
    for k in (2, 1, 0):
        order = 4 - k
        d = stats.where(F.col("o") == order).select("lang", "d")
        contexts = levels[k].selectExpr("lang", "shiftrightunsigned(key, 16) as h", "c", "n").groupBy("lang", "h").agg(F.sum("c").alias("sum"), F.count("*").alias("types"), F.sum("n").alias("n"))
        contexts = contexts.join(d, "lang").selectExpr("lang", "h", "n", "sum", "d", "d * types / sum as share")
        own = levels[k].selectExpr("lang", "key", "c", "n", "shiftrightunsigned(key, 16) as h", f"key & {(1 << 16 * (order - 1)) - 1}L as suffix")
        own = own.join(contexts.drop("n"), ["lang", "h"]).join(below.selectExpr("lang", "key as suffix", "p as q"), ["lang", "suffix"])
        below = own.selectExpr("lang", "key", "n", "ln(greatest(c - d, 0d) / sum + share * exp(q)) as p", "q + ln(share) as rest")
        below = cut(below) if k else below
        model = model.unionByName(below.selectExpr(f"{1 + order} as kind", "key", "lang", "p - rest as w", "n"))
        model = model.unionByName(contexts.selectExpr(f"{4 + order} as kind", "h as key", "lang", "ln(share) as w", "n"))
    return model


#: For each kind, where its key stands in a 4-gram: bits to the right that it leaves out, and how many it has.
KINDS = {2: (0, 16), 3: (0, 32), 4: (0, 48), 5: (0, 64), 6: (16, 16), 7: (16, 32), 8: (16, 48)}


class Tables:
    """Weights in arrays sorted by n-gram: for each kind the keys, where a key's cells start, and the cells' languages and weights."""

    def __init__(self, n_langs: int, floor: np.ndarray, cells: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.n_langs, self.floor, self.kinds = n_langs, floor, {}
        for kind, (key, lang, w) in cells.items():
            order = np.lexsort((lang, key))
            key, lang, w = key[order], lang[order], w[order]
            keys, start = np.unique(key, return_index=True)
            self.kinds[kind] = (keys, np.append(start, len(key)), lang.astype(np.int32), w.astype(np.float32))

    def weights(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each 4-gram its sum of weights in every language, and which of the kinds (a column each) the arrays don't have."""
        out, lack = np.zeros(len(wanted) * self.n_langs), np.ones((len(wanted), len(KINDS)), bool)
        for column, (kind, (right, bits)) in enumerate(KINDS.items()):
            if kind not in self.kinds:
                continue
            keys, start, lang, w = self.kinds[kind]
            own = (wanted >> np.uint64(right)) & np.uint64((1 << bits) - 1)
            at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
            hit = np.flatnonzero(keys[at] == own)
            lack[hit, column] = False
            n = start[at[hit] + 1] - start[at[hit]]
            cell = np.repeat(start[at[hit]] - np.cumsum(n) + n, n) + np.arange(n.sum())
            out += np.bincount(np.repeat(hit, n) * self.n_langs + lang[cell], w[cell], len(out))
        return out.reshape(len(wanted), self.n_langs), lack

    def sums(self, texts: list[str | None], rest: bool = False) -> tuple[np.ndarray, np.ndarray, list[dict[tuple[int, int], int]]]:
        """For each text its log probability in every language, its length in characters, and, if rest, how often it has each (kind, key) that isn't in the arrays."""
        total, length, lacks = np.zeros((len(texts), self.n_langs)), np.zeros(len(texts), np.int64), [{} for _ in texts]
        for at, block in _blocks(texts):
            full = [(k, c) for k, c in zip(at, block, strict=True) if len(c)]
            if not full:
                continue
            size = np.array([len(c) for _, c in full])
            wanted, back = np.unique(np.concatenate([grams(c) for _, c in full]), return_inverse=True)
            weight, lack = self.weights(wanted)
            doc = np.repeat(np.arange(len(full)), size)
            where = np.array([k for k, _ in full])
            pair, times = np.unique(doc * len(wanted) + back, return_counts=True)  # a text's distinct 4-grams
            own, gram = pair // len(wanted), pair % len(wanted)
            starts = np.searchsorted(own, np.arange(len(full)))
            for j in range(self.n_langs):
                total[where, j] = np.add.reduceat(weight[gram, j] * times, starts)
            total[where] += size[:, None] * self.floor
            length[where] = size
            if rest:
                for column, (kind, (right, bits)) in enumerate(KINDS.items()):
                    gone = np.flatnonzero(lack[gram, column])
                    for d, key, n in zip(own[gone], (wanted[gram[gone]] >> np.uint64(right)) & np.uint64((1 << bits) - 1), times[gone], strict=True):
                        held = lacks[where[d]]
                        held[kind, int(key)] = held.get((kind, int(key)), 0) + int(n)
        return total, length, lacks


def _hot(model: DataFrame, most: int) -> tuple[DataFrame, DataFrame | None]:
    """The cells of the most frequent keys, `most` at most, and the others if there are any. A key's cells stay together."""
    cells = model.where("kind > 0")
    if cells.count() <= most:
        return cells, None
    keys = cut(cells.groupBy("kind", "key").agg(F.sum("n").alias("n"), F.count("*").alias("cells")))
    near, far = most_frequent(keys, F.col("cells"), most)
    return tuple(cells.join(k.select("kind", "key"), ["kind", "key"], "left_semi") for k in (near, far))


def scored(texts: DataFrame, model: DataFrame, langs: list[str], most: int = CELLS) -> DataFrame:
    """texts(text, ...) without text, and, by the rows (kind, key, place, w, n) of a model, best, entropy, margin: the place in langs of the likeliest language (null without a letter), its cross-entropy a character, and how far the next one's lies above.

    Every executor has the cells of the most frequent n-grams, `most` at most, in sorted arrays. Where the
    models are larger, a text's other n-grams meet the other cells by a join: rare ones by construction, so
    no key of that join is hot, and the sums are the same.
    """
    spark = texts.sparkSession
    small_batches(spark)
    floor = np.full(len(langs), -1e3)  # of a language that has no rows here
    for r in model.where("kind = 0").select("place", "w").collect():
        floor[r["place"]] = r["w"]
    near, far = _hot(model, most)
    got = near.select("kind", "key", "place", "w").toArrow()
    kind, key, lang, w = (got[c].to_numpy() for c in ("kind", "key", "place", "w"))
    cells = {int(k): (key[kind == k].view(np.uint64), lang[kind == k], w[kind == k]) for k in np.unique(kind)}
    sent = spark.sparkContext.broadcast(Tables(len(langs), floor, cells))

    def best(sums: np.ndarray, length: np.ndarray) -> pd.DataFrame:
        mean = -sums / np.maximum(length, 1)[:, None]
        order = np.sort(mean, axis=1)[:, :2]
        margin = order[:, 1] - order[:, 0] if len(langs) > 1 else np.full(len(mean), STEPS * STEP)
        return pd.DataFrame({"best": pd.array(np.where(length > 0, mean.argmin(axis=1), -1), "Int32"), "entropy": order[:, 0], "margin": margin})

    rest = [c for c in texts.columns if c != "text"]
    if far is None:

        @F.pandas_udf("best int, entropy double, margin double")
        def of(batch: pd.Series) -> pd.DataFrame:
            return best(*sent.value.sums(batch.tolist())[:2])

        found = texts.select(*rest, of("text").alias("_p"))
    else:

        @F.pandas_udf("sums array<double>, length long, lack array<struct<kind:int,key:long,n:long>>")
        def parts(batch: pd.Series) -> pd.DataFrame:
            sums, length, lack = sent.value.sums(batch.tolist(), rest=True)
            lists = [[(kind, np.uint64(key).astype(np.int64).item(), n) for (kind, key), n in x.items()] for x in lack]
            return pd.DataFrame({"sums": list(sums), "length": length, "lack": pd.Series(lists, dtype=object)})

        @F.pandas_udf("best int, entropy double, margin double")
        def of_sums(sums: pd.Series, length: pd.Series, more: pd.Series) -> pd.DataFrame:
            total = np.array(sums.tolist(), float).reshape(len(sums), len(langs))
            for k, cells in enumerate(more):
                for c in () if cells is None else cells:
                    total[k, c["place"]] += c["w"]
            return best(total, length.to_numpy())

        each = cut(texts.withColumns({"_a": F.xxhash64("text"), "_b": F.xxhash64(F.lit(1), "text")}).select("*", parts("text").alias("_q")).drop("text"))  # equal texts have equal sums
        apart = each.dropDuplicates(["_a", "_b"]).select("_a", "_b", F.explode("_q.lack").alias("l")).select("_a", "_b", "l.*")
        more = apart.join(far.select("kind", "key", "place", "w"), ["kind", "key"]).groupBy("_a", "_b", "place").agg(F.sum(F.col("n") * F.col("w")).alias("w"))
        more = more.groupBy("_a", "_b").agg(F.collect_list(F.struct("place", "w")).alias("_more"))  # a language each
        found = each.join(more, ["_a", "_b"], "left").select(*rest, of_sums("_q.sums", "_q.length", "_more").alias("_p"))
    return found.select(*rest, F.when(F.col("_p.best") >= 0, F.col("_p.best")).alias("best"), "_p.entropy", "_p.margin")


def _rising(right: np.ndarray, n: np.ndarray) -> list[float]:
    """Share of right predictions in each step of the margin, made to rise by pooling neighbours."""
    blocks: list[list[float]] = []
    for r, m in zip(right, n, strict=True):
        blocks.append([r + 1, m + 2, 1])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            r2, m2, k2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + r2, blocks[-1][1] + m2, blocks[-1][2] + k2]
    return [r / m for r, m, k in blocks for _ in range(int(k))]


def identify(docs: DataFrame, learn_from: DataFrame | None = None, most: int = CELLS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, cross_entropy, rejected) for each row of docs.

    The models learn from all rows whose lang is known and whose crc32(doc_id as text) mod 3 isn't 1; a
    prediction sees the text alone. One in FOLDS of those rows (by hash of the text) calibrates: it is scored by
    models of the other rows, so on texts that they didn't learn from. score: share of right predictions there at a like margin.
    rejected: the language is still named, but the score is under a half or the cross-entropy far above what
    the language's rows have. Null texts, and texts without a letter, are "und" with score 0, as is every text if
    nothing could be learned. Repeated rows come back as often as they are there. No rows give no rows.
    """
    held_out = remainder(F.col("doc_id"), 3) == 1
    known = (docs if learn_from is None else learn_from).where(~held_out & F.col("lang").isNotNull())
    test = F.pmod(F.xxhash64("text"), F.lit(FOLDS)) == 0
    counts = cut(count_grams(known.select("lang", test.alias("test"), "text")))
    langs = sorted(r["lang"] for r in counts.select("lang").distinct().collect())  # names alone come to the driver
    if not langs:
        return docs.select("doc_id", held_out.alias("held_out"), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("cross_entropy"), F.lit(True).alias("rejected"))
    name = F.get(F.array(*[F.lit(x) for x in langs]), F.col("best"))
    # both models are built at once: language k's of all rows has number k, that of the rows that don't calibrate comes after all those
    numbers = docs.sparkSession.createDataFrame(list(enumerate(langs)), "place int, lang string")
    both = counts.join(F.broadcast(numbers) if len(langs) <= 10_000 else numbers, "lang").selectExpr("gram", "n", f"explode(if(test, array(place), array(place, place + {len(langs)}))) as lang")
    models = cut(kneser_ney(cut(both.groupBy("lang", "gram").agg(F.sum("n").alias("n")))))
    whole, others = models.where(F.col("lang") < len(langs)).withColumnRenamed("lang", "place"), models.where(F.col("lang") >= len(langs)).withColumn("place", F.col("lang") - len(langs)).drop("lang")
    seen = scored(known.where(test).select("lang", "text"), others, langs, most).where("best is not null")
    step = F.least(F.lit(STEPS - 1), F.floor(F.col("margin") / STEP).cast("int"))
    seen = cut(seen.select(name.alias("pred"), (name == F.col("lang")).alias("right"), step.alias("step"), "entropy"))
    steps = {r["step"]: (r["right"], r["n"]) for r in seen.groupBy("step").agg(F.count("*").alias("n"), F.sum(F.col("right").cast("long")).alias("right")).collect()}
    rising = _rising(*np.array([steps.get(k, (0, 0)) for k in range(STEPS)], float).T)
    usual = {r["pred"]: (r["m"], r["s"]) for r in seen.groupBy("pred").agg(F.avg("entropy").alias("m"), F.stddev_pop("entropy").alias("s")).collect()}
    limit = F.get(F.array(*[F.lit(float(usual[x][0] + FAR * usual[x][1]) if x in usual else math.inf) for x in langs]), F.col("best"))
    score = F.when(F.col("best").isNull(), 0.0).otherwise(F.get(F.array(*[F.lit(float(x)) for x in rising]), step))
    every = scored(docs.select("doc_id", held_out.alias("held_out"), "text"), whole, langs, most)
    return every.select(
        "doc_id", "held_out", F.coalesce(name, F.lit("und")).alias("lang_pred"), score.alias("score"), F.when(F.col("best").isNotNull(), F.col("entropy")).alias("cross_entropy"),
        (F.col("best").isNull() | (score < 0.5) | (F.col("entropy") > limit)).alias("rejected"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document (see identify)."""
    return identify(table(spark, sf_dir, "documents"))
