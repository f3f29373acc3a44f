"""SentencePiece encoding and decoding over a table of distinct chunks."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import cut, most_frequent, quoted, small_batches, table

#: Bytes of chunks and ids (with what a dictionary needs for them) that every worker gets at most, about.
TABLE_BYTES = 48 << 20
#: Characters of the texts that are put together at a time.
BLOCK_CHARS = 1 << 20
#: Distinct chunks, and their characters, that a worker counts before it hands them on.
HELD, HELD_CHARS = 1 << 18, 1 << 24
MARK = "▁"
RUN = re.compile(" +[^ ]*")


def chunks(text: str | None) -> list[str]:
    """Keys of a text's chunks, in order: runs of whitespace marks with what follows up to the next mark, each without its first mark (the model puts one before any text)."""
    plain = (text or "").replace(MARK, " ")
    if "  " in plain or plain[:1] == " " or plain[-1:] == " ":
        return [x[1:] for x in RUN.findall(f" {plain}")]
    return plain.split(" ") if plain else []


class Segmenter:
    """The library's model, once it is clear that texts can be cut at whitespace marks.

    No piece of the model has a mark after another character, so no merge crosses the start of a chunk, and the
    ids of a text are the ids of its chunks in order.
    """

    def __init__(self, path: str | None):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path or model_path())
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces):
            raise ValueError("a piece of this model crosses a whitespace mark: its texts can't be cut there")
        if self.model.decode(self.model.encode("ﬁ  x² ")) != "ﬁ  x² ":
            raise ValueError("this model changes texts before it encodes them")
        self.alone = self.model.encode("x ")[-1:]  # a mark with nothing behind it: by itself the empty text, which has no ids
        if self.model.id_to_piece(self.alone[0]) != MARK:
            raise ValueError("this model has no piece for a single whitespace mark")

    def __call__(self, keys: list[str]) -> pd.DataFrame:
        """chunk, its ids and its decoded text, for each key."""
        ids = [x if key else self.alone for key, x in zip(keys, self.model.encode(keys, num_threads=1), strict=True)]
        return pd.DataFrame({"chunk": keys, "ids": pd.Series([np.array(x, np.int32) for x in ids], dtype=object), "plain": self.model.decode(ids) if keys else []})


@lru_cache(maxsize=4)
def segmenter(path: str | None) -> Segmenter:
    """One for each worker process and model."""
    return Segmenter(path)


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def distinct_chunks(docs: DataFrame) -> DataFrame:
    """(chunk, n): every distinct chunk of the texts and how often it occurs."""
    small_batches(docs.sparkSession)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter[str] = Counter()
        chars = 0
        for batch in batches:
            for text in batch["text"]:
                held.update(chunks(text))
                chars += len(text or "")
                if len(held) > HELD or chars > HELD_CHARS:
                    yield pd.DataFrame({"chunk": list(held), "n": list(held.values())})
                    held, chars = Counter(), 0
        if held:
            yield pd.DataFrame({"chunk": list(held), "n": list(held.values())})

    return docs.select("text").mapInPandas(count, "chunk string, n long").groupBy("chunk").agg(F.sum("n").alias("n"))


def segmented(found: DataFrame, segment: Callable[[list[str]], pd.DataFrame]) -> DataFrame:
    """(chunk, ids, plain, n) for each row of found(chunk, n), written to the shared folder: each chunk is segmented once. plain is its decoded text."""

    @F.pandas_udf("ids array<int>, plain string")
    def of(keys: pd.Series) -> pd.DataFrame:
        return segment(keys.tolist())[["ids", "plain"]]

    # the exchange by chunk lies below: a chunk reaches one task once
    return cut(found.select("chunk", "n", of("chunk").alias("s")).select("chunk", "s.ids", "s.plain", "n"))


def encode(docs: DataFrame, path: str | None = None, *keep: str, most: int = TABLE_BYTES) -> DataFrame:
    """The columns named in keep (doc_id if none), then ids array<int> and decoded string, for each row of docs.

    path: a model file that every executor can open; by default the installed one. The table has the most
    frequent chunks, up to `most` bytes: each is segmented once, and texts are put together from their ids by position. A rarer
    chunk, which mostly stands once in the corpus, is segmented where it stands, once a batch: joined to its
    position it would drag every text through a shuffle. Null and empty texts have no ids and an empty decoded
    text. Repeated rows come back as often as they are there. No rows give no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    found = cut(distinct_chunks(docs))
    near, _ = most_frequent(found, 6 * F.octet_length("chunk") + 200, most)  # a byte has one id at most
    got = segmented(near, lambda keys: segmenter(path)(keys)).select("chunk", "ids", F.when(F.col("plain") != F.col("chunk"), F.col("plain")).alias("plain")).toArrow()
    keys = got["chunk"].to_pylist()
    ids = dict(zip(keys, (x.values.to_numpy().tobytes() for x in got["ids"]), strict=True))
    sent = spark.sparkContext.broadcast((ids, {k: p for k, p in zip(keys, got["plain"].to_pylist(), strict=True) if p is not None}))

    @F.pandas_udf("ids array<int>, decoded string")
    def of(texts: pd.Series) -> pd.DataFrame:
        known, odd = sent.value
        out, at = [], 0
        while at < len(texts):
            own, chars = [], 0
            while at < len(texts) and (not own or chars < BLOCK_CHARS):
                own.append(chunks(texts.iat[at]))
                chars += len(texts.iat[at] or "")
                at += 1
            rare = sorted(set(chain.from_iterable(own)) - known.keys())
            seg = segmenter(path)(rare) if rare else None
            more = {} if seg is None else {k: x.tobytes() for k, x in zip(rare, seg["ids"], strict=True)}
            plain = odd if seg is None else odd | {k: p for k, p in zip(rare, seg["plain"], strict=True) if p != k}
            for part in own:
                raw = b"".join([known[k] if k in known else more[k] for k in part])
                out.append((np.frombuffer(raw, np.int32), " ".join(part if plain.keys().isdisjoint(part) else [plain.get(k, k) for k in part])))
        return pd.DataFrame({"ids": pd.Series([i for i, _ in out], dtype=object), "decoded": pd.Series([d for _, d in out], dtype=object)})

    kept = [F.col(quoted(c)) for c in keep or ("doc_id",)]
    return docs.select(*kept, of(F.col("text")).alias("_pieces")).select(*kept, "_pieces.ids", "_pieces.decoded")


def digests(encoded: DataFrame) -> DataFrame:
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every whole text, as digests. A row of docs is a row of the result."""
    return digests(encode(table(spark, sf_dir, "documents")))
