"""Quality classifier: hashed word n-gram logistic regression, follow-the-regularised-leader updates.

A text is a sparse vector of hashed n-grams (one and two words, and the same
over word shapes, where letters become ``a`` and digits ``0``; a pair of equal
words is one n-gram, whatever the word). A value is the
n-gram's share of the text, times a constant. Training shards run FTRL-proximal
on their rows and their weights are averaged; a score is the sparse dot product
of text and weights, put through the logistic function. Texts are scored
where they are read: nothing but the weights (a fixed number of them) moves.

Defined results:

* null, empty and white-space texts have no n-gram; they get the score of the bias;
* label rows with a null id or label are no training rows; several labels of one
  document count as their rounded mean;
* no training rows at all: every score is 0.5;
* a null ``doc_id`` is not held out; repeated rows are scored one by one;
* only ``doc_id`` and ``text`` are read, so other columns may have any name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm.common import materialize, table, text_batches

#: Fixed by the contract: remainder of crc32(doc_id) mod 5 that is held out, and the least score that passes.
HELD_OUT_REMAINDER = 0
FOLDS = 5
LEAST_SCORE = 0.3


@dataclass(frozen=True)
class Training:
    """``max_rows`` bounds the labelled sample (those of the smallest id hashes); ``shard_rows`` the rows of one trainer."""

    max_rows: int = 30_000
    shard_rows: int = 4_000
    bits: int = 18
    epochs: int = 3
    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 0.0
    l2: float = 1e-4
    scale: float = 60.0


class NgramHasher:
    """Words to hashed n-gram slots; hashes of seen words are kept, up to a bound."""

    KEPT_WORDS = 400_000

    def __init__(self, bits: int):
        self.bits = bits
        self.seen: dict[str, int] = {}

    def _codes(self, words: list[str]) -> np.ndarray:
        seen = self.seen
        if len(seen) > self.KEPT_WORDS:
            seen.clear()
        for word in set(words).difference(seen):
            shape = re.sub(r"\d+", "0", re.sub(r"[^\W\d_]+", "a", word))
            seen[word] = xxhash.xxh32_intdigest(word) << 32 | xxhash.xxh32_intdigest(shape, 1)
        return np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))

    def slots(self, text: str | None) -> np.ndarray:
        words = text.split() if text else []
        if not words:
            return np.empty(0, np.int64)
        codes = self._codes(words)
        parts = []
        for family, ids in enumerate((codes >> np.uint64(32), codes & np.uint64(0xFFFFFFFF))):
            one = (ids + np.uint64(1 + family)) * np.uint64(0x9E3779B97F4A7C15)
            parts.append(one)
            two = (one[:-1] ^ (one[1:] >> np.uint64(7))) * np.uint64(0xC2B2AE3D27D4EB4F)
            parts.append(np.where(one[:-1] == one[1:], np.uint64((family + 1) << 60), two))
        return (np.concatenate(parts) >> np.uint64(64 - self.bits)).astype(np.int64)


def probability(margin: np.ndarray | float) -> np.ndarray | float:
    return 1.0 / (1.0 + np.exp(-np.clip(margin, -35.0, 35.0)))


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, float]], how: Training) -> np.ndarray:
    """Weights after ``epochs`` passes of FTRL-proximal; the last one is the bias."""
    size = (1 << how.bits) + 1
    z, n = np.zeros(size), np.zeros(size)

    def weights(at: np.ndarray) -> np.ndarray:
        zi = z[at]
        w = -(zi - np.sign(zi) * how.l1) / ((how.beta + np.sqrt(n[at])) / how.alpha + how.l2)
        return np.where(np.abs(zi) <= how.l1, 0.0, w)

    for _ in range(how.epochs):
        for at, x, y in rows:
            w = weights(at)
            g = (probability(float(w @ x)) - y) * x
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / how.alpha
            z[at] += g - sigma * w
            n[at] += g * g
    return weights(np.arange(size))


def held_out(doc_id: Column) -> Column:
    remainder = F.crc32(doc_id.cast("string").cast("binary")) % FOLDS
    return F.coalesce(remainder == HELD_OUT_REMAINDER, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, how: Training) -> DataFrame:
    """``order, text, y`` of the sample. Its ids are at most ``how.max_rows``, so they are broadcast."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
    sample = (
        usable.groupBy("doc_id")
        .agg(F.round(F.avg("quality")).cast("double").alias("y"))
        .withColumn("order", F.xxhash64("doc_id"))
        .orderBy("order", "doc_id")
        .limit(how.max_rows)
    )
    return docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("order", "text", "y")


def train(docs: DataFrame, labels: DataFrame, how: Training = Training()) -> np.ndarray:
    """Averaged weights of the shards; only non-zero ones travel, at most ``2 ** bits + 1``."""
    text_batches(docs.sparkSession)
    shards = -(-how.max_rows // how.shard_rows)

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        hasher = NgramHasher(how.bits)
        vectors = []
        for text, y in rows.sort_values("order")[["text", "y"]].itertuples(index=False):
            at, counts = np.unique(hasher.slots(text), return_counts=True)
            x = counts * (how.scale * 4 / max(1, counts.sum()))
            vectors.append((np.append(at, 1 << how.bits), np.append(x, 1.0), y))
        w = ftrl(vectors, how)
        used = np.flatnonzero(w)
        return pd.DataFrame({"slot": used, "w": w[used]})

    sample = training_rows(docs, labels, how).withColumn("shard", F.pmod("order", F.lit(shards)))
    fitted = materialize(sample.groupBy("shard").applyInPandas(fit, "slot long, w double"), "quality-weights")
    trained = sample.select("shard").distinct().count()
    weights = np.zeros((1 << how.bits) + 1)
    for slot, w in fitted.groupBy("slot").agg(F.sum("w").alias("w")).toPandas().itertuples(index=False):
        weights[int(slot)] = w / trained
    return weights


def scorer(spark: SparkSession, weights: np.ndarray, how: Training = Training()):
    """A column function from text to score."""
    shared = spark.sparkContext.broadcast(weights)

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        w, hasher = shared.value, NgramHasher(how.bits)

        def one(text: str | None) -> float:
            at = hasher.slots(text)
            return w[-1] + (w[at].sum() * (how.scale * 4 / len(at)) if len(at) else 0.0)

        for batch in texts:
            yield pd.Series(probability(np.fromiter(map(one, batch), np.float64, len(batch))))

    return score


def score_documents(docs: DataFrame, labels: DataFrame, how: Training = Training()) -> DataFrame:
    """Per row of ``docs``: ``doc_id, held_out, score, predicted``."""
    score = scorer(docs.sparkSession, train(docs, labels, how), how)
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score("text").alias("score")).withColumn(
        "predicted", (F.col("score") >= LEAST_SCORE).cast("int")
    )


def good_documents(docs: DataFrame, labels: DataFrame, how: Training = Training()) -> DataFrame:
    """The rows of ``docs`` whose score passes, with all their columns."""
    score = scorer(docs.sparkSession, train(docs, labels, how), how)
    return docs.where(score("text") >= LEAST_SCORE)


def op5_quality(spark: SparkSession, folder: str) -> DataFrame:
    return score_documents(table(spark, folder, "documents"), table(spark, folder, "labels"))
