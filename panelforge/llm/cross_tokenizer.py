"""Cross-tokenizer alignment with counts under a minimal perfect hash.

A first pass aligns every text under both tokenizers and counts, per task, the
links of every pair of ids. The distinct pairs are dealt to buckets by hash; each
bucket gets a minimal perfect hash of its pairs. Under it the tasks' counts become
dense vectors, which are summed in a tree of bounded width. The finished buckets
(places, keys to verify against, counts, whether a count is the highest of its id
of B) are what the second pass looks links up in, aligning the texts again.

The buckets are sent to the tasks while they have at most :data:`SENT_PAIRS` pairs
together, whatever their share of the possible ones (the product of both vocabularies);
beyond that, the links of every text meet the buckets in a join, with the same results.

Defined results:

* null and empty texts, and texts whose tokens do not join to the blank and the text
  again under both tokenizers, have no tokens: zeros and an empty digest;
* strings of special tokens are ordinary text;
* repeated rows count again and give one row each; null ids are kept;
* texts of any length are aligned whole; an empty table gives no rows;
* a key that its bucket does not hold is an error, never a wrong count;
* only ``doc_id`` and ``text`` are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm.common import materialize, table, text_batches
from panelforge.llm.perfect_hash import PerfectHash, scrambled
from panelforge.llm.token_alignment import Aligner, Tokenizers

#: Vocabulary files of the two tokenizers.
VOCABULARY_A = "/opt/tokenizers/byte_bpe_50k.json"
VOCABULARY_B = "/opt/tokenizers/piece_bpe_32k.model"

#: Pairs of a bucket, on average.
BUCKET_PAIRS = 8_192
#: Vectors summed at a node of the tree.
TREE_WIDTH = 16
#: Pairs that are sent to the tasks at most (some 40 bytes each).
SENT_PAIRS = 2_000_000

_ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
_BUCKET = "bucket long, taken binary, sizes array<long>, keys binary"


@dataclass(frozen=True)
class Files:
    """Contents of the vocabulary files, as the tasks get them."""

    json: bytes
    model: bytes

    @classmethod
    def read(cls, a: str, b: str) -> Files:
        with open(a, "rb") as first, open(b, "rb") as second:
            return cls(first.read(), second.read())

    def aligner(self, with_groups: bool = True) -> Aligner:
        return Aligner(Tokenizers(self.json, self.model), with_groups)


def _bucket(pairs: np.ndarray, buckets: int) -> np.ndarray:
    return (scrambled(pairs, 1 << 20) >> np.uint64(32)).astype(np.int64) % buckets


def _batched(batches: Iterator[pa.RecordBatch], aligner: Aligner) -> Iterator[tuple[pa.RecordBatch, list[list[int]]]]:
    for batch in batches:
        if aligner.is_full():
            aligner.clear()
        yield batch, aligner.texts(batch.column("text").to_pylist())


# ---- first pass: counts -------------------------------------------------------


def task_counts(docs: DataFrame, files) -> DataFrame:
    """``task, pair, n``: how many links every task met of every pair of ids."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        aligner = files.value.aligner(with_groups=False)
        met = np.zeros(0, np.int64)

        def flushed() -> pa.RecordBatch:
            pairs, sizes = aligner.pairs(), aligner.column("n_links")
            times = np.repeat(np.pad(met, (0, max(0, aligner.size - len(met)))), sizes)
            found, place = np.unique(pairs[times > 0], return_inverse=True)
            n = np.bincount(place, times[times > 0], len(found)).astype(np.int64)
            return pa.record_batch({"task": np.full(len(found), task, np.int64), "pair": found, "n": n})

        for batch in batches:
            if aligner.is_full():
                yield flushed()
                aligner.clear()
                met = np.zeros(0, np.int64)
            numbers = aligner.texts(batch.column("text").to_pylist())
            seen = np.fromiter(chain.from_iterable(numbers), np.int64, sum(map(len, numbers)))
            more = np.bincount(seen, minlength=aligner.size)
            more[: len(met)] += met
            met = more
        yield flushed()

    counted = docs.select("text").mapInArrow(count, "task long, pair long, n long")
    # a task that forgot its segments on the way counted some pairs more than once
    return counted.groupBy("task", "pair").agg(F.sum("n").alias("n"))


# ---- minimal perfect hash and its vectors ---------------------------------------


def perfect_buckets(pairs: DataFrame) -> DataFrame:
    """``bucket, taken, sizes, keys`` of distinct ``bucket, pair``; ``keys`` are the pairs by slot, to verify against."""

    def build(part: pd.DataFrame) -> pd.DataFrame:
        keys = part["pair"].to_numpy(np.int64)
        hashed = PerfectHash.of(keys)
        by_slot = np.empty(len(keys), np.int64)
        by_slot[hashed.slots(keys)] = keys
        taken, sizes = hashed.packed()
        return pd.DataFrame(
            {"bucket": [part["bucket"].iloc[0]], "taken": [taken], "sizes": [sizes], "keys": [by_slot.tobytes()]}
        )

    return pairs.groupBy("bucket").applyInPandas(build, _BUCKET)


def dense_vectors(counts: DataFrame, buckets: DataFrame) -> DataFrame:
    """``bucket, node, vector``: the counts of a task by slot, one vector per bucket it met."""

    def spread(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            vectors = []
            for taken, sizes, keys, pairs, n in zip(part["taken"], part["sizes"], part["keys"], part["pairs"], part["ns"]):
                slots = verified(PerfectHash.unpacked(taken, sizes), np.frombuffer(keys, np.int64), np.asarray(pairs, np.int64))
                vector = np.zeros(len(keys) // 8, np.int64)
                vector[slots] = n
                vectors.append(vector.tobytes())
            yield pd.DataFrame({"bucket": part["bucket"], "node": part["task"], "vector": vectors})

    listed = counts.groupBy("bucket", "task").agg(F.collect_list(F.struct("pair", "n")).alias("met"))
    listed = listed.select("bucket", "task", F.col("met.pair").alias("pairs"), F.col("met.n").alias("ns"))
    return listed.join(buckets, "bucket").mapInPandas(spread, "bucket long, node long, vector binary")


def verified(hashed: PerfectHash, keys: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    slots = hashed.slots(pairs)
    if len(pairs) and not np.array_equal(keys[slots], pairs):
        raise ValueError("a pair of ids is missing from its bucket")
    return slots


def tree_summed(vectors: DataFrame, leaves: int) -> DataFrame:
    """``bucket, vector``: vectors of a bucket summed by :data:`TREE_WIDTH` at a time."""

    def add(part: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(v, np.int64) for v in part["vector"])
        return pd.DataFrame({"bucket": [part["bucket"].iloc[0]], "node": [part["node"].iloc[0]], "vector": [total.tobytes()]})

    while leaves > 1:
        vectors = vectors.withColumn("node", F.floor(F.col("node") / TREE_WIDTH))
        vectors = vectors.groupBy("bucket", "node").applyInPandas(add, vectors.schema)
        leaves = -(-leaves // TREE_WIDTH)
    return vectors.select("bucket", "vector")


def pair_table(docs: DataFrame, files, ids_b: int) -> tuple[DataFrame, int]:
    """``bucket, taken, sizes, keys, counts, best`` of all linked pairs, and the number of buckets."""
    counts = materialize(task_counts(docs, files), "task-counts")
    pairs = materialize(counts.select("pair").distinct(), "pairs")
    n_buckets = 1 + pairs.count() // BUCKET_PAIRS

    @F.pandas_udf("long")
    def bucket(pair: pd.Series) -> pd.Series:
        return pd.Series(_bucket(pair.to_numpy(np.int64), n_buckets))

    buckets = materialize(perfect_buckets(pairs.withColumn("bucket", bucket("pair"))), "buckets")
    leaves = 1 + (counts.agg(F.max("task")).first()[0] or 0)
    summed = tree_summed(dense_vectors(counts.withColumn("bucket", bucket("pair")), buckets), leaves)
    summed = materialize(buckets.join(summed, "bucket"), "counts")
    flat = summed.mapInPandas(_flat, "pair long, n long")
    # one number per id of B, a vocabulary's size at most
    highest = flat.groupBy((F.col("pair") % ids_b).alias("b")).agg(F.max("n").alias("highest"))
    most = np.zeros(ids_b, np.int64)
    for row in highest.collect():
        most[row["b"]] = row["highest"]
    most = docs.sparkSession.sparkContext.broadcast(most)

    def marked(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            best = [
                (np.frombuffer(v, np.int64) == most.value[np.frombuffer(k, np.int64) % ids_b]).astype(np.uint8).tobytes()
                for k, v in zip(part["keys"], part["vector"])
            ]
            yield part.rename(columns={"vector": "counts"}).assign(best=best)

    return materialize(summed.mapInPandas(marked, _BUCKET + ", counts binary, best binary"), "pair-table"), n_buckets


def _flat(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        for keys, vector in zip(part["keys"], part["vector"]):
            yield pd.DataFrame({"pair": np.frombuffer(keys, np.int64), "n": np.frombuffer(vector, np.int64)})


def pair_counts(docs: DataFrame, vocabulary_a: str = VOCABULARY_A, vocabulary_b: str = VOCABULARY_B) -> DataFrame:
    """``a, b, n``: links of every pair of ids in all texts."""
    contents = Files.read(vocabulary_a, vocabulary_b)
    ids_b = contents.aligner().tokenizers.b.get_piece_size()
    found, _ = pair_table(docs, docs.sparkSession.sparkContext.broadcast(contents), ids_b)
    flat = found.withColumnRenamed("counts", "vector").mapInPandas(_flat, "pair long, n long")
    return flat.select(F.floor(F.col("pair") / ids_b).alias("a"), (F.col("pair") % ids_b).alias("b"), "n")


# ---- second pass: lookups --------------------------------------------------------


class Lookup:
    """All buckets in one: slots of a bucket lie behind those of the buckets before it."""

    def __init__(self, rows: list, n_buckets: int):
        self.n_buckets = n_buckets
        self.hashes: dict[int, PerfectHash] = {r["bucket"]: PerfectHash.unpacked(r["taken"], r["sizes"]) for r in rows}
        self.keys = {r["bucket"]: np.frombuffer(r["keys"], np.int64) for r in rows}
        self.counts = {r["bucket"]: np.frombuffer(r["counts"], np.int64) for r in rows}
        self.best = {r["bucket"]: np.frombuffer(r["best"], np.uint8) for r in rows}

    def of(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count, and whether it is the best, of every pair."""
        distinct, inverse = np.unique(pairs, return_inverse=True)
        count, best = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
        bucket = _bucket(distinct, self.n_buckets)
        order = np.argsort(bucket, kind="stable")
        starts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
        for rows in np.split(order, starts[1:]) if len(order) else []:
            b = int(bucket[rows[0]])
            slots = verified(self.hashes[b], self.keys[b], distinct[rows])
            count[rows], best[rows] = self.counts[b][slots], self.best[b][slots]
        return count[inverse], best[inverse]


def _rows(batch: pa.RecordBatch, numbers: list[list[int]], aligner: Aligner) -> dict[str, pa.Array | np.ndarray]:
    out = {"doc_id": batch.column("doc_id")}
    sums = _Sums(numbers)
    for name in ("n_a", "n_b", "n_groups", "n_links"):
        out[name] = sums.of(aligner.column(name))
    out["groups_sha256"] = [
        hashlib.sha256(";".join(map(aligner.groups.__getitem__, n)).encode()).hexdigest() if n else "" for n in numbers
    ]
    return out


class _Sums:
    """Sums over the segments of every text."""

    def __init__(self, numbers: list[list[int]]):
        self.flat = np.fromiter(chain.from_iterable(numbers), np.int64, sum(map(len, numbers)))
        self.row = np.repeat(np.arange(len(numbers)), list(map(len, numbers)))
        self.rows = len(numbers)

    def of(self, per_segment: np.ndarray) -> np.ndarray:
        total = np.zeros(self.rows, np.int64)
        np.add.at(total, self.row, per_segment[self.flat])
        return total


def _looked_up(docs: DataFrame, files, lookup) -> DataFrame:
    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = files.value.aligner()
        since = None
        for batch, numbers in _batched(batches, aligner):
            if since != aligner.cleared:  # the first batch, or one after segments were forgotten
                since, parts, n_best, count_sum = aligner.cleared, 0, np.zeros(0, np.int64), np.zeros(0, np.int64)
            count, best = lookup.value.of(aligner.pairs(parts, forget=True))
            sizes = aligner.column("n_links")[len(n_best) :]
            row = np.repeat(np.arange(len(sizes)), sizes)
            more = np.zeros((2, len(sizes)), np.int64)
            np.add.at(more[0], row, best)
            np.add.at(more[1], row, count)
            n_best, count_sum, parts = np.r_[n_best, more[0]], np.r_[count_sum, more[1]], len(aligner.parts)
            sums = _Sums(numbers)
            yield pa.record_batch(_rows(batch, numbers, aligner) | {"n_best": sums.of(n_best), "count_sum": sums.of(count_sum)})

    return docs.select("doc_id", "text").mapInArrow(look, _ALIGNED + ", n_best long, count_sum long")


def _joined_up(docs: DataFrame, files, found: DataFrame) -> DataFrame:
    """The same by a join: every row's distinct pairs meet the counts. Rows are numbered in a written table."""

    def list_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = files.value.aligner()
        for batch, numbers in _batched(batches, aligner):
            pairs, sizes = aligner.pairs(), aligner.column("n_links")
            starts = np.cumsum(sizes) - sizes
            listed, times = [], []
            for segments in numbers:
                met = np.concatenate([np.zeros(0, np.int64), *[pairs[starts[s] : starts[s] + sizes[s]] for s in segments]])
                distinct, n = np.unique(met, return_counts=True)
                listed.append(distinct)
                times.append(n)
            yield pa.record_batch(_rows(batch, numbers, aligner) | {"pairs": listed, "times": times})

    flat = found.mapInPandas(_flat_best, "pair long, n long, best int")
    aligned = docs.select("doc_id", "text").mapInArrow(list_pairs, _ALIGNED + ", pairs array<long>, times array<long>")
    aligned = materialize(aligned.withColumn("row", F.monotonically_increasing_id()), "aligned")
    links = aligned.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("l"))
    links = links.select("row", F.col("l.pairs").alias("pair"), F.col("l.times").alias("times")).join(flat, "pair")
    sums = links.groupBy("row").agg(F.sum(F.col("best") * F.col("times")).alias("n_best"), F.sum(F.col("n") * F.col("times")).alias("count_sum"))
    zero = F.lit(0).cast("long")
    return (
        aligned.drop("pairs", "times")
        .join(sums, "row", "left")
        .withColumns({"n_best": F.coalesce("n_best", zero), "count_sum": F.coalesce("count_sum", zero)})
        .drop("row")
    )


def _flat_best(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        for keys, counts, best in zip(part["keys"], part["counts"], part["best"]):
            yield pd.DataFrame(
                {"pair": np.frombuffer(keys, np.int64), "n": np.frombuffer(counts, np.int64), "best": np.frombuffer(best, np.uint8)}
            )


def align_documents(
    docs: DataFrame, vocabulary_a: str = VOCABULARY_A, vocabulary_b: str = VOCABULARY_B, sent_pairs: int = SENT_PAIRS
) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every row of ``docs``."""
    spark = docs.sparkSession
    text_batches(spark)
    contents = Files.read(vocabulary_a, vocabulary_b)
    files = spark.sparkContext.broadcast(contents)
    found, n_buckets = pair_table(docs, files, contents.aligner().tokenizers.b.get_piece_size())
    if n_buckets * BUCKET_PAIRS <= sent_pairs:
        looked = _looked_up(docs, files, spark.sparkContext.broadcast(Lookup(found.collect(), n_buckets)))
    else:
        looked = _joined_up(docs, files, found)
    return looked.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op11_cross_tokenizer(spark: SparkSession, folder: str) -> DataFrame:
    return align_documents(table(spark, folder, "documents"))
