"""Approximate nearest neighbours by inner product: stable projections, a kd-tree, a chi-square stopping test.

A vector gets one more component, so that all have the largest norm and a
larger inner product is a smaller distance. Gaussian (2-stable) projections
take it to a few dimensions, where a projected distance is the true one times a
chi-square variable. A query takes candidates in the order of projected
distance, verifies each on the original vector, and stops when the next
projected distance is so large that a nearer vector than its k-th best would
show it with a probability below ``1 - sure`` only.

The upper kd-tree (at most ``2 ** MOST_LEVELS`` leaves) is fitted on a bounded
sample and deals all rows to blocks; inside a block a kd-tree of small leaves
gives the projected order. Each query first searches the block that it falls
into, which bounds its k-th distance, and then every block that the stopping
test leaves open.

Defined results:

* vectors that are null, empty, zero, or hold null or non-finite components take
  no part, as rows or as queries; a null ``vec_id`` takes no part either;
* vectors of another length only meet each other;
* a query's own row is every row of its ``vec_id``; repeated rows count once;
* fewer rows than ``k``: all are returned; ties go to the smaller ``vec_id``;
* only ``vec_id`` and ``embedding`` are read, so other columns may have any name.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelforge.llm.common import materialize, table

#: Fixed by the contract: neighbours, and which rows are queries.
K = 20
QUERY_EVERY = 20

#: Projected dimensions, and the least probability that a true neighbour is met.
DIMENSIONS = 32
SURE = 0.92

#: The upper tree: rows in its sample, most levels, and rows of a block.
SAMPLE_ROWS = 20_000
MOST_LEVELS = 10
BLOCK_ROWS = 4_096

#: Queries that a task takes with a block, queries measured at once, rows of a block's small leaves, rows verified at once.
BLOCK_QUERIES = 10_000
QUERY_RUN = 256
SMALL_LEAF = 32
RUN_ROWS = 256


def chi_square_bound(sure: float, dimensions: int) -> float:
    """The quantile of the chi-square distribution, for an even number of dimensions."""

    def below(x: float) -> float:
        return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(dimensions // 2))

    low, high = 0.0, 1000.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if below(middle) < sure else (low, middle)
    return high


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, v, norm2``: the rows that take part, components in double precision."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    norm2 = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and size(v) > 0")
    return rows.where(F.coalesce(finite, F.lit(False))).withColumn("norm2", norm2).where("norm2 > 0")


def projection(length: int, dimensions: int = DIMENSIONS) -> np.ndarray:
    """The same in every task: ``length + 1`` rows of Gaussian numbers."""
    return np.random.default_rng(10_007 * length + dimensions).standard_normal((length + 1, dimensions))


def project(v: np.ndarray, norm2: np.ndarray, largest: float) -> np.ndarray:
    a = projection(v.shape[1])
    return v @ a[:-1] + np.sqrt(np.maximum(0.0, largest - norm2))[:, None] * a[-1]


def split_tree(points: np.ndarray, levels: int) -> list[np.ndarray]:
    """Per level the dimension and value of each node's cut, at the median of its widest dimension."""
    tree, parts = [], [points]
    for _ in range(levels):
        cuts, below = [], []
        for part in parts:
            dim = int(np.argmax(np.ptp(part, axis=0))) if len(part) else 0
            value = float(np.median(part[:, dim])) if len(part) else 0.0
            cuts.append((dim, value))
            right = part[:, dim] > value
            below += [part[~right], part[right]]
        tree.append(np.array(cuts))
        parts = below
    return tree


def leaf_of(tree: list[np.ndarray], points: np.ndarray) -> np.ndarray:
    node = np.zeros(len(points), np.int64)
    for cuts in tree:
        dim, value = cuts[node, 0].astype(np.int64), cuts[node, 1]
        node = 2 * node + (points[np.arange(len(points)), dim] > value)
    return node


class Block:
    """Rows of a block in a kd-tree of small leaves."""

    def __init__(self, rows: pd.DataFrame, largest: float, k: int):
        rows = rows.sort_values("vec_id").drop_duplicates("vec_id")
        v = np.stack(rows["v"].to_numpy())
        # of equal vectors no query needs more than its k best and its own row
        same = np.unique(v, axis=0, return_inverse=True)[1].reshape(-1)
        nth = pd.Series(same).groupby(same).cumcount().to_numpy()
        keep = nth <= k
        ids, v = rows["vec_id"].to_numpy()[keep], v[keep]
        p = project(v, (v * v).sum(axis=1), largest)
        leaves = self._cut(p, np.arange(len(p)))
        order = np.concatenate(leaves)
        self.ids, self.v, self.p, self.largest, self.k = ids[order], v[order], p[order], largest, k
        self.leaf = np.repeat(np.arange(len(leaves)), [len(x) for x in leaves])
        self.low = np.array([p[x].min(axis=0) for x in leaves])
        self.high = np.array([p[x].max(axis=0) for x in leaves])

    def _cut(self, p: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
        if len(at) <= SMALL_LEAF:
            return [at]
        dim = int(np.argmax(np.ptp(p[at], axis=0)))
        order = at[np.argsort(p[at, dim], kind="stable")]
        return self._cut(p, order[: len(at) // 2]) + self._cut(p, order[len(at) // 2 :])

    def distances(self, pq: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the leaves that lie within ``reach`` of any of the queries, and their squared projected distances."""
        box = np.zeros((len(pq), len(self.low)))
        for d in range(pq.shape[1]):
            gap = np.maximum(0.0, np.maximum(self.low[:, d] - pq[:, d, None], pq[:, d, None] - self.high[:, d]))
            box += gap * gap
        at = np.flatnonzero((box <= reach[:, None]).any(axis=0)[self.leaf])
        p = self.p[at]
        return at, (pq * pq).sum(axis=1)[:, None] + (p * p).sum(axis=1) - 2 * pq @ p.T

    def search(self, query_id: int, q: np.ndarray, at: np.ndarray, far: np.ndarray, known: float, bound: float) -> tuple[np.ndarray, np.ndarray]:
        """Ids and inner products of the best ``k`` among the rows ``at``, which are ``far`` in the projection.

        ``known`` is a k-th squared distance found elsewhere. Rows are verified
        in runs, nearest in the projection first, until the test holds.
        """
        near = np.flatnonzero(far <= bound * known)
        near = near[np.argsort(far[near], kind="stable")]
        norm = self.largest + float((q * q).sum())
        ids, scores, kth, done = np.empty(0, np.int64), np.empty(0), known, 0
        while done < len(near) and far[near[done]] <= bound * kth:
            some = at[near[done : done + RUN_ROWS]]
            done += RUN_ROWS
            some = some[self.ids[some] != query_id]
            # row sums, not a matrix product: equal vectors get equal scores wherever they stand
            ids, scores = np.append(ids, self.ids[some]), np.append(scores, (self.v[some] * q).sum(axis=1))
            best = np.lexsort((ids, -scores))[: self.k]
            ids, scores = ids[best], scores[best]
            if len(ids) == self.k:
                kth = min(known, max(0.0, norm - 2 * scores[-1]))
        return ids, scores


def _search_block(rows: pd.DataFrame, queries: pd.DataFrame, largest: float, bound: float, k: int) -> pd.DataFrame:
    found = {"query_id": [], "vec_id": [], "score": []}
    if len(rows) and len(queries):
        block = Block(rows, largest, k)
        for start in range(0, len(queries), QUERY_RUN):
            some = queries.iloc[start : start + QUERY_RUN]
            q, known = np.stack(some["q"].to_numpy()), some["known"].to_numpy()
            at, far = block.distances(q @ projection(q.shape[1])[:-1], bound * known)
            for i, query_id in enumerate(some["query_id"].tolist()):
                ids, scores = block.search(query_id, q[i], at, far[i], known[i], bound)
                found["query_id"].append(np.full(len(ids), query_id))
                found["vec_id"].append(ids)
                found["score"].append(scores)
    return pd.DataFrame({c: np.concatenate(x) if x else [] for c, x in found.items()})


FOUND = "query_id long, vec_id long, score double"


def nearest(vectors: DataFrame, k: int = K, every: int = QUERY_EVERY, sure: float = SURE) -> DataFrame:
    """``query_id, rank, vec_id, score`` for the rows whose ``vec_id`` is divisible by ``every``."""
    rows = materialize(usable(vectors), "near-rows")
    shapes = rows.groupBy(F.size("v").alias("length")).agg(F.max("norm2").alias("largest"), F.count("*").alias("n")).collect()
    parts = [_nearest_of_length(rows.where(F.size("v") == s["length"]), s["largest"], s["n"], k, every, sure) for s in shapes]
    empty = rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return functools.reduce(DataFrame.union, parts, empty)


def _by_leaf(numbers: dict[int, int]) -> Column:
    """A number per leaf of the upper tree, as a column."""
    return F.element_at(F.create_map(*[F.lit(int(x)) for pair in numbers.items() for x in pair]), F.col("leaf").cast("int"))


def _nearest_of_length(rows: DataFrame, largest: float, n: int, k: int, every: int, sure: float) -> DataFrame:
    bound = chi_square_bound(sure, DIMENSIONS)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS).select("v", "norm2").toPandas()
    levels = max(0, min(MOST_LEVELS, math.ceil(math.log2(max(1.0, n / BLOCK_ROWS)))))
    tree = split_tree(project(np.stack(sample["v"].to_numpy()), sample["norm2"].to_numpy(), largest), levels)

    def place(parts):
        for part in parts:
            if len(part):
                p = project(np.stack(part["v"].to_numpy()), part["norm2"].to_numpy(), largest)
                ends = {f"p{d}": p[:, d] for d in range(DIMENSIONS)}
                yield pd.DataFrame({"vec_id": part["vec_id"], "v": part["v"], "leaf": leaf_of(tree, p), **ends})

    coordinates = ", ".join(f"p{d} double" for d in range(DIMENSIONS))
    placed = materialize(rows.mapInPandas(place, f"vec_id long, v array<double>, leaf long, {coordinates}"), "near-placed")
    ranges = [side(f"p{d}").alias(f"{name}{d}") for name, side in (("l", F.min), ("h", F.max)) for d in range(DIMENSIONS)]
    # one row per leaf of the upper tree, whose number is bounded
    leaves = placed.groupBy("leaf").agg(F.count("*").alias("n"), *ranges).toPandas().sort_values("leaf")
    low, high = (leaves[[f"{side}{d}" for d in range(DIMENSIONS)]].to_numpy() for side in "lh")
    numbers = leaves["leaf"].to_numpy()
    blocks = np.maximum(1, -(-leaves["n"].to_numpy() // BLOCK_ROWS))
    count_of = dict(zip(numbers.tolist(), blocks.tolist(), strict=True))
    dealt = placed.select("vec_id", "v", "leaf", F.pmod(F.xxhash64("vec_id"), _by_leaf(count_of)).alias("block"))
    queries = placed.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    queries = materialize(queries.dropDuplicates(["query_id"]), "near-queries")

    def boxes(part):
        """Per query the squared projected distance to the box of every leaf."""
        q = np.stack(part["q"].to_numpy())
        for p in q @ projection(q.shape[1])[:-1]:
            gap = np.maximum(0.0, np.maximum(low - p, p - high))
            yield (gap * gap).sum(axis=1)

    def home(part):
        """The nearest leaf, and one of its blocks."""
        return [[(at := int(np.argmin(box)), int(i % blocks[at]))] for i, box in zip(part["query_id"], boxes(part), strict=True)]

    def opened(part):
        """Every block of the leaves that the stopping test leaves open."""
        bounds = zip(part["known"], boxes(part), strict=True)
        return [[(at, b) for at in np.flatnonzero(box <= bound * known) for b in range(blocks[at])] for known, box in bounds]

    search = functools.partial(_search_block, largest=largest, bound=bound, k=k)
    asked = "query_id long, q array<double>, known double, leaf long, block long"

    def searched(some: DataFrame, chosen) -> DataFrame:
        def count(parts):
            seen = np.zeros((len(numbers), int(blocks.max())), np.int64)
            for part in parts:
                if len(part):
                    np.add.at(seen, tuple(np.array([x for one in chosen(part) for x in one], np.int64).reshape(-1, 2).T), 1)
            yield pd.DataFrame({"leaf": numbers, "most": seen.max(axis=1)})

        def send(parts):
            for part in parts:
                if len(part):
                    pairs = zip(part["query_id"], part["q"], part["known"], chosen(part), strict=True)
                    out = [(i, q, known, int(numbers[at]), b) for i, q, known, one in pairs for at, b in one]
                    yield pd.DataFrame(out, columns=["query_id", "q", "known", "leaf", "block"])

        # a block is repeated only as often as its own queries fill a task
        most = some.mapInPandas(count, "leaf long, most long").groupBy("leaf").agg(F.sum("most").alias("most")).collect()
        of_leaf = dict.fromkeys(count_of, 1) | {r["leaf"]: max(1, -(-r["most"] // BLOCK_QUERIES)) for r in most}
        slices = _by_leaf(of_leaf)
        left = dealt.withColumn("slice", F.explode(F.sequence(F.lit(0), slices - 1)))
        right = some.mapInPandas(send, asked).withColumn("slice", F.pmod(F.xxhash64("query_id"), slices).cast("int"))
        key = ["leaf", "block", "slice"]
        return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(search, FOUND)

    first = searched(queries.withColumn("known", F.lit(float("inf"))), home)
    worst = first.groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("found"))
    norm = F.aggregate("q", F.lit(0.0), lambda a, x: a + x * x)
    kth = F.when(F.col("found") >= k, F.greatest(F.lit(0.0), F.lit(largest) + norm - 2 * F.col("least"))).otherwise(F.lit(float("inf")))
    bounded = queries.join(worst, "query_id", "left").select("query_id", "q", F.coalesce(kth, F.lit(float("inf"))).alias("known"))
    found = searched(materialize(bounded, "near-bounds"), opened)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_nearest(spark: SparkSession, folder: str) -> DataFrame:
    return nearest(table(spark, folder, "embeddings"))
