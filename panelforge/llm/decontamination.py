"""Benchmark decontamination by spaced-seed hashing (SQL functions only).

Words are hashed. A seed is the hash of the words that a fixed mask keeps; the
positions it skips may differ. Both masks begin with the same three words, so a
bitmap over those finds the few places of a document that need seeds, and a
second bitmap over the seeds finds the few that can meet the benchmark. Only
these are joined, each with the short run of word hashes around it, and a hit
stands if enough words agree, place by place, in a window over it.

With these masks, every 13 words of which at most two are substituted share at
least one seed with the original. Items of 7 to 12 words have masks of their own
length besides: their places are dealt to four sets, and each mask leaves out as
many sets as words may differ, so every allowed substitution shares a seed. Shorter
items have one mask of all their words. A document is searched for these at every
place, but only for lengths that the benchmark has.

Defined results:

* words are runs of letters and digits, in lower case; null and empty texts have none;
* benchmark items of equal words count once, under their smallest ``item_id``;
* items shorter than the window must agree as a whole, with the share of equal
  words; those of less than 7 words must be met word by word;
* a row that repeats a document is found like the first; null ids are kept;
* an empty benchmark or an empty table gives no hits;
* only ``doc_id``, ``text`` and ``item_id`` are read, so other columns may have any name.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm.common import materialize, table

#: Kept positions. Both begin with the same three.
MASKS = ((0, 1, 2, 3, 5, 6), (0, 1, 2, 4, 7, 8))

#: A hit needs this share of equal words in some window of this length over it.
WINDOW = 13
LEAST_SHARE = 0.8

#: Items of fewer words must be met word by word.
LEAST_INEXACT = 7

#: Bits of the two bitmaps; their size is fixed, whatever the size of the benchmark.
BITMAP_BITS = 18

#: The benchmark's seeds are broadcast up to this number (some 300 bytes each), and joined by shuffle beyond.
BROADCAST_SEEDS = 100_000

#: Words under the shorter mask; windows that hold as many from a hit on are summed.
_SHORTEST = 1 + min(mask[-1] for mask in MASKS)
#: Places around a hit that windows can reach.
_REACH = range(-(WINDOW - 1), WINDOW)


def least_equal(n: int) -> int:
    """Words of an item of ``n`` that must agree."""
    return n if n < LEAST_INEXACT else math.ceil(min(WINDOW, n) * LEAST_SHARE)


def short_masks(n: int) -> list[tuple[int, ...]]:
    """Masks for items of ``n`` words, fewer than the window: any allowed substitution leaves one untouched."""
    left_out = itertools.combinations(range(4), n - least_equal(n))
    return [tuple(k for k in range(n) if k % 4 not in sets) for sets in left_out]


def word_hashes(text: Column) -> Column:
    plain = F.btrim(F.regexp_replace(F.lower(text), "[^\\p{L}\\p{N}]+", " "))
    words = F.when(F.length(plain) > 0, F.split(plain, " ")).otherwise(F.array().cast("array<string>"))
    return F.transform(words, lambda w: F.xxhash64(w))


def _at(h: Column, i: Column, offset: int) -> Column:
    return F.get(h, i + F.lit(offset)) if offset else F.get(h, i)


def _start(h: Column, i: Column) -> Column:
    """Hash of the three words that all masks begin with."""
    first, second, third = (_at(h, i, k) for k in range(3))
    return first.bitwiseXOR(F.shiftrightunsigned(second, 1)).bitwiseXOR(F.shiftrightunsigned(third, 2))


def _seeds(h: Column, i: Column) -> list[Column]:
    """One per mask; null where the mask passes the end."""
    return [
        F.when(i + F.lit(mask[-1]) < F.size(h), F.xxhash64(F.lit(m), *[_at(h, i, k) for k in mask])) for m, mask in enumerate(MASKS)
    ]


def _starts(h: Column) -> Column:
    return F.when(F.size(h) >= _SHORTEST, F.sequence(F.lit(0), F.size(h) - _SHORTEST)).otherwise(F.array().cast("array<int>"))


def _short_seeds(h: Column, i: Column, n: int) -> list[Column]:
    """One per mask of items of ``n`` words; ``i`` may lie before the start, null where the mask passes an end."""
    return [
        F.when(
            (i + F.lit(mask[0]) >= 0) & (i + F.lit(mask[-1]) < F.size(h)),
            F.xxhash64(F.lit(f"{n}:{m}"), *[_at(h, i, k) for k in mask]),
        )
        for m, mask in enumerate(short_masks(n))
    ]


def _short_places(h: Column) -> Column:
    """Places where a short item may begin; its first words may lie before the text."""
    missing = max(n - least_equal(n) for n in range(1, WINDOW))
    return F.when(F.size(h) > 0, F.sequence(F.lit(-missing), F.size(h) - 1)).otherwise(F.array().cast("array<int>"))


def _around(h: Column, i: Column) -> Column:
    """The words that windows over a hit at ``i`` can reach; null beyond the ends."""
    steps = F.array(*[F.lit(k) for k in _REACH])
    return F.transform(steps, lambda k: F.when(i + k >= 0, F.get(h, i + k)))


def _bitmap(hashes: DataFrame, bits: int) -> Column:
    """A literal bitmap of column ``x``; the driver gets at most ``2 ** bits / 64`` numbers."""
    slot = F.col("x").bitwiseAND(F.lit((1 << bits) - 1))
    filled = (
        hashes.where("x is not null")
        .groupBy(F.shiftrightunsigned(slot, 6).alias("word"))
        .agg(F.bit_or(F.expr(f"shiftleft(1L, cast((x & 63L) as int))")).alias("ones"))
    )
    words = [0] * (1 << (bits - 6))
    for row in filled.collect():
        words[row["word"]] = row["ones"]
    return F.split(F.lit(",".join(map(str, words))), ",").cast("array<bigint>")


def _in_bitmap(bitmap: Column, x: Column, bits: int) -> Column:
    slot = x.bitwiseAND(F.lit((1 << bits) - 1))
    word = F.get(bitmap, F.shiftrightunsigned(slot, 6).cast("int"))
    # 64-bit word, bit counted from the low end
    shifted = F.call_function("shiftrightunsigned", word, slot.bitwiseAND(F.lit(63)).cast("int"))
    return shifted.bitwiseAND(F.lit(1)) == 1


def benchmark_seeds(benchmark: DataFrame) -> DataFrame:
    """``seed, start, item_id, n_words, around`` for every place and mask of every distinct item."""
    items = (
        benchmark.select("item_id", word_hashes(F.col("text")).alias("h"))
        .groupBy("h")
        .agg(F.min("item_id").alias("item_id"))
    )
    h, i = F.col("h"), F.col("i")
    places = items.select("item_id", "h", F.explode(_starts(h)).alias("i"))
    by_mask = places.select(
        "item_id", F.size(h).alias("n_words"), _start(h, i).alias("start"), _around(h, i).alias("around"), F.explode(F.array(*_seeds(h, i))).alias("seed")
    )
    whole = F.coalesce(*[F.when(F.size(h) == n, F.array(*_short_seeds(h, F.lit(0), n))) for n in range(1, WINDOW)])
    by_length = items.where(F.size(h).between(1, WINDOW - 1)).select(
        "item_id", F.size(h).alias("n_words"), F.lit(None).cast("long").alias("start"), _around(h, F.lit(0)).alias("around"), F.explode(whole).alias("seed")
    )
    return by_mask.unionByName(by_length).where("seed is not null")


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: float = LEAST_SHARE) -> DataFrame:
    """``doc_id, text_hash, item_id, n_words, place, matched`` of all verified hits, one row per seed."""
    seeds = materialize(benchmark_seeds(benchmark), "leak-seeds")
    starts = _bitmap(seeds.select(F.col("start").alias("x")), BITMAP_BITS)
    known = _bitmap(seeds.select(F.col("seed").alias("x")), BITMAP_BITS)
    h = F.col("h")
    # one array in, one row out: words are hashed once, as nothing is pushed down or merged across a generator
    hashed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.explode(F.array(word_hashes(F.col("text")))).alias("h"))
    near = F.filter(_starts(h), lambda i: _in_bitmap(starts, _start(h, i), BITMAP_BITS))
    seeded = F.flatten(F.transform(near, lambda i: F.array(*[F.struct(i.alias("i"), s.alias("seed")) for s in _seeds(h, i)])))
    lengths = sorted(row["n_words"] for row in seeds.where(F.col("n_words") < WINDOW).select("n_words").distinct().collect())
    if lengths:
        at = lambda i: F.array(*[F.struct(i.alias("i"), s.alias("seed")) for n in lengths for s in _short_seeds(h, i, n)])
        seeded = F.concat(seeded, F.flatten(F.transform(_short_places(h), at)))
    found = F.filter(seeded, lambda s: _in_bitmap(known, s["seed"], BITMAP_BITS))
    probes = hashed.select("doc_id", "text_hash", "h", F.explode(found).alias("f")).select(
        "doc_id", "text_hash", F.col("f.i").alias("place"), F.col("f.seed").alias("seed"), _around(h, F.col("f.i")).alias("doc_around")
    )
    if seeds.count() <= BROADCAST_SEEDS:
        seeds = F.broadcast(seeds)
    met = probes.join(seeds, "seed")
    equal = F.zip_with("doc_around", "around", lambda a, b: F.when(a == b, 1).otherwise(0))
    sums = [
        F.aggregate(F.slice("equal", s, window), F.lit(0), lambda a, x: a + x) for s in range(_SHORTEST, window + 1)
    ]
    matched = met.withColumn("equal", F.explode(F.array(equal))).withColumn("matched", F.greatest(*sums))
    least = F.ceil(F.least(F.lit(window), F.col("n_words")) * F.lit(share))
    least = F.when(F.col("n_words") < LEAST_INEXACT, F.col("n_words")).otherwise(least)
    return matched.where(F.col("matched") >= least).select(
        "doc_id", "text_hash", "item_id", "n_words", F.greatest("place", F.lit(0)).alias("place"), "matched"
    )


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, item_id, n_matched, first_place``: documents that hold a passage of the benchmark."""
    return (
        hits(docs, benchmark)
        .groupBy("doc_id", "item_id")
        .agg(F.max("matched").cast("long").alias("n_matched"), F.min("place").cast("long").alias("first_place"))
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without any hit, with all their columns."""
    found = hits(docs, benchmark).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    found = materialize(found, "leaks")
    same = docs["doc_id"].eqNullSafe(found["_id"]) & (F.xxhash64(docs["text"]) == found["_hash"])
    return docs.join(found, same, "left_anti")


def op8_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
