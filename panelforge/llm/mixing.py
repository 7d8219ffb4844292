"""Mixing sources to target weights by hash-random order and exact prefix sums (SQL functions only).

Sizes are words. Every document gets a hash-random key; inside each source the
documents are range-sorted by it, prefix sums of the sizes run over all range
partitions, and the mix is cut at exactly the source's budget. A budget above
the source's size repeats whole epochs first.

Defined results:

* a null text has size 0 and is never taken; an empty table gives an empty mix;
* a null source is a source of its own, last in order;
* a null ``doc_id`` is ordered by its text; repeated rows are ordered next to
  each other and each counts with its own size;
* the document on the cut gives only the words up to the budget, so a source's
  taken words are the whole part of its target;
* other columns, whatever their names, are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelforge.llm.common import materialize, number_rows, running_start, table

#: Fixed by the contract: weights by source order, share of all words, most repeats.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0

#: Fixed by the contract: a word is a run without ASCII white space.
WORD = "[^\\x20\\x09-\\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def random_key(doc_id: Column, text: Column) -> Column:
    """The same for the same document in every run and every engine."""
    return F.md5(F.coalesce(doc_id.cast("string"), text, F.lit("")).cast("binary"))


def source_plan(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """One row per source: ``src`` (its place), ``source_size``, ``target``, ``epochs`` and the ``rest`` in words.

    The budget is ``share`` of all words. In order of the level at which they
    fill up, sources take ``most`` times their size as long as that is below
    their weighted part of what is left; the others share the rest by weight.
    The windows without a key run on one row per source.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("src") - 1) % len(weights) + 1)
    ranked = sources.withColumn("src", place).withColumns(
        {"weight": weight, "most": F.col("source_size") * F.lit(float(most))}
    )
    everything = Window.partitionBy()
    fill = Window.orderBy(F.col("most") / F.col("weight"), "src").rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("most").over(fill), F.lit(0.0))
    open_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(fill), F.lit(0.0))
    levelled = ranked.withColumn("level", left / open_weight).withColumn("full", F.col("most") <= F.col("weight") * F.col("level"))
    rest = F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(
        F.sum(F.when(F.col("full"), F.col("most"))).over(everything), F.lit(0.0)
    )
    rest_weight = F.sum(F.when(~F.col("full"), F.col("weight"))).over(everything)
    target = F.when(F.col("full"), F.col("most")).otherwise(F.col("weight") * rest / rest_weight)
    return (
        levelled.withColumn("target", target)
        .withColumn("words", F.floor("target").cast("long"))
        .withColumn("epochs", F.expr("words div greatest(source_size, 1)"))
        .withColumn("rest", F.col("words") - F.col("epochs") * F.col("source_size"))
        .select("source", "src", "source_size", "target", "epochs", "rest")
    )


def sized_rows(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), random_key(F.col("doc_id"), F.col("text")).alias("key"))


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Per document ``doc_id, size, source_size, target, taken``, and its ``source`` and place on the source's line."""
    sizes = materialize(sized_rows(docs), "mix-sizes")
    plan = materialize(source_plan(sizes, weights, share, most), "mix-plan")
    return cut(sizes, plan)


def cut(sizes: DataFrame, plan: DataFrame) -> DataFrame:
    rows = sizes.join(plan, sizes["source"].eqNullSafe(plan["source"])).select(
        "doc_id", sizes["source"], "size", "key", "src", "source_size", "target", "epochs", "rest"
    )
    placed = number_rows(rows, [F.col("src"), F.col("key"), F.col("doc_id"), F.col("size")], "mix-order")
    started = running_start(placed, "size", ["src"], "start")
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("start")))
    return started.withColumn("taken", F.col("epochs") * F.col("size") + part).select(
        "doc_id", "size", "source_size", "target", "taken", "source", "src", "key", "start", "epochs", "rest"
    )


def mixed_documents(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``docs`` repeated and cut to the mix, as whole rows with all their columns.

    Every source's cut is one point on its key line, so texts are not
    shuffled: each row meets its source's point. The document on the cut is
    kept whole, as are rows that tie with it.
    """
    sizes = materialize(sized_rows(docs), "mix-sizes")
    plan = materialize(source_plan(sizes, weights, share, most), "mix-plan")
    on_cut = cut(sizes, plan).where((F.col("size") > 0) & (F.col("start") < F.col("rest")))
    last = on_cut.groupBy("src").agg(F.max(F.struct("key", "doc_id")).alias("last"))
    points = materialize(
        plan.join(last, "src", "left").select(
            F.col("source").alias("_source"), "epochs", F.col("last.key").alias("cut_key"), F.col("last.doc_id").alias("cut_doc")
        ),
        "mix-points",
    )
    key = random_key(F.col("doc_id"), F.col("text"))
    own = F.struct(key.alias("key"), F.col("doc_id").alias("doc_id"))
    within = F.col("cut_key").isNotNull() & (own <= F.struct(F.col("cut_key").alias("key"), F.col("cut_doc").alias("doc_id")))
    copies = F.when(word_count(F.col("text")) == 0, 0).otherwise(F.col("epochs") + F.when(within, 1).otherwise(0)).cast("int")
    columns = docs.columns
    row = F.struct(*[F.col(c) for c in columns]).alias("_row")
    packed = docs.select(row, *[F.col(c) for c in ("doc_id", "source", "text")])
    joined = packed.join(points, packed["source"].eqNullSafe(points["_source"]))
    return joined.select("_row", F.explode(F.array_repeat(F.lit(1), copies))).select("_row.*")


def op9_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mix(table(spark, folder, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")
