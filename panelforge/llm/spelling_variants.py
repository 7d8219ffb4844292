"""Spelling variants by finite-state composition.

Two words are near if one inserted, deleted or replaced letter turns one into the
other: if the composition of the vocabulary's acceptor, a one-edit transducer and
the acceptor again accepts the pair. Up to the edit both tapes are in one state,
the state after the letters that the words begin with alike. The vocabulary is dealt by
such initial states. A state behind which few enough words lie is one partition: its
words' minimal acceptor is built and composed in one task. Behind any other state,
the edits taken right there are settled by a shuffle on what is left of the words (an
edit leaves equal rests), and its identity arcs lead to the next initial states; a
stretch that all its words share is passed in one step. So no task holds more than
``most`` words, whatever prefix a share of the vocabulary has.

Defined results:

* words are distinct and not null; counts of repeated words are added up;
* every pair of near words is met once, at the place where the words first differ;
* a word's form is the near word of largest count (ties: smallest in code-point
  order) if that is at least twice the word's own; forms therefore have no cycles;
* the root is the last word met when following forms, the word itself without one;
* null and empty texts have no words; repeated rows count again; a null id has no
  digits before the colon of the hashed string; a word of any length is kept whole;
* an empty table gives no rows;
* only ``doc_id`` and ``text`` are read, so other columns may have any name.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm.common import materialize, table
from panelforge.llm.word_acceptor import Acceptor

#: Words of one initial-state partition.
MOST_WORDS = 16_384

#: Letters of words: ASCII and the Latin-1 range.
LETTERS = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: One in so many occurrences loses a letter.
NOISE = 97
LEAST_LETTERS, LEAST_COUNT = 5, 3

#: A form has at least so many times the occurrences.
FORM_RATIO = 2


# ---- words --------------------------------------------------------------


def _with_noise(run: Column, doc_id: Column) -> Column:
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    cut = (h % F.length(run)).cast("int")
    return F.when(h % NOISE == 0, F.concat(F.substring(run, F.lit(1), cut), F.substring(run, cut + 2, F.length(run)))).otherwise(run)


def counted_words(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT) -> DataFrame:
    """``word, n`` of the runs of letters of all texts, a fixed share of which lose one letter."""
    lowered = F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER)
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(lowered, F.lit(LETTERS), F.lit(0))).alias("run"))
    words = runs.where(F.length("run") >= least_letters).select(_with_noise(F.col("run"), F.col("doc_id")).alias("word"))
    return (
        words.where(F.length("word") >= least_letters)
        .groupBy("word")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") >= least_count)
    )


# ---- near words -----------------------------------------------------------


def _shared(a: Column, b: Column) -> Column:
    """Letters that two words begin with alike."""
    steps = F.sequence(F.lit(1), F.least(F.length(a), F.length(b)) + 1)
    return F.size(F.filter(steps, lambda k: (k <= F.least(F.length(a), F.length(b))) & (F.substring(a, F.lit(1), k) == F.substring(b, F.lit(1), k))))


def _at_state(here: DataFrame) -> DataFrame:
    """Near words whose edit lies right behind the first ``branch`` letters (``word, n, branch``).

    A word without the letter there meets words of the same rest: those that lack
    another letter there, and the one that has the rest as it is and does not
    begin it with that letter. An alphabet bounds such a group.
    """
    at = F.col("branch")
    letter = F.substring(F.col("word"), at + 1, F.lit(1))
    rest = F.concat(F.substring(F.col("word"), F.lit(1), at), F.substring(F.col("word"), at + 2, F.length("word")))
    member = lambda whole: F.struct("word", "n", letter.alias("letter"), F.lit(whole).alias("whole"))
    cut = here.where(F.length("word") > at).select("branch", rest.alias("rest"), member(False).alias("m"))
    whole = here.select("branch", F.col("word").alias("rest"), member(True).alias("m"))
    met = cut.unionByName(whole).groupBy("branch", "rest").agg(F.collect_list("m").alias("all")).where(F.size("all") > 1)
    one = met.select("all", F.explode("all").alias("m"))
    others = F.filter("all", lambda o: (o["letter"] != F.col("m.letter")) & ~(o["whole"] & F.col("m.whole")))
    best = F.array_min(F.transform(others, lambda o: F.struct((-o["n"]).alias("order"), o["word"].alias("other"))))
    return one.select(F.col("m.word").alias("word"), F.size(others).cast("long").alias("n_near"), best.alias("best")).where("n_near > 0")


def _composed(words: pd.DataFrame) -> pd.DataFrame:
    """Near words of one initial-state partition, folded to one row a word."""
    words = words.sort_values("word", key=lambda c: c.str.encode("utf-32-be")).reset_index(drop=True)
    i, j = Acceptor(words["word"].tolist()).near()
    left, right = np.concatenate([i, j]), np.concatenate([j, i])
    n = words["n"].to_numpy()
    order = np.lexsort((right, -n[right], left))
    left, right = left[order], right[order]
    word, first, degree = np.unique(left, return_index=True, return_counts=True)
    best = right[first]
    return pd.DataFrame(
        {
            "word": words["word"].to_numpy()[word],
            "n_near": degree.astype(np.int64),
            "order": -n[best],
            "other": words["word"].to_numpy()[best],
        }
    )


def near_words(words: DataFrame, most: int = MOST_WORDS) -> DataFrame:
    """``word, n_near, best(order, other)`` of all words of ``words`` (``word, n``) that have near words.

    ``best`` is the near word of largest count, with its count negated.
    """
    open_ = words.select("word", "n", F.lit(0).alias("depth"))
    found = []
    while True:
        prefix = F.substring(F.col("word"), F.lit(1), F.col("depth"))
        open_ = open_.withColumn("prefix", prefix)
        states = open_.groupBy("depth", "prefix").agg(F.count("*").alias("held"), F.min("word").alias("lo"), F.max("word").alias("hi"))
        crowded = states.where(F.col("held") > most).select("depth", "prefix", _shared(F.col("lo"), F.col("hi")).alias("branch"))
        crowded = materialize(crowded, "crowded-states")
        level = materialize(open_.join(crowded, ["depth", "prefix"], "left"), "initial-states")
        fits = level.where("branch is null")
        composed = fits.groupBy("depth", "prefix").applyInPandas(
            lambda part: _composed(part), "word string, n_near long, order long, other string"
        )
        found.append(composed.select("word", "n_near", F.struct("order", "other").alias("best")))
        if crowded.isEmpty():
            break
        here = level.where("branch is not null")
        found.append(_at_state(here))
        open_ = here.where(F.length("word") > F.col("branch")).select("word", "n", (F.col("branch") + 1).alias("depth"))
    parts = reduce(DataFrame.unionByName, found)
    return parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


# ---- forms ----------------------------------------------------------------


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` for ``forms`` (``word, form``): every round follows twice as many steps.

    Chains have at most as many steps as a count can be halved.
    """
    jumps = materialize(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        onward = jumps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        jumped = materialize(
            jumps.join(onward, "root", "left").select(
                "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")
            ),
            "jumps",
        )
        jumps = jumped.select("word", "root")
        if jumped.where("moved").isEmpty():
            return jumps


def spelling_variants(words: DataFrame, ratio: float = FORM_RATIO, most: int = MOST_WORDS) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of all words of ``words`` (``word, n``)."""
    words = materialize(words.where("word is not null").groupBy("word").agg(F.sum("n").alias("n")), "words")
    near = near_words(words, most)
    is_form = -F.col("best.order") >= F.col("n") * ratio
    grouped = words.join(near, "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(is_form, F.col("best.other")).alias("form"),
        F.when(is_form, -F.col("best.order")).alias("form_n"),
    )
    grouped = materialize(grouped, "variants")
    last = roots(grouped.where("form is not null").select("word", "form"))
    return grouped.join(last, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def op12_spelling(spark: SparkSession, folder: str) -> DataFrame:
    return spelling_variants(counted_words(table(spark, folder, "documents")))
