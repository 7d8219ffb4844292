"""License scans by diagonal voting (SQL functions only).

Every run of two words of a document is hashed and joined to the places where
license notices hold it. A place of the document minus the place in the notice
is a diagonal; the hits of one occurrence lie on one diagonal, and words put in
or left out move the rest to a neighbouring one. A diagonal's votes are kept as
a bitmap of the notice's words; diagonals at most :data:`BAND` apart are merged
around each diagonal that has a third of the notice for itself, and the merged span
is verified: how many words of notice and document agree, and over how many words.

Defined results:

* words are runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after lower-casing A-Z;
  null and empty texts have none, and no license;
* the words are compared themselves, the hash only deals them;
* a span's score is the number of agreeing words over the larger of span and
  notice; it counts from :data:`LEAST_SCORE` on, so notices of up to four words must
  be met whole; a document's score is its best span's, 0 without one;
* base phrases are counted at every place where they stand whole, overlaps included;
* notices of equal words count once per label, under their smallest ``notice``; those
  of less than two words are never met; those over :data:`MOST_WORDS` words are cut into
  passages of at most that many, and each passage counts for itself;
* a row that repeats a document gets the same result; null ids are kept;
* an empty table of documents gives no rows, one of notices no licenses;
* only ``doc_id`` and ``text`` are read, so other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelforge.llm.common import materialize, table

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Diagonals this far apart are merged.
BAND = 3
LEAST_SCORE = 0.8

#: Words of a notice; bitmaps of these and of the span around them fit into a long.
MOST_WORDS = 48

#: Phrases whose every place is counted (fixed values).
BASE = (
    ("cc-by", "cc by"),
    ("gpl", "general public license"),
    ("reserved", "all rights reserved"),
)

#: Names and opening sentences of well-known licenses (fixed values, as published with them).
NOTICES = (
    ("agpl", "affero general public license"),
    ("apache", "apache license"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license"),
    ("artistic", "artistic license 2 0"),
    ("boost", "boost software license"),
    ("bsd", "bsd license"),
    ("bsd", "bsd 2 clause license"),
    ("bsd", "bsd 3 clause license"),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted"
        " provided that the following conditions are met",
    ),
    ("cc-by", "creative commons attribution"),
    ("cc-by-nc", "cc by nc"),
    ("cc-by-nc", "creative commons attribution noncommercial"),
    ("cc-by-nd", "cc by nd"),
    ("cc-by-nd", "creative commons attribution noderivatives"),
    ("cc-by-sa", "cc by sa"),
    ("cc-by-sa", "creative commons attribution sharealike"),
    ("cc0", "cc0 1 0 universal"),
    ("cc0", "creative commons zero"),
    ("epl", "eclipse public license"),
    ("eupl", "european union public licence"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    (
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the"
        " gnu general public license as published by the free software foundation",
    ),
    ("isc", "isc license"),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee"
        " is hereby granted",
    ),
    ("lgpl", "lesser general public license"),
    ("mit", "mit license"),
    ("mit", "released under the mit license"),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and"
        " associated documentation files the software to deal in the software without restriction",
    ),
    ("mpl", "mozilla public license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("reserved", "alle rechte vorbehalten"),
    ("reserved", "todos los derechos reservados"),
    ("reserved", "tous droits réservés"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("zlib", "this software is provided as is without any express or implied warranty"),
)


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def _pairs(w: Column) -> Column:
    """Every two consecutive words; the last entry is null."""
    following = F.slice(w, F.lit(2), F.greatest(F.size(w) - 1, F.lit(0)))
    return F.zip_with(w, following, lambda a, b: F.concat(a, F.lit(" "), b))


def known_notices(spark: SparkSession) -> DataFrame:
    """``notice, label, base, text`` of :data:`BASE` and :data:`NOTICES`."""
    rows = [(label, True, text) for label, text in BASE] + [(label, False, text) for label, text in NOTICES]
    listed = [
        F.struct(F.lit(k).alias("notice"), F.lit(label).alias("label"), F.lit(base).alias("base"), F.lit(text).alias("text"))
        for k, (label, base, text) in enumerate(rows)
    ]
    return spark.range(1).select(F.inline(F.array(*listed)))


def notice_places(notices: DataFrame) -> DataFrame:
    """``pair, h, notice, label, base, m, place``: every two words of every distinct passage of the notices."""
    w = F.col("w")
    passages = notices.select("notice", "label", "base", words(F.col("text")).alias("w")).where(F.size("w") >= 2)
    starts = F.sequence(F.lit(0), F.floor((F.size(w) - 1) / MOST_WORDS).cast("int"))
    # passages of about equal length, so that none is left with a single word
    cut = F.transform(
        starts,
        lambda k: F.slice(
            w,
            F.floor(k * F.size(w) / F.size(starts)).cast("int") + 1,
            (F.floor((k + 1) * F.size(w) / F.size(starts)) - F.floor(k * F.size(w) / F.size(starts))).cast("int"),
        ),
    )
    passages = passages.select("notice", "label", "base", F.posexplode(cut).alias("passage", "w"))
    passages = passages.groupBy("label", "base", "w").agg(F.min(F.struct("notice", "passage")).alias("notice"))
    return (
        passages.select("notice", "label", "base", F.size(w).alias("m"), F.posexplode(_pairs(w)).alias("place", "pair"))
        .where("pair is not null")
        .withColumn("h", F.xxhash64("pair"))
    )


def diagonals(docs: DataFrame, notices: DataFrame) -> DataFrame:
    """``doc_id, text_hash, notice, label, base, m, diagonal, cover``; ``cover`` has a bit per agreeing word of the notice.

    The table of notices is met by its measured size: sent to the tasks while it is small.
    """
    places = materialize(notice_places(notices), "notice-places")
    held = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(_pairs(words(F.col("text")))).alias("at", "pair"))
    met = held.withColumn("h", F.xxhash64("pair")).join(places, ["h", "pair"])
    hit = met.select(
        "doc_id", "text_hash", "notice", "label", "base", "m", (F.col("at") - F.col("place")).alias("diagonal"),
        F.call_function("shiftleft", F.lit(3).cast("long"), F.col("place")).alias("bits"),
    )
    # one exchange: diagonals, windows and documents are all within (doc_id, text_hash)
    return (
        hit.repartition("doc_id", "text_hash")
        .groupBy("doc_id", "text_hash", "notice", "label", "base", "m", "diagonal")
        .agg(F.bit_or("bits").alias("cover"))
    )


def _low(bits: Column) -> Column:
    return F.length(F.bin(bits.bitwiseAND(-bits)))


def spans(docs: DataFrame, notices: DataFrame) -> DataFrame:
    """Verified spans: ``doc_id, text_hash, notice, label, base, m, diagonal, whole, first_word, last_word, score``."""
    around = (
        Window.partitionBy("doc_id", "text_hash", "notice", "label", "base", "m").orderBy("diagonal").rangeBetween(-BAND, BAND)
    )
    merged = diagonals(docs, notices).withColumn("near", F.collect_list(F.struct("diagonal", "cover")).over(around))
    none = F.lit(0).cast("long")
    own = F.bit_count("cover")
    merged = merged.where(own * 3 >= F.col("m")).withColumns(
        {
            "of_notice": F.aggregate("near", none, lambda a, x: a.bitwiseOR(x["cover"])),
            "of_text": F.aggregate(
                "near",
                none,
                lambda a, x: a.bitwiseOR(F.call_function("shiftleft", x["cover"], x["diagonal"] - F.col("diagonal") + BAND)),
            ),
        }
    )
    length = F.length(F.bin("of_text")) - _low(F.col("of_text")) + 1
    agreeing = F.least(F.bit_count("of_notice"), F.bit_count("of_text"))
    score = F.greatest(own / F.col("m"), agreeing / F.greatest(F.col("m"), length))
    first = F.col("diagonal") + _low(F.col("of_text")) - 1 - BAND
    return merged.select(
        "doc_id", "text_hash", "notice", "label", "base", "m", "diagonal", (own == F.col("m")).alias("whole"),
        first.alias("first_word"), (first + length - 1).alias("last_word"), score.alias("score"),
    ).where(F.col("score") >= LEAST_SCORE)


def license_scan(docs: DataFrame, notices: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` of every row of ``docs``."""
    base = F.col("base") & F.col("whole")
    joined = lambda label: F.array_join(F.sort_array(F.collect_set(label)), ",")
    found = (
        spans(docs, notices)
        .groupBy("doc_id", "text_hash")
        .agg(
            F.count_if(base).alias("n_base"),
            F.min(F.when(base, F.col("diagonal"))).cast("long").alias("first_word"),
            F.max(F.when(base, F.col("diagonal"))).cast("long").alias("last_word"),
            joined(F.when(base, F.col("label"))).alias("base_labels"),
            joined(F.col("label")).alias("labels"),
            F.max("score").alias("score"),
        )
        .withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash"})
    )
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.size(words(F.col("text"))).cast("long").alias("n_words"))
    same = rows["doc_id"].eqNullSafe(found["_id"]) & (rows["text_hash"] == found["_hash"])
    return rows.join(found, same, "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def op13_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan(table(spark, folder, "documents"), known_notices(spark))
