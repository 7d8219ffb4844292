"""Line dedup: range-partitioned line hashes in document order, answered with keep bitmaps.

Texts are split where they are read. Every (key hash, document) is one row with
the line positions packed; the rows are range-partitioned on hash and
document, largest document first, and sorted inside their partition, so a very
frequent line spreads over many partitions. Each partition is streamed: the
first row of a key is its keeper, later rows of a key lose their lines. Keys
on a partition's edge are settled with the edge totals of all partitions (at
most two rows each). The answer is one compressed bitmap per document.

Defined results:

* a null or empty text is one empty line, which is never dropped (short key);
* hashes have 128 bits; keys shorter than ``min_chars`` code points never count;
* rows that repeat a ``doc_id`` are one document for the count of documents, and
  each of them loses the lines at the positions that the document loses;
* a null ``doc_id`` holds lines like an id below all others;
* only ``doc_id`` and ``text`` are read, so other columns may have any name.
"""

from __future__ import annotations

import functools
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelforge.llm.common import materialize, number_rows, table, text_batches

#: Fixed by the contract: what a key is stripped of, its least length and least number of documents.
STRIPPED = " \t\n\v\f\r"
MIN_CHARS = 20
MIN_DOCS = 3


#: Stands for a null ``doc_id``: below all others.
NO_ID = -(1 << 63)


def doc_key(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("long"), F.lit(NO_ID))


def keyed_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``hi, lo, doc_id, positions`` per key and row of ``docs``; positions are int32, packed."""
    text_batches(docs.sparkSession)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            his, los, ids, packed = [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held: dict[bytes, list[int]] = {}
                for at, line in enumerate((text or "").split("\n")):
                    key = line.strip(STRIPPED)
                    if len(key) >= min_chars:
                        held.setdefault(xxhash.xxh3_128_digest(key.encode("utf-8", "surrogatepass").lower()), []).append(at)
                for digest, at in held.items():
                    his.append(int.from_bytes(digest[:8], "big", signed=True))
                    los.append(int.from_bytes(digest[8:], "big", signed=True))
                    ids.append(doc_id)
                    packed.append(np.asarray(at, np.int32).tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(his, pa.int64()), pa.array(los, pa.int64()), pa.array(ids, pa.int64()), pa.array(packed, pa.binary())],
                names=["hi", "lo", "doc_id", "positions"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(split, "hi long, lo long, doc_id long, positions binary")


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``doc, positions`` of the lines that go; ``doc`` is ``doc_id``, or NO_ID where that is null."""
    lines = keyed_lines(docs, min_chars).withColumn("doc", doc_key(F.col("doc_id"))).drop("doc_id")
    placed = number_rows(lines, [F.col("hi"), F.col("lo"), F.col("doc").desc()], "line-order")
    stream = functools.partial(_settle, least=min_docs)
    totals = _edge_totals(placed)
    return placed.groupBy("pid").cogroup(totals.groupBy("pid")).applyInPandas(stream, "doc long, positions binary")


def _edge_totals(placed: DataFrame) -> DataFrame:
    """``pid, hi, lo, key_docs, key_largest`` for the first and last key of every range partition."""
    key = F.struct("hi", "lo")
    ends = placed.groupBy("pid").agg(F.min_by(key, "idx").alias("first"), F.max_by(key, "idx").alias("last"))
    edge_keys = materialize(
        ends.select("pid", F.explode(F.array_distinct(F.array("first", "last"))).alias("k")).select("pid", "k.*"), "line-edge-keys"
    )
    parts = (
        placed.join(edge_keys, ["pid", "hi", "lo"], "left_semi")
        .groupBy("pid", "hi", "lo", "doc")
        .agg(F.lit(1).alias("one"))
        .groupBy("pid", "hi", "lo")
        .agg(F.count("one").alias("docs"), F.max("doc").alias("largest"), F.min("doc").alias("smallest"))
    )
    # a document whose lines of a key end one partition and begin the next is counted once
    line = Window.partitionBy("hi", "lo").orderBy("pid")
    again = (F.lag("smallest").over(line) == F.col("largest")).cast("long")
    totals = (
        parts.withColumn("docs", F.col("docs") - F.coalesce(again, F.lit(0)))
        .groupBy("hi", "lo")
        .agg(F.sum("docs").alias("key_docs"), F.max("largest").alias("key_largest"))
    )
    return edge_keys.join(totals, ["hi", "lo"])


def _settle(rows: pd.DataFrame, totals: pd.DataFrame, least: int) -> pd.DataFrame:
    """Streams one range partition: all but the keeper's rows of every key that enough documents hold."""
    rows = rows.sort_values("idx")
    if not len(rows):
        return rows[["doc", "positions"]]
    doc, hi, lo = (rows[c].to_numpy(np.int64) for c in ("doc", "hi", "lo"))
    new_key = np.append(True, (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1]))
    new_doc = new_key | np.append(True, doc[1:] != doc[:-1])
    starts, group = np.flatnonzero(new_key), np.cumsum(new_key) - 1
    docs, keeper = np.bincount(group, new_doc), doc[starts]
    known = {(h, w): (n, big) for h, w, n, big in totals[["hi", "lo", "key_docs", "key_largest"]].itertuples(index=False)}
    for at in (0, len(starts) - 1):
        docs[at], keeper[at] = known[hi[starts[at]], lo[starts[at]]]
    return rows.loc[(docs[group] >= least) & (doc != keeper[group]), ["doc", "positions"]]


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``doc, n_dropped, keep`` of the documents that lose lines.

    ``keep`` has one bit per line up to the last one dropped (1: stays, as all
    lines after it), packed and deflated.
    """

    @F.pandas_udf("n_dropped long, keep binary")
    def pack(lists: pd.Series) -> pd.DataFrame:
        out = []
        for parts in lists:
            gone = np.unique(np.concatenate([np.frombuffer(x, np.int32) for x in parts]))
            bits = np.ones(int(gone[-1]) // 8 * 8 + 8, np.uint8)
            bits[gone] = 0
            out.append((len(gone), zlib.compress(np.packbits(bits).tobytes())))
        return pd.DataFrame(out, columns=["n_dropped", "keep"])

    lists = dropped_lines(docs, min_chars, min_docs).groupBy("doc").agg(F.collect_list("positions").alias("parts"))
    return lists.select("doc", pack("parts").alias("_p")).select("doc", "_p.*")


def kept_text(text: str | None, keep: bytes | None) -> tuple[str, int, int]:
    """The text without its dropped lines, its lines before, and the lines dropped."""
    lines = (text or "").split("\n")
    if keep is None:
        return text or "", len(lines), 0
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8))[: len(lines)]
    kept = [line for at, line in enumerate(lines) if at >= len(bits) or bits[at]]
    return "\n".join(kept), len(lines), len(lines) - len(kept)


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_lines, n_dropped, kept_sha256``."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, keeps = batch.columns
            out = []
            for text, keep in zip(texts.to_pylist(), keeps.to_pylist(), strict=True):
                kept, n, gone = kept_text(text, keep)
                out.append((n, gone, hashlib.sha256(kept.encode("utf-8", "surrogatepass")).hexdigest()))
            n, gone, sha = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())],
                names=["doc_id", "n_lines", "n_dropped", "kept_sha256"],
            )

    text_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), doc_key(F.col("doc_id")).alias("doc"))
    joined = rows.join(bitmaps, "doc", "left").select("doc_id", "text", "keep")
    return joined.mapInArrow(digest, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def op3_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return apply_bitmaps(docs, keep_bitmaps(docs))
