"""Token counts that follow edits: pre-token segment trees per document.

A text is cut into pre-tokens, whose token counts do not depend on each other.
Blocks of them are the leaves of a segment tree of counts, stored per document
with the leaves' lengths. After edits, only the leaves that an edit touches, one
leaf of context before them, and what follows up to the first old leaf boundary
that is a pre-token boundary again are cut and encoded anew; the pattern looks
only ahead, so everything behind such a boundary stays as it was. The changed
leaves then update the sums above them.

Defined results:

* null and empty texts have no tokens and a tree of one empty leaf;
* edits are spans of code points of the old text with their replacement; spans
  are clipped to the text; of overlapping spans the first counts (by start, end,
  replacement); edits with a null start or end are ignored, a null replacement
  deletes; equal starts of empty spans (insertions) are overlaps too;
* edits are addressed by ``row`` (:func:`row_key`, the hash of id and text), so
  repeated rows share them, and null ids are no exception;
* strings of special tokens are ordinary text;
* only ``doc_id`` and ``text`` are read, so other columns may have any name.
"""

from __future__ import annotations

import base64
import functools
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm.common import materialize, table, text_batches

#: Ranks of a byte-level BPE, and the pre-token pattern that belongs to them (fixed values of the vocabulary).
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Pre-tokens of a leaf.
LEAF = 32

#: What the query's edits take out of the texts, and what they put there.
REDACTIONS = (
    (r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+", "<email>"),
    (r"\b\d{1,3}(?:\.\d{1,3}){3}\b", "<ip>"),
    (r"\b[0-9a-f]{32,}\b", "<key>"),
    (r"\+?\d[\d ()-]{7,}\d", "<number>"),
)


class Counter:
    """Pre-tokens and their token counts; counts of seen pre-tokens are kept, up to a bound."""

    KEPT = 500_000

    def __init__(self, vocabulary: str, pattern: str = PATTERN):
        with open(vocabulary, "rb") as lines:
            ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("corpus", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.seen: dict[str, int] = {}

    def counts(self, pieces: list[str]) -> np.ndarray:
        seen = self.seen
        if len(seen) > self.KEPT:
            seen.clear()
        for piece in set(pieces).difference(seen):
            seen[piece] = len(self.encoding.encode_ordinary(piece))
        return np.fromiter(map(seen.__getitem__, pieces), np.int64, len(pieces))


@functools.lru_cache(maxsize=2)
def counter(vocabulary: str) -> Counter:
    return Counter(vocabulary)


class Tree:
    """Leaves with their lengths in code points; ``sums`` in heap order, the root at 1."""

    def __init__(self, lengths: np.ndarray, sums: np.ndarray):
        self.lengths, self.sums = lengths, sums

    @classmethod
    def build(cls, text: str, count: Counter, leaf: int = LEAF) -> Tree:
        pieces = count.pattern.findall(text)
        starts = np.arange(0, max(1, len(pieces)), leaf)
        if pieces:
            lengths = np.add.reduceat(np.fromiter(map(len, pieces), np.int64, len(pieces)), starts)
            tokens = np.add.reduceat(count.counts(pieces), starts)
        else:
            lengths = tokens = np.zeros(1, np.int64)
        size = 1 << (len(lengths) - 1).bit_length()
        sums = np.zeros(2 * size, np.int64)
        sums[size : size + len(tokens)] = tokens
        level = size
        while level > 1:
            half = level // 2
            sums[half:level] = sums[level : 2 * level : 2] + sums[level + 1 : 2 * level : 2]
            level = half
        return cls(lengths, sums)

    @property
    def total(self) -> int:
        return int(self.sums[1])

    def set_leaf(self, at: int, length: int, tokens: int) -> None:
        self.lengths[at] = length
        node = len(self.sums) // 2 + at
        change = tokens - int(self.sums[node])
        while change and node:
            self.sums[node] += change
            node //= 2

    def edit(self, text: str, edits: list[tuple[int, int, str]], count: Counter) -> tuple[str, int]:
        """Applies edits in order of their starts; gives the new text and how many pre-tokens were encoded anew."""
        bounds = np.append(0, np.cumsum(self.lengths)).tolist()
        pieces, at, shifts = [], 0, []
        for start, end, new in edits:
            pieces += [text[at:start], new]
            shifts.append(len(new) - (end - start))
            at = end
        changed = "".join([*pieces, text[at:]])
        shift = np.append(0, np.cumsum(shifts)).tolist()
        last, encoded, k = len(self.lengths), 0, 0

        def leaf_before(position: int) -> int:
            # the leaf of the code point before it, and one more as context
            return max(0, min(bisect_right(bounds, max(0, position - 1)) - 1, last - 1) - 1)

        while k < len(edits):
            first = leaf_before(edits[k][0])
            found: list[str] = []
            position = bounds[first] + shift[k]
            k += 1
            stop = last
            target = self._next_bound(bounds, first, edits[k - 1][1])
            for piece in count.pattern.finditer(changed, position):
                while target < last and bounds[target] + shift[k] < piece.start():
                    target += 1
                while k < len(edits) and (target >= last or leaf_before(edits[k][0]) < target):
                    target = max(target, self._next_bound(bounds, first, edits[k][1]))
                    k += 1
                    while target < last and bounds[target] + shift[k] < piece.start():
                        target += 1
                if target < last and piece.start() == bounds[target] + shift[k]:
                    stop = target
                    break
                found.append(piece.group())
            else:
                k = len(edits)
            self._refill(first, stop, found, count)
            encoded += len(found)
        return changed, encoded

    @staticmethod
    def _next_bound(bounds: list[int], first: int, end: int) -> int:
        """The first old leaf boundary after ``end`` and after the leaf ``first``."""
        return max(first + 1, bisect_right(bounds, end))

    def _refill(self, first: int, stop: int, pieces: list[str], count: Counter) -> None:
        tokens = count.counts(pieces)
        share = -(-len(pieces) // (stop - first)) if pieces else 0
        for i in range(first, stop):
            a, b = (i - first) * share, (i - first + 1) * share
            self.set_leaf(i, sum(map(len, pieces[a:b])), int(tokens[a:b].sum()))


def row_key() -> Column:
    return F.xxhash64("doc_id", "text")


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(row_key().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def trees(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Per row ``row, doc_id, n_tokens`` and the packed tree: ``lengths, sums``."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [Tree.build(text.as_py() or "", counter(vocabulary)) for text in batch.column(2)]
            columns = [
                *batch.columns[:2],
                pa.array([t.total for t in made], pa.int64()),
                pa.array([t.lengths.astype(np.int32).tobytes() for t in made], pa.binary()),
                pa.array([t.sums.astype(np.int32).tobytes() for t in made], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "n_tokens", "lengths", "sums"])

    text_batches(docs.sparkSession)
    return _rows(docs).mapInArrow(build, "row long, doc_id long, n_tokens long, lengths binary, sums binary")


def redactions(docs: DataFrame) -> DataFrame:
    """Edits ``row, start, end, replacement`` that take personal data and secrets out of the texts."""
    rules: list[tuple[re.Pattern, str]] = [(re.compile(pattern), new) for pattern, new in REDACTIONS]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                out += [(row, m.start(), m.end(), new) for rule, new in rules for m in rule.finditer(text)]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            names = ["row", "start", "end", "replacement"]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=names)

    text_batches(docs.sparkSession)
    # a rule needs a digit, so other texts do not go to Python
    some = _rows(docs).where(F.col("text").rlike(r"[\p{Nd}@]|[0-9a-f]{32}")).select("row", "text")
    return some.mapInArrow(find, "row long, start long, end long, replacement string")


def ordered_edits(edits: list, size: int) -> list[tuple[int, int, str]]:
    """Clipped to the text, in order, without overlaps."""
    kept: list[tuple[int, int, str]] = []
    clipped = {(min(max(0, e["start"]), size), min(max(0, e["end"], e["start"]), size), e["replacement"] or "") for e in edits}
    for start, end, new in sorted(clipped):
        if not kept or start > kept[-1][1] or (start == kept[-1][1] and start > kept[-1][0] and end > start):
            kept.append((start, end, new))
    return kept


def recount(docs: DataFrame, kept: DataFrame, edits: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``row, n_edits, n_tokens_edited, n_encoded`` for the edited rows; ``kept`` holds their trees."""

    def update(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row, text, lengths, sums, some in zip(*(batch.column(k) for k in range(5)), strict=True):
                tree = Tree(*(np.frombuffer(x.as_buffer(), np.int32).astype(np.int64) for x in (lengths, sums)))
                text = text.as_py() or ""
                todo = ordered_edits(some.as_py(), len(text))
                _, encoded = tree.edit(text, todo, counter(vocabulary))
                out.append((row.as_py(), len(todo), tree.total, encoded))
            names = ["row", "n_edits", "n_tokens_edited", "n_encoded"]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(4)], names=names)

    text_batches(docs.sparkSession)
    per_row = (
        edits.where("row is not null and start is not null and end is not null")
        .groupBy("row")
        .agg(F.collect_set(F.struct("start", "end", "replacement")).alias("edits"))
    )
    texts = _rows(docs).select("row", "text").join(per_row, "row").dropDuplicates(["row"])
    packed = kept.select("row", "lengths", "sums").dropDuplicates(["row"])
    joined = texts.join(packed, "row").select("row", "text", "lengths", "sums", "edits")
    return joined.mapInArrow(update, "row long, n_edits long, n_tokens_edited long, n_encoded long")


def edited_counts(docs: DataFrame, make_edits: Callable[[DataFrame], DataFrame], vocabulary: str = VOCABULARY) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_tokens, n_edits, n_tokens_edited, n_encoded``."""
    kept = materialize(trees(docs, vocabulary), "token-trees")
    edits = materialize(make_edits(docs), "token-edits")
    counted = kept.select("row", "doc_id", "n_tokens").join(recount(docs, kept, edits, vocabulary), "row", "left")
    zero = F.lit(0).cast("long")
    return counted.select(
        "doc_id",
        "n_tokens",
        F.coalesce("n_edits", zero).alias("n_edits"),
        F.coalesce("n_tokens_edited", "n_tokens").alias("n_tokens_edited"),
        F.coalesce("n_encoded", zero).alias("n_encoded"),
    )


def op2_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return edited_counts(table(spark, folder, "documents"), redactions)
