"""CSV files with line breaks inside quotes, read by many tasks.

A line break ends a record only if the quotes before it are even in number. A
first pass counts the quotes of every split; their running sum over a file's splits
tells whether a split starts inside quotes. A second pass reads the splits from
their true record starts: records that lie within a split are put together where
they are read, and the one record that may cross into the next split is joined from
its parts, of which there are at most two a split. What is sent to the tasks is a
row for every split, some hundred bytes for as many megabytes of the files as a split has.

Quotes are doubled inside quotes. The header is one line. Empty lines are no records.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from panelforge.session import scratch_path

_OPTIONS = {"quote": '"', "escape": '"', "multiLine": "true"}


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """``value, file, start`` of all lines; lines of a split come in order."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def split_states(lines: DataFrame) -> DataFrame:
    """``file, start, inside, head``: whether a split starts inside quotes, and a file's first line at its first split."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    counted = lines.groupBy("file", "start").agg(
        F.sum(quotes).alias("quotes"), F.first(F.when(F.col("start") == 0, F.col("value"))).alias("head")
    )
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    # one row per split
    inside = F.coalesce(F.sum("quotes").over(before) % 2, F.lit(0)).cast("int")
    return counted.select("file", "start", inside.alias("inside"), "head")


class _Split:
    """Puts the lines of one split together to records; ``lead`` are the lines up to the first true record start."""

    def __init__(self, file: str, start: int, inside: int):
        self.file, self.start, self.parity = file, start, inside
        self.open: list[str] = []
        self.is_lead = bool(inside)

    def add(self, values: pa.Array) -> tuple[pa.Array, list[str], list[tuple]]:
        """Records of one line, records of several lines, and the finished lead."""
        quotes = pc.count_substring(values, '"').to_numpy(zero_copy_only=False).astype(np.int64) & 1
        after = (self.parity + np.cumsum(quotes)) & 1
        before = np.r_[self.parity, after[:-1]]
        whole = (before == 0) & (quotes == 0)
        several, edges = [], []
        rest = np.flatnonzero(~whole)
        for i, text in zip(rest, values.take(pa.array(rest)).to_pylist()):
            self.open.append(text)
            if after[i] == 0:
                record = "\n".join(self.open)
                if self.is_lead:
                    edges.append((self.file, self.start, 0, record))
                else:
                    several.append(record)
                self.open, self.is_lead = [], False
        self.parity = int(after[-1]) if len(after) else self.parity
        return values.filter(pa.array(whole)), several, edges

    def rest(self) -> list[tuple]:
        """What is open at the end: the tail, or, in a split without a record start, more of an earlier one's."""
        return [(self.file, self.start, 0 if self.is_lead else 1, "\n".join(self.open))] if self.open else []


def _together(lines: DataFrame, states: DataFrame, with_edges: bool) -> DataFrame:
    """Records within splits, or else the parts of those that cross splits (``file, start, is_tail, value``)."""
    # a split that the first pass did not see would have a wrong state
    state = F.coalesce("inside", F.raise_error(F.lit("the splits of the files have changed between two reads")).cast("int"))
    known = lines.join(F.broadcast(states.select("file", "start", "inside")), ["file", "start"], "left")
    known = known.select("value", "file", "start", state.alias("inside"))

    def edges_of(found: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*found)) or [[], [], [], []]
        types = [pa.string(), pa.int64(), pa.int32(), pa.string()]
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], ["file", "start", "is_tail", "value"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = None
        for batch in batches:
            files, starts = batch.column("file"), batch.column("start").to_numpy()
            coded = pc.dictionary_encode(files).indices.to_numpy()
            cuts = np.flatnonzero(np.r_[True, (np.diff(starts) != 0) | (np.diff(coded) != 0)]) if len(starts) else []
            for a, b in zip(cuts, [*cuts[1:], len(starts)]):
                file, start = files[int(a)].as_py(), int(starts[a])
                found = []
                if split is None or (split.file, split.start) != (file, start):
                    found = split.rest() if split else []
                    split = _Split(file, start, batch.column("inside")[int(a)].as_py())
                    a += start == 0  # the header
                single, several, edges = split.add(batch.column("value").slice(a, b - a))
                if with_edges:
                    yield edges_of(found + edges)
                elif len(single) or several:
                    yield pa.record_batch([pa.concat_arrays([single, pa.array(several, single.type)])], ["value"])
        if with_edges and split:
            yield edges_of(split.rest())

    if with_edges:
        return known.mapInArrow(read, "file string, start long, is_tail int, value string")
    return known.mapInArrow(read, "value string")


def records(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """``value`` of every record, and the different headers of the files."""
    lines = _lines(spark, path)
    states = _stored(split_states(lines), "splits")
    # every file should begin alike; two are enough to tell
    heads = [r["head"] for r in states.where("start = 0 and head is not null").select("head").distinct().limit(2).collect()]
    edges = _stored(_together(lines, states, True), "split-edges")
    order = Window.partitionBy("file").orderBy("start", "is_tail")
    numbered = edges.select("file", "start", "is_tail", F.sum("is_tail").over(order).alias("record"))
    parts = edges.join(numbered, ["file", "start", "is_tail"]).groupBy("file", "record")
    listed = parts.agg(F.sort_array(F.collect_list(F.struct("start", "is_tail", "value"))).alias("parts"))
    crossing = listed.select(F.array_join("parts.value", "\n").alias("value"))
    return _together(lines, states, False).unionByName(crossing), heads


def read_quoted_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of CSV files with a header, like the reader of whole files with ``multiLine`` and ``escape='"'``."""
    names = StructType.fromDDL(schema).names
    found, heads = records(spark, path)
    for head in heads:
        shown = [h.strip().strip('"') for h in head.removeprefix("\ufeff").rstrip("\r").split(",")]
        if shown != names:
            raise ValueError(f"header of {path} is {shown}, expected {names}")
    value = F.regexp_replace("value", r"\r\z", "")
    return found.where(value != "").select(F.from_csv(value, schema, _OPTIONS).alias("_r")).select("_r.*")
