"""Removal of long repeated byte strings, with suffix arrays by linear grouping.

Any string of ``length`` bytes holds an anchor: the window of ``WINDOW`` bytes
with the smallest hash in it. Equal strings have their anchors at equal places,
so repeats can only lie around anchors that occur more than once.

1. Texts are read once for their anchors. Each goes, with a hash of the bytes
   that strings over it can reach (its surroundings), to the anchor's bucket.
   There, occurrences whose whole surroundings are equal are settled, and
   anchors that occur in different surroundings are marked.
2. Only surroundings of marked anchors are shipped, one per distinct content.
   A bucket sorts them by their bytes to the right and by their bytes to the
   left, each with a suffix array built by linear grouping
   (:mod:`panelforge.llm.suffix_groups`) over names of byte blocks. Intervals of
   common prefixes in the right order, and neighbours in the left order inside
   them, give each occurrence the longest match to both sides, byte by byte.
3. An anchor in more than ``CROWD`` different surroundings is spread instead:
   its strings are dealt by their hashes, and those met twice are reported.
   It is the same test for each single string, so results do not depend on it.
4. The runs of a document are joined to its text, cut out and digested.

Equal texts count once in all this and are then removed whole.

Defined results:

* a null text is empty; texts shorter than ``length`` bytes lose nothing;
* repeated rows, also of one ``doc_id``, are copies of each other and lose all
  their bytes if they have ``length`` of them;
* hashes have 64 bits (equal texts: 64 bits, CRC and length);
* only ``doc_id`` and ``text`` are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm.common import materialize, table, text_batches
from panelforge.llm.hashing import BASE, Hashes, mixed
from panelforge.llm.suffix_groups import row_order

#: Fixed by the contract: bytes of a repeated string.
LENGTH = 400

#: Bytes of an anchor.
WINDOW = 64

#: An anchor in more different surroundings than this is dealt out string by string.
CROWD = 2_000

#: Slots of the bitmaps that mark occurrences and crowded anchors (8 MB each, whatever the data).
MARK_BITS = 26

#: Blocks that a side of the surroundings is cut into; each gets one name.
BLOCKS = 5

_AT = np.uint64((1 << 24) - 1)


def anchors(windows: np.ndarray, span: int) -> np.ndarray:
    """Places that hold the leftmost smallest of some ``span`` windows in a row. At most 2 ** 24 windows at a time."""
    places = []
    piece = 1 << 23
    for start in range(0, max(1, len(windows) - span + 1), piece):
        part = windows[start : start + piece + span - 1]
        keys = (part & ~_AT) | np.arange(len(part), dtype=np.uint64)
        blocks = -(-len(keys) // span)
        grid = np.full(blocks * span, np.uint64(0xFFFFFFFFFFFFFFFF))
        grid[: len(keys)] = keys
        grid = grid.reshape(blocks, span)
        ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
        behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        count = len(keys) - span + 1
        least = np.minimum(behind[:count], ahead[span - 1 : span - 1 + count])
        places.append((least[np.append(True, least[1:] != least[:-1])] & _AT).astype(np.int64) + start)
    return np.unique(np.concatenate(places))


def _bytes(text: pa.Scalar) -> np.ndarray:
    value = text.as_buffer()
    return np.frombuffer(value, np.uint8) if value is not None else np.empty(0, np.uint8)


class Reader:
    """Anchors of texts and what lies around them."""

    def __init__(self, length: int):
        self.length, self.left = length, length - WINDOW
        self.hashes = Hashes()

    def read(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Prefix sums, anchors' places and anchors' hashes."""
        sums = self.hashes.of(data)
        windows = self.hashes.windows(sums, WINDOW)
        places = anchors(windows, self.length - WINDOW + 1)
        return sums, places, windows[places]

    def around(self, sums: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.maximum(0, places - self.left), np.minimum(len(sums) - 1, places + self.length)


def _keyed(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, th, text``; ``th`` is the same for the same text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    th = F.xxhash64(text, F.crc32(text.cast("binary")), F.octet_length(text))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), th.alias("th"), text.alias("text"))


def _dealt(columns: list[np.ndarray], bucket: np.ndarray) -> list[tuple]:
    order = np.argsort(bucket, kind="stable")
    ends = np.flatnonzero(np.append(np.diff(bucket[order]) != 0, True)) + 1
    starts = np.append(0, ends[:-1])
    return [(int(bucket[order[a]]), *(c[order[a:b]].tobytes() for c in columns)) for a, b in zip(starts, ends, strict=True)]


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)


def _buckets(spark: SparkSession) -> int:
    return 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def anchor_table(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Anchors of all texts, dealt to buckets by hash: ``bucket`` and packed ``h, c, th, pos, reach``.

    ``c`` hashes the surroundings, ``reach`` packs the lengths of their two sides.
    """
    buckets = _buckets(docs.sparkSession)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, seen = Reader(length), set()
        for batch in batches:
            parts: list[list[np.ndarray]] = []
            for th, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = _bytes(text)
                if len(data) < length or th in seen:
                    continue
                seen.add(th)
                sums, places, h = reader.read(data)
                start, end = reader.around(sums, places)
                c = reader.hashes.stretch(sums, start, end) + (places - start).astype(np.uint64)
                reach = ((places - start) * 4096 + (end - places)).astype(np.int32)
                parts.append([h, c, np.full(len(h), th, np.int64), places.astype(np.int32), reach])
            if parts:
                columns = [np.concatenate(x) for x in zip(*parts, strict=True)]
                rows = _dealt(columns, (columns[0] % np.uint64(buckets)).astype(np.int64))
                yield _batch(rows, ["bucket", "h", "c", "th", "pos", "reach"], [pa.int32(), *[pa.binary()] * 5])

    text_batches(docs.sparkSession)
    return _keyed(docs).where(F.col("n_bytes") >= length).select("th", "text").mapInArrow(
        gather, "bucket int, h binary, c binary, th binary, pos binary, reach binary"
    )


_KINDS = {"h": np.uint64, "c": np.uint64, "th": np.int64, "pos": np.int32, "reach": np.int32, "w": np.uint64, "a": np.int32}


def _unpacked(rows: pd.DataFrame, names: str) -> list[np.ndarray]:
    return [np.concatenate([np.frombuffer(x, _KINDS[n]) for x in rows[n]]) for n in names.split()]


def judged_anchors(packed: DataFrame, length: int = LENGTH) -> DataFrame:
    """``kind, th, x, y``: runs [x, y) that are settled (kind 0), occurrences x of marked anchors (1), crowded anchors x (2)."""

    def judge(rows: pd.DataFrame) -> pd.DataFrame:
        h, c, th, pos, reach = _unpacked(rows, "h c th pos reach")
        order = np.lexsort((pos, th, c, h))
        h, c, th, pos, reach = (x[order] for x in (h, c, th, pos, reach))
        new = np.append(True, (h[1:] != h[:-1]) | (th[1:] != th[:-1]) | (pos[1:] != pos[:-1]))
        h, c, th, pos, reach = (x[new] for x in (h, c, th, pos, reach))
        first = np.append(True, (h[1:] != h[:-1]) | (c[1:] != c[:-1]))
        kind = np.cumsum(first) - 1
        copies = np.bincount(kind)[kind]
        group = np.cumsum(np.append(True, h[1:] != h[:-1])) - 1
        contents = np.bincount(group, first)[group]
        left, right = reach // 4096, reach % 4096
        equal = (copies > 1) & (left + right >= length)
        settled = pd.DataFrame({"kind": 0, "th": th[equal], "x": (pos - left)[equal].astype(np.int64), "y": (pos + right)[equal].astype(np.int64)})
        ship = first & (contents > 1)
        marked = pd.DataFrame({"kind": 1, "th": th[ship], "x": pos[ship].astype(np.int64), "y": 0})
        crowded = np.unique(h[contents > CROWD]).view(np.int64)
        return pd.concat([settled, marked, pd.DataFrame({"kind": 2, "th": 0, "x": crowded, "y": 0})])

    return packed.groupBy("bucket").applyInPandas(judge, "kind int, th long, x long, y long")


def _occurrence(th: np.ndarray | int, pos: np.ndarray) -> np.ndarray:
    return mixed(np.asarray(th, np.int64).view(np.uint64) * BASE + pos.astype(np.uint64))


def _marks(found: DataFrame, of_anchor: bool) -> np.ndarray:
    """A bitmap of fixed size; tasks mark and the driver gets at most ``2 ** (MARK_BITS - 13)`` pieces."""

    def mark(rows: pd.DataFrame) -> pd.DataFrame:
        ones = np.zeros(8192, np.uint8)
        ones[rows["bit"].to_numpy()] = 1
        return pd.DataFrame({"piece": rows["piece"].iloc[:1], "ones": [np.packbits(ones).tobytes()]})

    def slots(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            x = part["x"].to_numpy(np.int64)
            slot = (x.view(np.uint64) if of_anchor else _occurrence(part["th"].to_numpy(np.int64), x)) & np.uint64((1 << MARK_BITS) - 1)
            slot = np.unique(slot).astype(np.int64)
            yield pd.DataFrame({"piece": slot >> 13, "bit": (slot & 8191).astype(np.int32)})

    pieces = (
        found.select("th", "x")
        .mapInPandas(slots, "piece long, bit int")
        .distinct()
        .groupBy("piece")
        .applyInPandas(mark, "piece long, ones binary")
        .toPandas()
    )
    bitmap = np.zeros((1 << MARK_BITS - 13, 1024), np.uint8)
    for piece, ones in pieces.itertuples(index=False):
        bitmap[piece] = np.frombuffer(ones, np.uint8)
    return bitmap.reshape(-1)


def _is_marked(bitmap: np.ndarray, x: np.ndarray) -> np.ndarray:
    slot = (x & np.uint64((1 << MARK_BITS) - 1)).astype(np.int64)
    return (bitmap[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8) & 1).astype(bool)


def matched_runs(docs: DataFrame, found: DataFrame, length: int = LENGTH) -> DataFrame:
    """``th, x, y``: runs around the marked anchors."""
    spark = docs.sparkSession
    buckets = _buckets(spark)
    shared = spark.sparkContext.broadcast((_marks(found.where("kind = 1"), False), _marks(found.where("kind = 2"), True)))
    left, right = length - WINDOW, length

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Surroundings of marked anchors (``bytes``: left side, reversed, and right side) and strings of crowded ones (``w``)."""
        reader, seen = Reader(length), set()
        occurrences, crowds = shared.value
        names = ["bucket", "h", "th", "pos", "a", "bytes"]
        for batch in batches:
            rows: list[tuple] = []
            parts: list[list[np.ndarray]] = []
            strings: list[list[np.ndarray]] = []
            for th, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = _bytes(text)
                if len(data) < length or th in seen:
                    continue
                seen.add(th)
                sums, places, h = reader.read(data)
                chosen = _is_marked(occurrences, _occurrence(th, places))
                if not chosen.any():
                    continue
                places, h = places[chosen], h[chosen]
                crowded = _is_marked(crowds, h)
                # bytes of UTF-8 stay below 255, so 0 can stand for what is beyond the ends
                padded = np.zeros(len(data) + left + right, np.uint8)
                padded[left : left + len(data)] = data + 1
                some = places[~crowded]
                if len(some):
                    view = np.lib.stride_tricks.sliding_window_view(padded, left + right)[some]
                    parts.append([h[~crowded], np.full(len(some), th, np.int64), some.astype(np.int32), view])
                if crowded.any():
                    start = (places[crowded][:, None] - np.arange(left + 1)).reshape(-1)
                    at = np.repeat(places[crowded], left + 1)
                    inside = (start >= 0) & (start + length <= len(data))
                    start, at = start[inside], at[inside]
                    w = reader.hashes.stretch(sums, start, start + length)
                    strings.append([w, np.full(len(w), th, np.int64), at.astype(np.int32), (at - start).astype(np.int32)])
            if parts:
                h, th, pos, view = (np.concatenate(x) for x in zip(*parts, strict=True))
                bucket = (h % np.uint64(buckets)).astype(np.int64)
                none = np.zeros((len(h), 0), np.int32)
                rows += _dealt([h, th, pos, none, view], bucket)
            if strings:
                columns = [np.concatenate(x) for x in zip(*strings, strict=True)]
                rows += [(-1 - b, *x, b"") for b, *x in _dealt(columns, (columns[0] % np.uint64(buckets)).astype(np.int64))]
            if rows:
                yield _batch(rows, names, [pa.int32(), *[pa.binary()] * 5])

    def match(rows: pd.DataFrame) -> pd.DataFrame:
        if rows["bucket"].iloc[0] < 0:
            return _met_strings(rows, length)
        h, th, pos = _unpacked(rows, "h th pos")
        context = np.concatenate([np.frombuffer(x, np.uint8).reshape(-1, left + right) for x in rows["bytes"]])
        order = np.lexsort((pos, th, h))
        order = order[np.append(True, (np.diff(th[order]) != 0) | (np.diff(pos[order]) != 0) | (h[order][1:] != h[order][:-1]))]
        several = np.bincount(np.unique(h[order], return_inverse=True)[1])[np.unique(h[order], return_inverse=True)[1]] > 1
        order = order[several]
        h, th, pos, context = h[order], th[order], pos[order], context[order]
        before, after = longest_matches(h, context[:, :left][:, ::-1], context[:, left:], length)
        hit = before + after > 0
        return pd.DataFrame({"th": th[hit], "x": (pos[hit] - before[hit]).astype(np.int64), "y": (pos[hit] + after[hit]).astype(np.int64)})

    text_batches(spark)
    shipped = _keyed(docs).where(F.col("n_bytes") >= length).select("th", "text").mapInArrow(
        gather, "bucket int, h binary, th binary, pos binary, a binary, bytes binary"
    )
    return shipped.groupBy("bucket").applyInPandas(match, "th long, x long, y long")


def _met_strings(rows: pd.DataFrame, length: int) -> pd.DataFrame:
    """Runs of the strings (hash in ``h``) that start in several places."""
    w, th, pos, a = _unpacked(rows.rename(columns={"h": "w"}), "w th pos a")
    order = np.lexsort((pos - a, th, w))
    w, th, start = w[order], th[order], (pos - a)[order]
    new = np.append(True, (w[1:] != w[:-1]) | (th[1:] != th[:-1]) | (start[1:] != start[:-1]))
    w, th, start = w[new], th[new], start[new]
    same = w[1:] == w[:-1]
    met = np.append(same, False) | np.append(False, same)
    th, start = th[met], start[met].astype(np.int64)
    order = np.lexsort((start, th))
    th, start = th[order], start[order]
    if not len(th):
        return pd.DataFrame({"th": th, "x": start, "y": start})
    first = np.append(True, (th[1:] != th[:-1]) | (start[1:] > start[:-1] + length))
    last = np.append(first[1:], True)
    return pd.DataFrame({"th": th[first], "x": start[first], "y": start[last] + length})


def _common(rows: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefixes of rows ``a`` and ``b``, not counting padding."""
    out = np.empty(len(a), np.int64)
    for k in range(0, len(a), 20_000):
        one, two = rows[a[k : k + 20_000]], rows[b[k : k + 20_000]]
        differ = (one != two) | (one == 0)
        out[k : k + 20_000] = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return out


def _names(rows: np.ndarray) -> np.ndarray:
    """Names of the byte blocks of each row, in the order of their bytes."""
    width = -(-rows.shape[1] // BLOCKS)
    padded = np.zeros((len(rows), width * BLOCKS), np.uint8)
    padded[:, : rows.shape[1]] = rows
    blocks = np.ascontiguousarray(padded.reshape(-1, width)).view(f"S{width}").reshape(-1)
    return np.unique(blocks, return_inverse=True)[1].reshape(-1, BLOCKS)


def longest_matches(h: np.ndarray, left: np.ndarray, right: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """How far each occurrence's repeated strings reach to the left (reversed bytes given) and to the right; 0 and 0 for none.

    Occurrences of one anchor begin their right sides alike and are neighbours
    in the right order. Those with a common prefix of at least r form an
    interval in it; the best partner to the left within an interval is a
    neighbour in the left order of its members.
    """
    n = len(h)
    before, after = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if n < 2:
        return before, after
    order = row_order(_names(right))
    place = np.empty(n, np.int64)
    place[row_order(_names(left))] = np.arange(n)
    shared = _common(right, order[:-1], order[1:])
    shared[h[order[:-1]] != h[order[1:]]] = 0
    least = length - left.shape[1]
    lo, hi, r = _intervals(shared.tolist(), least)
    if not len(lo):
        return before, after
    size = hi - lo
    node = np.repeat(np.arange(len(lo)), size)
    inside = np.arange(len(node)) - np.repeat(np.cumsum(size) - size, size)
    member = order[np.repeat(lo, size) + inside]
    by_left = np.lexsort((place[member], node))
    node, member = node[by_left], member[by_left]
    near = np.where(node[1:] == node[:-1], _common(left, member[:-1], member[1:]), -1)
    best = np.maximum(np.append(near, -1), np.append(-1, near))
    reach = r[node]
    hit = best + reach >= length
    np.maximum.at(before, member[hit], best[hit])
    np.maximum.at(after, member[hit], reach[hit])
    return before, after


def _intervals(shared: list[int], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs [lo, hi) of the order whose neighbours share at least r, for every r >= ``least`` that ends one."""
    found: list[tuple[int, int, int]] = []
    open_: list[tuple[int, int]] = []
    for at, value in enumerate([*shared, 0]):
        start = at
        while open_ and open_[-1][1] > value:
            start, r = open_.pop()
            found.append((start, at + 1, r))
        if value >= least and (not open_ or open_[-1][1] < value):
            open_.append((start, value))
    if not found:
        return (np.empty(0, np.int64),) * 3
    lo, hi, r = np.array(found, np.int64).T
    return lo, hi, r


def repeated_runs(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``th, runs``: per text that occurs once the packed starts and ends of its removed runs; ``runs`` null: a repeated text."""
    found = materialize(judged_anchors(anchor_table(docs, length), length), "suffix-anchors")
    runs = found.where("kind = 0").select("th", "x", "y").union(matched_runs(docs, found, length))

    def merge(lists: pd.Series) -> pd.Series:
        out = []
        for rows in lists:
            spans = np.array([(r["x"], r["y"]) for r in rows], np.int64)
            spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
            reach = np.maximum.accumulate(spans[:, 1])
            first = np.append(True, spans[1:, 0] > reach[:-1])
            out.append(np.column_stack([spans[first, 0], reach[np.append(first[1:], True)]]).tobytes())
        return pd.Series(out)

    packed = runs.groupBy("th").agg(F.collect_list(F.struct("x", "y")).alias("list")).select("th", F.pandas_udf(merge, "binary")("list").alias("runs"))
    repeated = _keyed(docs).where(F.col("n_bytes") >= length).groupBy("th").agg(F.count("*").alias("k")).where("k > 1")
    repeated = repeated.select("th", F.lit(True).alias("repeated"))
    return packed.join(repeated, "th", "full").select("th", "runs", F.coalesce("repeated", F.lit(False)).alias("repeated"))


def cut_texts(docs: DataFrame, runs: DataFrame) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        nothing = hashlib.sha256().hexdigest()
        for batch in batches:
            rows = []
            for doc_id, size, text, packed, repeated in zip(*(batch.column(k) for k in range(5)), strict=True):
                n = size.as_py()
                if repeated.as_py():
                    rows.append((doc_id.as_py(), n, n, 1, nothing))
                    continue
                data = text.as_buffer().to_pybytes()
                spans = np.frombuffer(packed.as_buffer(), np.int64).reshape(-1, 2).tolist() if packed.is_valid else []
                digest, at = hashlib.sha256(), 0
                for x, y in spans:
                    digest.update(data[at:x])
                    at = y
                digest.update(data[at:])
                rows.append((doc_id.as_py(), n, sum(y - x for x, y in spans), len(spans), digest.hexdigest()))
            yield _batch(rows, names, [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()])

    text_batches(docs.sparkSession)
    joined = _keyed(docs).join(runs, "th", "left").select("doc_id", "n_bytes", "text", "runs", "repeated")
    return joined.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op7_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return cut_texts(docs, repeated_runs(docs))
