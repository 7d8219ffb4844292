"""N-gram Jaccard join with a token-group matrix: near duplicates on word shingles, exactly.

Texts become sets of hashed five-word shingles. Documents of equal sets are one
node. Two sets can only be similar enough if they share tokens among their
first ones in a global order, so only those first tokens (a fifth of a set) are
compared; tokens that several documents hold come last in the order, the more
often the later.

1. Tokens held by one node alone are dropped.
2. Similar nodes are grouped: some nodes of each token are centres, and nodes that
   are verified against a centre share its group; nodes left alone among many meet more.
3. The token-group matrix stores each group's union of first tokens, with the
   range of its set sizes. For a node (the query) and another group, the tokens
   they share bound the overlap with any member; only groups that can still
   reach the share are opened, and only pairs within them whose own bounds hold
   (common tokens, and bitmaps of the whole sets, which grow with the sets) are
   verified on whole sets.
4. Of a node and an opened group the likeliest pair is verified first; all others
   follow where it is no link. Links become components.

A group of thousands of near copies has one row per token in the matrix, so it
is met once, not once per member; no pairs inside a group are formed.

Defined results:

* null, empty and white-space texts have no shingle; they link with nothing and
  are their own component;
* with fewer than five words the whole sequence is the one shingle;
* repeated rows and equal texts share a component; its id is the smallest
  non-null ``doc_id`` in it (null if there is none);
* hashes of words, shingles and sets have 64 bits;
* the centres and the list of frequent tokens only steer the work: any choice of
  them gives the same links;
* only ``doc_id`` and ``text`` are read, so other columns may have any name.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm.common import materialize, table, text_batches
from panelforge.llm.components import components
from panelforge.llm.hashing import Hashes

#: Words of a shingle.
WORDS = 5

#: First tokens kept beyond those that exactness needs; more of them tighten the bound.
EXTRA = 2

#: Tokens of more documents than this come last in the order, the most frequent
#: so many of them (5 bytes each, broadcast). Any such list gives exact results.
HEAVY_DOCS = 2
MOST_HEAVY = 2_000_000

#: Slots of the bitmap that picks the rows whose whole sets are verified (8 MB, whatever the data).
ROW_BITS = 26

_LOW32 = np.uint64(0xFFFFFFFF)


#: Fixed by the contract: bytes between words.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


class Shingler:
    """Texts to sorted sets of shingle hashes."""

    def __init__(self, words: int = WORDS):
        self.words = words
        self.hashes = Hashes()

    def tokens(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, np.uint64)
        # bytes.lower knows ASCII only, which is the contract
        data = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), np.uint8)
        edge = np.flatnonzero(np.diff(_SPACE[data], prepend=True, append=True))
        if not len(edge):
            return np.empty(0, np.uint64)
        ids = self.hashes.stretch(self.hashes.of(data), edge[::2], edge[1::2])
        width = min(self.words, len(ids))
        h = np.full(len(ids) - width + 1, width, np.uint64)
        for k in range(width):
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            h += ids[k : len(ids) - width + 1 + k]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(29)
        h.sort()
        return h[np.append(True, h[1:] != h[:-1])]


def first_count(n: int) -> int:
    return min(n, n - (4 * n + 4) // 5 + EXTRA)


#: Low halves of the frequent tokens, sorted, and the power of two their count has reached.
Heavy = tuple[np.ndarray, np.ndarray]


def first_tokens(tokens: np.ndarray, heavy: Heavy | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The first tokens in the order (by frequency where that is known, then by hash), as light and heavy ones."""
    count = first_count(len(tokens))
    if heavy is None or not len(heavy[0]):
        return tokens[:count], tokens[:0]
    low = (tokens & _LOW32).astype(np.uint32)
    at = np.minimum(np.searchsorted(heavy[0], low), len(heavy[0]) - 1)
    is_heavy = heavy[0][at] == low
    light = tokens[~is_heavy][:count]
    late = tokens[is_heavy][np.argsort(heavy[1][at[is_heavy]], kind="stable")]
    return light, late[: count - len(light)]


#: Columns of a set's bitmap, 64 bits each.
BITS = ("b0", "b1", "b2", "b3")
#: The same of the other set of a pair.
OTHER = ("y0", "y1", "y2", "y3")


def parity(tokens: np.ndarray) -> list[int]:
    """256 bits: whether an odd number of tokens falls on each. Bits in which two sets differ bound their difference."""
    odd = (np.bincount((tokens >> np.uint64(56)).astype(np.int64), minlength=256) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64).tolist()


def whole_map(tokens: np.ndarray) -> bytes:
    """:func:`parity` on a power of two of bits, at least eight for every token."""
    width = max(8, (8 * len(tokens) - 1).bit_length())
    odd = np.bincount((tokens >> np.uint64(64 - width)).astype(np.int64), minlength=1 << width) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def folded(maps: np.ndarray, size: int) -> np.ndarray:
    """Rows of :func:`whole_map` as they are on fewer bits (``size`` bytes)."""
    while maps.shape[1] > size:
        bits = np.unpackbits(maps, axis=1)
        maps = np.packbits(bits[:, ::2] ^ bits[:, 1::2], axis=1)
    return maps


def _buckets(spark: SparkSession) -> int:
    return 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def _by_bucket(bucket: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    bucket = bucket.astype(np.min_scalar_type(buckets), copy=False)  # narrow numbers are sorted by radix
    order = np.argsort(bucket, kind="stable")
    ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for b in np.flatnonzero(ends[1:] > ends[:-1]):
        yield int(b), order[ends[b] : ends[b + 1]]


def _rows(docs: DataFrame) -> DataFrame:
    row = F.xxhash64("doc_id", "text")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), row.alias("row"), F.col("text").cast("string").alias("text"))


#: Tokens that a task gathers before it hands them on. What they take, and the copies made to deal them out,
#: stays with the Python worker, and with the executor's own buffers for a batch, also while later steps run.
_GATHERED = 500_000
#: Steps of a count for each power of two, when the list of frequent tokens is made to fit.
_STEPS = 8


def _gathered(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """``bucket, low``: low halves of the tokens of texts, dealt by the other half of a hash, so different tokens are hardly counted as one."""
    shingler, parts, held = Shingler(), [], 0

    def packed() -> pa.RecordBatch:
        low, bucket = (np.concatenate([part[k] for part in parts]) for k in range(2))
        rows = [(b, low[at].tobytes()) for b, at in _by_bucket(bucket, buckets)]
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["bucket", "low"]
        )

    narrow = np.min_scalar_type(buckets)
    for batch in batches:
        for text in batch.column(0):
            tokens = shingler.tokens(text.as_py())
            parts.append((tokens.astype(np.uint32), ((tokens >> np.uint64(32)) % np.uint64(buckets)).astype(narrow)))
            held += len(tokens)
            if held > _GATHERED:
                yield packed()
                parts, held = [], 0
    if held:
        yield packed()


def heavy_tokens(docs: DataFrame) -> Heavy:
    """The tokens that several documents hold.

    All tokens of a text are counted, not its first ones by hash: where frequent
    ones make room, those next by hash may be as frequent.
    """
    spark = docs.sparkSession
    buckets = _buckets(spark)

    def count(rows: pd.DataFrame) -> pd.DataFrame:
        low, n = np.unique(np.concatenate([np.frombuffer(x, np.uint32) for x in rows["low"]]), return_counts=True)
        low, n = low[n > HEAVY_DOCS], n[n > HEAVY_DOCS]
        step = np.floor(_STEPS * np.log2(n)).astype(np.int64)
        packed = [(s, len(at), low[at].tobytes()) for s, at in _by_bucket(step, step.max(initial=0) + 1)]
        return pd.DataFrame(packed, columns=["step", "k", "low"])

    text_batches(spark)
    gathered = docs.select(F.col("text").cast("string")).mapInArrow(functools.partial(_gathered, buckets=buckets), "bucket int, low binary")
    counts = materialize(gathered.groupBy("bucket").applyInPandas(count, "step int, k long, low binary"), "shingle-counts")
    sizes = dict(counts.groupBy("step").agg(F.sum("k")).collect())
    least, share, room = 0, 1.0, MOST_HEAVY
    for step in sorted(sizes, reverse=True):
        if room <= 0:
            break
        least, share = step, min(1.0, room / sizes[step])
        room -= sizes[step]
    # packed, as a row for each token would fill the driver; of the last step there may be room for a share
    some = F.when(F.col("step") > least, F.col("k")).otherwise(F.floor(F.col("k") * share)).cast("int")
    most = counts.where(F.col("step") >= least).select("step", F.col("low").substr(F.lit(1), 4 * some).alias("low")).collect()
    low = np.concatenate([np.empty(0, np.uint32), *(np.frombuffer(x["low"], np.uint32) for x in most)])
    power = np.repeat(np.array([x["step"] // _STEPS for x in most], np.uint8), [len(x["low"]) // 4 for x in most])
    order = np.lexsort((power, low))
    low, power = low[order], power[order]
    last = np.append(low[1:] != low[:-1], True)[: len(low)]  # tokens of one low half have the larger count
    return low[last], power[last]


def sketches(docs: DataFrame) -> DataFrame:
    """Per row ``doc_id, row, n, node, b0 … b3, light, heavy, map``: set size, hash and bitmaps of the set, first tokens."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(heavy_tokens(docs))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, heavy = Shingler(), shared.value
        for batch in batches:
            out = []
            for text in batch.column(2):
                tokens = shingler.tokens(text.as_py())
                light, late = first_tokens(tokens, heavy)
                node = int(np.uint64(xxhash.xxh3_64_intdigest(tokens.tobytes())).astype(np.int64))
                out.append((len(tokens), node, *parity(tokens), light.tobytes(), late.view(np.int64), whole_map(tokens) if len(tokens) else b""))
            kinds = (*[pa.int64()] * 6, pa.binary(), pa.list_(pa.int64()), pa.binary())
            columns = [pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], names=["doc_id", "row", "n", "node", *BITS, "light", "heavy", "map"])

    sketched = _rows(docs).mapInArrow(sketch, "doc_id long, row long, n long, node long, b0 long, b1 long, b2 long, b3 long, light binary, heavy array<long>, map binary")
    return materialize(sketched, "shingle-sketches")


def shared_tokens(sketched: DataFrame, nodes: DataFrame) -> DataFrame:
    """``token, node, n, late, b0 … b3`` for the first tokens that several nodes hold."""
    spark = sketched.sparkSession
    buckets = _buckets(spark)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            parts, nodes = [], []
            for node, light in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if node not in seen:
                    seen.add(node)
                    parts.append(np.frombuffer(light, np.uint64))
                    nodes.append(np.full(len(parts[-1]), node, np.int64))
            if not parts:
                continue
            tokens, nodes = np.concatenate(parts), np.concatenate(nodes)
            rows = [(b, tokens[at].tobytes(), nodes[at].tobytes()) for b, at in _by_bucket((tokens & _LOW32).astype(np.int64) % buckets, buckets)]
            kinds = (pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["bucket", "tokens", "nodes"])

    def several(rows: pd.DataFrame) -> pd.DataFrame:
        tokens, nodes = (np.concatenate([np.frombuffer(x, np.int64) for x in rows[c]]) for c in ("tokens", "nodes"))
        order = np.lexsort((nodes, tokens))
        tokens, nodes = tokens[order], nodes[order]
        new = np.append(True, (tokens[1:] != tokens[:-1]) | (nodes[1:] != nodes[:-1]))
        tokens, nodes = tokens[new], nodes[new]
        same = tokens[1:] == tokens[:-1]
        keep = np.append(same, False) | np.append(False, same)
        return pd.DataFrame({"token": tokens[keep], "node": nodes[keep]})

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    some = sketched.where("n > 0")
    light = some.select("node", "light").mapInArrow(gather, "bucket int, tokens binary, nodes binary")
    light = light.groupBy("bucket").applyInPandas(several, "token long, node long")
    late = some.select("node", F.explode("heavy").alias("token")).select("token", "node").distinct()
    described = nodes.select("node", "n", "late", *BITS)
    return materialize(light.unionByName(late).join(described, "node"), "shingle-tokens")


def _left_out(n: str) -> str:
    return f"greatest(0, (4 * {n} + 4) div 5 - {EXTRA})"


def _needed(a: str, b: str) -> str:
    """Common first tokens that sets of these sizes must have: what their other tokens cannot bring.

    100 * intersection >= 80 * union is 9 * intersection >= 4 * (a + b).
    """
    return f"greatest(1, (4 * ({a} + {b}) + 8) div 9 - greatest({_left_out(a)}, {_left_out(b)}))"


def _possible(pairs: DataFrame) -> DataFrame:
    return pairs.where(f"5 * least(na, nb) >= 4 * greatest(na, nb) and c >= {_needed('na', 'nb')}")


def _near_bits(na: str, nb: str) -> str:
    """Whether the bitmaps of two sets leave room for enough overlap."""
    differ = " + ".join(f"bit_count({a} ^ {b})" for a, b in zip(BITS, OTHER, strict=True))
    return f"2 * ((4 * ({na} + {nb}) + 8) div 9) <= {na} + {nb} - ({differ})"


#: Centres of a token: in the first round, and for nodes that these left alone, where more nodes hold it.
CENTRES = 2
MORE_CENTRES = 12


def centre_pairs(tokens: DataFrame, linked: DataFrame | None = None) -> DataFrame:
    """``a, na, b, nb``: nodes and centres that can be similar.

    Each token has up to three centres among its nodes: the one with the most
    heavy tokens (in a group of near copies that which the others were made
    from) and two by hash. With ``linked`` (``node``), the nodes without a link
    meet further centres of the tokens that more nodes hold.
    """
    node = F.struct(F.col("node").alias("b"), F.col("n").alias("nb"), *[F.col(b).alias(y) for b, y in zip(BITS, OTHER, strict=True)])
    if linked is None:
        ranks, asking, enough = ["late", *(F.xxhash64("node", F.lit(k + 1)) for k in range(CENTRES))], tokens, 1
    else:
        ranks, enough = [F.xxhash64("node", F.lit(CENTRES + k + 1)) for k in range(MORE_CENTRES)], CENTRES + 1
        asking = tokens.join(linked, "node", "left_anti")
    best = [F.max_by(node, rank).alias(f"m{k}") for k, rank in enumerate(ranks)]
    centre = tokens.groupBy("token").agg(F.count("*").alias("held"), *best).where(F.col("held") > enough)
    centre = centre.select("token", F.inline(F.array_distinct(F.array(*[f"m{k}" for k in range(len(best))]))))
    fits = f"node <> b and 5 * least(n, nb) >= 4 * greatest(n, nb) and {_near_bits('n', 'nb')}"
    met = asking.join(centre, "token").where(fits)
    counted = met.groupBy(F.col("node").alias("a"), F.col("n").alias("na"), "b", "nb").agg(F.count("*").alias("c"))
    return _possible(counted).select("a", "na", "b", "nb")


def _labels(roots: DataFrame) -> DataFrame:
    """``node, root`` with the roots themselves."""
    return roots.select("node", "root").union(roots.select(F.col("root").alias("node"), "root")).distinct()


def group_pairs(tokens: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs of different groups that can be similar, through the token-group matrix.

    ``a, na, b, nb`` of nodes that are groups of their own; the tokens with
    their groups; ``node, g`` of the groups of several that are opened for a node.

    A group of one node is its own row of the matrix; with its bitmap, and with
    the count of common tokens, the pair is judged at once. Groups of several
    are opened if their union leaves them possible. Each pair of groups is met
    from one side: a node asks groups above its own, and groups of several.
    """
    grouped = tokens.join(_labels(roots), "node", "left").withColumn("many", F.col("root").isNotNull()).withColumn("g", F.coalesce("root", "node"))
    grouped = materialize(grouped.select("token", "node", "n", *BITS, "g", "many"), "shingle-groups")
    matrix = grouped.groupBy("token", F.col("g").alias("other"), F.col("many").alias("many_other")).agg(
        F.min("n").alias("least"), F.max("n").alias("most"), *[F.min(b).alias(y) for b, y in zip(BITS, OTHER, strict=True)]
    )
    wide = materialize(matrix, "shingle-matrix")
    several = wide.groupBy("token").agg(F.count("*").alias("k")).where("k > 1").select("token")
    wide = wide.join(several, "token", "left_semi")
    fits = "g <> other and 5 * most >= 4 * n and 4 * least <= 5 * n"
    once = f"case when many_other then not many or g < other else not many and g < other and {_near_bits('n', 'least')} end"
    met = grouped.join(wide, "token").where(fits).where(once)
    bound = met.groupBy("node", "n", "other", "many_other").agg(F.count("*").alias("c"), F.min("least").alias("least"), F.max("most").alias("most"))
    bound = materialize(bound.where("many_other or c >= " + _needed("n", "least")), "shingle-bounds")
    alone = bound.where("not many_other").select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("other").alias("b"), F.col("least").alias("nb"))
    reach = bound.where("many_other").withColumn("low", F.expr("greatest(least, (4 * n + 4) div 5)")).withColumn("high", F.expr("least(most, (5 * n) div 4)"))
    opened = reach.where(f"low <= high and c >= greatest(1, least({_needed('n', 'low')}, {_needed('n', 'high')}) - 1)")
    opened = materialize(opened.select("node", F.col("other").alias("g")), "shingle-opened")
    return alone, grouped, opened


#: Members of a group and queries that meet in one task.
BLOCK_MEMBERS = 256
BLOCK_QUERIES = 2_048


def _opened_pairs(grouped: DataFrame, opened: DataFrame, maps: DataFrame, best: bool = False) -> DataFrame:
    """Pairs of queries and members of the groups opened for them, in blocks of both.

    A block counts the common first tokens of a query with all its members at
    once, so no row is made per common token; only pairs whose bounds hold leave it.
    ``maps``: ``node, map``, the bitmaps that are sized by their sets. ``best``:
    only the likeliest pair of a query and a block. Returns ``a, na, b, nb, g``.
    """
    packed = F.collect_list("token").alias("tokens")
    own = ["node", "n"]
    groups = opened.groupBy("g").agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("slices"))
    members = grouped.where("many").join(groups, "g").groupBy("g", "slices", *own).agg(packed)
    members = materialize(members.join(maps, "node"), "shingle-members")
    parts = members.groupBy("g").agg(F.ceil(F.count("*") / BLOCK_MEMBERS).cast("int").alias("parts"))
    parts = materialize(parts.join(groups, "g"), "shingle-blocks")
    asked = grouped.drop("g", "many").join(opened, "node").groupBy("g", *own).agg(packed).join(maps, "node")
    every = [F.col(c).alias(c) for c in (*own, "tokens", "map")]  # both sides come from one table
    members = members.drop("slices").join(parts, "g").select(
        F.col("g").alias("g"), F.pmod(F.xxhash64("node"), "parts").cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), *every
    )
    asked = asked.join(parts, "g").select(
        "g", F.pmod(F.xxhash64("node"), "slices").cast("int").alias("slice"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), *every
    )
    key = ["g", "part", "slice"]
    return members.groupBy(*key).cogroup(asked.groupBy(*key)).applyInPandas(functools.partial(_met_members, best=best), "a long, na long, b long, nb long, g long")


def _met_members(members: pd.DataFrame, asked: pd.DataFrame, best: bool) -> pd.DataFrame:
    found = []
    if len(members) and len(asked):
        lists = [np.asarray(x, np.int64) for x in members["tokens"]]
        union, at = np.unique(np.concatenate(lists), return_inverse=True)
        held = np.zeros((len(union), len(lists)), np.uint8)
        held[at, np.repeat(np.arange(len(lists)), [len(x) for x in lists])] = 1
        node, nb = members["node"].to_numpy(), members["n"].to_numpy()
        size = np.array([len(x) for x in members["map"]])
        maps = {z: np.frombuffer(b"".join(members["map"][size == z]), np.uint8).reshape(-1, z) for z in set(size.tolist())}
        on_fewer: dict[tuple[int, int], np.ndarray] = {}
        left = np.maximum(0, (4 * nb + 4) // 5 - EXTRA)
        for a, na, tokens, own in asked[["node", "n", "tokens", "map"]].itertuples(index=False):
            tokens = np.asarray(tokens, np.int64)
            slot = np.minimum(np.searchsorted(union, tokens), len(union) - 1)
            common = held[slot[union[slot] == tokens]].sum(axis=0, dtype=np.int64)
            overlap = (4 * (na + nb) + 8) // 9
            needed = np.maximum(1, overlap - np.maximum(left, max(0, (4 * na + 4) // 5 - EXTRA)))
            fits = (5 * np.minimum(na, nb) >= 4 * np.maximum(na, nb)) & (common >= needed)
            spare = np.zeros(len(nb), np.int64)
            for z in set(size[fits].tolist()):
                z0 = min(z, len(own))
                if (z, z0) not in on_fewer:
                    on_fewer[z, z0] = folded(maps[z], z0)
                mine = folded(np.frombuffer(own, np.uint8).reshape(1, -1), z0)
                at = np.flatnonzero((size == z) & fits)
                differ = np.bitwise_count(on_fewer[z, z0][np.searchsorted(np.flatnonzero(size == z), at)] ^ mine).sum(axis=1, dtype=np.int64)
                spare[at] = na + nb[at] - differ - 2 * overlap[at]
                fits[at] = spare[at] >= 0
            if best and fits.any():
                fits = np.flatnonzero(fits)[[np.argmax(spare[fits])]]
            found.append(pd.DataFrame({"a": a, "na": na, "b": node[fits], "nb": nb[fits], "g": members["g"].iloc[0]}))
    return pd.concat(found) if found else pd.DataFrame({c: np.empty(0, np.int64) for c in ("a", "na", "b", "nb", "g")})


def verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """``u, v``: the pairs whose whole sets are similar. ``nodes``: ``node, row`` of one document each."""
    spark = docs.sparkSession
    pairs = materialize(pairs, "shingle-pairs")
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    slot = F.col("row").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    filled = (
        nodes.join(wanted, "node", "left_semi")
        .select(F.shiftrightunsigned(slot, 13).alias("word"), slot.bitwiseAND(F.lit(8191)).cast("int").alias("bit"))
        .groupBy("word")
        .agg(F.collect_set("bit").alias("bits"))
    )

    def pack(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in rows:
            words = []
            for bits in part["bits"]:
                ones = np.zeros(8192, np.uint8)
                ones[np.asarray(bits)] = 1
                words.append(np.packbits(ones).tobytes())
            yield pd.DataFrame({"word": part["word"], "ones": words})

    bitmap = np.zeros((1 << ROW_BITS - 13, 1024), np.uint8)
    for word, ones in filled.mapInPandas(pack, "word long, ones binary").toPandas().itertuples(index=False):
        bitmap[word] = np.frombuffer(ones, np.uint8)
    shared = spark.sparkContext.broadcast(bitmap.reshape(-1))

    def whole_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, marks = Shingler(), shared.value
        for batch in batches:
            at = batch.column(1).to_numpy() & ((1 << ROW_BITS) - 1)
            picked = np.flatnonzero(marks[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1)
            sets = [shingler.tokens(batch.column(2)[int(k)].as_py()).tobytes() for k in picked]
            node = [int(np.uint64(xxhash.xxh3_64_intdigest(x)).astype(np.int64)) for x in sets]
            rows = batch.column(1).take(pa.array(picked, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), rows, pa.array(sets, pa.binary())], names=["node", "row", "tokens"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            us, vs = [], []
            for u, v, left, right in zip(*(batch.column(k) for k in range(4)), strict=True):
                a, b = (np.frombuffer(x.as_buffer(), np.uint64) for x in (left, right))
                both = len(np.intersect1d(a, b, assume_unique=True))
                if 100 * both >= 80 * (len(a) + len(b) - both):
                    us.append(u.as_py())
                    vs.append(v.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    text_batches(spark)
    sets = _rows(docs).mapInArrow(whole_sets, "node long, row long, tokens binary")
    sets = materialize(sets.join(nodes.join(wanted, "node", "left_semi"), ["node", "row"], "left_semi").select("node", "tokens"), "shingle-sets")
    left = sets.select(F.col("node").alias("a"), F.col("tokens").alias("left"))
    right = sets.select(F.col("node").alias("b"), F.col("tokens").alias("right"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "left", "right")
    return materialize(both.mapInArrow(compare, "u long, v long").distinct(), "shingle-links")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_shingles, component_id``, ``row`` (hash of id and text), ``root`` (key of its component)."""
    sketched = sketches(docs)
    same = [F.max(c).alias(c) for c in ("n", *BITS)]  # of equal sets
    maps = sketched.where("n > 0").groupBy("node").agg(F.max("map").alias("map"))
    late = F.max(F.size("heavy")).alias("late")
    nodes = sketched.where("n > 0").groupBy("node").agg(F.min("row").alias("row"), F.min("doc_id").alias("least_id"), late, *same)
    nodes = materialize(nodes, "shingle-nodes")
    tokens = shared_tokens(sketched, nodes)
    keyed = nodes.select("node", "row")
    around = verified(docs, keyed, centre_pairs(tokens))
    linked = materialize(around.select(F.col("u").alias("node")).union(around.select(F.col("v").alias("node"))).distinct(), "shingle-linked")
    around = around.union(verified(docs, keyed, centre_pairs(tokens, linked)))
    roots = materialize(components(around), "shingle-roots")
    alone, grouped, opened = group_pairs(tokens, roots)
    # one link joins a node to a group, so first the likeliest is tried; whom that leaves apart meets all members
    tried = materialize(_opened_pairs(grouped, opened, maps, best=True), "shingle-likeliest")
    likeliest = verified(docs, keyed, tried.select("a", "na", "b", "nb"))
    edges = likeliest.union(roots.select("node", "root"))
    joined = materialize(components(edges), "shingle-joined")
    of_node = _labels(joined)
    of_group = of_node.select(F.col("node").alias("g"), F.col("root").alias("of_g"))
    apart = F.coalesce("root", "node") != F.coalesce("of_g", "g")
    unsettled = tried.select(F.col("a").alias("node"), "g").distinct()
    unsettled = unsettled.join(of_node, "node", "left").join(of_group, "g", "left").where(apart).select("node", "g")
    unsettled = materialize(unsettled, "shingle-unsettled")
    rest = _opened_pairs(grouped, unsettled, maps).select("a", "na", "b", "nb")
    across = verified(docs, keyed, alone.union(rest))
    roots = components(across.union(edges))
    labelled = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).select("node", "root", "least_id")
    smallest = labelled.groupBy("root").agg(F.min("least_id").alias("component_id"))
    of_node = materialize(labelled.join(smallest, "root").select("node", "root", "component_id"), "shingle-components")
    found = sketched.select("doc_id", "row", "n", "node").join(of_node, "node", "left")
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    root = F.when(F.col("n") > 0, F.col("root"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), "row", root.alias("root"))


def distinct_documents(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` per component, that of the smallest id, with all its columns; texts without shingles stay.

    Rows that repeat an id and its text are one document.
    """
    found = near_duplicates(docs)
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first")
    keepers = found.where("root is not null").groupBy("root").agg(first).select(F.col("first.row").alias("_key"))
    keepers = materialize(keepers.union(found.where("root is null").select("row")), "shingle-keepers")
    keyed = docs.select(F.xxhash64("doc_id", "text").alias("_key"), F.struct(*docs.columns).alias("_row"))
    return keyed.join(keepers, "_key", "left_semi").dropDuplicates(["_key"]).select("_row.*")


def op6_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents")).select("doc_id", "n_shingles", "component_id")
