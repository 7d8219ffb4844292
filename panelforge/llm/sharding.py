"""Sharding by balanced label propagation over groups of equal texts (SQL functions only).

Linked documents are those of equal text. Every document starts in a shard by
hash. In each round the members of a group look at the shards of their
neighbours: those outside the group's best shard with room ask to move there,
and as many move as the quotas allow. A quota is the room left under the
capacity plus what leaves the shard in exchange. Members of a group in one
shard are alike, so the state is one row per (group, shard) with a count: a
group of a third of all rows has at most as many rows as there are shards.
Groups that the quotas leave apart then take the seats that are left, side by
side and the largest first, so no more of them than there are shards are cut.
Documents without neighbours cut no edge; they fill what is left, so the
shards' counts are at most one apart (law ``rows``).

Defined results:

* a null text counts as an empty one: size 8, linked with other empty texts;
* repeated rows are linked documents like any other; null ids are kept;
* a group larger than a shard's capacity fills whole shards one after the other;
* fewer documents than shards: the first shards get one each;
* only ``doc_id`` and ``text`` are read, so other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelforge.llm.common import materialize, number_rows, running_start, table, with_places

#: Fixed by the contract: shards, and bytes added to a text's size.
SHARDS = 24
OVERHEAD = 8

#: A round that moves nothing is the last; a group fills about one shard a round.
MOST_ROUNDS = 2 * SHARDS

#: Groups whose moves between two shards are ranked in one window.
GROUPS_PER_WINDOW = 20_000


def hashed(docs: DataFrame) -> DataFrame:
    """``doc_id, size, text_crc32`` and ``g``, ``h``: the text's hashes, equal for equal texts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id",
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("g"),
    )


def capacities(spark: SparkSession, rows: int, shards: int) -> DataFrame:
    return spark.range(shards).select(
        F.col("id").cast("int").alias("shard"), (F.lit(rows // shards) + F.when(F.col("id") < rows % shards, 1).otherwise(0)).alias("capacity")
    )


def propagate(state: DataFrame, capacity: DataFrame, shards: int, rounds: int = MOST_ROUNDS) -> DataFrame:
    """Moves counts of ``state`` (``grp, shard, n``) between shards until nothing wants or is allowed to move."""
    slices = 1 + state.count() // (GROUPS_PER_WINDOW * shards)
    for _ in range(rounds):
        loads = state.groupBy("shard").agg(F.sum("n").alias("load"))
        room = materialize(
            capacity.join(loads, "shard", "left").select("shard", (F.col("capacity") - F.coalesce("load", F.lit(0))).alias("room")),
            "shard-room",
        )
        moves = materialize(_moves(state, room, slices), "shard-moves")
        if moves.isEmpty():
            break
        changed = (
            state.union(moves.select("grp", "shard", -F.col("m")))
            .union(moves.select("grp", F.col("to").alias("shard"), "m"))
            .groupBy("grp", "shard")
            .agg(F.sum("n").alias("n"))
            .where("n > 0")
        )
        state = materialize(changed, "shard-state")
    return state


def _moves(state: DataFrame, room: DataFrame, slices: int) -> DataFrame:
    """``grp, shard, to, m``: what moves in this round."""
    rank = Window.partitionBy("grp").orderBy(F.col("n").desc(), F.xxhash64("grp", "shard"))
    best_open = F.min(F.when(F.col("room") > 0, F.struct("place", "shard"))).over(Window.partitionBy("grp"))
    first = F.min(F.struct("place", "shard")).over(Window.partitionBy("grp"))
    placed = state.join(room, "shard").withColumn("place", F.row_number().over(rank))
    # towards the best shard with room, or else the best one in exchange for others
    seen = placed.withColumns({"open": best_open, "first": first}).withColumn(
        "goal", F.when(F.col("open.place") < F.col("place"), F.col("open")).otherwise(F.col("first"))
    )
    wishes = seen.where("goal.place < place").select(
        "grp", "shard", F.col("goal.shard").alias("to"), "n", F.pmod(F.xxhash64("grp"), F.lit(slices)).alias("slice")
    )
    wishes = materialize(wishes, "shard-wishes")
    demand = wishes.groupBy("shard", "to", "slice").agg(F.sum("n").alias("d"))
    back = demand.select(F.col("to").alias("shard"), F.col("shard").alias("to"), "slice", F.col("d").alias("back"))
    paired = demand.join(back, ["shard", "to", "slice"], "left").withColumn("swap", F.least("d", F.coalesce("back", F.lit(0))))
    over = paired.withColumn("over", F.col("d") - F.col("swap")).join(room.select(F.col("shard").alias("to"), "room"), "to")
    into = Window.partitionBy("to")
    before = into.orderBy("shard", "slice").rowsBetween(Window.unboundedPreceding, -1)
    free = F.greatest(F.lit(0), F.least("over", F.col("room") - F.coalesce(F.sum("over").over(before), F.lit(0))))
    quotas = materialize(over.select("shard", "to", "slice", (F.col("swap") + free).alias("quota")), "shard-quotas")
    line = Window.partitionBy("shard", "to", "slice").orderBy(F.col("n").desc(), "grp").rowsBetween(Window.unboundedPreceding, -1)
    allowed = (
        wishes.withColumn("ahead", F.coalesce(F.sum("n").over(line), F.lit(0)))
        .join(quotas, ["shard", "to", "slice"])
        .withColumn("m", F.least("n", F.col("quota") - F.col("ahead")))
    )
    return allowed.where("m > 0").select("grp", "shard", "to", "m")


def _seats(capacity: DataFrame, state: DataFrame) -> list[tuple[int, int]]:
    """(seats, shard) that ``state`` leaves free, the most first. Collects one number per shard."""
    loads = state.groupBy("shard").agg(F.sum("n").alias("load"))
    free = capacity.join(loads, "shard", "left").select("shard", (F.col("capacity") - F.coalesce("load", F.lit(0))).alias("seats"))
    return sorted(((row["seats"], row["shard"]) for row in free.collect()), reverse=True)


def _seat_whole(state: DataFrame, capacity: DataFrame) -> DataFrame:
    """Seats the groups that are still in several shards anew, one after the other."""
    apart = state.groupBy("grp").agg(F.count("*").alias("k"), F.sum("n").alias("n")).where("k > 1").select("grp", "n")
    stay = state.join(materialize(apart, "shard-apart"), "grp", "left_anti").select("grp", "shard", "n")
    line = running_start(number_rows(apart, [F.col("n").desc(), F.col("grp")], "shard-line"), "n", [], "begin")
    parts, end = [], 0
    for seats, shard in _seats(capacity, stay):
        here = F.least(F.col("begin") + F.col("n"), F.lit(end + seats)) - F.greatest(F.col("begin"), F.lit(end))
        parts.append(F.struct(F.lit(shard).alias("shard"), here.alias("n")))
        end += seats
    return stay.union(line.select("grp", F.inline(F.array(*parts))).where("n > 0"))


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Per document ``doc_id, size, text_crc32, shard, slot``; the counts of the shards are at most one apart."""
    key = ["g", "text_crc32", "size"]
    ranked = with_places(number_rows(hashed(docs), [F.col(c) for c in (*key, "doc_id")], "shard-order"), "place")
    # a group is known by the place of its first member; a start by place keeps every shard within its capacity
    groups = ranked.groupBy(*key).agg(F.count("*").alias("members"), F.min("place").alias("grp")).where("members > 1")
    groups = materialize(groups, "shard-groups")
    capacity = materialize(capacities(docs.sparkSession, ranked.count(), shards), "shard-capacity")
    first = F.pmod("place", F.lit(shards)).cast("int").alias("shard")
    start = ranked.join(groups, key).groupBy("grp", first).agg(F.count("*").alias("n"))
    state = propagate(materialize(start, "shard-state"), capacity, shards)
    state = materialize(_seat_whole(state, capacity), "shard-seated")
    # members of a group take its shards in the order of their places
    line = Window.partitionBy("grp").orderBy(F.col("n").desc(), "shard").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    steps = (
        state.withColumn("end", F.sum("n").over(line))
        .groupBy("grp")
        .agg(F.array_sort(F.collect_list(F.struct("end", "shard"))).alias("steps"))
    )
    steps = materialize(groups.join(steps, "grp").select(*key, "grp", "steps"), "shard-steps")
    member = F.col("place") - F.col("grp")
    linked = ranked.join(steps, key, "left").select(
        "doc_id", "size", "text_crc32", "place", F.filter("steps", lambda s: s["end"] > member)[0]["shard"].alias("shard")
    )
    return _slots(_fill(materialize(linked, "shard-linked"), capacity))


def _fill(linked: DataFrame, capacity: DataFrame) -> DataFrame:
    """Gives documents without a shard the seats that are left, in a hashed order."""
    alone = number_rows(linked.where("shard is null").drop("shard"), [F.xxhash64("place"), F.col("place")], "shard-alone")
    shard, end = F.lit(None).cast("int"), 0
    spans = []
    for seats, number in _seats(capacity, linked.where("shard is not null").withColumn("n", F.lit(1))):
        end += seats
        spans.append((end, number))
    for end, number in reversed(spans):
        shard = F.when(F.col("seat") < end, F.lit(number)).otherwise(shard)
    seated = with_places(alone, "seat").withColumn("shard", shard)
    columns = ["doc_id", "size", "text_crc32", "place", "shard"]
    return linked.where("shard is not null").select(*columns).union(seated.select(*columns))


def _slots(sharded: DataFrame) -> DataFrame:
    """The place of a document among all, less the place of its shard's first one."""
    placed = with_places(number_rows(sharded, [F.col("shard"), F.col("place")], "shard-slots"), "at")
    first = materialize(placed.groupBy("shard").agg(F.min("at").alias("first")), "shard-first")
    return placed.join(first, "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("at") - F.col("first")).alias("slot"))


def op4_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return with_law(shard_documents(table(spark, folder, "documents")))


def with_law(sharded: DataFrame) -> DataFrame:
    return sharded.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
