import zlib
from collections import Counter, defaultdict

from panelforge.llm.sharding import shard_documents, with_law


def check(rows, got, shards):
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size, r.text_crc32) for r in got) == sorted(
        (d is None, d or 0, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in rows
    )
    counts = Counter(r.shard for r in got)
    assert max(counts.values()) - min(counts.get(s, 0) for s in range(shards)) <= 1
    for s in counts:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(counts[s]))


def cut(got):
    places = defaultdict(set)
    for r in got:
        places[r.text_crc32, r.size].add(r.shard)
    return sum(len(x) - 1 for x in places.values())


def test_odd_documents(odd, odd_rows, none):
    got = with_law(shard_documents(odd)).collect()
    check([r[:2] for r in odd_rows], got, 24)
    assert {r.law for r in got} == {"rows"}
    assert shard_documents(none).count() == 0


def test_groups_stay_together_and_a_hot_group_fills_whole_shards(spark):
    rows = [(i, "hot") for i in range(400)]
    rows += [(1000 + i, f"pair {i // 2}") for i in range(300)] + [(2000 + i, f"alone {i}") for i in range(500)]
    got = shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), 12).collect()
    check(rows, got, 12)
    # 400 documents need four shards of 100; at most one cut more per shard
    assert cut(got) <= 3 + 12
    assert [tuple(r) for r in sorted(got)] == [tuple(r) for r in sorted(shard_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 12).collect())]


def test_no_free_seats(spark):
    rows = [(i, f"group {i // 6}") for i in range(288)]
    got = shard_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    check(rows, got, 24)
    # two groups of six fit into each shard
    assert cut(got) <= 24
