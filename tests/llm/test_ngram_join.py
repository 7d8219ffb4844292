import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from panelforge.llm import ngram_join
from panelforge.llm.ngram_join import distinct_documents, near_duplicates


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def expected(rows):
    """Per row its set size and component, by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= 80 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((doc_id, len(sets[i]), min(ids, default=None) if sets[i] else doc_id))
    return out


def run(docs):
    return [tuple(r) for r in near_duplicates(docs).select("doc_id", "n_shingles", "component_id").collect()]


def test_odd_documents(odd, odd_rows, none):
    assert Counter(run(odd)) == Counter(expected([r[:2] for r in odd_rows]))
    assert run(none) == []
    kept = distinct_documents(odd)
    assert kept.columns == odd.columns
    rows = expected([r[:2] for r in odd_rows])
    alone = {(r[0], r[1]) for r, (_, n, _) in zip(odd_rows, rows, strict=True) if not n}
    assert kept.count() == len({c for _, n, c in rows if n}) + len(alone)
    assert distinct_documents(none).count() == 0


@pytest.mark.parametrize("heavy", [2, 24])
def test_chains_of_near_copies_and_common_passages(spark, monkeypatch, heavy):
    monkeypatch.setattr(ngram_join, "HEAVY_DOCS", heavy)
    rng = random.Random(heavy)
    word = lambda: f"v{rng.randrange(3000)}"
    passage = [word() for _ in range(40)]
    rows = []
    for g in range(12):
        base = [word() for _ in range(rng.choice([6, 30, 120, 250]))]
        for _ in range(rng.choice([1, 2, 9])):
            rows.append((len(rows), " ".join(base)))
            # a chain: each differs from the one before by some words
            for at in rng.sample(range(len(base)), max(1, len(base) // 60)):
                base[at] = word()
        rows.append((len(rows), " ".join([word() for _ in range(100)] + passage)))
    rows += [(1000 + k, " ".join(passage + [word()] * (k % 3))) for k in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(run(docs)) == Counter(expected(rows))


def test_large_groups_are_linked_without_all_their_pairs(spark, monkeypatch):
    """Copies of one text with some words replaced: half of the pairs are links, few need to be looked at."""
    rng = random.Random(7)
    base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    rows = []
    for k in range(150):
        words = list(base)
        for at in rng.sample(range(300), 2 + k % 3):
            words[at] = f"n{rng.randrange(10**6)}"
        rows.append((k, " ".join(words)))
    looked_at = []
    verified = ngram_join.verified

    def counting(docs, nodes, pairs):
        looked_at.append(pairs.count())
        return verified(docs, nodes, pairs)

    monkeypatch.setattr(ngram_join, "verified", counting)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(run(docs)) == Counter(expected(rows))
    assert sum(looked_at) < 12 * len(rows)


def test_bitmaps_of_different_sizes_bound_the_difference():
    rng = random.Random(8)
    for _ in range(50):
        common = [rng.getrandbits(64) for _ in range(rng.randrange(200))]
        sets = [np.unique(np.array(common + [rng.getrandbits(64) for _ in range(rng.randrange(1, 300))], np.uint64)) for _ in range(2)]
        maps = [np.frombuffer(ngram_join.whole_map(x), np.uint8).reshape(1, -1) for x in sets]
        size = min(x.shape[1] for x in maps)
        a, b = (ngram_join.folded(x, size) for x in maps)
        assert np.bitwise_count(a ^ b).sum() <= len(np.setxor1d(*sets))
        assert np.array_equal(a, np.frombuffer(ngram_join.whole_map(sets[0]), np.uint8).reshape(1, -1)) or size < maps[0].shape[1]


def test_every_common_token_counts_as_frequent(spark, monkeypatch):
    """Half of each text is a common passage; its shingles are frequent wherever their hashes lie in the order."""
    rng = random.Random(9)
    passage = " ".join(f"p{rng.randrange(10**6)}" for _ in range(80))
    twice = " ".join(f"q{rng.randrange(10**6)}" for _ in range(80))
    rows = [(k, " ".join(f"u{rng.randrange(10**6)}" for _ in range(80)) + " " + passage + (" " + twice if k < 4 else "")) for k in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    low = {name: set((ngram_join.Shingler().tokens(text) & ngram_join._LOW32).tolist()) for name, text in (("all", passage), ("some", twice))}
    found, power = ngram_join.heavy_tokens(docs)
    assert low["all"] | low["some"] <= set(found.tolist())
    assert (np.diff(found.astype(np.int64)) > 0).all() and len(power) == len(found)
    monkeypatch.setattr(ngram_join, "MOST_HEAVY", len(low["all"]))
    assert set(ngram_join.heavy_tokens(docs)[0].tolist()) == low["all"]
    assert Counter(run(docs)) == Counter(expected(rows))


def test_frequent_tokens_reach_the_driver_packed(spark, monkeypatch):
    """A row for each of up to two million tokens took the driver's memory."""
    rng = random.Random(10)
    texts = [" ".join(f"p{rng.randrange(10**6)}" for _ in range(2000)) for _ in range(3)]
    rows = [(k, texts[k % 3]) for k in range(18)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    fetched = []
    for name in ("collect", "toPandas"):
        plain = getattr(type(docs), name)
        monkeypatch.setattr(type(docs), name, lambda df, plain=plain: fetched.append(plain(df)) or fetched[-1])
    tokens = {int(x) & 0xFFFFFFFF for text in texts for x in ngram_join.Shingler().tokens(text)}
    found, power = ngram_join.heavy_tokens(docs)
    assert set(found.tolist()) == tokens and set(power.tolist()) == {2}
    assert sum(map(len, fetched)) < 100
    # where they do not all fit, there is a list of those that do
    monkeypatch.setattr(ngram_join, "MOST_HEAVY", 1000)
    some, power = ngram_join.heavy_tokens(docs)
    assert 900 < len(some) <= 1000 and set(some.tolist()) <= tokens and len(power) == len(some)
    assert Counter(run(docs)) == Counter(expected(rows))


def test_gathered_tokens_take_little_of_a_worker():
    """What a task gathers stays with its worker, so it is handed on in small packs, each token in its bucket."""
    rng, buckets, texts = np.random.default_rng(7), 40, []

    def batches():
        for _ in range(50):
            texts.append(" ".join(map(str, rng.integers(0, 10**6, 50_000))))
            yield pa.RecordBatch.from_arrays([pa.array(texts[-1:])], names=["text"])

    found, peak = Counter(), 0
    tracemalloc.start()
    try:
        for batch in ngram_join._gathered(batches(), buckets):
            peak = max(peak, tracemalloc.get_traced_memory()[1] - sum(map(len, texts)))
            for bucket, low in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found[bucket] += int(np.frombuffer(low, np.uint32).astype(np.uint64).sum())
    finally:
        tracemalloc.stop()
    tokens = np.concatenate([ngram_join.Shingler().tokens(text) for text in texts])
    assert len(tokens) > 2_000_000
    high, low = (tokens >> np.uint64(32)).astype(np.int64) % buckets, tokens & np.uint64(2**32 - 1)
    assert found == {b: int(low[high == b].sum()) for b in range(buckets)}
    assert peak < 40e6, peak
