import hashlib
import re
from collections import defaultdict

import pytest

from panelforge.llm.mixing import mix, mixed_documents


def targets(sizes, share=1.5, most=2.0):
    """Fills up step by step: whoever is above the limit stops there, the rest is shared again."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    budget, full = share * sum(sizes.values()), set()
    while True:
        left = budget - sum(most * sizes[s] for s in full)
        total = sum(weight[s] for s in order if s not in full)
        now = {s: most * sizes[s] if s in full else weight[s] * left / total for s in order}
        above = {s for s in order if s not in full and now[s] > most * sizes[s]}
        if not above:
            return now
        full |= above


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_odd_documents(odd, odd_rows, none):
    got = mix(odd).collect()
    sizes = defaultdict(int)
    for r in odd_rows:
        sizes[r[3]] += size(r[1])
    want, taken = targets(sizes), defaultdict(int)
    assert len(got) == len(odd_rows)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    for source, target in want.items():
        assert taken[source] == int(target + 1e-6)
    assert mix(none).count() == 0
    again = sorted(map(str, mix(odd.repartition(5)).select("doc_id", "size", "taken").collect()))
    assert again == sorted(map(str, mix(odd).select("doc_id", "size", "taken").collect()))


def test_the_cut_follows_the_hashed_order(spark):
    rows = [(i, "w " * (1 + i % 7), f"s{i % 2}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r.taken for r in mix(docs, weights=(1, 9), share=0.6, most=0.9).collect()}
    sizes = defaultdict(int)
    for i, _, s in rows:
        sizes[s] += 1 + i % 7
    left = {"s1": int(0.9 * sizes["s1"]), "s0": int(0.6 * sum(sizes.values()) - 0.9 * sizes["s1"])}
    for i, _, s in sorted(rows, key=lambda r: hashlib.md5(str(r[0]).encode()).hexdigest()):
        part = min(1 + i % 7, left[s])
        left[s] -= part
        assert got[i] == part


def test_mixed_documents_repeat_whole_rows(odd, odd_rows, none):
    got = mixed_documents(odd)
    assert got.columns == odd.columns
    rows = got.collect()
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in odd_rows:
        sizes[r[3]] += size(r[1])
    for r in rows:
        taken[r.source] += size(r.text)
    for source, target in targets(sizes).items():
        # whole documents: off by one document, and rows that tie with it, at most
        assert int(target + 1e-6) <= taken[source] <= 2 * sizes[source]
    assert all(r.text and r.text.strip() for r in rows)
    assert mixed_documents(none).count() == 0
