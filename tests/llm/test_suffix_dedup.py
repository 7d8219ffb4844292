import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from panelforge.llm import suffix_dedup
from panelforge.llm.suffix_dedup import cut_texts, repeated_runs
from panelforge.llm.suffix_groups import row_order


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 6).flatmap(lambda w: st.lists(st.lists(st.integers(0, 3), min_size=w, max_size=w), min_size=1, max_size=12)))
def test_row_order_sorts(rows):
    order = row_order(np.array(rows, np.int64))
    assert sorted(order) == list(range(len(rows)))
    assert [rows[i] for i in order] == sorted(rows)


def expected(rows, length=400):
    data = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(b[k : k + length] for _, b in data for k in range(len(b) - length + 1))
    out = []
    for doc_id, b in data:
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = True
        kept = bytes(x for x, g in zip(b, gone, strict=False) if not g)
        spans = int((np.diff(np.append(0, gone.astype(int))) == 1).sum())
        out.append((doc_id, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def run(docs):
    return Counter(tuple(r) for r in cut_texts(docs, repeated_runs(docs)).collect())


def test_odd_documents(spark, odd, odd_rows, none):
    rows = [(d, t if t is None or len(t) < 20_000 else t[:9_000]) for d, t, *_ in odd_rows]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, th long, h long")
    assert run(docs) == expected(rows)
    assert run(none) == Counter()


@pytest.mark.parametrize("crowd", [1, 2_000])
def test_copies_with_edits_and_common_passages(spark, monkeypatch, crowd):
    monkeypatch.setattr(suffix_dedup, "CROWD", crowd)
    rng = random.Random(crowd)
    text = lambda n: "".join(rng.choice("abcdefgh é\n") for _ in range(n))
    passage, base = text(520), text(2_500)
    rows = []
    for i in range(24):
        kind = i % 4
        if kind == 0:
            rows.append((i, text(rng.randrange(700)) + passage + text(rng.randrange(700))))
        elif kind == 1:
            at = rng.randrange(2_000)
            rows.append((i, base[:at] + text(3) + base[at + 3 :]))
        elif kind == 2:
            cut = rng.randrange(300, 500)
            rows.append((i, text(100) + base[700 : 700 + cut] + text(50) + passage[: rng.randrange(350, 520)]))
        else:
            rows.append((i, text(1_000)))
    own = text(450)
    rows += [(100, own + text(30) + own), (101, "a" * 1_000), (102, text(399)), (103, base), (104, base)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert run(docs) == expected(rows)
