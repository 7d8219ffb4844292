import math

import numpy as np
import pytest

from panelforge.llm import nearest as near
from panelforge.llm.nearest import chi_square_bound, nearest

SCHEMA = "vec_id long, embedding array<float>, label int, v string, leaf long"


def brute(rows, k, every):
    use = {}
    for i, v, *_ in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            use.setdefault(i, np.array(v, np.float32).astype(float))
    out = {}
    for q, a in use.items():
        if q % every == 0:
            scored = sorted((-float((a * b).sum()), i) for i, b in use.items() if i != q and len(a) == len(b))
            out[q] = [(i, -s) for s, i in scored[:k]]
    return out


@pytest.mark.parametrize("block", [50, 4096])
def test_recall_ties_and_odd_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(near, "BLOCK_ROWS", block)
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((8, 16))
    rows = [(i, (centres[i % 8] + 0.4 * rng.standard_normal(16)).tolist(), 0, "x", 1) for i in range(600)]
    rows += [(1000 + i, rows[3][1], 0, "x", 1) for i in range(200)]
    rows += [(5000, None, 0, "x", 1), (5020, [], 0, "x", 1), (5040, [0.0] * 16, 0, "x", 1), (5060, [None] * 16, 0, "x", 1)]
    rows += [(5080, [float("nan")] * 16, 0, "x", 1), (None, rows[0][1], 0, "x", 1), (6000, [1.0, 2.0], 0, "x", 1), (6001, [1.0, 1.0], 0, "x", 1)]
    rows += [rows[40], rows[41]]
    want = brute(rows, 20, 20)
    got = {}
    for r in sorted(nearest(spark.createDataFrame(rows, SCHEMA)).collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    assert set(got) == set(want)
    hits = [len({i for i, _ in got[q]} & {i for i, _ in w}) / len(w) for q, w in want.items()]
    assert sum(hits) / len(hits) >= 0.9
    assert [x[0] for x in got[6000]] == [6001]
    for q, found in got.items():
        assert [(-s, i) for i, s in found] == sorted((-s, i) for i, s in found)
        assert len(found) == len(want[q])
    copies = [i for i, _ in want[1000]]
    assert [i for i, _ in got[1000]] == copies


def test_empty_table_and_bound(spark):
    assert nearest(spark.createDataFrame([], SCHEMA)).count() == 0
    assert chi_square_bound(0.95, 8) == pytest.approx(15.507, abs=1e-3)
