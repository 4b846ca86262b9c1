from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from quirefold.llm import ann
from quirefold.llm.ann import nearest

SCHEMA = "vec_id long, embedding array<float>, label int, rank int, leaf int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, 0, 0) for i, v in rows], SCHEMA).repartition(3)


def brute(rows, k):
    good = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[i] = np.array(v, dtype=np.float32).astype(float)
    out = {}
    for q in good:
        if q % 50 == 0:
            near = []
            for i, v in good.items():
                if i != q:
                    near.append((-round(float(good[q] @ v / np.linalg.norm(good[q]) / np.linalg.norm(v)), 9), i))
            out[q] = sorted(near)[:k]
    return out


def answers(got):
    out = {}
    for r in sorted(got.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((-round(r["score"], 9), r["vec_id"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_recall_and_order_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ann, "LEAF_ROWS", 32)
    monkeypatch.setattr(ann, "SLOT_ROWS", 20)
    monkeypatch.setattr(ann, "QUERY_ROWS", 3)
    draw = np.random.default_rng(1)
    centres = draw.normal(size=(12, 16))
    rows = [(i, [float(x) for x in centres[i % 12] + draw.normal(size=16) * 0.7]) for i in range(2000)]
    want, got = brute(rows, 5), answers(nearest(vectors(spark, rows), F.col("vec_id") % 50 == 0, k=5))
    assert set(got) == set(want) and all(len(v) == 5 for v in got.values())
    found = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want)
    assert found >= 0.9 * 5 * len(want)


def test_copies_ties_and_vectors_that_take_no_part(spark):
    same = [0.5, -0.0, 1.0]
    rows = [(i, same) for i in range(0, 120)] + [(i, [0.5, 0.0, 1.0]) for i in range(120, 130)]
    rows += [(200, [1.0, 0.0, 0.0]), (201, [2.0, 0.0, 0.0]), (202, [4.0, 0.0, 0.0]), (250, [0.0, 1e-30, 0.0]), (251, [0.0, 1e30, 0.0])]
    rows += [(300, None), (301, [0.0, 0.0, 0.0]), (302, [None, 1.0, 1.0]), (303, [float("nan"), 1.0, 1.0]), (304, [float("inf"), 1.0, 1.0])]
    rows += [(305, []), (306, [1.0]), (None, same), (7, same)]
    got = answers(nearest(vectors(spark, rows), F.col("vec_id") % 50 == 0, k=5))
    want = brute([r for r in rows if r[0] is None or r[0] < 305], 5)
    assert got == want and [i for _, i in got[0]] == [1, 2, 3, 4, 5] and [i for _, i in got[50]] == [0, 1, 2, 3, 4]


def test_fewer_candidates_than_asked(spark):
    assert answers(nearest(vectors(spark, [(0, [1.0, 0.0]), (1, [0.0, 1.0])]), F.col("vec_id") % 50 == 0)) == {0: [(0.0, 1)]}
    assert nearest(vectors(spark, [(0, [1.0, 0.0])]), F.col("vec_id") % 50 == 0).count() == 0
    assert nearest(vectors(spark, []), F.col("vec_id") % 50 == 0).count() == 0


def test_a_batch_goes_down_as_single_vectors_do():
    draw = np.random.default_rng(2)
    rows = ann._unit(draw.normal(size=(3000, 8)))
    leaves = []
    root = ann.grow(rows[:1500], 8, draw, leaves)
    assert ann.leaves_of(root, rows).tolist() == [ann.leaf_order(root, v, 1)[0] for v in rows]
    assert ann.sample_size(1000) == 20_000 and ann.sample_size(10**10) == 2_000_000
