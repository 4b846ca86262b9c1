from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirefold.llm import negatives
from quirefold.llm.negatives import Columns, hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, win string, v int, _q1 int"


def table(spark, rows):
    return spark.createDataFrame([(*r, "w", 1, 2) for r in rows], SCHEMA).repartition(3)


def brute(rows, anchors, p=5, n=10, share=(30, 90)):
    good = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        good[i, label, tuple(math.floor(256 * float(np.float32(x))) for x in v)] = 1
    out = []
    for i, label, v in good:
        if not anchors(i):
            continue
        scores = [(-sum(a * b for a, b in zip(v, w)), j, other) for j, other, w in good]
        near = sorted((s, j) for s, j, other in scores if other == label and j != i)[:p]
        for s, j in near:
            fit = sorted((t, k) for t, k, other in scores if other != label and share[0] * -s <= 100 * -t <= share[1] * -s)
            out += [(i, j, r + 1, k, -s, -t) for r, (t, k) in enumerate(fit[:n])]
    return sorted(out)


def vectors(n, dim, labels, seed, spread=0.6):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(labels, dim))
    rows = []
    for i in range(n):
        x = centres[i % labels] * spread + draw.normal(size=dim) + 0.5
        rows.append((i, [float(y) for y in (x / np.linalg.norm(x)).astype(np.float32)], int(draw.integers(labels))))
    return rows


@pytest.mark.parametrize("rows_of_page", [64, 8192])
def test_equals_brute_force(spark, monkeypatch, rows_of_page):
    monkeypatch.setattr(negatives, "PAGE_ROWS", rows_of_page)
    rows = vectors(900, 20, 4, 1)
    found = hard_negatives(table(spark, rows), F.col("vec_id") % 50 == 0)
    assert sorted(map(tuple, found.collect())) == brute(rows, lambda i: i % 50 == 0)


def test_blocks_of_anchors_give_the_same(spark, monkeypatch):
    rows = vectors(300, 12, 3, 2)
    want = brute(rows, lambda i: i % 20 == 0)
    monkeypatch.setattr(negatives, "ANCHOR_BYTES", 8 * 12 * 4)
    found = hard_negatives(table(spark, rows), F.col("vec_id") % 20 == 0)
    assert sorted(map(tuple, found.collect())) == want


def test_ties_copies_and_awkward_rows(spark):
    rows = vectors(60, 6, 2, 3)
    rows += [(100 + i, rows[0][1], 0) for i in range(30)] + [(200 + i, rows[0][1], 1) for i in range(30)]
    rows += [(100, rows[0][1], 0), (100, rows[5][1], 0), (100, rows[0][1], 1)]
    rows += [
        (300, None, 1), (301, [0.5], None), (302, [0.1, None, 0.2], 1), (303, [0.1, float("nan")], 0),
        (304, [float("inf"), 1.0], 1), (None, [0.5] * 6, 0), (305, [], 0), (306, [0.5, 0.5], 1), (307, [0.0] * 6, 1),
    ]
    found = hard_negatives(table(spark, rows), F.col("vec_id") % 20 == 0)
    assert sorted(map(tuple, found.collect())) == brute(rows, lambda i: i % 20 == 0)


def test_large_components_stay_exact(spark):
    rows = [(i, [x * 30_000 for x in v], label) for i, v, label in vectors(120, 8, 2, 4)]
    found = hard_negatives(table(spark, rows), F.col("vec_id") % 10 == 0)
    assert sorted(map(tuple, found.collect())) == brute(rows, lambda i: i % 10 == 0)


def test_a_long_vector_and_few_rows(spark):
    rows = [(0, [0.01] * 20_000, 1), (1, [0.02] * 20_000, 1), (2, [0.015] * 20_000, 2), (3, [1.0], 2)]
    found = hard_negatives(table(spark, rows), F.col("vec_id") == 0, share=(0, 100))
    assert sorted(map(tuple, found.collect())) == brute(rows, lambda i: i == 0, share=(0, 100))


def test_empty_tables(spark):
    assert hard_negatives(table(spark, []), F.col("vec_id") % 2 == 0).count() == 0
    assert hard_negatives(table(spark, vectors(5, 3, 2, 5)), F.lit(False)).count() == 0


def test_the_scan_leaves_rows_out_before_the_last_column():
    """Bounds of unread columns shrink the candidates, and what stays has its exact score."""
    draw = np.random.default_rng(1)
    pages = np.floor(256 * draw.normal(size=(4000, 64)) * np.linspace(2, 0.05, 64))
    columns, anchor, sizes = Columns(pages), pages[7], []
    exact = pages @ anchor
    cut = np.sort(exact)[-10]

    def wanted(least, most):
        sizes.append(len(most))
        return most >= cut

    rows, scores = columns.scan(anchor, np.arange(4000), wanted)
    assert sorted(rows.tolist()) == np.flatnonzero(exact >= cut).tolist() and (scores == exact[rows]).all()
    assert sizes[len(sizes) // 2] < 2000
