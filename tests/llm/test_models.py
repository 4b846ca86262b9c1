"""The learners against plain versions of the same sums."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from quirefold.llm import langid, quality, toxicity
from quirefold.llm.queries import op5_lm_score
from quirefold.llm.quality import score_quality
from quirefold.llm.common import remainder as crc
from quirefold.llm.simhash import drop_near_copies, simhash_groups
from quirefold.llm.url_filter import judge_urls
from tests.llm.helpers import documents, own_columns_stay

LONG = " ".join(f"word{i % 5000}" for i in range(300_000))


def test_quality_equals_one_dense_solve(spark):
    """Sums over partitions and folds give the weights of a ridge regression on all rows at once."""
    draw = np.random.default_rng(2)
    stats = draw.normal(size=(400, quality.STATISTICS)).astype(np.float32)
    labels = (stats[:, 3] + 0.3 * draw.normal(size=400) > 0).astype(int)
    rows = [([float(v) for v in x], int(y), i % quality.FOLDS) for i, (x, y) in enumerate(zip(stats, labels))]
    model = quality.fit_quality(spark.createDataFrame(rows, "_qstats array<float>, _qlabel int, _qfold int").repartition(5))
    x64 = stats.astype(float)
    mean, scale = x64.mean(0), x64.std(0) + 1e-9
    x = quality.fourier(x64, mean, scale)
    d = x.shape[1]
    penalty = quality.RIDGE * len(x) / quality.FEATURES
    # The same problem as least squares with the penalty as further rows.
    stacked = np.vstack([x, math.sqrt(penalty) * np.eye(d)])
    want = np.linalg.lstsq(stacked, np.concatenate([labels, np.zeros(d)]), rcond=None)[0]
    assert np.allclose(x @ model.weights, x @ want, atol=1e-6)
    assert (np.diff(model.probability) >= 0).all()
    assert np.mean((model.score(x64) >= 0.5) == labels) > 0.9


def test_language_learner_equals_plain_dictionaries():
    """One shard, one weight at a time, with the steps written out."""
    draw = random.Random(3)
    size, classes = 40, 3
    rows = []
    for _ in range(60):
        buckets = np.array(sorted(draw.sample(range(size - 1), 5)))
        rows.append((buckets, np.array([draw.random() for _ in range(5)]), draw.randrange(classes)))
    z, n = np.zeros((size, classes)), np.zeros((size, classes))
    langid.ftrl_epoch(rows, z, n)

    sums, squares = {}, {}

    def weight(key):
        total = sums.get(key, 0.0)
        if abs(total) <= langid.L1:
            return 0.0
        return -(total - math.copysign(langid.L1, total)) / ((langid.BETA + math.sqrt(squares.get(key, 0.0))) / langid.ALPHA + langid.L2)

    for buckets, values, label in rows:
        features = [*zip(buckets.tolist(), values.tolist()), (size - 1, 1.0)]
        scores = [sum(x * weight((b, c)) for b, x in features) for c in range(classes)]
        top = max(scores)
        odds = [math.exp(s - top) for s in scores]
        gradients = {(b, c): x * (odds[c] / sum(odds) - (c == label)) for b, x in features for c in range(classes)}
        weights = {key: weight(key) for key in gradients}
        for key, g in gradients.items():
            before = squares.get(key, 0.0)
            step = (math.sqrt(before + g * g) - math.sqrt(before)) / langid.ALPHA
            sums[key] = sums.get(key, 0.0) + g - step * weights[key]
            squares[key] = before + g * g
    for b in range(size):
        for c in range(classes):
            assert z[b, c] == pytest.approx(sums.get((b, c), 0.0), abs=1e-12)
            assert n[b, c] == pytest.approx(squares.get((b, c), 0.0), abs=1e-12)


def test_toxicity_score_is_the_sum_over_all_pairs():
    draw = np.random.default_rng(4)
    hashes = toxicity._TermHashes()
    words = [f"w{i}" for i in range(30)]
    terms = np.sort(np.array([hashes[w] for w in words], dtype=np.int64))
    machine = toxicity.Machine.start(terms)
    machine.factors = draw.normal(size=machine.factors.shape)
    machine.z, machine.n = draw.normal(size=31) * 9, draw.random(31) * 5
    machine.offset = 0.4
    text = "W1, w2 w7. w7 unknown w29 w11"
    at = [int(np.searchsorted(terms, hashes[w])) for w in ("w1", "w2", "w7", "w29", "w11")]
    weights = machine.weights()
    total = machine.offset + weights[-1] + sum(weights[i] for i in at)
    for i in range(len(at)):
        for j in range(i):
            total += sum(machine.factors[at[i], f] * machine.factors[at[j], f] for f in range(toxicity.FACTORS))
    assert toxicity.Scorer(machine).score(text) == pytest.approx(1 / (1 + math.exp(-total)), abs=1e-12)


def test_a_very_long_text_goes_through_every_operator(spark, tmp_path):
    docs = documents(spark, [(1, LONG), (2, LONG + " x"), (3, "short one")], awkward=False)
    groups = {r["doc_id"]: r for r in simhash_groups(docs).collect()}
    assert groups[1]["component_id"] == 1 and groups[2]["component_id"] == 1 and groups[3]["component_id"] == 3
    kept = drop_near_copies(docs)
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3] and own_columns_stay(kept)
    labels = spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, quality int")
    assert all(0 <= r["score"] <= 1 for r in score_quality(docs, labels, crc(5) >= 0).collect())
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    scored = {r["doc_id"]: r for r in op5_lm_score(spark, str(tmp_path)).collect()}
    assert scored[1]["n_tokens"] == 300_001 and scored[2]["n_tokens"] == 300_002
    page = spark.createDataFrame([(1, "http://net/es/" + "a" * 500_000, "<p>" * 500_000)], "page_id long, url string, html string")
    assert judge_urls(page, [("block", "net", "/es/")]).first()["verdict"] == "block"
