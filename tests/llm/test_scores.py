"""Quality, language and toxicity: held-out accuracy, awkward rows, no labels, no rows."""

from __future__ import annotations

import random

import numpy as np

from quirefold.llm.common import held_out, remainder as crc
from quirefold.llm.langid import fit_languages, identify_languages
from quirefold.llm.quality import isotonic, score_quality
from quirefold.llm.queries import QUERIES
from quirefold.llm.toxicity import score_toxicity
from tests.llm.helpers import documents, own_columns_stay, remainder

SF = "/root/testdata/sf0.01"


def test_split_follows_the_crc(spark):
    docs = documents(spark, [(i, "x") for i in range(50)])
    got = {r["doc_id"]: r["h"] for r in docs.select("doc_id", held_out(5, 0).alias("h")).collect()}
    assert got == {d: d is not None and remainder(d, 5) == 0 for d in got}


def labelled(spark, rows, name):
    return spark.createDataFrame([(i, y, 0) for i, y in rows], f"doc_id long, {name} int, text int")


def test_isotonic():
    counts, positives = np.array([4, 0, 4, 4, 0, 8.0]), np.array([1, 0, 3, 2, 0, 8.0])
    values = isotonic(counts, positives)
    assert (np.diff(values) >= 0).all() and len(values) == 6 and 0 < values[0] < 0.5 < values[-1] < 1
    assert values[2] == values[3]
    assert list(isotonic(np.zeros(3), np.zeros(3))) == [0, 0, 0]


def test_quality_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    got = QUERIES["op1_quality"](spark, SF)
    assert got.count() == docs.count()
    held = [(r["predicted"], r["quality"]) for r in got.where("held_out").join(labels, "doc_id").collect()]
    assert len(held) > 50 and np.mean([a == b for a, b in held]) > 0.95
    assert {r["predicted"] for r in got.where("score < 0.3").collect()} == {0}


def test_quality_of_awkward_rows(spark):
    rows = [(i, f"A fine sentence number {i}, with words. Another one.") for i in range(40)] + [(50 + i, "$$$ ### " * 9) for i in range(40)]
    docs = documents(spark, rows)
    labels = labelled(spark, [(d, int(d < 50)) for d, _ in rows] + [(905, None), (906, 7), (None, 1)], "quality")
    got = score_quality(docs, labels, crc(5) != 0).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    score = {r["doc_id"]: r["score"] for r in got}
    assert score[901] == score[902] and score[905] == score[906]
    assert min(score[i] for i in range(40)) > max(score[i] for i in range(50, 90))


def test_nothing_to_learn_from(spark):
    docs, empty = documents(spark, [(1, "a b")]), documents(spark, [], awkward=False)
    for name, score in (("quality", score_quality), ("toxic", score_toxicity)):
        none = labelled(spark, [], name)
        assert score(docs, none, crc(5) != 0).count() == docs.count()
        assert score(empty, none, crc(5) != 0).count() == 0
    assert fit_languages(empty, crc(5) != 0) is None
    assert {r["lang_pred"] for r in identify_languages(docs, None).collect()} == {"und"}


def test_languages_on_held_out_documents(spark):
    got = QUERIES["op4_language_id"](spark, SF).where("held_out").join(
        spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id"
    ).collect()
    assert len(got) > 100 and np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_languages_of_awkward_rows(spark):
    draw = random.Random(1)
    words = {"en": ["the", "house", "with", "thing"], "de": ["das", "schöne", "Straße", "über"]}
    rows = [(i, " ".join(draw.choices(words[x], k=12)), x) for i, x in enumerate(["en", "de"] * 40)]
    docs = documents(spark, rows + [(200, "das schöne", None), (201, "12 345 $$", "en"), (202, "the " * 40_000, "en")], lang=None)
    got = identify_languages(docs, fit_languages(docs, crc(5) != 0))
    assert got.columns == [*docs.columns, "lang_pred"]
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in got.collect()}
    assert got.count() == docs.count()
    assert all(found[i] == ("und", 0.0) for i in (901, 902, 903, 904, 201))
    assert found[200][0] == "de" and found[202][0] == "en" and found[905] == found[906]
    assert np.mean([found[i][0] == x for i, _, x in rows if remainder(i, 5) == 0]) > 0.9


def test_toxicity_on_held_out_documents(spark):
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic")
    held = QUERIES["op7_toxicity"](spark, folder).where("held_out").join(labels, "doc_id").collect()
    hit = [r["predicted"] for r in held if r["toxic"] == 1]
    clean = [r["predicted"] for r in held if r["toxic"] == 0]
    assert len(hit) > 80 and np.mean(hit) > 0.7 and np.mean(clean) < 0.01


def test_toxicity_learns_what_only_pairs_tell(spark):
    """A text is toxic if and only if it holds an insult together with a group; weights alone cannot say so."""
    draw = random.Random(4)
    rows, labels = [], []
    for i in range(2000, 3200):
        insult, group = draw.random() < 0.5, draw.random() < 0.5
        words = [f"w{draw.randrange(30)}" for _ in range(6)] + ["Insult!"] * insult + ["group"] * group
        draw.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, int(insult and group)))
    docs = documents(spark, rows)
    got = score_toxicity(docs, labelled(spark, labels, "toxic"), crc(4) != 2)
    assert got.count() == docs.count() and set(got.columns) == set(docs.columns)
    score = {r["doc_id"]: r["score"] for r in got.collect()}
    held = [(score[i] >= 0.3, y) for i, y in labels if remainder(i, 4) == 2]
    assert np.mean([a == bool(b) for a, b in held]) > 0.95
    assert score[901] == score[902] and score[905] == score[906]


def test_toxicity_counts_terms_over_all_labels(spark):
    """A rare insult is learnt though the fitting sample holds a small share of the documents."""
    draw = random.Random(5)
    rows, labels = [], []
    for i in range(4000, 6400):
        insult = "zorg" if i % 100 == 0 else "grob" if i % 100 < 4 else None
        words = [f"w{draw.randrange(60)}" for _ in range(8)] + [insult] * (insult is not None)
        draw.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, int(insult is not None)))
    docs = documents(spark, rows + [(9000, "w1 " * 60_000 + "zorg")])
    got = score_toxicity(docs, labelled(spark, labels, "toxic"), crc(4) != 2, max_train=300)
    assert own_columns_stay(got)
    score = {r["doc_id"]: r["score"] for r in got.collect()}
    rare = [score[i] for i, _ in labels if i % 100 == 0]
    assert min(rare) >= 0.3 and score[9000] >= 0.3
    assert np.mean([score[i] >= 0.3 for i, y in labels if y == 0]) < 0.01
