from __future__ import annotations

import pytest

import corpus_pipeline
from tests.llm.helpers import documents
from tests.llm.test_decontamination import brute as brute_contamination
from tests.llm.test_line_dedup import brute as brute_lines
from tests.llm.test_simhash import brute_components

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """(name, input, output) of every stage on the smallest tables."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, function in corpus_pipeline.STAGES:
        got = function(spark, docs, SF).cache()
        out.append((name, docs, got))
        docs = got
    return {name: (before, after) for name, before, after in out}


def test_order_and_columns(spark, stages):
    assert list(stages) == ["language_id", "line_dedup", "simhash_near_dedup", "decontamination", "packing"]
    for before, after in list(stages.values())[:-1]:
        assert after.schema.names == before.schema.names and after.dtypes == before.dtypes


def test_every_stage_equals_brute_force_on_its_own_input(spark, stages):
    before, after = stages["language_id"]
    letters = {r["doc_id"] for r in before.collect() if any(c.isalpha() for c in r["text"] or "")}
    assert {r["doc_id"] for r in after.collect()} <= letters and after.count() >= 0.98 * len(letters)

    before, after = stages["line_dedup"]
    want = {d: t for d, _, _, t in brute_lines([(r["doc_id"], r["text"]) for r in before.collect()], 10)}
    assert {r["doc_id"]: r["text"] for r in after.collect()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in after.collect())

    before, after = stages["simhash_near_dedup"]
    groups = brute_components([(r["doc_id"], r["text"]) for r in before.collect()])
    assert sorted(r["doc_id"] for r in after.collect()) == sorted({c for _, _, c in groups})

    before, after = stages["decontamination"]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hit = {d for d, _, _ in brute_contamination([(r["doc_id"], r["text"]) for r in before.collect()], items)}
    assert {r["doc_id"] for r in after.collect()} == {r["doc_id"] for r in before.collect()} - hit

    before, after = stages["packing"]
    tokens = {r["doc_id"]: sum(-(-len(w) // 16) for w in (r["text"] or "").split()) + 1 for r in before.collect()}
    packed = {}
    for r in after.collect():
        packed[r["doc_id"]] = packed.get(r["doc_id"], 0) + r["n_tokens"]
    assert packed == tokens


def test_run_equals_the_stages(spark, stages):
    got = corpus_pipeline.run(spark, SF)
    want = stages["packing"][1]
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.select(got.columns).collect()))


def test_awkward_rows_and_clashing_columns(spark):
    docs = documents(spark, [(i, f"the same line\nand line {i} of the text") for i in range(12)])
    docs = docs.withColumnsRenamed({"word": "n_lines", "h1": "lang_pred"})
    for name, function in corpus_pipeline.STAGES[:-1]:
        out = function(spark, docs, SF)
        assert out.dtypes == docs.dtypes, name
        docs = out.cache()
    assert docs.where("n_lines = 'w' AND lang_pred = 1 AND score = 's'").count() == docs.count() > 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() >= docs.count()


def test_no_documents(spark):
    docs = documents(spark, [], awkward=False)
    for _, function in corpus_pipeline.STAGES:
        docs = function(spark, docs, SF)
    assert docs.count() == 0
