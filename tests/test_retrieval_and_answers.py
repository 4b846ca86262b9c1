"""Retrieval against brute force, the store, and the answer rules."""

from __future__ import annotations

import hashlib
import os
import pathlib

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from quirefold import schemas
from quirefold.functions.embedders import HashEmbedder, ModelEmbedder
from quirefold.operators import answering, cells, identity, retrieval
from quirefold.operators.signatures import directions, signature_table
from quirefold.plans import comparison
from quirefold.session import shared_folder
from quirefold.sources import files, store as stores
from quirefold.streaming.ingest import ingest_documents

DASHES = "\n" + "-" * 86 + "\n"


def store_of(spark, sizes, dim=6, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for title, n in sizes.items():
        for i in range(n):
            rows.append((f"{title}-{i:04d}", f"text {title} {i}", title, "z", [float(x) for x in rng.integers(0, 3, dim)]))
    return spark.createDataFrame(rows, schemas.STORE)


def vectors_of(spark, n, dim=6, seed=2):
    rng = np.random.default_rng(seed)
    rows = [(q, [float(x) for x in rng.integers(0, 3, dim)]) for q in range(n)]
    return spark.createDataFrame(rows, "q_idx int, vector array<double>")


def brute_force(store, vectors):
    def distance(a, b):
        scale = np.linalg.norm(a) * np.linalg.norm(b)
        return round(1 - (float(np.dot(a, b)) / scale if scale else 0.0), 6)

    items, hits = store.collect(), set()
    for q in vectors.collect():
        for title in {r["title"] for r in items}:
            own = [r for r in items if r["title"] == title]
            k = min(int(len(own) ** 0.4 * 2), 20)
            near = sorted((distance(np.array(r["embedding"]), np.array(q["vector"])), r["id"]) for r in own)
            hits |= {(title, q["q_idx"], i + 1, id_) for i, (_, id_) in enumerate(near[:k])}
    return hits


@pytest.mark.parametrize("method", ["matrix", "native"])
@pytest.mark.parametrize("question_block", [3, 2048])
def test_hits_against_brute_force(spark, monkeypatch, method, question_block):
    """Many exact ties, one title far larger than the others, question lists of several blocks."""
    monkeypatch.setattr(retrieval, "QUESTION_BLOCK", question_block)
    monkeypatch.setattr(retrieval, "QUESTION_BYTES", question_block * 8 * 6)
    store = store_of(spark, {"hot": 400, "one": 1, "few": 9}).repartition(7)
    vectors = vectors_of(spark, 8)
    hits = retrieval.retrieve(store, vectors, method=method, digits=6)
    assert {(r["title"], r["q_idx"], r["rank"], r["id"]) for r in hits.collect()} == brute_force(store, vectors)


def test_small_arrow_batches_give_the_same_hits(spark):
    store, vectors = store_of(spark, {"hot": 300, "few": 9}), vectors_of(spark, 4)
    whole = sorted(retrieval.retrieve(store, vectors, digits=6).collect())
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert sorted(retrieval.retrieve(store, vectors, digits=6).collect()) == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def clustered(rng, titles, per_title, dim, spread):
    rows = []
    for title in titles:
        centres = rng.normal(size=(5, dim))
        for i in range(per_title):
            x = centres[i % 5] * spread + rng.normal(size=dim)
            rows.append((f"{title}{i:04d}", "c", title, "z", [float(v) for v in x]))
    return rows


@pytest.mark.parametrize(("dim", "spread"), [(16, 0.0), (64, 0.0), (64, 2.0), (50, 1.0)])
def test_approximate_hits_are_exact_in_distance_and_found(spark, dim, spread):
    """Recall is held against the exact search on questions that mostly took no part in the calibration."""
    rng = np.random.default_rng(3)
    rows = clustered(rng, ["t", "u"], 600, dim, spread)
    store = spark.createDataFrame(rows, schemas.STORE).repartition(3)
    asked = [(i, [float(v) for v in rng.normal(size=dim)]) for i in range(120)]
    vectors = spark.createDataFrame(asked, "q_idx int, vector array<double>")
    exact = {(r["title"], r["q_idx"], r["id"]): r["distance"] for r in retrieval.retrieve(store, vectors, digits=6).collect()}
    hits = retrieval.retrieve(store, vectors, method="lsh", digits=6).collect()
    found = {(r["title"], r["q_idx"], r["id"]): r["distance"] for r in hits}
    both = exact.keys() & found.keys()
    assert len(both) >= 0.93 * len(exact)
    assert all(found[k] == exact[k] for k in both)


@pytest.mark.parametrize(("dim", "spread"), [(3, 0.0), (16, 0.0), (32, 6.0)])
def test_cells_give_the_exact_hits(spark, dim, spread):
    """Copies, a zero vector, a title below k, a zero question and questions that are chunks themselves."""
    rng = np.random.default_rng(4)
    rows = clustered(rng, ["t", "u"], 700, dim, spread)
    rows += [(f"x{i}", "c", "t", "z", rows[5][4]) for i in range(60)] + [("zero", "c", "t", "z", [0.0] * dim)]
    rows += [("only", "c", "one", "z", rows[0][4]), ("null", "c", "t", "z", None)]
    store = spark.createDataFrame(rows, schemas.STORE).repartition(3)
    asked = [(i, [float(v) for v in rng.normal(size=dim)]) for i in range(20)]
    asked += [(30, rows[3][4]), (31, rows[5][4]), (32, [0.0] * dim)]
    vectors = spark.createDataFrame(asked, "q_idx int, vector array<double>")
    want = sorted(retrieval.retrieve(store, vectors, digits=6).collect())
    assert sorted(retrieval.retrieve(store, vectors, method="cells", digits=6).collect()) == want


def test_cells_of_clustered_vectors_are_mostly_skipped(spark):
    rng = np.random.default_rng(5)
    rows = clustered(rng, ["t", "u"], 1500, 32, 6.0)
    store = spark.createDataFrame(rows, schemas.STORE).repartition(3)
    index = cells.cell_index(store)
    near = [(i, [float(v + n) for v, n in zip(rows[i * 97][4], rng.normal(size=32))]) for i in range(15)]
    vectors = spark.createDataFrame(near, "q_idx int, vector array<double>")
    k = identity.title_counts(store).select("title", retrieval.adaptive_k(F.col("n_chunks")).alias("k"))
    blocks = list(retrieval._question_matrices(vectors))
    _, visits = cells.cell_candidates(index, blocks, k, 20, 6)
    compared = visits.agg(F.sum("n")).first()[0] / (3000 * 15)
    assert compared < 0.5
    hits = retrieval.retrieve(store, vectors, method="cells", digits=6, index=index)
    assert sorted(hits.collect()) == sorted(retrieval.retrieve(store, vectors, digits=6).collect())


def test_a_kept_index_and_depth_replace_the_calibration(spark):
    store, vectors = store_of(spark, {"hot": 300, "few": 9}), vectors_of(spark, 6)
    index = signature_table(store)
    whole = retrieval.retrieve(store, vectors, method="lsh", digits=6, index=index, depth=100.0)
    assert sorted(whole.collect()) == sorted(retrieval.retrieve(store, vectors, digits=6).collect())
    k = identity.title_counts(store).select("title", retrieval.adaptive_k(F.col("n_chunks")).alias("k"))
    low, high = [retrieval.calibrated_depth(store, index, vectors, k, 20, 6, t) for t in (0.3, 1.0)]
    assert 1 <= low <= high


@pytest.mark.parametrize("dim", [1, 3, 8, 64])
def test_directions_are_orthonormal(dim):
    turned = directions(dim)
    assert np.allclose(turned.T @ turned, np.eye(dim))


def test_approximate_search_without_rows(spark):
    store, vectors = store_of(spark, {"t": 5}), vectors_of(spark, 3)
    assert retrieval.retrieve(store.limit(0), vectors, method="lsh").count() == 0
    assert retrieval.retrieve(store, vectors.limit(0), method="lsh").count() == 0


@pytest.mark.parametrize(("n", "k"), [(1, 2), (5, 3), (10, 5), (50, 9), (100, 12), (316, 19), (317, 20), (10**6, 20), (0, 0)])
def test_adaptive_k(spark, n, k):
    assert spark.range(1).select(retrieval.adaptive_k(F.lit(n))).first()[0] == k


def test_adaptive_k_is_python_for_many_sizes(spark):
    rows = spark.range(1, 5000).select("id", retrieval.adaptive_k(F.col("id")).alias("k")).collect()
    assert all(r["k"] == min(int(r["id"] ** 0.4 * 2), 20) for r in rows)


def test_chunk_ids(spark):
    rows = [("Title", 0, "a"), ("Title", 5, "b"), ("Other", 2, "c"), ("Title", 9, "d")]
    chunks = spark.createDataFrame(rows, "title string, chunk_idx int, chunk string")
    ids = {r["chunk"]: r["id"] for r in identity.assign_ids(chunks).collect()}
    assert ids["b"] == "7e8cd2056da73a7f-1" and ids["a"].endswith("-0") and ids["d"].endswith("-2")
    assert ids["c"] == hashlib.sha256(b"Other").hexdigest()[:16] + "-0"


@pytest.mark.parametrize(
    ("response", "numbers", "text"),
    [
        ("Answer: x.\nSource Chunks: 2, 1.", [2, 1], "h2" + DASHES + "h1"),
        ("Answer: x.\nSource Chunks: 2,2. more 9.", [2, 2], "h2" + DASHES + "h2"),
        ("Source Chunks: 0.", [0], "h3"),
        ("Source Chunks: -1.", [-1], "h2"),
        ("Source Chunks: -2.", [-2], "h1"),
        ("Source Chunks: -3.", [-3], None),
        ("Source Chunks: +3 .", [3], "h3"),
        ("Source Chunks: 3", [3], "h3"),
        ("Source Chunks: None.", None, None),
        ("Source Chunks: 1, x.", None, None),
        ("Source Chunks: .", None, None),
        ("Source Chunks: 1,.", None, None),
        ("Source Chunks: 4.", [4], None),
        ("Source Chunks: 1. Source Chunks: 2.", [1], "h1"),
        ("no marker", None, None),
    ],
)
def test_citations(spark, response, numbers, text):
    rows = spark.createDataFrame(
        [("t", 0, "q", ["h1", "h2", "h3"], response)], "title string, q_idx int, question string, docs array<string>, response string"
    )
    row = answering.parse_answers(rows).first()
    assert row["cited"] == numbers
    assert row["source_chunks"] == (text or "Source Chunks: None")
    assert row["response"] == response.split("Source Chunks: ")[0]


def test_no_hits_fall_back(spark):
    rows = spark.createDataFrame(
        [("t", 0, "q", [], "Source Chunks: 1.")], "title string, q_idx int, question string, docs array<string>, response string"
    )
    assert answering.parse_answers(rows).first()["source_chunks"] == "Source Chunks: None"


def test_comparison_keeps_duplicate_questions_and_order(spark):
    rows = [("b", 1, "same", "rb1", "sb1"), ("a", 0, "same", "ra0", "sa0"), ("b", 0, "same", "rb0", "sb0")]
    answers = spark.createDataFrame(rows, "title string, q_idx int, question string, response string, source_chunks string")
    table = answering.comparison_table(answers, ["b", "a", "x.y"], partial=True)
    assert table.columns == [
        "q_idx", "question", "b-response", "b-source_chunks", "a-response", "a-source_chunks", "x.y-response", "x.y-source_chunks",
    ]
    assert [tuple(r) for r in table.collect()] == [
        (0, "same", "rb0", "sb0", "ra0", "sa0", None, None),
        (1, "same", "rb1", "sb1", None, None, None, None),
    ]


def test_generate_passes_settings(spark):
    prompts = spark.createDataFrame([("p",)], "prompt string")

    def model(system_text, texts, **settings):
        return [f"{system_text}|{t}|{sorted(settings.items())}" for t in texts]

    row = answering.generate(prompts, model, "sys", temperature=0.5).first()
    assert row["response"] == "sys|p|[('max_output_tokens', 4096), ('temperature', 0.5), ('top_p', 0.3)]"


def test_store_is_created_once_and_skips_known_ids(spark, tmp_path):
    location = str(tmp_path / "store")
    rows = store_of(spark, {"a": 5, "b": 3})
    stores.get_or_create(spark, "s1", location)
    assert stores.append_new(rows, "s1") == 8
    assert stores.append_new(rows, "s1") == 0
    more = store_of(spark, {"b": 4})
    assert stores.append_new(more, "s1") == 1
    assert stores.get_or_create(spark, "s1", location).count() == 9
    assert stores.of_title(spark, "s1", "b").count() == 4
    assert spark.sql("SHOW TBLPROPERTIES s1").where("key = 'distance'").first()["value"] == "cosine"
    # another session finds the rows at the same place
    assert stores.get_or_create(spark, "s2", location).count() == 9
    spark.sql("DROP TABLE s1")
    spark.sql("DROP TABLE s2")


def test_questions_from_a_sheet(spark, tmp_path):
    sheet = tmp_path / "q.csv"
    sheet.write_text('No,Question,Note\n1,"What, now?",x\n2,,y\n3,"two\nlines ""q""",z\nlast,What?,w\n')
    rows = files.read_questions(spark, str(sheet)).orderBy("q_idx").collect()
    assert [tuple(r) for r in rows] == [(0, "What, now?"), (1, 'two\nlines "q"'), (2, "What?")]


def test_text_folder(spark, tmp_path):
    folder = tmp_path / "funds"
    folder.mkdir()
    (folder / "alpha.v2.txt").write_bytes("a\r\nb\rc\n".encode())
    (folder / "skip.TXT").write_text("no")
    (folder / "skip.pdf").write_text("no")
    assert [tuple(r) for r in files.read_texts(spark, str(folder)).collect()] == [("alpha", "funds", "a\nb\nc\n")]


def test_ingest_guard_refuses_large_folders(spark):
    names = spark.createDataFrame([("f", f"{i}.PDF") for i in range(20)] + [("g", "a.pdf")], schemas.FILES)
    with pytest.raises(ValueError):
        files.check_ingest(names)
    files.check_ingest(names, allow_large=True)
    files.check_ingest(names, threshold=21)


def test_folder_comparison_counts_all_files(spark):
    source = spark.createDataFrame([("f", "a.pdf"), ("f", "n.doc"), ("g", "a.pdf"), ("h", "a.PDF")], schemas.FILES)
    done = spark.createDataFrame([("f", "a.txt"), ("f", "n.doc"), ("g", "a.txt"), ("g", "b.txt"), ("h", "a.txt"), ("x", "q")], schemas.FILES)
    got = {r["folder"]: r["up_to_date"] for r in files.folder_up_to_date(source, done).collect()}
    assert got == {"f": True, "g": False, "h": False}


def test_stage_files_keep_numeric_titles(spark, tmp_path):
    chunks = spark.createDataFrame([("007", "z", 0, "x")], schemas.CHUNKS)
    files.write_stage(chunks, str(tmp_path / "c"))
    assert files.read_chunks(spark, str(tmp_path / "c")).first()["title"] == "007"


def small_pages(spark):
    rows = []
    for doc, words in (("a.pdf", "fox"), ("b.pdf", "sea")):
        rows.append((doc, 0, "cover"))
        for p in range(1, 7):
            rows.append((doc, p, f"HEAD\n{words} {words} line {p}{'x' * p}  \nother thing {p}  \n{words} again"))
    rows.append(("empty.pdf", 0, "cover"))
    return spark.createDataFrame(rows, schemas.PAGES)


def test_whole_run_and_its_page_form_agree(spark):
    questions = spark.createDataFrame([(0, "fox?"), (1, "sea?"), (2, "fox?")], schemas.QUESTIONS)
    pages = small_pages(spark)
    stub = answering.stub_generator
    merged = comparison.compare_documents(pages, questions, generator=stub).orderBy("title", "q_idx").collect()
    paged = comparison.compare_documents(pages, questions, generator=stub, by_pages=True).orderBy("title", "q_idx").collect()
    assert merged == paged
    assert [(r["title"], r["q_idx"]) for r in merged] == [(t, q) for t in ("a", "b", "empty") for q in range(3)]
    assert all((r["source_chunks"] == "Source Chunks: None") == (r["title"] == "empty") for r in merged)


def test_sheets_hold_every_title(spark, tmp_path):
    """More titles than one table may have columns for, awkward names and texts, gaps, one empty table."""
    path = str(tmp_path / "sheets")
    odd = ['a "b", c', "x.y", "-", "é\nz"]
    rows = [(t, q, f'why "{q}",\n?', f'r "{t}"\n{q},', f"s {q}") for t in [*odd, *[f"t{i}" for i in range(6000)]] for q in (0, 2) if (t, q) != ("x.y", 2)]
    answers = spark.createDataFrame(rows, "title string, q_idx int, question string, response string, source_chunks string")
    manifest = files.write_sheets(answers, path, 700).orderBy("sheet").collect()
    assert [r["n_titles"] for r in manifest] == [700] * 8 + [404]
    assert all(a["last_title"] < b["first_title"] for a, b in zip(manifest, manifest[1:]))
    sheet = files.read_sheet(spark, path, 0)
    want = sorted(r[0] for r in rows if r[1] == 0)[:700]
    assert sheet.columns == ["q_idx", "question", *[f"{t}-{p}" for t in want for p in ("response", "source_chunks")]]
    by_key = {(r[0], r[1]): r for r in rows}
    for got in sheet.collect():
        assert got["question"] == f'why "{got["q_idx"]}",\n?'
        for t in want[:50]:
            row = by_key.get((t, got["q_idx"]))
            assert got[f"{t}-response"] == (row[3] if row else "")
    assert files.write_sheets(answers.limit(0), str(tmp_path / "none")).count() == 0


def test_shared_titles_are_refused(spark):
    pages = spark.createDataFrame([("a.v1.pdf", 0, "c"), ("a.v2.pdf", 0, "c")], schemas.PAGES)
    with pytest.raises(ValueError, match="'a'"):
        files.check_unique_titles(pages)


def test_stored_documents_answer_questions(spark, tmp_path):
    stores.get_or_create(spark, "asked", str(tmp_path / "store"))
    docs = spark.createDataFrame([("a", "z", "red fox\nruns far"), ("b", "z", "blue sea\n\nis deep")], schemas.DOCS)
    assert comparison.add_documents(docs, "asked", split_regex="\n") == 2
    assert comparison.add_documents(docs, "asked", split_regex="\n") == 0
    questions = spark.createDataFrame([(0, "fox")], schemas.QUESTIONS)
    answers = comparison.ask(spark.table("asked"), docs.select("title"), questions, generator=answering.stub_generator)
    got = {r["title"]: r["source_chunks"] for r in answers.collect()}
    assert got == {"a": "red fox runs far", "b": "blue sea  is deep"}
    spark.sql("DROP TABLE asked")


def test_stream_ingests_new_files_once(spark, tmp_path):
    source, checkpoint = str(tmp_path / "in"), str(tmp_path / "check")
    stores.get_or_create(spark, "streamed", str(tmp_path / "store"))

    def run():
        options = {"split_regex": "\n", "embedder": HashEmbedder(8)}
        ingest_documents(spark, source, "streamed", checkpoint, **options).awaitTermination()
        return sorted(r["title"] for r in spark.table("streamed").select("title").distinct().collect())

    spark.createDataFrame([("a", "z", "x\ny"), ("b", "z", "u")], schemas.DOCS).write.parquet(source)
    assert run() == ["a", "b"]
    first = spark.table("streamed").count()
    assert run() == ["a", "b"] and spark.table("streamed").count() == first
    spark.createDataFrame([("b", "z", "changed"), ("c", "z", "new")], schemas.DOCS).write.mode("append").parquet(source)
    assert run() == ["a", "b", "c"] and spark.table("streamed").count() == first + 1
    spark.sql("DROP TABLE streamed")


@pytest.mark.parametrize("keys", [[-1, 0, 3000], [-1, 0, 2000], [7], [10**9, -(10**9), 5]])
def test_every_question_keeps_its_pairs(spark, monkeypatch, keys):
    """Keys may be negative or far apart; the number of parts follows the questions, not the keys."""
    monkeypatch.setattr(retrieval, "QUESTION_BLOCK", 2)
    questions = spark.createDataFrame([(k, "?") for k in keys], schemas.QUESTIONS)
    assert len(retrieval.question_blocks(questions)) == (len(keys) + 1) // 2
    titles = spark.createDataFrame([("a",), ("b",)], "title string")
    pairs = {(r["title"], r["q_idx"]) for r in retrieval.title_question_pairs(titles, questions).collect()}
    assert pairs == {(t, k) for t in "ab" for k in keys}


def test_questions_without_a_key_are_refused(spark):
    questions = spark.createDataFrame([(None, "?"), (1, "?")], schemas.QUESTIONS)
    with pytest.raises(ValueError, match="q_idx"):
        retrieval.question_blocks(questions)


def test_candidates_are_narrow_and_frames_bounded(spark, monkeypatch):
    """Many small titles and many questions: ids and distances only, a bounded number of rows at a time."""
    monkeypatch.setattr(retrieval, "FRAME_ROWS", 500)
    rng = np.random.default_rng(1)
    batch = pd.DataFrame({
        "title": [f"t{i // 3}" for i in range(90)],
        "id": [f"{i:03d}" for i in range(90)],
        "embedding": [rng.normal(size=4) for _ in range(90)],
    })

    class Asked:
        value = (np.arange(40), retrieval.unit_rows(rng.normal(size=(40, 4))))

    frames = list(retrieval._batch_candidates(Asked, 20, None)(iter([batch])))
    assert all(list(f.columns) == ["title", "q_idx", "id", "distance"] and len(f) <= 500 for f in frames)
    assert sum(map(len, frames)) == 90 * 40
    store, vectors = store_of(spark, {"a": 5}), vectors_of(spark, 3)
    for method in retrieval.METHODS.values():
        assert method(store, vectors, 20).columns == ["title", "q_idx", "id", "distance"]


def test_a_list_that_leaves_titles_out_is_refused(spark):
    rows = [(t, 0, "?", f"r{t}", "s", [1]) for t in "ab"]
    answers = spark.createDataFrame(
        rows, "title string, q_idx int, question string, response string, source_chunks string, cited array<int>"
    )
    with pytest.raises(ValueError, match="'b'"):
        answering.comparison_table(answers, ["a"])
    assert answering.comparison_table(answers).first()["b-response"] == "rb"
    assert "b-response" not in answering.comparison_table(answers, ["a"], partial=True).columns


def test_documents_that_share_a_title_are_refused_by_the_store(spark, tmp_path):
    stores.get_or_create(spark, "unique_titles", str(tmp_path / "store"))
    docs = spark.createDataFrame([("a", "z", "x"), ("a", "z", "y")], schemas.DOCS)
    with pytest.raises(ValueError, match="'a'"):
        comparison.add_documents(docs, "unique_titles")
    spark.sql("DROP TABLE unique_titles")


def titled(spark, titles, text="c"):
    rows = [(f"{t}-{i}", f"{text} {i}", t, "z", [1.0]) for t in titles for i in range(2)]
    return spark.createDataFrame(rows, schemas.STORE)


def spoil(folder):
    """Chunk files that nobody can read any more."""
    files_ = list(folder.glob("bucket=*/*.parquet"))
    for file in files_:
        file.write_bytes(b"not parquet")
        (file.parent / f".{file.name}.crc").unlink(missing_ok=True)
    return len(files_)


def test_what_is_stored_is_known_without_reading_chunks(spark, tmp_path):
    stores.get_or_create(spark, "indexed", str(tmp_path / "store"), buckets=8)
    old, new = [f"t{i}" for i in range(600)], [f"u{i}" for i in range(400)]
    assert stores.append_new(titled(spark, old), "indexed") == 1200
    assert spoil(tmp_path / "store")
    incoming = titled(spark, old + new)
    assert stores.skip_existing_titles(incoming, stores.stored_titles(spark, "indexed")).count() == 800
    assert stores.append_new(incoming, "indexed") == 800
    assert stores.append_new(incoming, "indexed") == 0
    assert stores.stored_titles(spark, "indexed").count() == 1000
    with pytest.raises(Exception, match="(?i)parquet"):
        stores.append_new(spark.createDataFrame([("t0-9", "c", "t0", "z", [1.0])], schemas.STORE), "indexed")
    spark.sql("DROP TABLE indexed")


def test_the_number_of_buckets_is_always_the_stores(spark, tmp_path):
    """Readers, a second table over the same files and a repeated append all take the kept number."""
    location, rows = str(tmp_path / "store"), titled(spark, [f"t{i}" for i in range(40)])
    stores.get_or_create(spark, "few", location, buckets=8)
    assert stores.append_new(rows, "few") == 80
    assert stores.buckets_of(spark, "few") == 8
    assert all(stores.of_title(spark, "few", f"t{i}").count() == 2 for i in (0, 7, 39))
    part = stores.touched(spark, "few", rows.limit(1))
    assert len({f.rsplit("/", 2)[1] for f in part.inputFiles()}) == 1
    stores.get_or_create(spark, "again", location)
    assert stores.buckets_of(spark, "again") == 8
    assert stores.append_new(rows, "again") == 0 and spark.table("again").count() == 80
    with pytest.raises(ValueError, match="8 buckets"):
        stores.get_or_create(spark, "wrong", location, buckets=64)
    for name in ("few", "again"):
        spark.sql(f"DROP TABLE {name}")


def test_files_without_their_number_are_taken_over_if_they_fit(spark, tmp_path):
    import shutil

    location, rows = tmp_path / "store", titled(spark, [f"t{i}" for i in range(40)])
    stores.get_or_create(spark, "bare", str(location), buckets=8)
    stores.append_new(rows, "bare")
    spark.sql("DROP TABLE bare")
    shutil.copytree(location, tmp_path / "copy", ignore=shutil.ignore_patterns("_titles", "_buckets"))
    with pytest.raises(ValueError, match="64 buckets"):
        stores.get_or_create(spark, "bare", str(tmp_path / "copy"))
    stores.get_or_create(spark, "bare", str(tmp_path / "copy"), buckets=8)
    assert stores.stored_titles(spark, "bare").count() == 40
    assert stores.append_new(rows, "bare") == 0
    spark.sql("DROP TABLE bare")


@pytest.mark.parametrize("step", ["_in_files", "_end"])
def test_a_run_that_broke_off_is_made_good(spark, tmp_path, monkeypatch, step):
    """Broken before chunks were written, or after them: the next run leaves every chunk stored once."""
    stores.get_or_create(spark, "broken", str(tmp_path / "store"), buckets=4)
    first, second = titled(spark, ["a", "b"]), titled(spark, ["b", "c", "d"])
    stores.append_new(first, "broken")

    def fail(*_):
        raise RuntimeError("gone")

    with monkeypatch.context() as patch:
        patch.setattr(stores, step, fail)
        with pytest.raises(RuntimeError):
            stores.append_new(second, "broken")
    stores.append_new(second, "broken")
    assert sorted(r["id"] for r in spark.table("broken").collect()) == [f"{t}-{i}" for t in "abcd" for i in range(2)]
    assert {(r["title"], r["n"]) for r in stores.stored_titles(spark, "broken").collect()} == {(t, 2) for t in "abcd"}
    assert stores.mend(spark, "broken") == 0
    spark.sql("DROP TABLE broken")


def test_changed_texts_take_the_place_of_the_old_ones(spark, tmp_path):
    options = {"split_regex": "\n", "embedder": HashEmbedder(8)}
    stores.get_or_create(spark, "changing", str(tmp_path / "store"), buckets=4)
    stores.get_or_create(spark, "fresh", str(tmp_path / "fresh"), buckets=4)
    before = [(f"t{i}", "z", f"one {i}\ntwo\n\nthree\nfour five") for i in range(12)] + [("gone", "z", "x\ny"), ("blank", "z", "")]
    after = [(t, z, text if i % 3 else f"other {i}\n" + text) for i, (t, z, text) in enumerate(before[:12])]
    after += [("gone", "z", "  "), ("blank", "z", "now\nmore"), ("new", "z", "a\nb")]
    comparison.add_documents(spark.createDataFrame(before, schemas.DOCS), "changing", **options)
    assert comparison.add_documents(spark.createDataFrame(after, schemas.DOCS), "changing", **options) > 0
    changed = comparison.add_documents(spark.createDataFrame(after, schemas.DOCS), "changing", replace=True, **options)
    assert changed > 0
    comparison.add_documents(spark.createDataFrame(after, schemas.DOCS), "fresh", **options)

    def content(name):
        return sorted((r["title"], r["id"], r["chunk"], tuple(r["embedding"])) for r in spark.table(name).collect())

    assert content("changing") == content("fresh")
    index = [sorted(map(tuple, stores.stored_titles(spark, n).collect())) for n in ("changing", "fresh")]
    assert index[0] == index[1]
    assert spoil(tmp_path / "store")  # nothing is left to do, and no chunk is read to find that out
    assert comparison.add_documents(spark.createDataFrame(after, schemas.DOCS), "changing", replace=True, **options) == 0
    for name in ("changing", "fresh"):
        spark.sql(f"DROP TABLE {name}")


def test_changed_pages_take_the_place_of_the_old_ones(spark, tmp_path):
    options = {"split_regex": "\n", "embedder": HashEmbedder(8)}
    stores.get_or_create(spark, "paged", str(tmp_path / "store"), buckets=4)
    pages = small_pages(spark)
    assert comparison.add_pages(pages, "paged", **options) > 0
    assert comparison.add_pages(pages, "paged", replace=True, **options) == 0
    other = pages.withColumn("text", F.when(F.col("doc") == "b.pdf", F.replace("text", F.lit("sea"), F.lit("lake"))).otherwise(F.col("text")))
    assert comparison.add_pages(other, "paged", replace=True, **options) > 0
    words = {r["title"]: r["chunk"] for r in spark.table("paged").collect()}
    assert "lake" in words["b"] and "sea" not in words["b"] and "fox" in words["a"]
    spark.sql("DROP TABLE paged")


def test_a_second_run_embeds_and_asks_only_once_per_text(spark, tmp_path):
    """Counts the calls of both hooks over a run in two goes."""
    cut, asked = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def encode(texts):
        cut.add(len(texts))
        return [[float(len(t)), 1.0] for t in texts]

    def generator(system_text, prompts, **settings):
        asked.add(len(prompts))
        return answering.stub_generator(system_text, prompts)

    stores.get_or_create(spark, "twice", str(tmp_path / "store"))
    pages = small_pages(spark)
    questions = spark.createDataFrame([(0, "fox?")], schemas.QUESTIONS)
    comparison.add_pages(pages.where("doc = 'a.pdf'"), "twice", embedder=ModelEmbedder(encode))
    first = cut.value
    assert first == spark.table("twice").count()
    answers = comparison.compare_stored(pages, questions, "twice", generator=generator, embedder=ModelEmbedder(encode))
    assert answers.count() == 3 and len(answers.collect()) == 3
    assert asked.value == 3
    assert cut.value >= spark.table("twice").count() + 1
    assert comparison.add_pages(pages, "twice", embedder=ModelEmbedder(encode)) == 0
    with pytest.raises(ValueError):
        names = spark.createDataFrame([("f", f"{i}.pdf") for i in range(20)], schemas.FILES)
        comparison.compare_stored(pages, questions, "twice", names, generator=generator)
    spark.sql("DROP TABLE twice")


def test_titles_meet_questions_as_one_row(spark, monkeypatch):
    """The passages of `retrieve`, for repeated and missing ids, missing vectors and texts, long titles and empty ones."""
    rng = np.random.default_rng(3)
    rows = [(f"a-{i}", "a", f"text {i}", rng.random(4).tolist()) for i in range(9)]
    rows += [(f"b-{i}", "b", f"b {i}", [1.0, 0.0, 0.0, float(i % 2)]) for i in range(3)]
    rows += [("b-1", "b", "again", [1.0, 0.0, 0.0, 1.0]), (None, "b", "no id", [1.0, 1.0, 1.0, 1.0])]
    rows += [("c-0", "c", "no vector", None), ("c-1", "c", None, [0.0] * 4), ("d-0", "d", "only", None), ("z", None, "z", [1.0] * 4)]
    store = spark.createDataFrame(rows, "id string, title string, chunk string, embedding array<double>")
    titles = spark.createDataFrame([(t,) for t in ["a", "b", "c", "d", "e", None]], "title string")
    questions = spark.createDataFrame([(i * 3 - 9, f"word{i % 5} w{i}") for i in range(70)], "q_idx int, question string")
    embedder = HashEmbedder(4)
    hits = retrieval.retrieve(store, retrieval.embed_questions(questions, embedder), digits=6)
    pairs = retrieval.title_question_pairs(titles, questions)
    wanted = answering.build_prompts(pairs, retrieval.context_blocks(hits)).collect()
    key = lambda r: (r["title"] or "", r["q_idx"])
    for longest in (256, 5):
        monkeypatch.setattr(comparison, "WHOLE_TITLE", longest)
        found = comparison._contexts(store, titles, questions, embedder, "matrix", 6)
        assert sorted(answering.render_prompts(found).collect(), key=key) == sorted(wanted, key=key)


def test_pairs_are_not_shuffled_and_passages_not_written(spark):
    docs = spark.createDataFrame([(f"t{i}", f"red fox {i}") for i in range(4)], "title string, chunk string")
    store = docs.select(F.concat("title", F.lit("-0")).alias("id"), "title", "chunk", HashEmbedder(8).embed(F.col("chunk")).alias("embedding"))
    questions = spark.createDataFrame([(0, "fox"), (1, "red")], "q_idx int, question string")
    found = retrieval.title_contexts(store, docs.select("title"), questions, HashEmbedder(8))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(title" in plan
    assert not [line for line in plan.split("\n") if "hashpartitioning" in line and "q_idx" in line]
    before = set(os.listdir(shared_folder(spark).removeprefix("file:")))
    answers = comparison.ask(store, docs.select("title"), questions, HashEmbedder(8), generator=answering.stub_generator)
    assert answers.count() == 8
    for name in set(os.listdir(shared_folder(spark).removeprefix("file:"))) - before:
        assert not {"docs", "prompt"} & set(spark.read.parquet(f"{shared_folder(spark)}/{name}").columns)


def test_write_texts_makes_one_file_per_row(spark, tmp_path):
    values = [("a/b=c", "one\r\ntwo"), (None, "Straße"), ("x y", None), ("", "")]
    rows = spark.createDataFrame(values, "source string, value string").repartition(2)
    assert files.write_texts(rows, f"{tmp_path}/mine", by="source") == 4
    rows.select("source", F.coalesce("value", F.lit("")).alias("value")).write.option("maxRecordsPerFile", 1).partitionBy("source").text(f"{tmp_path}/spark")
    def read(path):
        return sorted((p.parent.name, p.read_bytes()) for p in pathlib.Path(path).rglob("part-*.txt"))
    assert read(f"{tmp_path}/mine") == read(f"{tmp_path}/spark")
    assert files.write_texts(rows.limit(0), f"file://{tmp_path}/none") == 0
    assert files.write_texts(rows, f"file://{tmp_path}/flat") == 4
    assert len(list((tmp_path / "flat").glob("part-*.txt"))) == 4


def test_text_files_are_listed_by_tasks_as_spark_lists_them(spark, tmp_path):
    names = ["a b%c#dé[x]{y}.txt", "q?r;s@u&v=w+x$y,z!~*'().txt", "pct%20.v2.txt", "p^`|<>.txt", "日本.txt", "_h.txt", "_h=1.txt", ".h.txt", "UP.TXT"]
    below = ["k=1/sub/a.txt", "k=2/a.txt", "k=2/.hidden/a.txt", "k=2/_hidden/a.txt"]
    for name in [f"flat b%c/{n}" for n in names + ["sub/in.txt"]] + [f"keyed/{n}" for n in below] + [f"under/x/{n}" for n in below]:
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"x\xff\r\ny\rz\n" + name.encode())
    (tmp_path / "flat b%c" / "empty.txt").touch()
    (tmp_path / "void").mkdir()

    def by_spark(path):
        found = spark.read.option("pathGlobFilter", "*.txt").text(path, wholetext=True)
        location = F.col("_metadata.file_path")
        return found.select(
            files.title_from_path(location), files.folder_from_path(location), F.regexp_replace("value", "\r\n?", "\n")
        )

    counts = {"flat b%c": 6, "keyed": 2, "keyed/*": 1, "under": 2, "void": 0, "flat b%c/pct%20.v2.txt": 1, "flat b%c/p*.txt": 2}
    for place, n in counts.items():
        texts = files.read_texts(spark, f"{tmp_path}/{place}")
        assert not [f for f in texts.inputFiles() if f.endswith(".txt")]
        found = sorted(map(tuple, texts.collect()))
        assert len(found) == n and found == sorted(map(tuple, by_spark(f"{tmp_path}/{place}").collect()))
    assert files.read_texts(spark, f"file://{tmp_path}/keyed").count() == 2
    with pytest.raises(AnalysisException):
        files.read_texts(spark, f"{tmp_path}/none")


def test_answers_beside_the_generator_are_those_of_prompts_in_rows(spark, monkeypatch):
    """Prompts, docs and replies of `answer_titles` against `retrieve`, `build_prompts` and `generate`, in small slices."""
    rng = np.random.default_rng(5)
    rows = [(f"a-{i}", "a", f"text {i}", rng.random(4).tolist()) for i in range(9)]
    rows += [("b-1", "b", "one", [1.0, 0.0, 0.0, 1.0]), ("b-1", "b", "again", [1.0, 0.0, 0.0, 1.0]), (None, "b", "no id", [1.0] * 4)]
    rows += [("c-0", "c", "no vector", None), ("c-1", "c", None, [0.0, 1.0, 0.0, 0.0]), ("d-0", "d", "only", None)]
    store = spark.createDataFrame(rows, "id string, title string, chunk string, embedding array<double>")
    titles = spark.createDataFrame([(t,) for t in ["a", "b", "c", "d", "e", None]], "title string")
    questions = spark.createDataFrame([(i * 3 - 9, f"word{i % 5} w{i}") for i in range(70)], "q_idx int, question string")
    embedder, asked = HashEmbedder(4), spark.sparkContext.accumulator(0)

    def generator(system_text, prompts, **settings):
        asked.add(len(prompts))
        return [None if "w13\n" in p else f"{p} {sorted(settings.items())} {system_text}" for p in prompts]

    hits = retrieval.retrieve(store, retrieval.embed_questions(questions, embedder), digits=6)
    pairs = retrieval.title_question_pairs(titles, questions)
    prompts = answering.build_prompts(pairs, retrieval.context_blocks(hits))
    wanted = answering.generate(prompts, generator).drop("prompt").collect()
    key = lambda r: (r["title"] or "", r["q_idx"])
    for slice_, most in ((256, 1 << 13), (32, 40)):
        monkeypatch.setattr(retrieval, "QUESTIONS_AT_ONCE", slice_)
        monkeypatch.setattr(answering, "PROMPTS_AT_ONCE", most)
        before = asked.value
        found = answering.answer_titles(store, titles, questions, embedder, generator, digits=6)
        assert found.count() == len(wanted) and sorted(found.collect(), key=key) == sorted(wanted, key=key)
        assert asked.value - before == len(wanted)  # each prompt once, however often the answers are read


def test_prompts_do_not_travel(spark):
    """A title's chunks are handed to one Python step per slice of questions, and prompts are no column of the plan."""
    docs = spark.createDataFrame([(f"t{i}", f"red fox {i}") for i in range(4)], "title string, chunk string")
    store = docs.select(F.concat("title", F.lit("-0")).alias("id"), "title", "chunk", HashEmbedder(8).embed(F.col("chunk")).alias("embedding"))
    questions = spark.createDataFrame([(i, f"fox {i}") for i in range(50)], "q_idx int, question string")
    folder = shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    answers = comparison.ask(store, docs.select("title"), questions, HashEmbedder(8), generator=answering.stub_generator)
    plan = answers._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and "MapInArrow" not in plan
    replies = [name for name in set(os.listdir(folder)) - before if name.startswith("replies-")]
    assert len(replies) == 1 and spark.read.parquet(f"{folder}/{replies[0]}").count() == 4
    assert answers.count() == 200


def test_citations_as_before(spark):
    replies = {
        "Answer: x.\nSource Chunks: 1.": [1], "Source Chunks: 1": [1], "a Source Chunks: 2,3. Source Chunks: 9.": [2, 3],
        "Source Chunks: 1\n.": [1], "Source Chunks: \u20281\u2028.": [1], "Source Chunks: +2, -1 .": [2, -1], "Source Chunks: None.": None,
        "Source Chunks: .": None, "Source Chunks: 1,.": None, "Source Chunks: 1 2.": None, "Source Chunks: 9999999999.": None,
        "Source Chunks: 999999999.": [999999999], "Source Chunks: \u0661.": None, "no marker": None, "": None, None: None,
        "\u00e9\u65e5 Source Chunks: 4.": [4], "Source Chunks:1.": None, "Source Chunks: 1Source Chunks: 2.": [1],
    }
    rows = spark.createDataFrame([(r,) for r in replies], "response string")
    found = rows.select("response", answering.cited_numbers(F.col("response")).alias("n"), answering.answer_text(F.col("response")).alias("t")).collect()
    assert {r["response"]: r["n"] for r in found} == replies
    assert all(r["t"] == (r["response"] if r["response"] is None else r["response"].split("Source Chunks: ")[0]) for r in found)
    docs = spark.createDataFrame([([1],), ([0],), ([-2],), ([3],), ([2, 1],), ([1, 3],), ([],), (None,)], "cited array<int>")
    chunks = docs.select(answering.cited_chunks(F.col("cited"), F.array(F.lit("a"), F.lit("b")), "|", "-").alias("c"))
    assert [r["c"] for r in chunks.collect()] == ["a", "b", "-", "-", "b|a", "-", "", "-"]
