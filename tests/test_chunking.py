"""Splitting, windows, thresholds and chunks against hand-worked values, NumPy and plain Python."""

from __future__ import annotations

import hashlib
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Window, functions as F

from quirefold.functions import embedders
from quirefold.functions.embedders import HashEmbedder, ModelEmbedder
from quirefold.functions.text import ascii_fold, fold_text, is_not_blank, packed_parts, split_sentences, unit_array, word_count
from quirefold.functions.vectors import l2_normalize
from quirefold.operators import chunking, longform, ordering, packing, selection, splitting
from quirefold.plans import tables

SF = "/root/testdata/sf0.001"


def docs(spark, *texts):
    return spark.createDataFrame([(f"t{i}", "zip", t) for i, t in enumerate(texts)], "title string, zip_name string, text string")


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t"))).first()[0]


@pytest.mark.parametrize("text", ["", "  ", "a", " a  b c d\n\te ", "a\x1fb\x85c", "x　y​z"])
def test_words_are_python_words(spark, text):
    assert one(spark, text, word_count) == len(text.split())
    assert one(spark, text, is_not_blank) == bool(text.strip())


@pytest.mark.parametrize("text", ["A b. C d? E!  F", "no end", "a.b c.\n\nd", ".  .  ", "x! ", ""])
def test_sentence_ends(spark, text):
    assert one(spark, text, split_sentences) == re.split(r"(?<=[.?!])\s+", text)


def test_packing(spark):
    pack = lambda t, n: one(spark, t, lambda c: packed_parts(c, n))
    assert pack("a b c d. e f.", 3) == ["", "a b c d.", "e f."]
    assert pack("a b. c d. e  f. g.", 4) == ["a b. c d.", "e f. g."]
    assert pack("a b c d e", 3) == ["", "a b c d e"]


def packed_in_python(text, limit):
    if len(text.split()) <= limit:
        return [text]
    done, words = [], []
    for sentence in re.split(r"(?<=[.?!])\s+", text):
        more = sentence.split()
        if len(words) + len(more) > limit:
            done, words = [*done, " ".join(words)], more
        else:
            words = words + more
    return done + ([" ".join(words)] if words else [])


def test_units_of_all_documents(spark):
    table = tables.documents(spark, SF)
    units = splitting.split_units(table, "\n", 20)
    got: dict[str, list] = {}
    for r in units.orderBy("title", "idx").collect():
        got.setdefault(r["title"], []).append(r["sentence"])
        assert r["idx"] == len(got[r["title"]]) - 1
    for r in table.collect():
        assert got[r["title"]] == [p for u in r["text"].split("\n") for p in packed_in_python(u, 20)]


def test_default_split_is_at_paragraphs(spark):
    units = splitting.split_units(docs(spark, "a\nb  \nc   \n  \n")).orderBy("idx").collect()
    assert [u["sentence"] for u in units] == re.split("  \n", "a\nb  \nc   \n  \n")


def test_null_text_gives_no_units(spark):
    assert splitting.split_units(docs(spark, None, "a")).count() == 1


def test_context_window(spark):
    rows = splitting.combine_window(splitting.split_units(docs(spark, "A\nB\nC"), "\n")).orderBy("idx").collect()
    assert [r["combined"] for r in rows] == ["A \n\nB", "A \n\nB \n\nC", "B \n\nC"]


def test_zero_vector_stays_zero(spark):
    row = spark.range(1).select(l2_normalize(F.array(F.lit(0.0), F.lit(0.0))), l2_normalize(F.array(F.lit(3), F.lit(4)))).first()
    assert row[0] == [0.0, 0.0] and row[1] == pytest.approx([0.6, 0.8])


LINES = ["red fox", "red fox runs", "blue sea", "blue sea is deep", "stars", "stars shine", "red fox"]


def measured(spark, lines, *options):
    units = chunking.measure_units(docs(spark, "\n".join(lines)), chunking.Breakpoints(*options), split_regex="\n")
    return units.orderBy("idx").collect()


def reference_distances(spark, lines):
    embedder = HashEmbedder()
    windows = ["\n".join(lines[max(i - 1, 0) : i + 2]) for i in range(len(lines))]
    rows = spark.createDataFrame([(i, w) for i, w in enumerate(windows)], "i int, w string")
    vectors = [np.array(r[0]) for r in rows.orderBy("i").select(embedder.embed(F.col("w"))).collect()]
    return np.round([1 - a @ b for a, b in zip(vectors, vectors[1:])], 6)


def test_distances(spark):
    got = [r["distance"] for r in measured(spark, LINES)]
    assert got[-1] is None
    assert got[:-1] == pytest.approx(list(reference_distances(spark, LINES)), abs=1.1e-6)


@pytest.mark.parametrize("kind", ["percentile", "standard_deviation", "interquartile", "gradient"])
def test_thresholds_against_numpy(spark, kind):
    rows = measured(spark, LINES, kind)
    d = np.array([r["distance"] for r in rows[:-1]])
    amount = chunking.DEFAULT_AMOUNTS[kind]
    metric = np.gradient(d, range(len(d))) if kind == "gradient" else d
    quarters = np.percentile(d, [25, 75])
    limit = {
        "percentile": np.percentile(metric, amount),
        "gradient": np.percentile(metric, amount),
        "standard_deviation": d.mean() + amount * d.std(),
        "interquartile": d.mean() + amount * (quarters[1] - quarters[0]),
    }[kind]
    assert [r["metric"] for r in rows[:-1]] == pytest.approx(list(metric), abs=1e-7)
    assert rows[0]["threshold"] == pytest.approx(limit, abs=1e-9)
    assert [r["is_break"] for r in rows] == [bool(x > limit + 1e-9) for x in metric] + [False]


@pytest.mark.parametrize("wanted", [1, 2, 3, 4, 50])
def test_wanted_number_of_chunks(spark, wanted):
    lines = [f"w{i} " * (i + 1) + f"v{i * i}" for i in range(9)]
    n = len({r["distance"] for r in measured(spark, lines)}) - 1
    chunks = chunking.semantic_chunk(docs(spark, "\n".join(lines)), sentence_split_regex="\n", number_of_chunks=wanted)
    assert n == 8 and chunks.count() == min(wanted, 8)


def test_unknown_threshold_type():
    with pytest.raises(ValueError):
        chunking.Breakpoints("median")
    assert chunking.Breakpoints("interquartile").amount == 1.5


def chunk_texts(spark, text, **options):
    cut = chunking.semantic_chunk(docs(spark, text), sentence_split_regex="\n", **options)
    return [r["chunk"] for r in cut.orderBy("chunk_idx").collect()]


def test_short_documents(spark):
    assert chunk_texts(spark, "only one") == ["only one"]
    assert chunk_texts(spark, "a b\nc d") == ["a b c d"]
    assert chunk_texts(spark, "a b\nc d", breakpoint_threshold_type="gradient") == ["a b", "c d"]
    assert chunk_texts(spark, "") == [""]


def test_start_index_ignores_separators(spark):
    chunks = spark.createDataFrame([("t", 0, "ab"), ("t", 1, "cde"), ("t", 2, "f")], "title string, chunk_idx int, chunk string")
    rows = chunking.with_start_index(chunks).orderBy("chunk_idx").collect()
    assert [r["start_index"] for r in rows] == [0, 2, 5]


def test_chunks_rejoin_to_the_units(spark):
    table = tables.documents(spark, SF)
    chunks = chunking.semantic_chunk(table, sentence_split_regex="\n", breakpoint_threshold_amount=85)
    by_title: dict[str, list] = {}
    for r in chunks.orderBy("title", "chunk_idx").collect():
        by_title.setdefault(r["title"], []).append(r["chunk"])
    for r in table.collect():
        want = " ".join(p for u in r["text"].split("\n") for p in packed_in_python(u, 350))
        assert " ".join(by_title[r["title"]]) == want


def test_model_embedder_equals_native_when_the_model_does(spark):
    def encode(model, texts):
        out = np.zeros((len(texts), 8))
        for i, t in enumerate(texts):
            for w in t.split():
                out[i, model[w[0]]] += 1
        return out

    hook = ModelEmbedder(encode, load=lambda: {c: ord(c) % 8 for c in "abcdefghijklmnopqrstuvwxyz"})
    text = "\n".join(LINES)
    cut = chunking.semantic_chunk(docs(spark, text, "single"), sentence_split_regex="\n", embedder=hook)
    rows = cut.orderBy("title", "chunk_idx").collect()
    assert [r["chunk"] for r in rows if r["title"] == "t1"] == ["single"]
    assert " ".join(r["chunk"] for r in rows if r["title"] == "t0") == " ".join(LINES)
    assert len([r for r in rows if r["title"] == "t0"]) > 1


def test_one_exchange_for_the_whole_cut(spark):
    plan = chunking.semantic_chunk(docs(spark, "a\nb"), sentence_split_regex="\n")._jdf.queryExecution().executedPlan()
    assert plan.toString().count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_running_total_over_blocks(spark, block):
    rows = [(k, p, (p * 7) % 5) for k in "ab" for p in range(0, 40, 3)]
    df = spark.createDataFrame(rows, "k string, p int, v int")
    order = Window.partitionBy("k").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    want = df.withColumn("t", F.coalesce(F.sum("v").over(order), F.lit(0)))
    got = ordering.running_total(df, ["k"], "p", F.col("v"), "t", block)
    assert sorted(got.collect()) == sorted(want.collect())
    dense = ordering.dense_index(df, ["k"], "p", "i", block=block).orderBy("k", "p").collect()
    assert [r["i"] for r in dense] == list(range(14)) * 2


@pytest.mark.parametrize(
    "options",
    [{}, {"breakpoint_threshold_type": "gradient"}, {"number_of_chunks": 3}, {"buffer_size": 2, "breakpoint_threshold_amount": 60}],
)
@pytest.mark.parametrize("block", [2, 7])
def test_page_form_equals_whole_text(spark, options, block):
    """Texts cut at every fifth line into pages give the chunks of the whole text."""
    table = tables.documents(spark, SF)
    lines = F.split("text", "\n", -1)
    n = F.ceil(F.size(lines) / 5)
    pages = table.select("title", "text", F.explode(F.sequence(F.lit(0), n - 1)).alias("position"), (n - 1).alias("last")).select(
        "title", "position", "last", F.array_join(F.slice(lines, F.col("position").cast("int") * 5 + 1, F.lit(5)), "\n").alias("text")
    )
    whole = chunking.semantic_chunk(table, sentence_split_regex="\n", max_words=30, **options)
    paged = longform.semantic_chunk_pages(pages, sentence_split_regex="\n", max_words=30, block=block, **options)
    assert sorted(whole.select("title", "chunk_idx", "chunk").collect()) == sorted(paged.collect())


@pytest.mark.parametrize("kind", ["percentile", "gradient", "interquartile", "standard_deviation", "chunks"])
def test_thresholds_of_documents_over_many_blocks(spark, kind):
    """Against numpy: ties, one value everywhere, a document of one block, values next to each other."""
    rng = np.random.default_rng(6)
    docs = {
        "long": rng.random(3000), "ties": rng.integers(0, 4, 2500) / 4, "same": np.full(700, 0.25), "short": rng.random(40),
        "close": 0.5 + rng.integers(0, 900, 1500) * 2.0**-52, "steep": 10.0 ** -rng.integers(0, 300, 900).astype(float), "none": np.zeros(0),
    }
    rows = [(t, i, float(x)) for t, xs in docs.items() for i, x in enumerate(xs)] + [(t, len(xs), None) for t, xs in docs.items()]
    measured = spark.createDataFrame(rows, "title string, idx long, metric double").repartition(4)
    amount = {"percentile": 85.0, "gradient": 95.0, "interquartile": 1.5, "standard_deviation": 3.0}.get(kind)
    breakpoints = chunking.Breakpoints(*((kind, amount) if amount else ("percentile", None, 7)))
    got = {r["title"]: (r["last_idx"], r["threshold"]) for r in longform.document_thresholds(measured, breakpoints, 64).collect()}
    for title, xs in docs.items():
        assert got[title][0] == len(xs)
        if not len(xs):
            continue
        if kind in ("percentile", "gradient"):
            want = np.percentile(xs, amount)
        elif kind == "interquartile":
            want = xs.mean() + amount * (np.percentile(xs, 75) - np.percentile(xs, 25))
        elif kind == "standard_deviation":
            want = xs.mean() + amount * xs.std()
        else:
            want = np.sort(xs)[-7]
        assert got[title][1] == pytest.approx(want, rel=1e-12, abs=1e-15) and (kind != "chunks" or got[title][1] == want)


def test_ranks_of_a_million_units(spark):
    """One title of 10**6 different values: the rank found is the one numpy finds, over blocks of 4096."""
    n = 1_000_000
    values = spark.range(n, numPartitions=8).select(
        F.lit("t").alias("title"), F.col("id").alias("idx"), (F.pmod(F.col("id") * 7919, F.lit(n)) / n).alias("metric")
    )
    wanted = spark.createDataFrame([("t", n - 1, r) for r in (0, 1, 499_999, 950_000, n - 1, n)], "title string, last_idx long, rank long")
    got = {r["rank"]: r["value"] for r in selection.order_statistics(values, wanted).collect()}
    assert got == {r: r / n for r in (0, 1, 499_999, 950_000, n - 1)}


def test_page_form_with_paragraphs_over_pages(spark):
    text = "a\nb  \nc\nd\ne  \n\nf"
    pages = spark.createDataFrame(
        [("t", i, 6, line) for i, line in enumerate(text.split("\n"))], "title string, position int, last int, text string"
    )
    rows = longform.page_paragraphs(pages, block=2).orderBy("par").collect()
    assert [r["paragraph"] for r in rows] == text.split("  \n")


def text_over_pages(draw, n_pages):
    """Lines of random sentences: blank lines, sentences over many lines, some too long, a few paragraph ends."""
    lines = []
    for _ in range(n_pages):
        words = [draw.choice(["a", "b.", "c?", "d", "e", "f!", ".", "é", "g ", "  h"]) for _ in range(draw.randrange(0, 9))]
        lines.append(" ".join(words) + draw.choice(["", "", "", " ", ".", "  "]))
    return lines


@pytest.mark.parametrize("max_words", [1, 3, 20])
@pytest.mark.parametrize("whole_chars", [0, 30])
def test_packing_over_rows_equals_packing_of_one_value(spark, max_words, whole_chars):
    """Units of paragraphs that are never joined are those of joined ones, over many small blocks."""
    draw = random.Random(max_words)
    titles = {f"t{i}": text_over_pages(draw, n) for i, n in enumerate([1, 4, 60, 250])} | {"dots": ["."] * 90, "none": ["x y"] * 70}
    rows = [(t, i, len(x) - 1, line) for t, x in titles.items() for i, line in enumerate(x)]
    pages = spark.createDataFrame(rows, "title string, position int, last int, text string").repartition(3)
    pieces = longform.page_pieces(pages, block=8)
    units = longform.paragraph_units(pieces, max_words, block=8, whole_chars=whole_chars).collect()
    got = {t: {r["idx"]: r["sentence"] for r in units if r["title"] == t} for t in titles}
    assert len(units) == sum(map(len, got.values()))
    texts = spark.createDataFrame([(t, "\n".join(x)) for t, x in titles.items()], "title string, text string")
    want = {r["title"]: dict(enumerate(r["u"])) for r in texts.select("title", unit_array(F.col("text"), "  \n", max_words).alias("u")).collect()}
    assert got == want


def test_cuts_of_one_long_sequence(spark):
    """A single key over many blocks, against a plain loop."""
    n, budget = 20_000, 37
    words = [1 + (i * i * 31 + i // 7 + 45) % 50 for i in range(n)]
    rows = spark.createDataFrame([("k", i, w) for i, w in enumerate(words)], "k string, idx long, words long")
    got = {r["idx"]: r["nth"] for r in packing.greedy_cuts(rows, ["k"], budget, 64).collect()}
    want, part, used = {}, int(words[0] > budget), 0
    for i, w in enumerate(words):
        if i and used + w > budget:
            part, used = part + 1, 0
        used += w
        want[i] = part
    assert got == want


@pytest.mark.parametrize("regex", [r"\n\s*\n", r"\s+", "\n\n", "."])
def test_patterns_that_reach_over_page_ends_are_refused_when_cutting_from_pages(spark, regex):
    pages = spark.createDataFrame([("a", 0, 0, "x")], "title string, position int, last int, text string")
    with pytest.raises(ValueError, match="line end"):
        longform.semantic_chunk_pages(pages, sentence_split_regex=regex)
    assert longform.ends_lines("  \n") and longform.ends_lines(r"\n")


def seconds(frame):
    start = time.perf_counter()
    frame.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def test_packing_time_is_in_proportion(spark):
    def unit(n):
        text = " ".join(f"a{i} b c." for i in range(n))
        return spark.createDataFrame([(text,)], "t string").select(packed_parts(F.col("t"), 10).alias("p"))

    seconds(unit(1000))
    assert seconds(unit(64000)) <= 6 * seconds(unit(16000)) + 1


def test_chunk_number_time_is_in_proportion(spark):
    def cut(n):
        doc = [("d", "\n".join(f"w{i % 97} b{i % 13} c" for i in range(n)))]
        docs = spark.createDataFrame(doc, "title string, text string")
        return chunking.semantic_chunk(docs, number_of_chunks=7, sentence_split_regex="\n")

    seconds(cut(500))
    assert seconds(cut(16000)) <= 6 * seconds(cut(4000)) + 1


def test_fold_of_ligatures_marks_and_combining_accents(spark):
    text = "\ufb01 \ufb02 \u1e9e \u2122 \u2022 \u20ac \u00bd \u2011 e\u0301 \u00e9 \u00df \uff21 \u2163 \u6771"
    got = spark.createDataFrame([(text,)], "t string").select(ascii_fold(F.col("t"))).first()[0]
    assert got == "fi fl SS TM * EUR 1/2 - e e ss A IV \u6771"


def test_hash_embedder_counts_words_of_folded_texts_in_tasks(spark):
    """Folding, splitting and hashing of a text are one pass over Arrow batches, with the counts of the expressions."""
    texts = ["Straße — ÉTÉ œuvre x1 x1", "", "... ", None, "Ж ﬁn ½ İstanbul \u212a9", "e\u0301a " * 500]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    tokens = F.filter(F.split(F.lower(ascii_fold(F.col("text"))), "[^a-z0-9]+", -1), lambda w: w != "")
    wanted = rows.select("i", tokens.alias("words"))
    got = rows.select("i", HashEmbedder(64).counts(F.col("text")).alias("n"), HashEmbedder(64).embed(F.col("text")).alias("v"))
    assert "ArrowEvalPython" in got._jdf.queryExecution().toString()
    for row in got.join(wanted, "i").collect():
        if row["words"] is None:
            assert row["n"] == [None] * 64
            continue
        counts = np.zeros(64)
        for word in row["words"]:
            counts[int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % 64] += 1
        assert row["n"] == counts.tolist()
        assert row["v"] == [x / max(np.sqrt((counts**2).sum()), 1e-12) for x in counts]


def test_fold_text_is_ascii_fold(spark):
    texts = ["a" + chr(c) + "B" for c in [*range(1, 0x0600), *range(0x1D00, 0x2300), *range(0xFB00, 0xFB10), *range(0xFF00, 0xFFF0)]]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", ascii_fold(F.col("t")).alias("f")).collect()
    assert [r["f"] for r in rows] == [fold_text(r["t"]) for r in rows]


def test_units_of_a_document_are_neither_sorted_nor_exchanged(spark):
    """Distances, thresholds and chunks work on arrays of the one row of a title; vectors stay in the Arrow batch."""
    table = docs(spark, "\n".join(LINES), "x y\nz")
    for cut in (
        chunking.semantic_chunk(table, sentence_split_regex="\n"),
        chunking.measure_units(table, chunking.Breakpoints(), split_regex="\n"),
    ):
        plan = cut._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and plan.count("ArrowEvalPython") == 1
        assert "Window" not in plan


def test_blocks_of_pages_are_arrays(spark):
    units = spark.createDataFrame([("t", i, line) for i, line in enumerate(LINES)], "title string, idx long, sentence string")
    cut = longform.block_distances(units, chunking.Breakpoints(), block=3)
    assert "Window" not in cut._jdf.queryExecution().executedPlan().toString()
    whole = measured(spark, LINES)
    assert [r["metric"] for r in cut.orderBy("idx").collect()] == [r["metric"] for r in whole]


@pytest.mark.parametrize("buffer_size", [0, 1, 3])
def test_distances_over_slices_and_lists(monkeypatch, buffer_size):
    """Slices of five texts, lists of many lengths, texts that are null, a batch that is a part of another."""
    monkeypatch.setattr(embedders, "SLICE_TEXTS", 5)
    draw = random.Random(buffer_size)
    lists = [[draw.choice(["a b", "b", "c d d", "", "É e", None]) for _ in range(n)] for n in (4, 0, 1, 17, 2, 5, 11)]
    texts, ends = pa.array(sum(lists, []), pa.string()), np.cumsum([0, *map(len, lists)])
    buckets = embedders._Buckets(64)
    got = embedders._window_distances(texts, ends, buffer_size, buckets).to_pylist()
    want = []
    for texts_of_one in lists:
        counts = embedders._word_counts([t or "" for t in texts_of_one], buckets) if texts_of_one else []
        for i, text in enumerate(texts_of_one):
            if i + 1 == len(texts_of_one) or text is None or texts_of_one[i + 1] is None:
                want.append(None)
                continue
            a, b = (counts[max(k - buffer_size, 0) : k + buffer_size + 1].sum(axis=0) for k in (i, i + 1))
            scale = np.sqrt(a @ a) * np.sqrt(b @ b)
            want.append(1.0 - (a @ b / scale if scale else 0.0))
    assert got == want


def test_rows_of_one_title_meet(spark):
    """Units of both rows are ordered by their number in the row; a row without text adds none."""
    rows = [("t", "z", "a\nb\nc"), ("t", "z", "a\nb\nc"), ("t", "z", None), ("u", "z", None)]
    table = spark.createDataFrame(rows, "title string, zip_name string, text string")
    units = chunking.measure_units(table, chunking.Breakpoints(), split_regex="\n").orderBy("idx").collect()
    assert [(r["idx"], r["n_units"], r["sentence"]) for r in units] == [(i, 3, x) for i, x in enumerate("abc") for _ in "12"]
    assert sum(r["distance"] is None for r in units) == 1
    chunks = chunking.semantic_chunk(table, sentence_split_regex="\n").orderBy("chunk_idx").collect()
    assert " ".join(r["chunk"] for r in chunks) == "a a b b c c" and {r["zip_name"] for r in chunks} == {"z"}
