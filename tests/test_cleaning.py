"""Hand-worked cases of the cleaning rules."""

from __future__ import annotations

import unicodedata

import pytest
from pyspark.sql import functions as F

from quirefold import schemas
from quirefold.functions.text import NAMED_RANGES, ascii_fold, line_lengths, lines
from quirefold.operators import cleaning

PHONE = "call + 1 212 555 0100"
DISCLAIMER = "This document and all of the information contained in it is private"


def pages(spark, *texts, doc="d.pdf"):
    return spark.createDataFrame([(doc, i, t) for i, t in enumerate(texts)], schemas.PAGES)


def sized(*lengths):
    return "\n".join("x" * n for n in lengths)


def header(spark, *texts):
    row = cleaning.common_headers(pages(spark, *texts)).first()
    return row["common_index"], row["common_lengths"]


def body(spark, *texts):
    """Body pages numbered from 0, as if headers were gone."""
    rows = [("d.pdf", i + 1, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, schemas.PAGES).withColumn("last_page", F.lit(len(texts)))


def kept(spark, *texts):
    rows = cleaning.drop_boilerplate(body(spark, *texts)).orderBy("p1").collect()
    return [r["text"] for r in rows]


@pytest.mark.parametrize(
    "text",
    ["", "a", "a\n", "a\n\nb", "\n", "a\r\nb\rc", "a\x0bb\x0cc\x1cd\x1de\x1ef\x85g h i", "\r\n\r\n", "a\x1fb"],
)
def test_lines_are_python_lines(spark, text):
    row = spark.createDataFrame([(text,)], "t string").select(
        lines(F.col("t")).alias("a"), line_lengths(F.col("t")).alias("n")
    ).first()
    assert row["a"] == text.splitlines()
    assert row["n"] == [len(x) for x in text.splitlines()]


def test_header_ends_at_first_different_length(spark):
    assert header(spark, "cover", sized(10, 6, 40), sized(10, 6, 33), sized(10, 6, 12)) == (2, [10, 6])


def test_no_difference_means_no_header(spark):
    assert header(spark, "cover", sized(10, 6), sized(10, 6)) == (0, [])
    assert header(spark, "cover", sized(10, 6)) == (0, [])
    assert header(spark, "cover only") == (0, [])


def test_short_sampled_page_counts_as_difference(spark):
    assert header(spark, "cover", sized(10, 6, 4), sized(10, 6)) == (2, [10, 6])


def test_only_first_pages_are_sampled(spark):
    same = [sized(10, 6, 4 + i) for i in range(5)]
    assert header(spark, "cover", *same, sized(3)) == (2, [10, 6])


def strip(spark, page_num, text):
    """One page against the reference header [10, 6]."""
    texts = ["cover", *[sized(10, 6, 20 + i) for i in range(page_num - 1)], text]
    rows = cleaning.strip_common_headers(pages(spark, *texts)).where(F.col("page_num") == page_num).collect()
    return [len(x) for x in rows[0]["text"].split("\n")]


def test_page_number_growth_is_tolerated(spark):
    assert strip(spark, 11, sized(10, 7, 30)) == [30]


def test_growth_beyond_the_digits_cuts(spark):
    assert strip(spark, 7, sized(10, 7, 30)) == [7, 30]
    assert strip(spark, 11, sized(10, 8, 30)) == [8, 30]


def test_short_header_line_cuts(spark):
    assert strip(spark, 7, sized(10, 5, 30)) == [5, 30]
    assert strip(spark, 7, sized(9, 6, 30)) == [9, 6, 30]


def test_page_shorter_than_header_becomes_empty(spark):
    assert strip(spark, 7, sized(10)) == [0]


def test_contacts_first_equal_page_goes(spark):
    assert kept(spark, "a", PHONE, "b", PHONE, "c") == ["a", "b", PHONE, "c"]


def test_last_contacts_page_decides(spark):
    assert kept(spark, "a", PHONE, "b", PHONE + " x", "c") == ["a", PHONE, "b", "c"]


def test_disclaimer_cuts_the_tail(spark):
    assert kept(spark, "a", "b", "c", DISCLAIMER, "d") == ["a", "b", "c"]


def test_early_disclaimer_stays(spark):
    assert kept(spark, "a", DISCLAIMER, "b", "c", "d", "e") == ["a", DISCLAIMER, "b", "c", "d", "e"]


def test_first_page_disclaimer_never_cuts(spark):
    assert kept(spark, DISCLAIMER, "b") == [DISCLAIMER, "b"]


def test_contacts_before_disclaimer_leaves_the_disclaimer_page(spark):
    assert kept(spark, "a", "b", "c", PHONE, "d", DISCLAIMER) == ["a", "b", "c", "d", DISCLAIMER]


def numbered(first, n=20):
    return [first, *[f"page body x{'i' * i}" for i in range(n - 1)]]


@pytest.mark.parametrize(
    ("line", "left"),
    [("Overview 3", 19), ("Overview 9", 20), ("Overview 5", 17), ("Overview 1", 1), ("Overview 0", 2), ("Overview 2", 20)],
)
def test_contents_line(spark, line, left):
    assert len(kept(spark, *numbered(line))) == left


def test_contents_number_of_any_size(spark):
    assert len(kept(spark, *numbered("Overview 99999999999999999999999"))) == 20


def test_contents_line_moves_up_when_contacts_page_was_first(spark):
    assert kept(spark, PHONE, "Overview 3", "a", "b") == ["a", "b"]


def test_document_without_remaining_pages_is_empty_text(spark):
    marked = cleaning.mark_boilerplate(body(spark, PHONE))
    assert [tuple(r) for r in cleaning.merge_pages(marked).collect()] == [("d.pdf", "")]


def test_documents_do_not_mix(spark):
    both = pages(spark, "cover", "a\nx", "b\nyy").union(pages(spark, "cover", "c\nx", "d\nyy", doc="e.pdf"))
    rows = {r["doc"]: r["text"] for r in cleaning.clean_documents(both).collect()}
    assert rows == {"d.pdf": "x\nyy", "e.pdf": "x\nyy"}


def test_fold(spark):
    text = "ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöü Łódź “œuvre” – naïve… plain"
    row = spark.createDataFrame([(text,)], "t string").select(ascii_fold(F.col("t"))).first()
    assert row[0] == 'ACEEEINOOUssaceeeinoou Lodz "oeuvre" - naive... plain'


def test_fold_of_greek_and_cyrillic(spark):
    """Every letter of the named ranges is spelt in ASCII; words come out in their usual spelling."""
    words = {
        "Щука ждёт юг": "Shchuka zhdet yug", "объём и день": "ob\"em i den'", "Київ": "Kiiv", "Љубљана Џеп": "Ljubljana Dzhep",
        "Ψυχή φως ρόδος": "Psukhe phos rodos", "ΘΕΟΣ Ἀθῆναι": "ThEOS Athenai", "東京 naïve": "東京 naive",
    }
    df = spark.createDataFrame(list(words.items()), "t string, want string").select(ascii_fold(F.col("t")).alias("got"), "want")
    assert all(r["got"] == r["want"] for r in df.collect()), df.collect()
    letters = "".join(chr(c) for low, high in NAMED_RANGES for c in range(low, high) if unicodedata.category(chr(c))[0] == "L")
    got = spark.createDataFrame([(letters,)], "t string").select(ascii_fold(F.col("t"))).first()[0]
    assert got.isascii() and len(got) > len(letters)
