"""Cleaning of paged documents: repeated headers, contact pages, disclaimers, contents pages.

Input is one row per page, `(doc, page_num, text)`, with page 0 as the cover. Per-document facts are
plain aggregates with a small state, and they come back to the pages block by block, so a document
may have any number of pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quirefold.functions.text import SPACE, ascii_fold, line_lengths, lines
from quirefold.operators.ordering import attach_facts

# Fixed values.
CONTACTS_PATTERN = r"\+ 1 \p{Nd}{3} \p{Nd}{3} \p{Nd}{4}"
DISCLAIMER_PATTERN = "This document and all of the information contained in it"
CONTENTS_PATTERN = rf"(\p{{Nd}}+){SPACE}*$"


def drop_cover(pages: DataFrame) -> DataFrame:
    return pages.where(F.col("page_num") >= 1)


def common_headers(pages: DataFrame, sample_pages: int = 5) -> DataFrame:
    """One row per document: `common_index`, `common_lengths`, and `last_page`.

    The header ends at the first line whose length differs between the sampled pages. Without any
    difference inside the first sampled page there is no header. A sampled page that has fewer lines
    counts as a difference. Only line lengths of the sampled pages are grouped, never texts.
    """
    sampled = pages.where(F.col("page_num").between(1, sample_pages)).select(
        "doc", "page_num", F.posexplode_outer(line_lengths(F.col("text"))).alias("i", "len")
    )
    per_line = sampled.groupBy("doc", "i").agg(
        F.count("*").alias("n"),
        F.min("len").alias("lo"),
        F.max("len").alias("hi"),
        F.max(F.when(F.col("page_num") == 1, F.col("len"))).alias("first"),
    )
    per_doc = per_line.groupBy("doc").agg(
        # each sampled page has one row at line 0, or one row without a line
        F.sum(F.when(F.coalesce("i", F.lit(0)) == 0, F.col("n"))).alias("n_pages"),
        F.array_sort(
            F.collect_list(F.when(F.col("first").isNotNull(), F.struct("i", "first", "lo", "hi", "n")))
        ).alias("page_1"),
    )
    differing = F.filter("page_1", lambda x: (x["lo"] != x["hi"]) | (x["n"] < F.col("n_pages")))
    prefix = F.filter("page_1", lambda x: x["i"] < F.col("common_index"))
    headers = per_doc.withColumn("common_index", F.coalesce(F.get(differing, F.lit(0))["i"], F.lit(0))).select(
        "doc", "common_index", F.transform(prefix, lambda x: x["first"]).alias("common_lengths")
    )
    last = pages.groupBy("doc").agg(F.max("page_num").alias("last_page"))
    return last.join(headers, "doc", "left").select(
        "doc",
        "last_page",
        F.coalesce("common_index", F.lit(0)).alias("common_index"),
        F.coalesce("common_lengths", F.array().cast("array<int>")).alias("common_lengths"),
    )


def strip_common_headers(pages: DataFrame, sample_pages: int = 5) -> DataFrame:
    """Pages without the cover and without the common header; keeps `last_page` for later steps.

    Where the line lengths of a page differ from the header, the header ends at the first line that
    is shorter, or longer by at least as many characters as the page number has digits.
    """
    body = attach_facts(drop_cover(pages), common_headers(pages, sample_pages), "doc", "page_num", "last_page")
    body = body.withColumn("_lines", lines(F.col("text")))
    head_lengths = F.transform(F.slice("_lines", F.lit(1), F.col("common_index")), F.length)
    excess = F.zip_with(
        head_lengths, F.slice("common_lengths", F.lit(1), F.size(head_lengths)), lambda here, common: here - common
    )
    digits = F.length((F.col("page_num") + 1).cast("string"))
    first_off = F.array_position(F.transform(excess, lambda x: (x >= digits) | (x < 0)), True)
    cut = F.when(first_off > 0, first_off.cast("int") - 1).otherwise(F.col("common_index"))
    return body.select(
        "doc",
        "page_num",
        F.array_join(F.slice("_lines", cut + 1, F.size("_lines") + 1), "\n").alias("text"),
        "last_page",
        "_block",
    )


def boilerplate_facts(
    body: DataFrame,
    contacts_pattern: str = CONTACTS_PATTERN,
    disclaimer_pattern: str = DISCLAIMER_PATTERN,
    disclaimer_tail: int = 3,
    toc_divisor: int = 10,
) -> DataFrame:
    """One row per document with everything that decides which pages stay.

    Page positions: `p0` counts from the first page after the cover; `p1` counts again after the
    contacts page is removed. The disclaimer position is a `p0`, yet it cuts in terms of `p1`, so a
    contacts page in front of the disclaimer leaves the disclaimer page in place.

    One pass: pages that match the contacts pattern are grouped by their text (the page to remove is
    the first one equal to the last match), all others fall in one group per document.
    """
    p0 = F.col("page_num") - 1
    text = F.col("text")
    contents_line = F.get(F.filter(F.split(text, "\n", -1), lambda x: x.rlike(CONTENTS_PATTERN)), F.lit(0))
    number = F.regexp_extract(contents_line, CONTENTS_PATTERN, 1)
    # a number that does not fit is larger than any page count
    toc = F.when(contents_line.isNotNull(), F.coalesce(number.try_cast("long"), F.lit(2**62)))
    by_text = (
        body.withColumn("_contacts", F.when(text.rlike(contacts_pattern), text))
        .groupBy("doc", "_contacts")
        .agg(
            F.count("*").alias("n"),
            F.sum(F.length("text")).alias("n_chars"),
            F.min(p0).alias("first"),
            F.max(p0).alias("last"),
            F.max(F.when(text.rlike(disclaimer_pattern), p0)).alias("disclaimer"),
            F.max(F.when(p0 == 0, toc)).alias("toc_0"),
            F.max(F.when(p0 == 1, toc)).alias("toc_1"),
        )
    )
    has_contacts = F.col("_contacts").isNotNull()
    facts = by_text.groupBy("doc").agg(
        F.sum("n").alias("n_pages"),
        F.sum("n_chars").alias("n_chars"),
        F.max_by(F.when(has_contacts, F.col("first")), F.when(has_contacts, F.col("last"))).alias("contacts"),
        F.max("disclaimer").alias("disclaimer"),
        F.max("toc_0").alias("toc_0"),
        F.max("toc_1").alias("toc_1"),
    )
    n_left = F.col("n_pages") - F.when(F.col("contacts").isNotNull(), 1).otherwise(0)
    cuts = (F.col("disclaimer") > 0) & (F.col("disclaimer") >= F.col("n_left") - disclaimer_tail)
    start = F.when(F.col("contacts") == 0, F.col("toc_1")).otherwise(F.col("toc_0")) - 2
    start = F.coalesce(F.when(start <= F.floor(F.col("n_kept") / toc_divisor) + 1, start), F.lit(0))
    return (
        facts.withColumn("n_left", n_left)
        .withColumn("n_kept", F.when(cuts, F.least("n_left", "disclaimer")).otherwise(F.col("n_left")))
        .withColumn("start", start)
        .select(
            "doc",
            "n_pages",
            "n_chars",
            "contacts",
            "disclaimer",
            "n_left",
            "n_kept",
            # a start below zero counts from the end
            F.when(F.col("start") < 0, F.greatest(F.col("n_kept") + F.col("start"), F.lit(0)))
            .otherwise(F.col("start"))
            .alias("start_page"),
        )
    )


def mark_boilerplate(body: DataFrame, **options) -> DataFrame:
    """Body pages with the facts of their document, `p1` (null on the contacts page) and `keep`."""
    facts = boilerplate_facts(body, **options)
    marked = attach_facts(body, facts.withColumn("_last", F.col("n_pages")), "doc", "page_num", "_last")
    p0 = F.col("page_num") - 1
    p1 = F.when(F.col("contacts").isNull() | (p0 < F.col("contacts")), p0).when(p0 > F.col("contacts"), p0 - 1)
    return (
        marked.withColumn("p1", p1)
        .withColumn("keep", F.coalesce((p1 >= F.col("start_page")) & (p1 < F.col("n_kept")), F.lit(False)))
        .drop("_last", "_block")
    )


def remove_contacts_page(marked: DataFrame) -> DataFrame:
    return marked.where(F.col("p1").isNotNull())


def truncate_disclaimer(marked: DataFrame) -> DataFrame:
    return marked.where(F.col("p1") < F.col("n_kept"))


def drop_boilerplate(body: DataFrame, **options) -> DataFrame:
    """Pages that survive the contacts, disclaimer and contents rules, numbered by `p1`."""
    return mark_boilerplate(body, **options).where("keep").select("doc", "p1", "text")


def merge_pages(marked: DataFrame, separator: str = "\n", fold: bool = True) -> DataFrame:
    """One text per document, `(doc, text)`; a document that loses all pages has an empty text.

    The result is one value per document, which bounds its use to documents that fit in a value.
    `operators.longform` cuts units from pages directly and has no such bound.
    """
    kept = F.collect_list(F.when(F.col("keep"), F.struct("p1", "text")))
    text = F.array_join(F.transform(F.array_sort(kept), lambda x: x["text"]), separator)
    docs = marked.groupBy("doc").agg(text.alias("text"))
    return docs.withColumn("text", ascii_fold(F.col("text"))) if fold else docs


def title_of(name: Column) -> Column:
    """Document title: the file name up to its first dot."""
    return F.split_part(name, F.lit("."), F.lit(1))


def clean_pages(pages: DataFrame, sample_pages: int = 5, **options) -> DataFrame:
    """Header stripping and boilerplate rules in one go: marked pages."""
    return mark_boilerplate(strip_common_headers(pages, sample_pages), **options)


def clean_documents(pages: DataFrame, separator: str = "\n", fold: bool = True, **options) -> DataFrame:
    """Paged documents to cleaned texts, `(doc, text)`."""
    return merge_pages(clean_pages(pages, **options), separator, fold)
