"""The driver tables seen as inputs of the operators: documents, pages, files, questions, store.

Every view covers its whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quirefold.functions.embedders import HashEmbedder
from quirefold.operators.chunking import COMPARED_DIGITS, drop_blank_chunks, semantic_chunk
from quirefold.operators.retrieval import beside_each, embed_questions
from quirefold.sources.files import questions_of

PAGE_LINES = 3
UNIT_REGEX = "\n"
UNIT_WORDS = 50
PERCENTILE = 85

PHONE_LINE = "Call + 1 212 555 0100"
DISCLAIMER_LINE = "This document and all of the information contained in it is provided as is."


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(
        F.concat(F.lit("doc"), "doc_id").alias("title"), F.col("source").alias("zip_name"), "text"
    )


def document_files(spark: SparkSession, folder: str) -> DataFrame:
    """File names as a folder might hold them: most are `.pdf`, English ones `.PDF`, Spanish ones `.txt`."""
    extension = F.when(F.col("lang") == "en", ".PDF").when(F.col("lang") == "es", ".txt").otherwise(".pdf")
    return table(spark, folder, "documents").select(
        F.col("source").alias("folder"), F.concat(F.lit("doc"), "doc_id", extension).alias("name")
    )


def document_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Documents cut into pages of three lines behind a cover, with a header and boilerplate lines by language."""
    lang = F.col("lang")
    body = F.split("text", "\n", -1)
    docs = table(spark, folder, "documents").select(
        F.concat(F.lit("doc"), "doc_id").alias("title"),
        "source",
        "lang",
        body.alias("lines"),
        F.ceil(F.size(body) / PAGE_LINES).cast("int").alias("n"),
    )
    pages = docs.select("*", F.explode(F.sequence(F.lit(0), F.col("n"))).alias("page_num"))
    p, n = F.col("page_num"), F.col("n")
    header = F.when((lang == "es") & (p > 5), F.concat(F.lit("HD "), "source")).otherwise(
        F.concat(F.lit("HEADER "), "source")
    )
    number = F.when((lang == "de") & (p > 5), F.concat(F.lit("Page number "), p)).otherwise(
        F.concat(F.lit("Page "), p)
    )
    contents = F.when(
        p == 1,
        F.when(lang.isin("en", "fr"), "Contents 3").when(lang == "de", "Contents 9").otherwise("Contents 1"),
    )
    phone = F.when(((lang == "en") & (p == n - 1)) | ((lang == "de") & (p == 1)), PHONE_LINE)
    disclaimer = F.when(((lang == "en") & (p == n)) | ((lang == "fr") & (p == n - 1)), DISCLAIMER_LINE)
    text = F.concat_ws(
        "\n", header, number, contents, F.slice("lines", (p - 1) * PAGE_LINES + 1, F.lit(PAGE_LINES)), phone, disclaimer
    )
    return pages.select(
        F.concat("title", F.lit(".pdf")).alias("doc"),
        "page_num",
        F.when(p == 0, F.concat(F.lit("COVER "), "title")).otherwise(text).alias("text"),
    )


def questions(spark: SparkSession, folder: str) -> DataFrame:
    return questions_of(table(spark, folder, "benchmark"), "item_id")


def question_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return embed_questions(questions(spark, folder), HashEmbedder())


def label_store(spark: SparkSession, folder: str) -> DataFrame:
    """Every document as a chunk of a store; vector and title are those of the embedding of its number, in turn."""
    vectors = table(spark, folder, "embeddings").select("vec_id", "label", "embedding")
    docs = table(spark, folder, "documents").select(
        "doc_id", "text", "source", F.pmod("doc_id", F.lit(vectors.count())).alias("vec_id")
    )
    return docs.join(vectors, "vec_id").select(
        F.concat(F.lit("v"), "doc_id").alias("id"),
        F.coalesce("text", F.lit("")).alias("chunk"),
        F.concat(F.lit("label"), "label").alias("title"),
        F.coalesce("source", F.lit("")).alias("zip_name"),
        "embedding",
    )


def document_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Every document as one stored chunk under its own title."""
    return documents(spark, folder).select(
        F.concat("title", F.lit("-0")).alias("id"), F.col("text").alias("chunk"), "title", "zip_name",
        F.array(F.lit(1.0)).alias("embedding"),
    )


def chunks(spark: SparkSession, folder: str, **options) -> DataFrame:
    """Chunks of `documents`, blank ones dropped."""
    options = {"breakpoint_threshold_amount": PERCENTILE, "digits": COMPARED_DIGITS} | options
    cut = semantic_chunk(
        documents(spark, folder), sentence_split_regex=UNIT_REGEX, max_words=UNIT_WORDS, **options
    )
    return drop_blank_chunks(cut)


def answered(spark: SparkSession, folder: str) -> DataFrame:
    """Responses written out by rule for every (title, question): all forms a model may reply in."""
    forms = F.array(
        F.lit("Answer: one and three.\nSource Chunks: 1, 3."),
        F.lit("Answer: nothing found.\nSource Chunks: None."),
        F.lit("Answer: the last.\nSource Chunks: 0."),
        F.lit("Answer: out of range.\nSource Chunks: 2, 99."),
        F.lit("Answer: twice.\nSource Chunks: 2,2. Source Chunks: 1."),
        F.lit("Answer: bad token.\nSource Chunks: 1, x."),
        F.lit("Answer: no marker."),
    )
    vectors = table(spark, folder, "embeddings")
    titles = vectors.select(F.concat(F.lit("label"), "label").alias("title"), "label").distinct()
    return beside_each(titles, questions(spark, folder)).select(
        "title",
        "q.q_idx",
        "q.question",
        F.get(forms, (F.col("q.q_idx") + F.col("label")) % 7).alias("response"),
    )

