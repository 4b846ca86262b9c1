"""Registered queries: one per operator, each over whole driver tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from quirefold.functions import text as tx
from quirefold.functions.embedders import HashEmbedder
from quirefold.functions.vectors import l2_normalize, round_to
from quirefold.operators import answering, chunking, cleaning, identity, longform, ordering, retrieval, splitting
from quirefold.operators.signatures import signature_table
from quirefold.plans import tables
from quirefold.plans.comparison import add_documents, add_pages, compare_documents, compare_stored
from quirefold.session import scratch_path, stage
from quirefold.sources import files, store as stores
from quirefold.sources.archives import TextArchives

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _sparse(df: DataFrame, keys: list[str], vector) -> DataFrame:
    """Non-zero entries of a vector column, one row per dimension."""
    return (
        df.select(*keys, F.posexplode(vector).alias("dim", "value"))
        .where(F.col("value") != 0)
        .withColumn("value", round_to(F.col("value"), 6))
    )


# --- scans, files, folders -------------------------------------------------------------------------


@query
def scan_pages(spark, folder):
    return tables.document_pages(spark, folder)


@query
def scan_text(spark, folder):
    """Writes every document as a text file of its own, title first, then reads the folder back."""
    path = scratch_path(spark, "texts")
    docs = tables.documents(spark, folder)
    value = F.concat_ws("\r\n", "title", F.replace("text", F.lit("\n"), F.lit("\r\n")))
    files.write_texts(docs.select(value.alias("value")), path)
    back = files.read_texts(spark, path).select(F.split("text", "\n", 2).alias("parts"))
    return back.select(
        F.get("parts", F.lit(0)).alias("title"), F.regexp_replace(F.get("parts", F.lit(1)), "\n$", "").alias("text")
    )


@query
def scan_text_folders(spark, folder):
    """One folder of text files per source; the reader names the folder of every file, and its title by its name."""
    path = scratch_path(spark, "folders")
    docs = tables.table(spark, folder, "documents").select("source", F.coalesce("text", F.lit("")).alias("value"))
    files.write_texts(docs, path, by="source")
    back = files.read_texts(spark, f"{path}/*")
    return back.groupBy("zip_name").agg(
        F.count("*").alias("n_files"), F.bool_and(F.col("title").startswith("part-")).alias("named")
    )


@query
def scan_archives(spark, folder):
    """Every document as a member of a zip archive, in a folder of its source; the archives are read in slices."""
    path = scratch_path(spark, "archives")
    spark.dataSource.register(TextArchives)
    docs = tables.documents(spark, folder).withColumn("zip_name", F.coalesce("zip_name", F.lit("none")))
    docs.repartition("title").write.format("text_archives").mode("append").save(path)
    return spark.read.format("text_archives").option("sliceBytes", 1 << 20).load(path)


@query
def title_from_path(spark, folder):
    pages = tables.table(spark, folder, "pages")
    return pages.select(
        "page_id",
        files.title_from_path(F.col("url")).alias("title"),
        files.folder_from_path(F.col("url")).alias("zip_name"),
    )


@query
def sink_docs(spark, folder):
    path = scratch_path(spark, "docs")
    files.write_documents(cleaning.clean_documents(tables.document_pages(spark, folder)), path)
    return spark.read.parquet(path)


@query
def chunks_jsonl_roundtrip(spark, folder):
    path = scratch_path(spark, "chunks")
    files.write_stage(tables.chunks(spark, folder), path)
    return files.read_chunks(spark, path)


@query
def embeddings_jsonl_roundtrip(spark, folder):
    path = scratch_path(spark, "embedded")
    files.write_stage(
        tables.label_store(spark, folder).select(
            "title", "zip_name", F.substring("id", 2, 18).cast("int").alias("chunk_idx"), "chunk", "embedding"
        ),
        path,
    )
    back = files.read_embedded_chunks(spark, path)
    entries = F.transform("embedding", lambda x: F.format_string("%.5f", x.cast("double") + F.lit(0.0)))
    return back.select("title", "zip_name", "chunk_idx", "chunk", F.array_join(entries, ",").alias("embedding"))


@query
def questions_second_column(spark, folder):
    return tables.questions(spark, folder)


@query
def sink_comparison(spark, folder):
    path = scratch_path(spark, "comparison")
    files.write_comparison(comparison_table(spark, folder), path)
    return files.read_comparison(spark, path)


@query
def comparison_sheets(spark, folder):
    """All answers in sheets of three titles, read back as one row per title and question."""
    path, parts = scratch_path(spark, "sheets"), []
    for row in files.write_sheets(_answers(spark, folder), path, 3).collect():
        sheet = files.read_sheet(spark, path, row["sheet"])
        titles = [c.removesuffix("-response") for c in sheet.columns if c.endswith("-response")]
        cells = F.array(*[
            F.struct(F.lit(t).alias("title"), F.col(f"`{t}-response`").alias("response"), F.col(f"`{t}-source_chunks`").alias("source_chunks"))
            for t in titles
        ])
        parts.append(sheet.select(F.lit(row["sheet"]).cast("long").alias("sheet"), "q_idx", "question", F.inline(cells)))
    return reduce(DataFrame.unionByName, parts)


@query
def filter_extension(spark, folder):
    return files.pdf_names(tables.document_files(spark, folder))


@query
def ingest_guard(spark, folder):
    return files.ingest_guard(tables.document_files(spark, folder))


@query
def folder_up_to_date(spark, folder):
    """Processed names are those of documents with a label, so some folders match and most do not."""
    source = tables.document_files(spark, folder)
    labelled = tables.table(spark, folder, "labels").select(F.concat(F.lit("doc"), "doc_id").alias("title"))
    processed = source.withColumn("title", cleaning.title_of(F.col("name"))).join(labelled, "title", "left_semi")
    return files.folder_up_to_date(
        source, processed.select("folder", files.text_name(F.col("name")).alias("name"))
    )


# --- cleaning --------------------------------------------------------------------------------------


@query
def drop_cover(spark, folder):
    return cleaning.drop_cover(tables.document_pages(spark, folder))


@query
def page_line_lengths(spark, folder):
    pages = tables.document_pages(spark, folder)
    return pages.select(
        "doc", "page_num", F.posexplode(tx.line_lengths(F.col("text"))).alias("line_idx", "line_len")
    )


@query
def common_header(spark, folder):
    headers = cleaning.common_headers(tables.document_pages(spark, folder))
    return headers.select("doc", "common_index", F.array_join("common_lengths", ",").alias("common_lengths"))


@query
def strip_headers(spark, folder):
    return cleaning.strip_common_headers(tables.document_pages(spark, folder)).select("doc", "page_num", "text")


@query
def remove_contacts_page(spark, folder):
    marked = cleaning.clean_pages(tables.document_pages(spark, folder))
    return cleaning.remove_contacts_page(marked).select("doc", "p1", "text")


@query
def truncate_disclaimer(spark, folder):
    marked = cleaning.clean_pages(tables.document_pages(spark, folder))
    return cleaning.truncate_disclaimer(marked).select("doc", "p1", "text")


@query
def toc_start_page(spark, folder):
    facts = cleaning.boilerplate_facts(cleaning.strip_common_headers(tables.document_pages(spark, folder)))
    return facts.select("doc", "n_kept", "start_page")


@query
def drop_boilerplate(spark, folder):
    return cleaning.drop_boilerplate(cleaning.strip_common_headers(tables.document_pages(spark, folder)))


@query
def merge_pages(spark, folder):
    return cleaning.clean_documents(tables.document_pages(spark, folder), fold=False)


@query
def ascii_fold(spark, folder):
    return tables.documents(spark, folder).select("title", tx.ascii_fold(F.col("text")).alias("text"))


# --- splitting and chunking ------------------------------------------------------------------------


@query
def split_paragraphs(spark, folder):
    docs = tables.documents(spark, folder)
    return docs.select(
        "title", F.posexplode_outer(F.split("text", tables.UNIT_REGEX, -1)).alias("idx", "sentence")
    )


@query
def split_punctuation(spark, folder):
    docs = tables.documents(spark, folder)
    return docs.select("title", F.posexplode(tx.split_sentences(F.col("text"))).alias("idx", "sentence"))


@query
def word_count(spark, folder):
    return tables.documents(spark, folder).select("title", tx.word_count(F.col("text")).alias("n_words"))


def _units(spark, folder):
    return splitting.split_units(tables.documents(spark, folder), tables.UNIT_REGEX, tables.UNIT_WORDS)


@query
def pack_large_units(spark, folder):
    return _units(spark, folder).select("title", "n_units", "idx", "sentence")


@query
def combine_window(spark, folder):
    docs = tables.documents(spark, folder).repartition("title")
    units = splitting.split_units(docs, tables.UNIT_REGEX, tables.UNIT_WORDS)
    return splitting.combine_window(units).select("title", "idx", "combined")


@query
def hash_embed_units(spark, folder):
    return _sparse(_units(spark, folder), ["title", "idx"], HashEmbedder().counts(F.col("sentence")))


@query
def l2_normalize_vectors(spark, folder):
    vectors = tables.table(spark, folder, "embeddings")
    doubled = F.transform("embedding", lambda x: x.cast("double") * 3)
    return _sparse(vectors, ["vec_id"], l2_normalize(doubled))


def _measured(spark, folder, kind="percentile", amount=None, number_of_chunks=None):
    return chunking.measure_units(
        tables.documents(spark, folder),
        chunking.Breakpoints(kind, amount, number_of_chunks, chunking.COMPARED_DIGITS),
        split_regex=tables.UNIT_REGEX,
        max_words=tables.UNIT_WORDS,
    )


@query
def adjacent_distance(spark, folder):
    return _measured(spark, folder).select("title", "idx", "distance")


def _threshold(name: str, *options):
    def run(spark, folder):
        units = _measured(spark, folder, *options)
        return units.groupBy("title").agg(
            F.first("threshold").alias("threshold"), F.count_if("is_break").alias("n_breaks")
        )

    run.__name__ = name
    return query(run)


_threshold("threshold_percentile", "percentile", tables.PERCENTILE)
_threshold("threshold_stddev", "standard_deviation", 1.0)
_threshold("threshold_iqr", "interquartile", 0.5)
_threshold("threshold_gradient", "gradient", tables.PERCENTILE)
_threshold("threshold_n_chunks", "percentile", None, 4)


@query
def short_doc_bypass(spark, folder):
    """Documents of one or two units under the gradient rule: every unit is a chunk."""
    units = _measured(spark, folder, "gradient")
    return units.where(F.col("n_units") <= 2).select("title", "idx", "n_units", "is_break")


@query
def semantic_chunks(spark, folder):
    return tables.chunks(spark, folder)


def _chunks(name: str, **options):
    def run(spark, folder):
        return tables.chunks(spark, folder, **options)

    run.__name__ = name
    return query(run)


_chunks("semantic_chunks_stddev", breakpoint_threshold_type="standard_deviation", breakpoint_threshold_amount=1.0)
_chunks("semantic_chunks_iqr", breakpoint_threshold_type="interquartile", breakpoint_threshold_amount=0.5)
_chunks("semantic_chunks_gradient", breakpoint_threshold_type="gradient")
_chunks("semantic_chunks_n", number_of_chunks=4)


def _chunks_of_pages(name: str, **options):
    def run(spark, folder):
        marked = cleaning.clean_pages(tables.document_pages(spark, folder))
        cut = longform.semantic_chunk_pages(
            longform.kept_pages(marked),
            sentence_split_regex=tables.UNIT_REGEX,
            max_words=tables.UNIT_WORDS,
            digits=chunking.COMPARED_DIGITS,
            block=64,  # small, so that documents of the test tables span several blocks
            **options,
        )
        return chunking.drop_blank_chunks(cut)

    run.__name__ = name
    return query(run)


_chunks_of_pages("page_chunks", breakpoint_threshold_amount=tables.PERCENTILE)
_chunks_of_pages("page_chunks_gradient", breakpoint_threshold_type="gradient", breakpoint_threshold_amount=tables.PERCENTILE)
_chunks_of_pages("page_chunks_n", number_of_chunks=4)


@query
def drop_blank_chunks(spark, folder):
    turns = tables.table(spark, folder, "conversations")
    blanked = turns.select(
        F.col("conv_id").alias("title"), "turn", F.explode(F.split("text", "[A-Za-z]+", -1)).alias("chunk")
    )
    return chunking.drop_blank_chunks(blanked)


@query
def chunk_start_index(spark, folder):
    chunks = semantic_chunk_with_index(spark, folder)
    return chunks.select("title", "chunk_idx", "start_index")


def semantic_chunk_with_index(spark, folder):
    return chunking.semantic_chunk(
        tables.documents(spark, folder),
        add_start_index=True,
        digits=chunking.COMPARED_DIGITS,
        breakpoint_threshold_amount=tables.PERCENTILE,
        sentence_split_regex=tables.UNIT_REGEX,
        max_words=tables.UNIT_WORDS,
    )


@query
def chunk_metadata(spark, folder):
    """Documents carry their labels as a metadata map, which every chunk receives."""
    labels = tables.table(spark, folder, "labels").select(
        F.concat(F.lit("doc"), "doc_id").alias("title"),
        F.create_map(
            F.lit("quality"), F.col("quality").cast("string"), F.lit("toxic"), F.col("toxic").cast("string")
        ).alias("metadata"),
    )
    docs = tables.documents(spark, folder).join(labels, "title", "left")
    chunks = docs.transform(
        chunking.semantic_chunk,
        digits=chunking.COMPARED_DIGITS,
        breakpoint_threshold_amount=tables.PERCENTILE,
        sentence_split_regex=tables.UNIT_REGEX,
        max_words=tables.UNIT_WORDS,
    )
    return chunks.select(
        "title",
        "chunk_idx",
        "zip_name",
        F.col("metadata")["quality"].alias("quality"),
        F.col("metadata")["toxic"].alias("toxic"),
    )


# --- embedding, identity, store --------------------------------------------------------------------


@query
def hash_embed_chunks(spark, folder):
    return _sparse(tables.chunks(spark, folder), ["title", "chunk_idx"], HashEmbedder().embed(F.col("chunk")))


def _turn_chunks(spark, folder):
    """Conversations as a chunk table with gaps: one chunk per turn, under every other number."""
    turns = tables.table(spark, folder, "conversations")
    return turns.select(
        F.concat(F.lit("conv"), "conv_id").alias("title"),
        F.col("role").alias("zip_name"),
        (F.col("turn") * 2).cast("int").alias("chunk_idx"),
        F.col("text").alias("chunk"),
    )


@query
def chunk_ids(spark, folder):
    return identity.assign_ids(_turn_chunks(spark, folder)).select("title", "chunk_idx", "id")


@query
def doc_metadata(spark, folder):
    return identity.document_metadata(tables.chunks(spark, folder))


@query
def insert_batches(spark, folder):
    lines = tables.documents(spark, folder).select(
        "title", F.posexplode(F.split("text", "\n", -1)).alias("chunk_idx", "chunk")
    )
    rows = ordering.dense_index(lines, ["title"], "chunk_idx", "row_idx")
    return identity.insert_batches(rows, 4).groupBy("title", "batch").agg(F.count("*").alias("n_rows"))


@query
def chunks_per_title(spark, folder):
    return tables.chunks(spark, folder).groupBy("title").agg(F.count("*").alias("n_chunks"))


def _new_store(spark):
    name = "chunk_store_" + scratch_path(spark, "t").rsplit("-", 1)[1]
    stores.get_or_create(spark, name, scratch_path(spark, "store"))
    return name


@query
def store_append_count(spark, folder):
    """Appends the whole store twice; the second run adds nothing. Reports the rows stored per title."""
    name = _new_store(spark)
    rows = tables.label_store(spark, folder)
    stores.append_new(rows, name)
    stores.append_new(rows, name)
    return spark.table(name).groupBy("title").agg(F.count("*").alias("n_chunks"))


@query
def filter_title(spark, folder):
    name = _new_store(spark)
    stores.append_new(tables.label_store(spark, folder), name)
    return stores.of_title(spark, name, "label3").select("id", "title", "zip_name")


@query
def skip_existing_titles(spark, folder):
    """Documents with a label are stored; the others are left to do."""
    name, docs = _new_store(spark), tables.document_chunks(spark, folder)
    labelled = tables.table(spark, folder, "labels").select(F.concat(F.lit("doc"), "doc_id").alias("title"))
    stores.append_new(docs.join(labelled, "title", "left_semi"), name)
    return stores.skip_existing_titles(tables.documents(spark, folder), stores.stored_titles(spark, name)).select(
        "title", "zip_name"
    )


@query
def replace_changed_texts(spark, folder):
    """Half the documents are stored with their lines in reverse, then all are stored as they are: the chunks that
    stay are those of a fresh store."""
    name, docs = _new_store(spark), tables.documents(spark, folder)
    turned = F.array_join(F.reverse(F.split("text", "\n", -1)), "\n")
    first = docs.withColumn("text", F.when(F.crc32(F.col("title").cast("binary")) % 2 == 0, turned).otherwise(F.col("text")))
    options = {"split_regex": tables.UNIT_REGEX, "max_words": tables.UNIT_WORDS, "cut_digits": chunking.COMPARED_DIGITS}
    add_documents(first, name, **options)
    add_documents(docs, name, replace=True, **options)
    return spark.table(name).select("title", "id", "chunk", "zip_name")


# --- retrieval -------------------------------------------------------------------------------------


@query
def hash_embed_questions(spark, folder):
    return _sparse(tables.question_vectors(spark, folder), ["q_idx"], F.col("vector"))


@query
def title_chunk_counts(spark, folder):
    return identity.title_counts(tables.label_store(spark, folder))


@query
def adaptive_k(spark, folder):
    """k by the number of lines of every document."""
    docs = tables.documents(spark, folder).select("title", F.size(F.split("text", "\n", -1)).alias("n"))
    return docs.select("title", "n", retrieval.adaptive_k(F.col("n")).alias("k"))


def _hits(spark, folder, method, **options):
    return retrieval.retrieve(
        tables.label_store(spark, folder),
        tables.question_vectors(spark, folder),
        method=method,
        digits=retrieval.DISTANCE_DIGITS,
        **options,
    )


@query
def topk_within_title(spark, folder):
    return _hits(spark, folder, "matrix").select("title", "q_idx", "rank", "id", "distance")


@query
def topk_within_title_native(spark, folder):
    return _hits(spark, folder, "native").select("title", "q_idx", "rank", "id", "distance")


@query
def topk_cells(spark, folder):
    return _hits(spark, folder, "cells").select("title", "q_idx", "rank", "id", "distance")


@query
def topk_lsh(spark, folder):
    return _hits(spark, folder, "lsh").select("title", "q_idx", "rank", "id", "distance")


@query
def topk_lsh_recall(spark, folder):
    """Share of the exact hits that the approximate search finds, and share of the chunks it compares, per title."""
    store, vectors = tables.label_store(spark, folder), tables.question_vectors(spark, folder)
    counts = identity.title_counts(store)
    k = counts.select("title", "n_chunks", retrieval.adaptive_k(F.col("n_chunks")).alias("k"))
    index = stage(signature_table(store), "signatures")
    depth = retrieval.calibrated_depth(
        store, index, vectors, k, 20, retrieval.DISTANCE_DIGITS, retrieval.TARGET_RECALL
    )
    exact = _hits(spark, folder, "matrix").select("title", "q_idx", "id")
    found = _hits(spark, folder, "lsh", index=index, depth=depth).select("title", "q_idx", "id", F.lit(1).alias("found"))
    recall = exact.join(found, ["title", "q_idx", "id"], "left").groupBy("title").agg(
        F.count("*").alias("n_exact"), F.round(F.count("found") / F.count("*"), 4).alias("recall")
    )
    share = F.least(F.ceil(F.col("k") * depth) / F.col("n_chunks"), F.lit(1.0))
    return recall.join(k, "title").select("title", "n_exact", "recall", F.round(share, 4).alias("compared"))


@query
def title_question_pairs(spark, folder):
    titles = tables.label_store(spark, folder).select("title").distinct()
    return retrieval.title_question_pairs(titles, tables.questions(spark, folder))


@query
def context_blocks(spark, folder):
    blocks = retrieval.context_blocks(_hits(spark, folder, "matrix"))
    return blocks.select("title", "q_idx", "context")


# --- answers ---------------------------------------------------------------------------------------


def _prompts(spark, folder):
    titles = tables.table(spark, folder, "embeddings").select(F.concat(F.lit("label"), "label").alias("title"))
    pairs = retrieval.title_question_pairs(titles.distinct(), tables.questions(spark, folder))
    return answering.build_prompts(pairs, retrieval.context_blocks(_hits(spark, folder, "matrix")))


@query
def render_prompt(spark, folder):
    return _prompts(spark, folder).select("title", "q_idx", "prompt")


@query
def generate_hook(spark, folder):
    return answering.generate(_prompts(spark, folder), answering.stub_generator).select("title", "q_idx", "response")


@query
def parse_citations(spark, folder):
    cited = tables.answered(spark, folder).withColumn("cited", answering.cited_numbers(F.col("response")))
    return cited.select("title", "q_idx", F.array_join("cited", ",").alias("cited"))


def _answers(spark, folder):
    docs = retrieval.context_blocks(_hits(spark, folder, "matrix")).select("title", "q_idx", "docs")
    answered = tables.answered(spark, folder).join(docs, ["title", "q_idx"], "left")
    return answering.parse_answers(answered.withColumn("docs", F.coalesce("docs", F.array().cast("array<string>"))))


@query
def resolve_citations(spark, folder):
    return _answers(spark, folder).select("title", "q_idx", "source_chunks")


@query
def answer_text(spark, folder):
    return tables.answered(spark, folder).select(
        "title", "q_idx", answering.answer_text(F.col("response")).alias("response")
    )


@query
def comparison_table(spark, folder):
    return answering.comparison_table(_answers(spark, folder))


@query
def full_comparison(spark, folder):
    """Pages to answers in one run: clean, cut, embed, number, retrieve, ask, parse."""
    return compare_documents(
        tables.document_pages(spark, folder),
        tables.questions(spark, folder),
        generator=answering.stub_generator,
        split_regex=tables.UNIT_REGEX,
        max_words=tables.UNIT_WORDS,
        cut_digits=chunking.COMPARED_DIGITS,
        digits=retrieval.DISTANCE_DIGITS,
    ).select("title", "q_idx", "response", "source_chunks")


@query
def stored_comparison(spark, folder):
    """The run over a store in two goes: English documents first, then all of them; what is stored is skipped."""
    name, pages = _new_store(spark), tables.document_pages(spark, folder)
    english = tables.table(spark, folder, "documents").where("lang = 'en'")
    english = english.select(F.concat(F.lit("doc"), "doc_id", F.lit(".pdf")).alias("doc"))
    options = {"split_regex": tables.UNIT_REGEX, "max_words": tables.UNIT_WORDS, "cut_digits": chunking.COMPARED_DIGITS}
    add_pages(pages.join(english, "doc", "left_semi"), name, **options)
    files_ = tables.document_files(spark, folder)
    return compare_stored(
        pages,
        tables.questions(spark, folder),
        name,
        files_,
        files_.where("lower(name) LIKE '%.pdf'"),
        generator=answering.stub_generator,
        allow_large=True,
        digits=retrieval.DISTANCE_DIGITS,
        **options,
    ).select("title", "q_idx", "response", "source_chunks")


@query
def pages_roundtrip(spark, folder):
    """The page table written and read back with its schema."""
    path = scratch_path(spark, "pages")
    tables.document_pages(spark, folder).write.parquet(path)
    return files.read_pages(spark, path)
