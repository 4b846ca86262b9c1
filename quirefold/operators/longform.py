"""Chunking of documents that are spread over many page rows and may be of any size.

Units are cut from pages directly, windows work on blocks of consecutive units that overlap by the width of
the window, and what is known per document (threshold, counts) comes back to the rows block by block. A paragraph
over many pages is packed by its sentences' word counts and never joined. What has to be one value are a unit and
a chunk: a document whose distances are all equal is one chunk. The result equals merging the pages and calling
`semantic_chunk`, for patterns that end at a line end; others are refused.

Steps that are read more than once are written to the shared folder (`stage`), each pass then reads
the columns it needs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quirefold.functions.embedders import HashEmbedder
from quirefold.functions.text import PARAGRAPH, ascii_fold, bound, packed_parts, single_spaced, word_count
from quirefold.operators.chunking import (
    Breakpoints, gradient, join_units, neighbour_distances, rounded_distances, window_vectors,
)
from quirefold.operators.ordering import BLOCK, attach_facts, block_of, running_total
from quirefold.operators.packing import greedy_cuts
from quirefold.operators.selection import order_statistics, percentiles
from quirefold.operators.splitting import MAX_WORDS
from quirefold.session import stage

WHOLE_CHARS = 1 << 20  # a paragraph up to here may be one value


def kept_pages(marked: DataFrame, fold: bool = True) -> DataFrame:
    """Marked pages to `(title, position, last, text)`, the pages that stay."""
    text = ascii_fold(F.col("text")) if fold else F.col("text")
    title = F.split_part("doc", F.lit("."), F.lit(1))
    return marked.where("keep").select(
        title.alias("title"), F.col("p1").alias("position"), (F.col("n_kept") - 1).alias("last"), text.alias("text")
    )


def ends_lines(split_regex: str) -> bool:
    """Whether every match of the pattern lies inside one page and the line end that follows it."""
    plain = split_regex.replace("\\n", "\n")
    return plain.count("\n") == 1 and plain.endswith("\n") and not set(plain) & set(".^$*+?{}[]\\|()")


def page_pieces(pages: DataFrame, split_regex: str = PARAGRAPH, separator: str = "\n", block: int = BLOCK) -> DataFrame:
    """`(title, par, position, piece, border)`: the pages cut into pieces, numbered by the paragraph they belong to.

    Every page but the last is followed by `separator`. A separator match must lie inside one page and
    its `separator`, which holds for patterns that end where `separator` ends. The last piece of a
    page and the first piece of the next one belong to the same paragraph; all others (not `border`) are one.
    """
    ended = F.when(F.col("position") < F.col("last"), F.concat("text", F.lit(separator))).otherwise(F.col("text"))
    cut = pages.select("title", "position", F.split(ended, split_regex, -1).alias("pieces"))
    numbered = running_total(cut, ["title"], "position", F.size("pieces") - 1, "before", block)
    last = F.size("pieces") - 1
    pieces = numbered.select("title", "position", "before", last.alias("last"), F.posexplode("pieces").alias("nth", "piece"))
    border = (F.col("nth") == 0) | (F.col("nth") == F.col("last"))
    return pieces.select("title", (F.col("before") + F.col("nth")).alias("par"), "position", "piece", border.alias("border"))


def joined_paragraphs(pieces: DataFrame) -> DataFrame:
    """`(title, par, paragraph)` of pieces. Only those at page borders are grouped."""
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("position", "piece"))), lambda p: p["piece"])
    met = pieces.where("border").groupBy("title", "par").agg(F.array_join(in_order, "").alias("paragraph"))
    return pieces.where("NOT border").select("title", "par", F.col("piece").alias("paragraph")).unionByName(met)


def page_paragraphs(
    pages: DataFrame, split_regex: str = PARAGRAPH, separator: str = "\n", block: int = BLOCK
) -> DataFrame:
    """`(title, par, paragraph)`: the paragraphs of the document that the pages form, each as one value."""
    return joined_paragraphs(page_pieces(pages, split_regex, separator, block))


def long_paragraphs(pieces: DataFrame, max_words: int, whole_chars: int) -> DataFrame:
    """`(title, par)`: paragraphs of more than `whole_chars` characters and `max_words` words over several pages."""
    words = F.when(F.col("border"), word_count(F.col("piece"))).cast("long")
    sums = pieces.where("border").groupBy("title", "par").agg(F.sum(F.length("piece")).alias("chars"), F.sum(words).alias("words"))
    return sums.where((F.col("chars") > whole_chars) & (F.col("words") > max_words)).select("title", "par")


def packed_over_rows(pieces: DataFrame, max_words: int = MAX_WORDS, block: int = BLOCK) -> DataFrame:
    """`(title, par, nth, part)`: `packed_parts` of paragraphs with more than `max_words` words, without joining them.

    Pieces must begin and end at white space, as pages followed by a line end do. A piece is cut into parts of
    sentences; one without a sentence end behind it goes on in the next piece. The greedy cuts follow from the
    sentences' word counts (`greedy_cuts`). What has to be one value is a part: `max_words` words, or one sentence.
    """
    spaced = single_spaced(F.col("piece"))
    cut = pieces.select("title", "par", "position", F.split(spaced, "(?<=[.?!]) ", -1).alias("shreds")).where("shreds[0] <> ''")
    numbered = running_total(cut, ["title", "par"], "position", F.size("shreds"), "before", block)
    shreds = numbered.select("title", "par", "before", F.posexplode("shreds").alias("nth", "shred")).select(
        "title", "par", (F.col("before") + F.col("nth")).alias("at"), "shred"
    )
    shreds = stage(shreds, "shreds")
    ends = F.right("shred", F.lit(1)).isin(*".?!").cast("int")
    narrow = shreds.select("title", "par", "at", word_count(F.col("shred")).alias("words"), ends.alias("ends"))
    narrow = stage(running_total(narrow, ["title", "par"], "at", F.col("ends"), "idx", block), "sentence-of-shred")
    sentences = narrow.groupBy("title", "par", "idx").agg(F.sum("words").alias("words"))
    starts = greedy_cuts(sentences, ["title", "par"], max_words, block)
    rows = narrow.select("title", "par", "at", "idx").join(starts, ["title", "par", "idx"])
    rows = shreds.join(rows, ["title", "par", "at"])
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("at", "shred"))), lambda x: x["shred"])
    parts = rows.groupBy("title", "par", "nth").agg(F.array_join(in_order, " ").alias("part"))
    # a first sentence that is too long by itself leaves an empty part before it: `greedy_cuts` leaves number 0 free
    over = sentences.where((F.col("idx") == 0) & (F.col("words") > max_words))
    return parts.unionByName(over.select("title", "par", F.lit(0).cast("long").alias("nth"), F.lit("").alias("part")))


def paragraph_units(
    pieces: DataFrame, max_words: int = MAX_WORDS, block: int = BLOCK, whole_chars: int = WHOLE_CHARS
) -> DataFrame:
    """`(title, idx, sentence)`: paragraphs of `page_pieces`, oversized ones packed, numbered through the document.

    Paragraphs of more than `whole_chars` characters are packed without being joined first; the units are the same.
    """
    parts = packed_parts(F.col("paragraph"), max_words)
    sizes = pieces.where("border").groupBy("title", "par").agg(F.sum(F.length("piece")).alias("chars"))
    if sizes.where(F.col("chars") > whole_chars).isEmpty():
        # written, as the running total reads it twice and packing is its work
        rows = stage(joined_paragraphs(pieces).select("title", "par", parts.alias("parts")), "parts")
    else:
        long = stage(long_paragraphs(pieces, max_words, whole_chars), "long-paragraphs")
        marked = pieces.join(long.withColumn("_long", F.lit(True)), ["title", "par"], "left")
        spread = stage(packed_over_rows(marked.where("_long AND border"), max_words, block), "spread-parts")
        whole = joined_paragraphs(marked.where("_long IS NULL").drop("_long")).select("title", "par", parts.alias("parts"))
        # one row per paragraph or part; a paragraph's parts keep their order inside the paragraph
        one = F.array("part").alias("parts")
        rows = whole.withColumn("nth", F.lit(0).cast("long")).unionByName(spread.select("title", "par", "nth", one))
        rows = stage(rows, "parts")
        counts = rows.groupBy("title", "par").agg(F.sum(F.size("parts")).alias("n"), F.max("nth").alias("last"))
        begin = running_total(counts, ["title"], "par", F.col("n"), "before", block)
        begin = begin.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), block_of("last", block))))
        rows = rows.withColumn("_block", block_of("nth", block))
        rows = rows.join(begin.select("title", "par", "_block", "before"), ["title", "par", "_block"])
        return rows.select(
            "title", (F.col("before") + F.col("nth")).alias("first"), F.posexplode("parts").alias("_at", "sentence")
        ).select("title", (F.col("first") + F.col("_at")).alias("idx"), "sentence")
    numbered = running_total(rows, ["title"], "par", F.size("parts"), "before", block)
    return numbered.select("title", "before", F.posexplode("parts").alias("nth", "sentence")).select(
        "title", (F.col("before") + F.col("nth")).alias("idx"), "sentence"
    )


def _array_distances(
    rows: DataFrame, by: list[str], breakpoints: Breakpoints, buffer_size: int, embedder, block: int
) -> DataFrame:
    """`block_distances` with each block and its neighbours as one array, whose vectors stay in the embedder's batch."""
    blocks = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("idx", "sentence"))).alias("_units"))
    blocks = blocks.withColumn("_distances", embedder.distances(F.transform("_units", lambda u: u["sentence"]), buffer_size))
    measured = bound(rounded_distances(F.col("_distances"), breakpoints.digits), breakpoints.metrics)
    blocks = blocks.select("title", "_block", "_units", measured.alias("_metrics"))
    units = F.transform("_units", lambda u, i: F.struct(u["idx"].alias("idx"), u["sentence"].alias("sentence"), F.get("_metrics", i).alias("metric")))
    own = F.filter(units, lambda u: block_of(u["idx"], block) == F.col("_block"))
    found = blocks.select("title", F.explode_outer(own).alias("_unit"))
    return found.where(F.col("_unit").isNotNull()).select("title", "_unit.idx", "_unit.sentence", "_unit.metric")


def block_distances(
    units: DataFrame, breakpoints: Breakpoints, buffer_size: int = 1, embedder=None, block: int = BLOCK
) -> DataFrame:
    """`(title, idx, sentence, metric)`, measured block by block.

    A block also gets the neighbours that its outermost units look at: the text window, the next
    unit's window, and one more distance on both sides for the gradient.
    """
    before, after = buffer_size + 1, buffer_size + 2
    first = F.greatest(block_of(F.col("idx") - after, block), F.lit(0).cast("long"))
    last = block_of(F.col("idx") + before, block)
    rows = units.withColumn("_block", F.explode(F.sequence(first, last)))
    by = ["title", "_block"]
    embedder = embedder or HashEmbedder()
    if embedder.additive:
        return _array_distances(rows, by, breakpoints, buffer_size, embedder, block)
    rows = window_vectors(rows, embedder, buffer_size, by)
    rows = neighbour_distances(rows, by, breakpoints.digits)
    metric = gradient(by, breakpoints.digits) if breakpoints.uses_gradient else F.col("distance")
    return (
        rows.withColumn("metric", metric)
        .where(F.col("_block") == block_of("idx", block))
        .select("title", "idx", "sentence", "metric")
    )


def document_thresholds(measured: DataFrame, breakpoints: Breakpoints, block: int = BLOCK) -> DataFrame:
    """`(title, last_idx, threshold)`. No task holds more than one block of a document's metrics.

    Documents of one block are aggregated as they are; of longer ones, the ranks that decide are found by rounds of
    counts (`operators.selection`).
    """
    metric = F.col("metric")
    # Only the first block enters the state of an aggregate: all of a short document, and nothing that counts of a long one.
    short = F.when(F.col("idx") < block, metric)
    if breakpoints.number_of_chunks is None:
        threshold = breakpoints.threshold(short)
    else:
        largest = F.sort_array(F.collect_list(short), asc=False)
        threshold = F.get(largest, (breakpoints.nth(F.size(largest)) - 1).cast("int"))
    facts = measured.groupBy("title").agg(
        F.max("idx").alias("last_idx"), F.count("metric").alias("n"), F.avg("metric").alias("mean"), threshold.alias("threshold")
    )
    facts = stage(facts, "thresholds")
    long = facts.where(F.col("last_idx") >= block)
    only_ranks = breakpoints.number_of_chunks is not None or breakpoints.kind != "standard_deviation"
    if not only_ranks:  # plain sums, whatever the length
        return measured.groupBy("title").agg(F.max("idx").alias("last_idx"), breakpoints.threshold(metric).alias("threshold"))
    if long.isEmpty():
        return facts.select("title", "last_idx", "threshold")
    if breakpoints.number_of_chunks is not None:
        rank = (F.col("n") - breakpoints.nth(F.col("n"))).cast("long")
        found = order_statistics(measured, long.select("title", "last_idx", rank.alias("rank")), block)
        found = found.select("title", F.col("value").alias("exact"))
    else:
        shares = [0.25, 0.75] if breakpoints.kind == "interquartile" else [breakpoints.amount / 100.0]
        found = percentiles(measured, long.select("title", "last_idx", "n"), shares, block).join(long.select("title", "mean"), "title")
        value = F.get("values", F.lit(0))
        if breakpoints.kind == "interquartile":
            value = F.col("mean") + F.lit(float(breakpoints.amount)) * (F.get("values", F.lit(1)) - value)
        found = found.select("title", (value if breakpoints.digits is None else F.round(value, breakpoints.digits + 4)).alias("exact"))
    facts = facts.join(found, "title", "left")
    return facts.select(
        "title", "last_idx", F.when(F.col("last_idx") >= block, F.col("exact")).otherwise(F.col("threshold")).alias("threshold")
    )


def semantic_chunk_pages(
    pages: DataFrame,
    buffer_size: int = 1,
    breakpoint_threshold_type: str = "percentile",
    breakpoint_threshold_amount: float | None = None,
    number_of_chunks: int | None = None,
    sentence_split_regex: str = PARAGRAPH,
    embedder=None,
    max_words: int = MAX_WORDS,
    block: int = BLOCK,
    digits: int | None = None,
    whole_chars: int = WHOLE_CHARS,
) -> DataFrame:
    """Pages `(title, position, last, text)` to chunks `(title, chunk_idx, chunk)`."""
    if not ends_lines(sentence_split_regex):
        raise ValueError("cutting from pages needs a pattern of plain characters with one line end, at its end")
    breakpoints = Breakpoints(breakpoint_threshold_type, breakpoint_threshold_amount, number_of_chunks, digits)
    pieces = stage(page_pieces(stage(pages, "pages"), sentence_split_regex, block=block), "pieces")
    units = paragraph_units(pieces, max_words, block, whole_chars)
    measured = stage(block_distances(units, breakpoints, buffer_size, embedder, block), "measured")
    rows = attach_facts(measured, document_thresholds(measured, breakpoints, block), "title", "idx", "last_idx", block).drop(
        "_block"
    )
    bypassed = (F.col("last_idx") < breakpoints.bypass_units) & (F.col("idx") < F.col("last_idx"))
    is_break = F.when(F.col("last_idx") < breakpoints.bypass_units, bypassed).otherwise(
        F.coalesce(F.col("metric") > F.col("threshold"), F.lit(False))
    )
    numbered = running_total(rows, ["title"], "idx", is_break.cast("int"), "chunk_idx", block)
    return join_units(numbered.withColumn("chunk_idx", F.col("chunk_idx").cast("int")), [])
