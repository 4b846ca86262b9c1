"""Packing: optimal length buckets, token-budget batches inside each bucket.

Tokens are white-space words, long ones in parts of `WORD_CHARS`, or those of a public tokenizer given by its file.
Documents longer than `max_tokens` continue in further pieces. The histogram of
piece lengths has at most `max_tokens` bins whatever the corpus; dynamic programming over it finds the bucket
boundaries with the least padding. Batches are numbered without gathering a bucket: pieces are numbered inside
slots of bounded size, and slot counts give the offsets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from quirefold.llm.common import KEY, content_key, texts_of
from quirefold.session import stage

SLOT_ROWS = 1 << 15
WORD_CHARS = 16  # code points of a word that are a token of their own, so that a text without spaces is not one token
CACHE_WORDS = 1 << 19


class _WordLengths(dict):
    """Tokens of a white-space word, counted at its first use."""

    def __init__(self, definition: str):
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.encode_special_tokens = True

    def learn(self, words: set[str]) -> None:
        if len(self) > CACHE_WORDS:
            self.clear()
        new = [w for w in words if w not in self]
        for word, coded in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False)):
            self[word] = len(coded)


def token_counts(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, _q1, _q2, n) per row: tokens of the whole text and one end token. Null counts as empty: 1.

    Tokens are white-space words (`[^\\x20\\x09-\\x0D]+`), one for every `WORD_CHARS` begun, or those of the tokenizer in a file; it must not look
    across white space, as `word_bpe_49k.json` of the public tokenizers does not.
    """
    rows = docs.select("doc_id", "text", *content_key("doc_id", "text"))
    if tokenizer is None:
        words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(rf"[^\x20\x09-\x0D]{{1,{WORD_CHARS}}}")).cast("long")
        return rows.select("doc_id", *KEY, (words + 1).alias("n"))
    with open(tokenizer, encoding="utf-8") as file:  # one public vocabulary file: its size is its own bound
        definition = docs.sparkSession.sparkContext.broadcast(file.read())
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = _WordLengths(definition.value)
        for batch in batches:
            counts = []
            for text in texts_of(batch):
                words = text.split()
                try:
                    n = sum(map(lengths.__getitem__, words))
                except KeyError:
                    lengths.learn(set(words))
                    n = sum(map(lengths.__getitem__, words))
                counts.append(n + 1)
            columns = [batch.column(c) for c in ("doc_id", *KEY)] + [pa.array(counts, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *KEY, "n"])

    return rows.mapInArrow(run, f"doc_id {kind}, _q1 long, _q2 long, n long")


def best_boundaries(histogram: dict[int, int], n_buckets: int) -> list[int]:
    """Upper ends of at most `n_buckets` buckets with the least total padding, in rising order.

    A length goes to the first boundary that is not below it; the last boundary is the largest length.
    Of several best choices, the one with the smaller boundaries from the right is taken.
    """
    if not histogram:
        return []
    lengths = np.array(sorted(histogram), dtype=np.int64)
    counts = np.array([histogram[int(x)] for x in lengths], dtype=np.int64)
    rows = np.concatenate([[0], np.cumsum(counts)])
    tokens = np.concatenate([[0], np.cumsum(counts * lengths)])
    n, k = len(lengths), min(n_buckets, len(lengths))
    best = np.full(n + 1, np.iinfo(np.int64).max // 2)
    best[0] = 0
    choice = np.zeros((k, n + 1), dtype=np.int64)
    for b in range(k):
        new = np.full(n + 1, np.iinfo(np.int64).max // 2)
        for j in range(1, n + 1):  # the last bucket ends at lengths[j - 1] and starts after the first i lengths
            cost = best[:j] + lengths[j - 1] * (rows[j] - rows[:j]) - (tokens[j] - tokens[:j])
            choice[b, j] = np.argmin(cost)
            new[j] = cost[choice[b, j]]
        best = new
    ends, j = [], n
    for b in reversed(range(k)):
        ends.append(int(lengths[j - 1]))
        j = choice[b, j]
    return ends[::-1]


def pack_documents(
    docs: DataFrame,
    max_tokens: int = 2048,
    budget: int = 65536,
    n_buckets: int = 16,
    tokenizer: str | None = None,
) -> DataFrame:
    """doc_id, piece, start, n_tokens, boundary, batch, place: where every token of every document goes.

    Piece i holds tokens [start, start + n_tokens) of the document. Inside the bucket of `boundary`, batch
    numbers run from 0; a batch holds `budget // boundary` pieces (at least one) except the last, so its padded
    size is within `budget` (or one piece). Empty and null texts hold one end token. Repeated rows are packed
    one by one. An empty table gives no rows. Columns of the input other than doc_id are not returned.
    """
    pieces = token_counts(docs, tokenizer).select(
        "doc_id", *KEY, "n", F.explode(F.sequence(F.lit(0), ((F.col("n") - 1) / max_tokens).cast("int"))).alias("piece")
    )
    start = F.col("piece").cast("long") * max_tokens
    pieces = pieces.select(
        "doc_id", *KEY, "piece", start.alias("start"), F.least(F.col("n") - start, F.lit(max_tokens)).alias("n_tokens")
    )
    pieces = stage(pieces, "pieces")
    histogram = {r["n_tokens"]: r["count"] for r in pieces.groupBy("n_tokens").count().collect()}
    ends = best_boundaries(histogram, n_buckets) or [max_tokens]
    slots = 1 + sum(histogram.values()) // SLOT_ROWS
    boundary = F.get(F.filter(F.array(*[F.lit(e).cast("long") for e in ends]), lambda e: e >= F.col("n_tokens")), F.lit(0))
    rows = pieces.withColumns({"boundary": boundary, "_qslot": F.pmod(F.xxhash64(*KEY, "piece"), F.lit(slots))})
    counts = rows.groupBy("boundary", "_qslot").agg(F.count(F.lit(1)).alias("_qn"))
    before = Window.partitionBy("boundary").orderBy("_qslot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("boundary", "_qslot", F.coalesce(F.sum("_qn").over(before), F.lit(0)).alias("_qoffset"))
    inside = Window.partitionBy("boundary", "_qslot").orderBy(*KEY, "piece")
    rows = rows.withColumn("_qrow", F.row_number().over(inside) - 1).join(offsets, ["boundary", "_qslot"])
    at = F.col("_qrow") + F.col("_qoffset")
    size = F.greatest(F.call_function("div", F.lit(budget), F.col("boundary")), F.lit(1))
    return rows.select(
        "doc_id", "piece", "start", "n_tokens", "boundary",
        F.call_function("div", at, size).alias("batch"), F.pmod(at, size).alias("place"),
    )
