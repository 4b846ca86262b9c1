"""SimHash near-dedup: fingerprints over word shingles, linked when few bits differ.

Fingerprints are compared as distinct values, so groups of exact copies cost one row each. Every fingerprint
gets a row of the pivot table: its Hamming distances to reference fingerprints. By the triangle inequality two
fingerprints within `max_bits` differ by at most `max_bits` in every coordinate, so a pair is discarded by its
largest coordinate difference, and only survivors are verified bit by bit. Pairs are met inside cells: with
`max_bits` differing bits, at least `2` of `max_bits + 2` bit ranges agree, so every link is met in
the cell of some choice of ranges.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from quirefold.llm.common import KEY, content_key, keeps_columns, texts_of
from quirefold.llm.components import components
from quirefold.session import stage

PIVOTS = 16
SEED = 42  # fixed value: the seed of the shingle hash
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(text: str, shingle: int) -> int:
    """Bits set in more than half of the shingle hashes; 0 without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[: len(words) - shingle].tolist()]
    stops = (ends[shingle - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(joined[i:j], SEED) for i, j in zip(starts, stops)), dtype=np.uint64, count=len(starts)
    )
    octets = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    counts = np.concatenate([np.bincount(octets[:, k], minlength=256) @ _BITS for k in range(8)])
    return int(sum(1 << int(i) for i in np.flatnonzero(2 * counts > len(hashes))))


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, _q1, _q2, _qfp) per row of `docs`; `_qfp` is the fingerprint as a signed long."""
    kind = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = np.array([fingerprint(t, shingle) for t in texts_of(batch)], dtype=np.uint64)
            columns = [batch.column(n) for n in ("doc_id", *KEY)] + [pa.array(marks.view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *KEY, "_qfp"])

    narrow = docs.select("doc_id", "text", *content_key("doc_id", "text"))
    return narrow.mapInArrow(run, f"doc_id {kind.simpleString()}, _q1 long, _q2 long, _qfp long")


def pivots() -> list[int]:
    """Reference fingerprints by a rule: the hashes of their numbers, as signed longs."""
    return [int(np.uint64(xxhash.xxh64_intdigest(str(i), SEED)).astype(np.int64)) for i in range(PIVOTS)]


def pivot_table(marks: DataFrame) -> DataFrame:
    """(fp, d0, d1): each fingerprint with its distances to the pivots, eight to a long, one byte each."""
    packed = []
    for start in range(0, PIVOTS, 8):
        octet = [
            F.shiftleft(F.bit_count(F.col("_qfp").bitwiseXOR(F.lit(p))).cast("long"), 8 * i)
            for i, p in enumerate(pivots()[start : start + 8])
        ]
        packed.append(reduce(lambda x, y: x.bitwiseOR(y), octet))
    return marks.select(F.col("_qfp").alias("fp"), *[p.alias(f"d{i}") for i, p in enumerate(packed)])


def _close(x: str, y: str, most: int) -> Column:
    """No coordinate of two packed rows differs by more than `most`."""
    at = [(F.shiftright(x, 8 * i).bitwiseAND(F.lit(255)), F.shiftright(y, 8 * i).bitwiseAND(F.lit(255))) for i in range(8)]
    return reduce(lambda p, q: p & q, [F.abs(u - v) <= most for u, v in at])


def near_links(marks: DataFrame, max_bits: int) -> DataFrame:
    """(a, b) of distinct fingerprints `_qfp` that differ in 1 to `max_bits` bits; may repeat a pair."""
    blocks = max_bits + 2
    cuts = [round(i * 64 / blocks) for i in range(blocks + 1)]
    masks = [((1 << cuts[i + 1]) - (1 << cuts[i])) for i in range(blocks)]
    choices = [sum(masks[i] for i in c) for c in combinations(range(blocks), blocks - max_bits)]
    signed = [c - (1 << 64) if c >= 1 << 63 else c for c in choices]
    cells = F.array(*[
        F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("bits")) for i, m in enumerate(signed)
    ])
    rows = pivot_table(marks).select("fp", "d0", "d1", F.inline(cells))
    left = rows.select("choice", "bits", *[F.col(c).alias(f"a{c}") for c in ("fp", "d0", "d1")])
    right = rows.select("choice", "bits", *[F.col(c).alias(f"b{c}") for c in ("fp", "d0", "d1")])
    pairs = left.join(right, ["choice", "bits"]).where(
        (F.col("afp") < F.col("bfp"))
        & _close("ad0", "bd0", max_bits)
        & _close("ad1", "bd1", max_bits)
        & (F.bit_count(F.col("afp").bitwiseXOR(F.col("bfp"))) <= max_bits)
    )
    return pairs.select(F.col("afp").alias("a"), F.col("bfp").alias("b"))


def simhash_groups(docs: DataFrame, shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """One row per row of `docs`: doc_id, _q1, _q2 (content key), fingerprint, component_id, n_links.

    Texts are lower-cased in A-Z and cut at ASCII white space; with fewer words than `shingle` the whole
    sequence is the one shingle, without words (or null) the fingerprint is 0, linked like any other. Rows
    are linked when their fingerprints differ in at most `max_bits` bits; `component_id` is the smallest doc_id
    that can be reached over links (null only if no member has an id). `n_links` counts the other distinct
    fingerprints linked directly. Repeated rows get the same values; a very long text is read whole; bits set in exactly
    half of the hashes are 0; an empty table gives no rows. Other columns are not returned.
    """
    marks = stage(fingerprints(docs, shingle), "fingerprints")
    distinct = stage(marks.groupBy("_qfp").agg(F.min("doc_id").alias("_qmin")), "distinct-fingerprints")
    links = stage(near_links(distinct, max_bits).distinct(), "near-fingerprints")
    sides = links.select(F.col("a").alias("_qfp")).unionByName(links.select(F.col("b").alias("_qfp")))
    degrees = sides.groupBy("_qfp").agg(F.count(F.lit(1)).alias("_qlinks"))
    member = components(links, "a", "b", "_qcomp").withColumnRenamed("node", "_qfp")
    facts = distinct.join(member, "_qfp", "left").join(degrees, "_qfp", "left")
    facts = facts.withColumn("_qcomp", F.coalesce("_qcomp", "_qfp"))
    smallest = facts.groupBy("_qcomp").agg(F.min("_qmin").alias("component_id"))
    facts = stage(facts.join(smallest, "_qcomp").select("_qfp", "_qcomp", "component_id", "_qlinks"), "groups")
    return marks.join(facts, "_qfp").select(
        "doc_id",
        *KEY,
        F.lpad(F.lower(F.hex("_qfp")), 16, "0").alias("fingerprint"),
        "component_id",
        "_qcomp",
        F.coalesce("_qlinks", F.lit(0)).cast("long").alias("n_links"),
    )


@keeps_columns
def drop_near_copies(docs: DataFrame, shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """`docs` with one row of each group: the one with the smallest doc_id (ids before null, then by content).

    Columns are those of `docs`. Repeated rows are one group and leave one row.
    """
    groups = simhash_groups(docs, shingle, max_bits)
    chosen = groups.groupBy("_qcomp").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", *KEY)).alias("_qbest"))
    chosen = stage(chosen.select(*[F.col(f"_qbest.{k}").alias(k) for k in KEY]), "kept-documents")
    rows = docs.withColumns(dict(zip(KEY, content_key("doc_id", "text")))).join(chosen, KEY, "left_semi")
    return one_of_repeated(rows, docs.columns)


def one_of_repeated(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row per content key; which of several rows with equal id and text stays is decided by their values."""
    firsts = rows.withColumn("_qrow", F.struct(*[F.col(c) for c in columns]))
    best = firsts.groupBy(*KEY).agg(F.min_by("_qrow", F.xxhash64(*[F.col(c) for c in columns])).alias("_qrow"))
    return best.select(*[F.col("_qrow")[c].alias(c) for c in columns])
