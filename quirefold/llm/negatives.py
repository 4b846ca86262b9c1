"""Hard negatives by a vertical scan over columns (BOND): dimension by dimension, with bounds that shrink a bitmap.

Vectors are quantised to integers. A task turns each batch of rows into columns, one per dimension, with the
least and the largest component of every column. For an anchor the columns are read in the order of its largest
components; after every few columns, the partial score of a row and the least and most that the columns not yet
read can add bound its score, and rows that no longer can be wanted leave the bitmap. What is left at the end
has its exact score.

Two scans: the first keeps the best rows of the anchor's label (its positives), the second the best rows of
other labels inside the window of scores that each positive opens. Thresholds rise from batch to batch of a
task. Anchors, the stated query set, are sent to all tasks in blocks of bounded size; rows never move, and a
task passes on no more rows than are wanted per anchor and window.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from quirefold.session import stage

ANCHOR_BYTES = 8 * 1024 * 1024  # anchor vectors handed to the tasks at a time
STEP = 8  # columns read between two looks at the bitmap
PAGE_ROWS = 8192  # rows turned into columns at a time
LARGEST = 1 << 24  # components beyond this have no score that surely fits into 64 bits
SCALE = 256  # fixed value: units of the quantisation


def quantised(vector: str) -> Column:
    """Components as whole numbers: floor(256 * x) in double precision."""
    return F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * SCALE))


def usable(vector: str) -> Column:
    """Vectors without null and non-finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) * SCALE <= LARGEST))
    return F.col(vector).isNotNull() & F.coalesce(finite, F.lit(False))


class Columns:
    """A page of vectors as one array per dimension, with the range of every dimension."""

    def __init__(self, vectors: np.ndarray):
        self.values = np.ascontiguousarray(vectors.T)
        self.least, self.most = vectors.min(0), vectors.max(0)

    def scan(
        self, anchor: np.ndarray, rows: np.ndarray, wanted: Callable[[np.ndarray, np.ndarray], np.ndarray]
    ) -> tuple[np.ndarray, np.ndarray]:
        """(rows, exact scores) of the candidates that stay `wanted(least, most)` by the bounds of their scores."""
        order = np.argsort(-np.abs(anchor), kind="stable")
        q = anchor[order]
        ends = np.stack([q * self.least[order], q * self.most[order]])
        # What the columns from a place on can add, at least and at most.
        low = np.append(np.cumsum(ends.min(0)[::-1])[::-1], 0)
        high = np.append(np.cumsum(ends.max(0)[::-1])[::-1], 0)
        partial = np.zeros(len(rows), dtype=self.values.dtype)
        for at in range(0, len(order), STEP):
            for d, x in zip(order[at : at + STEP], q[at : at + STEP]):
                if x:
                    column = self.values[d]
                    partial += x * (column if len(rows) == len(column) else column[rows])
            done = min(at + STEP, len(order))
            stay = wanted(partial + low[done], partial + high[done])
            if not stay.all():
                rows, partial = rows[stay], partial[stay]
            if not len(rows):
                break
        return rows, partial


def best_first(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the `k` highest scores, ties by smaller id."""
    if len(scores) > 4 * k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        places = np.flatnonzero(scores >= cut)
    else:
        places = np.arange(len(scores))
    return places[np.lexsort((ids[places], -scores[places]))[:k]]


class _Best:
    """The best `k` (score, id) met so far, and the least score that still can enter."""

    def __init__(self, k: int, low: int, high: int):
        self.k, self.low, self.high = k, low, high
        self.scores, self.ids = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        inside = (scores >= self.low) & (scores <= self.high)
        scores = np.concatenate([self.scores, scores[inside].astype(np.int64)])
        ids = np.concatenate([self.ids, ids[inside]])
        keep = best_first(scores, ids, self.k)
        self.scores, self.ids = scores[keep], ids[keep]
        if len(keep) == self.k:
            self.low = max(self.low, int(self.scores[-1]))


def _any_window(windows: list[_Best]) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """A row stays while its score can be inside one of the windows, at their present thresholds."""

    def wanted(least: np.ndarray, most: np.ndarray) -> np.ndarray:
        return reduce(np.logical_or, [(most >= w.low) & (least <= w.high) for w in windows])

    return wanted


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of whole numbers, padded with zeros; 64-bit floats hold every score up to 2**53 exactly."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), dtype=flat.dtype)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def _number_type(width: int, largest: int) -> type:
    """Floats where all scores are exact in them, else 64-bit integers."""
    return np.float64 if width * largest * largest < 1 << 53 else np.int64


def _scan(rows: DataFrame, sent, same_label: bool, k: int, width: int, largest: int) -> DataFrame:
    """(anchor, win, id, score): the best `k` rows of every task per anchor of a block and window.

    The block holds anchors (number, label, vector) with their windows (number, least, most score).
    """
    kind, page_rows = _number_type(width, largest), PAGE_ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, vectors, windows = sent.value
        anchors = vectors.astype(kind)
        best = [[_Best(k, low, high) for _, low, high in w] for w in windows]
        looks = [_any_window(b) for b in best]
        for batch in batches:
            for low in range(0, len(batch), page_rows):
                page = batch.slice(low, page_rows)
                columns = Columns(_matrix(page.column("v"), width).astype(kind))
                page_ids = page.column("vec_id").to_numpy(zero_copy_only=False)
                page_labels = page.column("label").to_numpy(zero_copy_only=False)
                for i, anchor in enumerate(anchors):
                    if not best[i]:
                        continue
                    found, scores = columns.scan(anchor, np.flatnonzero((page_labels == labels[i]) == same_label), looks[i])
                    if same_label:
                        other = page_ids[found] != ids[i]
                        found, scores = found[other], scores[other]
                    if len(found):
                        for b in best[i]:
                            b.add(scores, page_ids[found])
        out = [(ids[i], windows[i][j][0], b) for i, bs in enumerate(best) for j, b in enumerate(bs) if len(b.ids)]
        for low in range(0, len(out), 4096):
            part = out[low : low + 4096]
            sizes = [len(b.ids) for _, _, b in part]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat([a for a, _, _ in part], sizes), pa.int64()),
                    pa.array(np.repeat([w for _, w, _ in part], sizes), pa.int64()),
                    pa.array(np.concatenate([b.ids for _, _, b in part]), pa.int64()),
                    pa.array(np.concatenate([b.scores for _, _, b in part]), pa.int64()),
                ],
                names=["anchor_id", "win", "vec_id", "score"],
            )

    found = rows.mapInArrow(run, "anchor_id long, win long, vec_id long, score long")
    order = Window.partitionBy("anchor_id", "win").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _blocks(anchors: DataFrame, width: int) -> Iterator[list]:
    """Anchors in parts of at most `ANCHOR_BYTES` of vectors, in the order of their ids."""
    size = max(1, ANCHOR_BYTES // (8 * max(width, 1)))
    part: list = []
    for row in anchors.orderBy("vec_id").toLocalIterator(prefetchPartitions=False):
        part.append(row)
        if len(part) == size:
            yield part
            part = []
    if part:
        yield part


def _limits(positive_score: int, share: tuple[int, int]) -> tuple[int, int]:
    """Least and largest whole score s with share[0] * p <= 100 * s <= share[1] * p."""
    return -(-share[0] * positive_score // 100), share[1] * positive_score // 100


def hard_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    positives: int = 5,
    negatives: int = 10,
    share: tuple[int, int] = (30, 90),
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    `vectors` holds vec_id, embedding and label. A score is the inner product of two quantised vectors (missing
    components of a shorter one count as zero). An anchor's positives are its `positives` best other rows of the same
    label; for each, the `negatives` best rows of other labels with a score of `share[0]` to `share[1]` percent
    of the positive's are returned, ranked from 1. Higher scores come first, ties go to the smaller vec_id.

    Rows without id, label or vector, with a null or non-finite component, or with one beyond 2**16 (no exact score in
    64 bits) take no part. Rows equal in id, label and vector count once; rows that share only an id are rows of
    their own, but never positives of each other. Fewer rows than asked for give fewer rows; an empty table gives none.
    A very long vector is read like any other, all vectors of a batch being padded to the longest. Other columns
    are ignored.
    """
    spark = vectors.sparkSession
    named = vectors.withColumn("_qanchor", F.coalesce(is_anchor, F.lit(False)))
    rows = named.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable("embedding"))
    whole = named.schema["label"].dataType.typeName() in ("byte", "short", "integer", "long")
    rows = rows.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        (F.col("label").cast("long") if whole else F.xxhash64("label")).alias("label"),
        quantised("embedding").alias("v"), F.col("_qanchor").alias("anchor"),
    )
    rows = stage(rows.distinct(), "quantised")
    width, largest = rows.agg(
        F.max(F.size("v")), F.max(F.greatest(F.abs(F.array_max("v")), F.abs(F.array_min("v"))))
    ).first()
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if width is None:
        return spark.createDataFrame([], schema)
    width, largest = max(width, 1), largest or 0
    narrow = rows.select("vec_id", "label", "v")
    parts = []
    everything = (-(1 << 62), 1 << 62)
    for block in _blocks(rows.where("anchor").drop("anchor"), width):
        ids, labels = [r["vec_id"] for r in block], [r["label"] for r in block]
        matrix = np.zeros((len(block), width), dtype=np.int64)
        for i, r in enumerate(block):
            matrix[i, : len(r["v"])] = r["v"]
        # Anchors that share an id are told apart by their place in the block.
        sent = spark.sparkContext.broadcast((ids, labels, matrix, [[(i, *everything)] for i in range(len(block))]))
        near = _scan(narrow, sent, True, positives, width, largest).orderBy("win", "rank").collect()
        windows: list[list[tuple[int, int, int]]] = [[] for _ in block]
        for r in near:  # at most `positives` per anchor of the block
            windows[r["win"]].append((r["win"] * positives + r["rank"] - 1, *_limits(r["score"], share)))
        sent = spark.sparkContext.broadcast((ids, labels, matrix, [[w for w in ws if w[1] <= w[2]] for ws in windows]))
        far = _scan(narrow, sent, False, negatives, width, largest)
        pairs = spark.createDataFrame(
            [(r["win"] * positives + r["rank"] - 1, r["vec_id"], r["score"]) for r in near], "win long, positive_id long, positive_score long"
        )
        found = far.join(F.broadcast(pairs), "win").select(
            "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"),
            "positive_score", F.col("score").alias("negative_score"),
        )
        parts.append(stage(found, "negatives"))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)
