"""Quality classifier: random Fourier features over document statistics, ridge scores, isotonic calibration.

A pass over the texts reduces each one to a few dozen statistics. Cosines of random projections of these, with
normal directions, approximate a Gaussian kernel; ridge regression on them needs only the sums X'X and X'y,
which every task adds up for its rows. The sums are kept per fold, so that each fold is scored by a model that
has not seen it; those scores, in a histogram of fixed size, give the isotonic (pool-adjacent-violators) map
from score to probability. The final model uses all folds.

All labelled rows that may be learnt from are used; what reaches the driver has a size set by the constants.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quirefold.llm.common import KEY, content_key, keeps_columns, partition_sum, texts_of
from quirefold.session import stage

FEATURES, FOLDS, BINS = 256, 4, 2000
RIDGE, WIDTH = 1e-3, 1.0  # penalty per row; kernel width in units of the square root of the number of statistics

_LETTERS = np.zeros(256, dtype=bool)
_LETTERS[[*range(65, 91), *range(97, 123)]] = True
_UPPER, _DIGIT, _SPACE = slice(65, 91), slice(48, 58), [9, 10, 11, 12, 13, 32]
_SENTENCE, _COMMA = [33, 46, 63], [44, 58, 59]
_PUNCT = [c for c in range(33, 127) if not chr(c).isalnum()]
_SYMBOL = [c for c in _PUNCT if c not in _SENTENCE + _COMMA]

STATISTICS = 26


def statistics(text: str) -> list[float]:
    """Sizes, shares of kinds of characters, repetition of words and lines, shapes of words and lines."""
    data = text.encode("utf-8", "surrogatepass")
    octets = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256).astype(float)
    size = max(len(data), 1)
    words = data.split()
    n = max(len(words), 1)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) if words else np.zeros(1, dtype=np.int64)
    distinct = len(set(words))
    repeats = sum(map(bytes.__eq__, words, words[1:]))
    lines = data.split(b"\n")
    full = [x for x in lines if x.strip()]
    widths = np.fromiter(map(len, lines), dtype=np.int64, count=len(lines))
    ends = octets[_SENTENCE].sum()
    return [
        math.log1p(len(data)),
        math.log1p(len(words)),
        math.log1p(len(lines)),
        octets[_LETTERS].sum() / size,
        octets[_UPPER].sum() / size,
        octets[_DIGIT].sum() / size,
        octets[_SPACE].sum() / size,
        octets[_SENTENCE].sum() / size,
        octets[_COMMA].sum() / size,
        octets[_SYMBOL].sum() / size,
        octets[128:].sum() / size,
        math.log1p(octets[_SYMBOL].max() / n * 100),
        octets[124] / n,
        octets[60] / n,
        distinct / n,
        math.log1p(distinct),
        repeats / n,
        float(lengths.mean()),
        float(lengths.std()),
        math.log1p(float(lengths.max())),
        float((lengths <= 2).sum()) / n,
        len(set(full)) / max(len(full), 1),
        math.log1p(float(widths.mean())),
        math.log1p(float(widths.std())),
        math.log1p(n / (ends + 1)),
        1 - len(full) / len(lines),
    ]


def document_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, _q1, _q2, _qstats) per row; null counts as the empty text."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = [statistics(t) for t in texts_of(batch)]
            columns = [batch.column(c) for c in ("doc_id", *KEY)] + [pa.array(stats, pa.list_(pa.float32()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *KEY, "_qstats"])

    rows = docs.select("doc_id", "text", *content_key("doc_id", "text"))
    return rows.mapInArrow(run, f"doc_id {kind}, _q1 long, _q2 long, _qstats array<float>")


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    steps: np.ndarray  # upper ends of the raw scores' bins
    probability: np.ndarray  # calibrated value of each bin

    def score(self, stats: np.ndarray) -> np.ndarray:
        raw = fourier(stats, self.mean, self.scale) @ self.weights
        return self.probability[np.clip(np.searchsorted(self.steps, raw), 0, len(self.probability) - 1)]


def fourier(stats: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Random Fourier features, and a constant."""
    draw = np.random.default_rng(20)
    directions = draw.normal(size=(STATISTICS, FEATURES)) / (WIDTH * math.sqrt(STATISTICS))
    phases = draw.uniform(0, 2 * math.pi, FEATURES)
    x = np.clip((stats - mean) / scale, -6, 6)
    return np.hstack([np.cos(x @ directions + phases) * math.sqrt(2 / FEATURES), np.ones((len(x), 1))])


def isotonic(counts: np.ndarray, positives: np.ndarray) -> np.ndarray:
    """The rising step function over the bins nearest to positives / counts (pool adjacent violators).

    Bins without rows take the value of the block they fall into; one row of each label is added to every
    block's ends in effect by the smoothing of its mean.
    """
    blocks: list[list[float]] = []  # rows, positives, bins
    for c, p in zip(counts, positives):
        blocks.append([float(c), float(p), 1])
        while len(blocks) > 1 and (
            blocks[-1][0] == 0 or blocks[-2][0] == 0 or blocks[-2][1] / blocks[-2][0] >= blocks[-1][1] / blocks[-1][0]
        ):
            c2, p2, b2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + c2, blocks[-1][1] + p2, blocks[-1][2] + b2]
    total, share = max(counts.sum(), 1), positives.sum() / max(counts.sum(), 1)
    values = [(p + share) / (c + 1) if total else share for c, p, _ in blocks]
    return np.maximum.accumulate(np.repeat(values, [int(b) for _, _, b in blocks]))


def _stack(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=float).reshape(-1, STATISTICS)


def fit_quality(rows: DataFrame) -> QualityModel | None:
    """A model from rows (_qstats, _qlabel 0 or 1, _qfold 0..FOLDS-1); None without rows."""
    spark = rows.sparkSession

    def moments(batch: pa.RecordBatch, sums: np.ndarray) -> None:
        x = _stack(batch.column("_qstats"))
        sums += np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)])

    sums = partition_sum(rows, moments, 1 + 2 * STATISTICS)
    if not sums[0]:
        return None
    mean = sums[1 : 1 + STATISTICS] / sums[0]
    scale = np.sqrt(np.maximum(sums[1 + STATISTICS :] / sums[0] - mean**2, 0)) + 1e-9
    d = FEATURES + 1
    sent = spark.sparkContext.broadcast((mean, scale))

    def normal(batch: pa.RecordBatch, sums: np.ndarray) -> None:
        x = fourier(_stack(batch.column("_qstats")), *sent.value)
        y, fold = np.asarray(batch.column("_qlabel"), dtype=float), np.asarray(batch.column("_qfold"))
        parts = sums.reshape(FOLDS, d + 1, d)
        for k in range(FOLDS):
            xk = x[fold == k]
            parts[k, :d] += xk.T @ xk
            parts[k, d] += y[fold == k] @ xk

    parts = partition_sum(rows, normal, FOLDS * (d + 1) * d).reshape(FOLDS, d + 1, d)

    def solve(part: np.ndarray) -> np.ndarray:
        return np.linalg.solve(part[:d] + RIDGE * max(part[d - 1, d - 1], 1) * np.eye(d) / FEATURES, part[d])

    weights = solve(parts.sum(0))
    unseen = []
    for k in range(FOLDS):
        rest = parts.sum(0) - parts[k]
        n, positives = rest[d - 1, d - 1], rest[d, d - 1]  # the last feature is the constant
        # Copies of a text share a fold; if the others then hold one label only, the final model stands in.
        unseen.append(solve(rest) if 0.5 < positives < n - 0.5 else weights)
    unseen = np.stack(unseen)
    steps = np.linspace(-0.5, 1.5, BINS)
    folded = spark.sparkContext.broadcast((mean, scale, unseen, steps))

    def histogram(batch: pa.RecordBatch, sums: np.ndarray) -> None:
        mean, scale, unseen, steps = folded.value
        x = fourier(_stack(batch.column("_qstats")), mean, scale)
        raw = np.einsum("ij,ij->i", x, unseen[np.asarray(batch.column("_qfold"))])
        bins = np.clip(np.searchsorted(steps, raw), 0, BINS - 1)
        y = np.asarray(batch.column("_qlabel"), dtype=float)
        sums += np.concatenate([np.bincount(bins, minlength=BINS), np.bincount(bins, weights=y, minlength=BINS)])

    bins = partition_sum(rows, histogram, 2 * BINS)
    return QualityModel(mean, scale, weights, steps, isotonic(bins[:BINS], bins[BINS:]))


@keeps_columns
def score_quality(docs: DataFrame, labels: DataFrame, learn: Column) -> DataFrame:
    """doc_id, _q1, _q2 (content key) and `score` (0 to 1, higher: label 1 likelier) per row of `docs`.

    `labels` holds doc_id and `quality`; rows of `docs` where `learn` holds and a label of 0 or 1 exists are
    learnt from (several labels of one id count one by one). Only the text is an input of the score; equal
    texts (also of repeated rows) get equal scores, null and empty texts one like any other, very long texts are read
    whole. Scores in one bin of the calibration tie. Without labels every score is 0.5, an empty table gives no
    rows. Other columns are not returned, whatever their names.
    """
    stats = stage(document_statistics(docs), "statistics")
    known = labels.select("doc_id", F.col("quality").cast("int").alias("_qlabel")).where("_qlabel IN (0, 1)")
    # Narrow rows only; folds by content, so that copies of a text are not split between fit and calibration.
    fold = F.pmod(F.hash("_qstats"), F.lit(FOLDS)).alias("_qfold")
    rows = stage(stats.where(learn).join(known, "doc_id").select("_qstats", "_qlabel", fold), "labelled-statistics")
    model = fit_quality(rows)
    if model is None:
        return stats.select("doc_id", *KEY, F.lit(0.5).alias("score"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def judge(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for column in columns:
            x = np.array(column.to_list(), dtype=float).reshape(-1, STATISTICS)
            yield pd.Series(np.round(np.clip(sent.value.score(x), 0, 1), 6))

    return stats.select("doc_id", *KEY, F.pandas_udf(judge, "double")("_qstats").alias("score"))
