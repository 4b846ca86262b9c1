"""Toxicity: a factorization machine over hashed terms.

The score of a text is the logistic of a bias, a weight per distinct term and a product of factors per pair of
terms, so that two terms can mean something together (an insult and the mention of a group) that neither
weight says alone. Terms are words in lower case without punctuation at their ends, named by 64-bit hashes.

Terms are counted over all labelled learning documents; the `MAX_TERMS` most associated with the label are used,
others are ignored in scoring. Only the weights are fitted on a sample of at most about `max_train` documents (a
stated bound): label 1 first, up to half of it, the rest from label 0; the odds of the sample are turned back into those of all rows by an offset. Shards
of the sample take their examples one by one with adaptive steps, an L1 penalty on weights (so that rare words
add no noise) and an L2 penalty on factors, and the states of the shards are averaged after each round. Every
text is scored whole.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from quirefold.llm.common import KEY, content_key, keeps_columns, sampled, texts_of
from quirefold.session import stage

MAX_TRAIN = 32768
MAX_TERMS = 1 << 16
FACTORS, SHARDS, ROUNDS = 4, 4, 8
RATE, FACTOR_RATE, L1, L2 = 2.0, 0.02, 4.0, 0.01
CACHE_WORDS = 1 << 19
MARKS = ".,;:!?\"'`()[]{}<>|*_-–—“”‘’«»¡¿…"


class _TermHashes(dict):
    def __missing__(self, word: str) -> int:
        bare = word.strip(MARKS)
        if len(self) > CACHE_WORDS:
            self.clear()
        self[word] = number = xxhash.xxh64_intdigest(bare.encode("utf-8", "surrogatepass")) >> 1 if bare else -1
        return number


def terms_of(text: str, hashes: _TermHashes) -> np.ndarray:
    """The sorted hashes of the distinct terms."""
    words = set(text.lower().split())
    found = np.fromiter(map(hashes.__getitem__, words), dtype=np.int64, count=len(words))
    return np.unique(found[found >= 0])


@dataclass
class Machine:
    terms: np.ndarray  # sorted hashes
    z: np.ndarray  # accumulated gradients of the weights; the last entry is the bias
    n: np.ndarray
    factors: np.ndarray
    m: np.ndarray
    offset: float = 0.0  # from the odds of the sample to those of all rows

    @classmethod
    def start(cls, terms: np.ndarray) -> Machine:
        draw = np.random.default_rng(7)
        shape = (len(terms), FACTORS)
        return cls(terms, np.zeros(len(terms) + 1), np.zeros(len(terms) + 1), draw.normal(0, 0.01, shape), np.zeros(shape))

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return -np.sign(z) * np.maximum(np.abs(z) - L1, 0) / ((1 + np.sqrt(n)) / RATE)

    def slots(self, terms: np.ndarray) -> np.ndarray:
        if not len(self.terms):
            return np.zeros(0, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return at[self.terms[at] == terms]

    def epoch(self, rows: list[tuple[np.ndarray, int]]) -> None:
        """One pass over (slots, label), updating the state in place."""
        bias = len(self.terms)
        for slots, label in rows:
            at = np.append(slots, bias)
            w, v = self.weights(at), self.factors[slots]
            total = v.sum(0)
            g = _logistic(w.sum() + 0.5 * float(total @ total - (v * v).sum())) - label
            step = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / RATE
            self.z[at] += g - step * w
            self.n[at] += g * g
            gv = g * (total - v) + L2 * v
            self.m[slots] += gv * gv
            self.factors[slots] = v - FACTOR_RATE * gv / (0.1 + np.sqrt(self.m[slots]))


class Scorer:
    """The fitted machine, ready for texts."""

    def __init__(self, machine: Machine):
        self.machine, self.weights, self.hashes = machine, machine.weights(), _TermHashes()

    def score(self, text: str) -> float:
        slots = self.machine.slots(terms_of(text, self.hashes))
        v = self.machine.factors[slots]
        total = v.sum(0)
        pairs = 0.5 * float(total @ total - (v * v).sum())
        return _logistic(float(self.weights[slots].sum() + self.weights[-1]) + pairs + self.machine.offset)


def _logistic(x: float) -> float:
    return float(1 / (1 + np.exp(-min(max(x, -35.0), 35.0))))


def least_documents(rows: int) -> int:
    """Documents a term has to stand in: a few, more by one whenever the rows double, as chance finds more then."""
    return max(2, round(math.log2(max(rows, 1))) - 4)


def labelled_terms(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, terms, _q1, _q2) of the documents with a label of 0 or 1, written.

    Texts meet their labels by a sort on both sides, whatever their sizes, and once: all later passes read terms.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _TermHashes()
        for batch in batches:
            terms = pa.array([terms_of(t, hashes) for t in texts_of(batch)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("label", *KEY)] + [terms], names=["label", *KEY, "terms"])

    known = labels.select("doc_id", F.col("toxic").cast("int").alias("label")).where("label IN (0, 1)")
    rows = docs.select("doc_id", "text", *content_key("doc_id", "text")).join(known.hint("merge"), "doc_id")
    rows = rows.select("label", *KEY, "text").mapInArrow(encode, "label int, _q1 long, _q2 long, terms array<long>")
    return stage(rows, "labelled-terms")


def fit_toxicity(rows: DataFrame, max_train: int = MAX_TRAIN) -> Machine | None:
    """A machine from `labelled_terms`; None without rows."""
    spark = rows.sparkSession
    sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n0 + n1:
        return None

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("terms")
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
            labels = np.repeat(batch.column("label").to_numpy(zero_copy_only=False), sizes)
            terms, at = np.unique(lists.flatten().to_numpy(zero_copy_only=False), return_inverse=True)
            both, toxic = np.bincount(at, minlength=len(terms)), np.bincount(at, weights=labels, minlength=len(terms))
            columns = [pa.array(terms, pa.int64()), pa.array(toxic.astype(np.int64)), pa.array((both - toxic).astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["term", "c1", "c0"])

    counts = rows.select("label", "terms").mapInArrow(count, "term long, c1 long, c0 long")
    terms = counts.groupBy("term").agg(F.sum("c1").alias("c1"), F.sum("c0").alias("c0"))
    share = (F.col("c1") + F.col("c0")) / (n0 + n1)
    gap = (F.col("c1") + 0.5) / (n1 + 1) - (F.col("c0") + 0.5) / (n0 + 1)
    terms = terms.where(F.col("c1") + F.col("c0") >= least_documents(n0 + n1)).select(
        "term", (F.pow(gap, 2) / (share * (1.0 + 1e-9 - share))).alias("gain")
    )
    terms = stage(terms, "toxicity-terms")  # written first: the sort and its sampling read two numbers a term
    best = terms.orderBy(F.desc("gain"), "term").limit(MAX_TERMS).toArrow().column("term").to_numpy()
    machine = Machine.start(np.sort(best))
    sent = spark.sparkContext.broadcast(machine)

    m1 = max(min(n1, max_train // 2), max_train - n0)
    drawn = [min(1.0, (max_train - min(m1, n1)) / max(n0, 1)), min(1.0, m1 / max(n1, 1))]
    chance = F.when(F.col("label") == 1, sampled(drawn[1] * n1, n1, *KEY)).otherwise(sampled(drawn[0] * n0, n0, *KEY))
    offset = math.log(drawn[0] / drawn[1]) if n0 and n1 else 0.0
    shard = F.pmod(F.xxhash64(F.lit(3), *KEY), F.lit(SHARDS)).cast("int").alias("shard")
    sample = rows.where(chance).select(shard, "label", "terms")

    def pack(group: pa.Table) -> pa.Table:
        rows = [(sent.value.slots(np.array(t.as_py(), dtype=np.int64)), y.as_py()) for t, y in zip(group["terms"], group["label"])]
        rows.sort(key=lambda r: (xxhash.xxh64_intdigest(r[0].tobytes()), r[1]))
        return pa.table({"data": [pickle.dumps([(s.astype(np.int32), y) for s, y in rows])]})

    # A shard becomes one value of bounded size, written once: rounds read it and shuffle nothing.
    shards = stage(sample.groupBy("shard").applyInArrow(pack, "data binary"), "toxicity-shards")
    for _ in range(ROUNDS):
        sent = spark.sparkContext.broadcast(machine)

        def epoch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for data in batch.column("data").to_pylist():
                    own = Machine(sent.value.terms, *[x.copy() for x in _state(sent.value)])
                    own.epoch(pickle.loads(data))
                    yield pa.RecordBatch.from_pydict(
                        {f"s{i}": [x.astype(np.float32).tobytes()] for i, x in enumerate(_state(own))}
                    )

        states = shards.mapInArrow(epoch, "s0 binary, s1 binary, s2 binary, s3 binary").collect()  # SHARDS states
        states.sort()
        parts = [
            np.mean([np.frombuffer(s[i], dtype=np.float32) for s in states], axis=0, dtype=float).reshape(x.shape)
            for i, x in enumerate(_state(machine))
        ]
        machine = Machine(machine.terms, *parts, offset)
        del states
        sent.destroy()
    return machine


def _state(machine: Machine) -> list[np.ndarray]:
    return [machine.z, machine.n, machine.factors, machine.m]


@keeps_columns
def score_toxicity(docs: DataFrame, labels: DataFrame, learn: Column, max_train: int = MAX_TRAIN) -> DataFrame:
    """`docs` with `score` (0 to 1, higher: label 1 likelier).

    `labels` holds doc_id and `toxic`; rows of `docs` where `learn` holds and a label of 0 or 1 exists may be
    learnt from. Only the text is an input of the score; null and empty texts get the score of the bias, very long
    ones are read whole. Equal texts, also of repeated rows, get equal scores; of terms that tie for the last places the
    smaller hashes are used. Without labels every score is 0, an empty table gives no rows. A column named `score` is replaced.
    """
    machine = fit_toxicity(labelled_terms(docs.where(learn), labels), max_train)
    if machine is None:
        return docs.withColumn("score", F.lit(0.0))
    sent = docs.sparkSession.sparkContext.broadcast(machine)

    def judge(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(sent.value)
        for batch in texts:
            yield pd.Series([round(scorer.score(t or ""), 6) for t in batch], dtype=float)

    return docs.withColumn("score", F.pandas_udf(judge, "double")("text"))
