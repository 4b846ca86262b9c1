"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Every text becomes a sparse vector of hashed n-grams (1 to 3 characters): logarithm of the count, times the
inverse document frequency over all learning documents, scaled to length 1. The weights are learnt with
follow-the-regularised-leader: shards of a sample take their examples one by one, with L1 and L2 penalties,
and the states of the shards are averaged after each round. A temperature, fitted on documents kept out of
the updates, makes the probabilities honest.

The sample for the weights holds at most about `max_train` documents (a stated bound); document frequencies
cover all learning documents, and every text is scored whole.
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
from pyspark.sql import DataFrame, functions as F

from quirefold.llm.common import keeps_columns, partition_sum, sampled, texts_of, with_results
from quirefold.session import stage

BUCKETS = 1 << 15
MAX_TRAIN = 8192
SHARDS, ROUNDS = 8, 5
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.05
_MIX = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], dtype=np.uint32)
_SHIFT = np.uint32(32 - BUCKETS.bit_length() + 1)


def ngram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, counts) of the hashed 1-, 2- and 3-grams of the lower-cased text."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    one = codes * _MIX[0]
    two = (one[:-1] ^ (one[:-1] >> np.uint32(15))) * _MIX[1] + one[1:]
    three = (two[:-1] ^ (two[:-1] >> np.uint32(13))) * _MIX[2] + one[2:]
    grams = np.concatenate([one * _MIX[2], two * _MIX[2], three * _MIX[1]]) >> _SHIFT
    counts = np.bincount(grams, minlength=BUCKETS)
    buckets = np.flatnonzero(counts)
    return buckets, counts[buckets]


def tfidf(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    buckets, counts = ngram_counts(text)
    values = (1 + np.log(counts)) * idf[buckets]
    return buckets, values / max(math.sqrt(float(values @ values)), 1e-12)


@dataclass
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # (BUCKETS + 1, languages); the last row is the bias
    temperature: float

    def logits(self, text: str) -> np.ndarray:
        buckets, values = tfidf(text, self.idf)
        return values @ self.weights[buckets] + self.weights[-1]


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _ftrl_weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    shrunk = np.sign(z) * np.maximum(np.abs(z) - L1, 0)
    return -shrunk / ((BETA + np.sqrt(n)) / ALPHA + L2)


def ftrl_epoch(rows: list[tuple[np.ndarray, np.ndarray, int]], z: np.ndarray, n: np.ndarray) -> None:
    """One pass over (buckets, values, label), updating the state in place; the bias is the last row."""
    for buckets, values, label in rows:
        at = np.append(buckets, len(z) - 1)
        x = np.append(values, 1.0)
        w = _ftrl_weights(z[at], n[at])
        p = _softmax(x @ w)
        p[label] -= 1
        g = np.outer(x, p)
        step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
        z[at] += g - step * w
        n[at] += g * g


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least negative log likelihood, by a search on a fixed log scale."""
    if not len(labels):
        return 1.0
    scale = np.exp(np.linspace(math.log(0.02), math.log(5.0), 200))
    losses = [-np.mean(np.log(_softmax(logits / t)[np.arange(len(labels)), labels] + 1e-300)) for t in scale]
    return float(scale[int(np.argmin(losses))])


def has_letter():
    return F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))


def fit_languages(docs: DataFrame, learn, max_train: int = MAX_TRAIN) -> LanguageModel | None:
    """A model from the rows of `docs` where `learn` holds, with a language and a letter; None without any."""
    spark = docs.sparkSession
    rows = docs.where(learn & F.col("lang").isNotNull() & has_letter()).select("text", "lang", "doc_id")
    languages = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # one row per language
    if not languages:
        return None
    names, total = sorted(languages), sum(languages.values())

    def add(batch: pa.RecordBatch, sums: np.ndarray) -> None:
        for text in texts_of(batch):
            sums[ngram_counts(text)[0]] += 1

    idf = np.log((1 + total) / (1 + partition_sum(rows.select("text"), add, BUCKETS))) + 1
    sent = spark.sparkContext.broadcast((names, idf))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, idf = sent.value
        for batch in batches:
            pairs = [tfidf(t, idf) for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("shard"),
                    pa.array([names.index(x) for x in batch.column("lang").to_pylist()], pa.int32()),
                    pa.array([b.astype(np.int32) for b, _ in pairs], pa.list_(pa.int32())),
                    pa.array([v.astype(np.float32) for _, v in pairs], pa.list_(pa.float32())),
                ],
                names=["shard", "label", "buckets", "values"],
            )

    shard = F.pmod(F.xxhash64("doc_id", "text"), F.lit(SHARDS + 1)).cast("int").alias("shard")
    sample = rows.where(sampled(max_train, total, "doc_id", "text")).select(shard, "lang", "text")
    sample = stage(
        sample.mapInArrow(vectors, "shard int, label int, buckets array<int>, values array<float>"), "language-sample"
    )

    def pack(group: pa.Table) -> pa.Table:
        return pa.table({"data": [pickle.dumps(_examples(group))]})

    # A shard becomes one value of bounded size, written once: rounds read it and shuffle nothing.
    learning = sample.where(F.col("shard") < SHARDS).groupBy("shard").applyInArrow(pack, "data binary")
    learning = stage(learning, "language-shards")
    shape = (BUCKETS + 1, len(names))
    z, n = np.zeros(shape), np.zeros(shape)
    for _ in range(ROUNDS):
        state = spark.sparkContext.broadcast((z, n))

        def epoch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for data in batch.column("data").to_pylist():
                    z, n = (x.copy() for x in state.value)
                    ftrl_epoch(pickle.loads(data), z, n)
                    yield pa.RecordBatch.from_pydict({"z": [z.tobytes()], "n": [n.tobytes()]})

        states = learning.mapInArrow(epoch, "z binary, n binary").collect()  # SHARDS states of a size set by BUCKETS
        states.sort()
        if states:
            z = np.mean([np.frombuffer(s["z"]).reshape(shape) for s in states], axis=0)
            n = np.mean([np.frombuffer(s["n"]).reshape(shape) for s in states], axis=0)
    weights = _ftrl_weights(z, n)
    kept = _examples(sample.where(F.col("shard") == SHARDS).toArrow())  # a ninth of the bounded sample
    logits = np.array([v @ weights[b] + weights[-1] for b, v, _ in kept])
    return LanguageModel(names, idf, weights, fit_temperature(logits, np.array([y for _, _, y in kept], dtype=int)))


def _examples(group: pa.Table) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """(buckets, values, label) in an order of their content, so that every run takes the same steps."""
    columns = [group.column(c) for c in ("buckets", "values", "label")]
    rows = [
        (np.array(b.as_py(), dtype=np.int64), np.array(v.as_py(), dtype=np.float64), y.as_py()) for b, v, y in zip(*columns)
    ]
    rows.sort(key=lambda r: (xxhash.xxh64_intdigest(r[0].tobytes()), r[2]))
    return [(b.astype(np.int32), v.astype(np.float32), y) for b, v, y in rows]


@keeps_columns
def identify_languages(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """`docs` with `lang_pred` and `score`, the calibrated probability of that language.

    Null texts and texts without a letter are `und` with score 0, and so is every text if there is no model.
    Equal texts get equal results. Ties go to the first language in alphabetical order. All input columns
    stay; `lang_pred` and `score` are replaced.
    """
    und = {"lang_pred": F.lit("und"), "score": F.lit(0.0)}
    if model is None:
        return with_results(docs, **und)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = sent.value
        for batch in texts:
            out = []
            for text in batch:
                p = _softmax(model.logits(text or "") / model.temperature)
                best = int(np.argmax(p))
                out.append((model.languages[best], round(float(p[best]), 6)))
            yield pd.DataFrame(out, columns=["lang_pred", "score"])

    judge = F.pandas_udf(predict, "lang_pred string, score double")
    rows = docs.withColumn("_qjudged", judge("text"))
    return with_results(
        rows,
        lang_pred=F.when(has_letter(), F.col("_qjudged.lang_pred")).otherwise("und"),
        score=F.when(has_letter(), F.col("_qjudged.score")).otherwise(0.0),
    ).drop("_qjudged")
