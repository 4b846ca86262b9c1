"""Embedding hooks. An embedder turns a text column into a vector column.

Two kinds exist. `HashEmbedder` needs no model and is deterministic: the default for tests and offline
runs, without any claim on quality. `ModelEmbedder` runs a user's batch function. Both work on Arrow
batches. Cutting and retrieval take separate embedders, since they may use different models.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, functions as F
from pyspark.sql.types import ArrayType, DoubleType

from quirefold.functions.text import fold_text
from quirefold.functions.vectors import unit_rows

VECTOR = ArrayType(DoubleType())  # a type's name would need a session to be read
KEPT_WORDS = 1 << 18  # words whose buckets a task keeps
SLICE_CHARS = 1 << 20  # characters whose words a task holds at a time
SLICE_TEXTS = 1 << 13  # texts whose counts a task holds at a time
# Bytes of folded texts: a-z and 0-9 stay, A-Z become lower case, all others end a word.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


class _Buckets(dict):
    """Bucket of every word: the first eight hex digits of its MD5, modulo `dim`. Keeps the words met last."""

    def __init__(self, dim: int):
        self.dim = dim

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        bucket = self[word] = int(hashlib.md5(word, usedforsecurity=False).hexdigest()[:8], 16) % self.dim
        return bucket


def _words(text: str) -> list[bytes]:
    plain = text if text.isascii() else fold_text(text).lower()
    return plain.encode().translate(WORD_BYTES).split()


def _word_counts(texts: list[str], buckets: _Buckets) -> np.ndarray:
    """One row of bucket counts per text."""
    words = [_words(text) for text in texts]
    rows = np.repeat(np.arange(len(texts)), [len(w) for w in words])
    found = np.fromiter(map(buckets.__getitem__, chain.from_iterable(words)), dtype=np.int64, count=len(rows))
    counts = np.bincount(rows * buckets.dim + found, minlength=len(texts) * buckets.dim)
    return counts.reshape(len(texts), buckets.dim).astype(float)


def _slices(texts: list[str]) -> Iterator[list[str]]:
    """Consecutive texts of about `SLICE_CHARS` characters together."""
    start, chars = 0, 0
    for i, text in enumerate(texts):
        chars += len(text)
        if chars >= SLICE_CHARS:
            yield texts[start : i + 1]
            start, chars = i + 1, 0
    if start < len(texts):
        yield texts[start:]


def _window_distances(texts: pa.Array, offsets: np.ndarray, buffer_size: int, buckets: _Buckets) -> pa.Array:
    """Cosine distance between the windows around each text and the next one of its list.

    List i is `texts[offsets[i]:offsets[i + 1]]`. A window's counts are the sums of its texts' counts, taken from
    running sums over a slice and the few texts beside it; all are whole numbers, so no order of adding changes them.
    """
    n = len(texts)
    first, last = (np.repeat(ends, np.diff(offsets)) for ends in (offsets[:-1], offsets[1:]))
    known = texts.is_valid().to_numpy(zero_copy_only=False)
    distances = np.zeros(n)
    for start in range(0, n, SLICE_TEXTS):
        stop = min(start + SLICE_TEXTS, n)
        at = np.arange(start, min(stop + 1, n))  # one more: the window that the last one is compared with
        low, high = max(start - buffer_size, 0), min(stop + 1 + buffer_size, n)
        read = texts.slice(low, high - low).fill_null("").to_pylist()
        sums = np.zeros((high - low + 1, buckets.dim))
        np.cumsum(np.concatenate([_word_counts(part, buckets) for part in _slices(read)]), axis=0, out=sums[1:])
        windows = sums[np.minimum(at + buffer_size + 1, last[at]) - low] - sums[np.maximum(at - buffer_size, first[at]) - low]
        norms = np.sqrt(np.einsum("ij,ij->i", windows, windows))
        scales = norms[:-1] * norms[1:]
        products = np.einsum("ij,ij->i", windows[:-1], windows[1:])
        similar = np.divide(products, scales, out=np.zeros(len(scales)), where=scales > 0)
        distances[start : start + len(scales)] = 1.0 - similar
    missing = np.ones(n, dtype=bool)
    missing[:-1] = ~(known[:-1] & known[1:]) | (np.arange(1, n) == last[:-1])
    return pa.array(distances, pa.float64(), mask=missing)


class HashEmbedder:
    """Counts of words hashed into `dim` buckets; word order is ignored.

    Arrow batches of texts are folded to ASCII and lower case and counted in tasks, each word hashed once.
    """

    additive = True  # the counts of joined texts are the sums of their counts

    def __init__(self, dim: int = 64):
        self.dim = dim
        self._counts, self._unit = self._udf(False), self._udf(True)

    def _udf(self, unit: bool):
        dim = self.dim

        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            buckets = _Buckets(dim)
            for batch in batches:
                texts = batch.fill_null("").to_pylist()
                parts = [_word_counts(part, buckets) for part in _slices(texts)]
                if unit:
                    parts = [unit_rows(part) for part in parts]
                values = np.concatenate(parts).ravel() if parts else np.zeros(0)
                # a text that is null has a vector of nulls
                missing = np.repeat(batch.is_null().to_numpy(zero_copy_only=False), dim)
                offsets = pa.array(np.arange(len(texts) + 1, dtype=np.int32) * dim, pa.int32())
                yield pa.ListArray.from_arrays(offsets, pa.array(values, pa.float64(), mask=missing))

        run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
        return F.arrow_udf(run, VECTOR)

    def counts(self, text: Column) -> Column:
        return self._counts(text)

    def embed(self, text: Column) -> Column:
        """The counts, scaled to unit length; a text without words has a zero vector."""
        return self._unit(text)

    def distances(self, texts: Column, buffer_size: int) -> Column:
        """For an array of texts in order: the cosine distance between the window of `buffer_size` texts on both sides
        of each and that of the next, null for the last. Texts that are null add nothing and have no distance.
        """
        dim = self.dim

        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            buckets = _Buckets(dim)
            for batch in batches:
                offsets = batch.offsets.to_numpy()
                flat = batch.values.slice(offsets[0], offsets[-1] - offsets[0])
                ends = offsets.astype(np.int64) - offsets[0]
                found = _window_distances(flat, ends, buffer_size, buckets)
                yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), found)

        run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
        return F.arrow_udf(run, VECTOR)(texts)


class ModelEmbedder:
    """A user's batch function `list[str] -> array (n, dim)`, called per Arrow batch.

    `load`, when given, is called once per Python task and its result is passed to `encode` as the
    first argument: the place for a model or a service client. Texts that are null are not sent.
    `encode` must be deterministic, or the embedded table must be written before it is used twice.
    """

    additive = False

    def __init__(self, encode: Callable, load: Callable[[], object] | None = None):
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = load() if load else None
            for texts in batches:
                vectors = pd.Series([None] * len(texts), index=texts.index, dtype=object)
                sent = texts[texts.notna()]
                if len(sent):
                    rows = encode(model, sent.tolist()) if load else encode(sent.tolist())
                    for i, row in zip(sent.index, np.asarray(rows, dtype=float), strict=True):
                        vectors.at[i] = row
                yield vectors

        run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
        self._udf = F.pandas_udf(run, VECTOR)

    def embed(self, text: Column) -> Column:
        return self._udf(text)
