"""Nearest chunks of one title for every (title, question) pair.

Candidates are ids and distances only; the texts of the hits are fetched once the ranks are known. The exact
search reads the store once for as many questions as fit into `QUESTION_BYTES` of vectors: each task compares
its Arrow batches with them in slices, and passes on at most `max_k` rows per (title, question) and batch, so
a title may hold any share of the store.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from quirefold.functions.vectors import dot, l2_normalize, round_to, unit_rows
from quirefold.operators.cells import CellIndex, cell_candidates, cell_index
from quirefold.operators.identity import title_counts
from quirefold.operators.ordering import dense_index
from quirefold.operators.signatures import decode, directions, signature_table
from quirefold.session import stage

DISTANCE_DIGITS = 6
QUESTION_BLOCK = 2048  # questions packed into one constant at a time
QUESTION_BYTES = 64 * 1024 * 1024  # question vectors handed to the tasks at a time
FRAME_ROWS = 1_000_000  # candidate rows a task holds at a time
CALIBRATION = 32  # questions answered exactly to find the depth of the approximate search
TARGET_RECALL = 0.97
FIRST_DEPTH = 16  # depth up to which ranks are looked at first
WHOLE_TITLE = 256  # chunks of a title that meets its questions as one row
QUESTIONS_AT_ONCE = 256  # questions such a row meets at a time
SEPARATOR = "\n" + "-" * 86 + "\n"  # fixed value: stands between the passages of a context


def embed_questions(questions: DataFrame, embedder) -> DataFrame:
    """`(q_idx, question)` to `(q_idx, vector)`; one call per question, whatever the number of titles."""
    return questions.select("q_idx", embedder.embed(F.col("question")).alias("vector"))


def question_blocks(questions: DataFrame, size: int | None = None) -> list[DataFrame]:
    """The question table in parts of `size` questions (default `QUESTION_BLOCK`) in the order of `q_idx`.

    Keys may have gaps and be negative; a null key is refused. Every list takes the same path.
    """
    size = size or QUESTION_BLOCK
    keys = questions.select("q_idx", F.lit(0).alias("_list"))
    if not keys.where(F.col("q_idx").isNull()).isEmpty():
        raise ValueError("every question needs a q_idx")
    numbered = dense_index(keys.distinct(), ["_list"], "q_idx", "_n")
    starts = sorted(r["q_idx"] for r in numbered.where(F.col("_n") % size == 0).collect())
    if not starts:
        return [questions]
    after = [F.col("q_idx") < nxt for nxt in starts[1:]] + [F.lit(True)]
    return [questions.where((F.col("q_idx") >= start) & end) for start, end in zip(starts, after)]


def beside_each(rows: DataFrame, questions: DataFrame) -> DataFrame:
    """`rows` with a column `q` for every question, without a join.

    Each part of the question list is packed into one constant and exploded in place, so the rows
    are neither shuffled nor sorted.
    """
    parts = []
    for block in question_blocks(questions):
        packed = block.agg(F.collect_list(F.struct(*block.columns)).alias("q"))
        parts.append(rows.withColumn("q", F.explode(packed.scalar())))
    return reduce(DataFrame.unionByName, parts)


def title_question_pairs(titles: DataFrame, questions: DataFrame) -> DataFrame:
    """Every title with every question: the rows of the answer table."""
    return beside_each(titles.select("title"), questions).select("title", "q.q_idx", "q.question")


# The defaults of the adaptive number of chunks.
def adaptive_k(n: Column, exponent: float = 0.4, factor: float = 2.0, max_k: int = 20) -> Column:
    """How many chunks to fetch from a title with `n` chunks."""
    return F.least((F.pow(n.cast("double"), F.lit(exponent)) * factor).cast("int"), F.lit(max_k))


def _vectors(embeddings: pd.Series) -> np.ndarray:
    return unit_rows(np.stack(embeddings.to_numpy()).astype(float))


def _batch_candidates(
    asked, max_k: int, digits: int | None, column: str = "embedding", read: Callable[[pd.Series], np.ndarray] = _vectors
):
    """Task function: the best rows of each Arrow batch, per title and question, in frames of bounded size.

    `read` turns `column` into one row of numbers per chunk, to be multiplied with those of the questions.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q_idx, questions = asked.value
        for batch in batches:
            batch = batch[batch[column].notna()].sort_values(["title", "id"], kind="stable").reset_index(drop=True)
            if batch.empty:
                continue
            vectors = read(batch[column])
            titles, ids = batch["title"].to_numpy(), batch["id"].to_numpy()
            groups = list(batch.groupby("title", sort=False).indices.values())
            step = max(1, FRAME_ROWS // len(batch))
            for low in range(0, len(q_idx), step):
                distances = 1.0 - vectors @ questions[low : low + step].T
                if digits is not None:
                    distances = np.round(distances, digits) + 0.0
                rows, cols = [], []
                for members in groups:
                    here = distances[members]
                    if len(members) > max_k:
                        # rows are in the order of their ids: a stable sort gives ties to the smaller one
                        members = members[np.argsort(here, axis=0, kind="stable")[:max_k]]
                    else:
                        members = np.repeat(members[:, None], here.shape[1], axis=1)
                    rows.append(members.ravel())
                    cols.append(np.tile(np.arange(here.shape[1]), len(members)))
                rows, cols = np.concatenate(rows), np.concatenate(cols)
                yield pd.DataFrame(
                    {"title": titles[rows], "q_idx": q_idx[low + cols], "id": ids[rows], "distance": distances[rows, cols]}
                )

    return run


def _compared(
    rows: DataFrame, vectors: DataFrame, max_k: int, digits: int | None, turned: bool = False, **options
) -> DataFrame:
    """(title, q_idx, id, distance) by matrix products per Arrow batch, for as many questions at a time as fit.

    With `turned`, the questions are turned by the directions of the signatures first.
    """
    spark = rows.sparkSession
    schema = "title string, q_idx int, id string, distance double"
    parts = []
    for q_idx, matrix in _question_matrices(vectors):
        sent = spark.sparkContext.broadcast((q_idx, matrix @ directions(matrix.shape[1]).T if turned else matrix))
        parts.append(rows.mapInPandas(_batch_candidates(sent, max_k, digits, **options), schema))
    return reduce(DataFrame.unionByName, parts or [spark.createDataFrame([], schema)])


def _question_matrices(vectors: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys and unit vectors of the questions, at most `QUESTION_BYTES` of vectors at a time."""
    width = vectors.select(F.max(F.size("vector"))).first()[0]
    for block in question_blocks(vectors, max(1, QUESTION_BYTES // (8 * max(width or 1, 1)))):
        asked = block.select("q_idx", "vector").toArrow()
        if len(asked):
            yield asked.column("q_idx").to_numpy(), unit_rows(np.array(asked.column("vector").to_pylist(), dtype=float))


def matrix_candidates(store: DataFrame, vectors: DataFrame, max_k: int, digits: int | None = None) -> DataFrame:
    """Candidates by matrix products per Arrow batch; the path for large stores and long vectors."""
    return _compared(store.select("title", "id", "embedding"), vectors, max_k, digits)


def _distance(a: Column, b: Column, digits: int | None) -> Column:
    distance = F.lit(1.0) - dot(a, b)
    return distance if digits is None else round_to(distance, digits)


def native_candidates(store: DataFrame, vectors: DataFrame, max_k: int, digits: int | None = None) -> DataFrame:
    """Candidates by array expressions, without Python workers.

    A chunk meets the questions of a block inside one expression, so no vector is repeated: what leaves it are
    narrow rows of keys and distances. The rank filter that follows becomes a group limit before the shuffle, so
    only the best rows of each task travel. For short question lists and short vectors.
    """
    stored = store.where(F.col("embedding").isNotNull()).select(
        "title", "id", l2_normalize(F.col("embedding")).alias("v")
    )
    parts = []
    for block in question_blocks(vectors.select("q_idx", l2_normalize(F.col("vector")).alias("vector"))):
        asked = block.agg(F.collect_list(F.struct("q_idx", "vector"))).scalar()
        compared = F.transform(
            F.col("asked"), lambda q: F.struct(q["q_idx"].alias("q_idx"), _distance(F.col("v"), q["vector"], digits).alias("distance"))
        )
        beside = stored.withColumn("asked", asked)
        parts.append(beside.select("title", "id", F.inline(compared)).select("title", "q_idx", "id", "distance"))
    return reduce(DataFrame.unionByName, parts)


def _ranked(candidates: DataFrame, most: int, name: str = "rank") -> DataFrame:
    """Candidates with their rank per title and question, up to `most`; ties go to the smaller id."""
    order = Window.partitionBy("title", "q_idx").orderBy("distance", "id")
    return candidates.withColumn(name, F.row_number().over(order)).where(F.col(name) <= most)


def probes(index: DataFrame, vectors: DataFrame, most: int) -> DataFrame:
    """(title, q_idx, id, probe): chunks in the order in which their buckets are visited, the first `most`.

    `index` is a `signature_table`. Buckets are visited by the product of the question with their centre; chunks
    of one bucket in the order of their ids.
    """
    near = _compared(index, vectors, most, DISTANCE_DIGITS, turned=True, column="signature", read=decode)
    return _ranked(near, most, "probe").drop("distance")


def calibrated_depth(
    store: DataFrame, index: DataFrame, vectors: DataFrame, k: DataFrame, max_k: int, digits: int | None, target: float
) -> float:
    """How many times k chunks have to be visited for `target` of the true hits, in quarters.

    Measured on at most `CALIBRATION` questions (a stated bound) against the exact search over the whole store, and
    widened until it is reached. Only a histogram of the visits needed reaches the driver.
    """
    asked = vectors.orderBy(F.md5(F.col("q_idx").cast("string")), "q_idx").limit(CALIBRATION)
    true = _ranked(matrix_candidates(store, asked, max_k, digits), max_k).join(k, "title").where(F.col("rank") <= F.col("k"))
    true = stage(true.select("title", "q_idx", "id", "k"), "true-hits")
    reach = FIRST_DEPTH
    while True:
        met = true.join(probes(index, asked, reach * max_k), ["title", "q_idx", "id"], "left")
        quarters = F.greatest(F.floor(4 * (F.col("probe") - 1) / F.col("k")) + 1, F.lit(4)).alias("quarters")
        needed = {r["quarters"]: r["count"] for r in met.select(quarters).groupBy("quarters").count().collect()}
        total, found = sum(needed.values()), 0
        for depth in sorted(q for q in needed if q is not None and q <= 4 * reach):
            found += needed[depth]
            if found >= target * total:
                return depth / 4
        if None not in needed:
            return float(max(needed, default=4)) / 4
        reach *= 4


def lsh_candidates(
    store: DataFrame,
    vectors: DataFrame,
    max_k: int,
    digits: int | None,
    k: DataFrame,
    target_recall: float = TARGET_RECALL,
    depth: float | None = None,
    index: DataFrame | None = None,
) -> DataFrame:
    """Approximate candidates: chunks of the most promising buckets, with their exact distance.

    Inside each title, buckets of signatures are visited in the order of their promise until `depth` times k
    chunks are met; without `depth`, it is calibrated to `target_recall`. `index` is the `signature_table` of the store, if
    it is kept; vectors are read only to compare those that were met.
    """
    if index is None:
        index = stage(signature_table(store), "signatures")
    if depth is None:
        depth = calibrated_depth(store, index, vectors, k, max_k, digits, target_recall)
    met = probes(index, vectors, math.ceil(depth * max_k)).join(k, "title").where(F.col("probe") <= F.ceil(F.col("k") * depth))
    stored = store.where(F.col("embedding").isNotNull()).select("title", "id", l2_normalize(F.col("embedding")).alias("v"))
    asked = vectors.select("q_idx", l2_normalize(F.col("vector")).alias("qv"))
    pairs = met.select("title", "id", "q_idx").join(stored, ["title", "id"]).join(asked, "q_idx")
    return pairs.select("title", "q_idx", "id", _distance(F.col("v"), F.col("qv"), digits).alias("distance"))


def cells_in_reach(
    store: DataFrame, vectors: DataFrame, max_k: int, digits: int | None, k: DataFrame, index: CellIndex | None = None
) -> DataFrame:
    """Exact candidates from those cells of each title that can hold a hit; `index` is its `cell_index`, if it is kept."""
    index = cell_index(store) if index is None else index
    return cell_candidates(index, list(_question_matrices(vectors)), k, max_k, digits)[0]


METHODS = {"matrix": matrix_candidates, "native": native_candidates}


def retrieve(
    store: DataFrame,
    vectors: DataFrame,
    exponent: float = 0.4,
    factor: float = 2.0,
    max_k: int = 20,
    method: str = "matrix",
    counts: DataFrame | None = None,
    digits: int | None = None,
    **options,
) -> DataFrame:
    """Hits `(title, q_idx, rank, id, chunk, distance)`: the adaptive top-k of each title.

    `store` has `title, id, chunk, embedding`; `vectors` has `q_idx, vector`. Ties go to the smaller id;
    `digits` rounds distances before they are ranked. Two filters on purpose: the constant bound is what Spark
    can push in front of the shuffle. Texts join when the ranks are final. `method` is `matrix` or `native`, which compare
    all chunks, `cells`, which skips those that cannot be hits (all three exact), or `lsh`; the last two take the
    `options` of `cells_in_reach` and `lsh_candidates`.
    """
    k = title_counts(store) if counts is None else counts
    k = k.select("title", adaptive_k(F.col("n_chunks"), exponent, factor, max_k).alias("k"))
    if method in ("lsh", "cells"):
        search = lsh_candidates if method == "lsh" else cells_in_reach
        candidates = search(store, vectors, max_k, digits, k, **options)
    else:
        candidates = METHODS[method](store, vectors, max_k, digits)
    best = _ranked(candidates, max_k).join(k, "title").where(F.col("rank") <= F.col("k"))
    return best.join(store.select("title", "id", "chunk"), ["title", "id"]).select(
        "title", "q_idx", "rank", "id", "chunk", "distance"
    )


def context_blocks(hits: DataFrame, separator: str = SEPARATOR) -> DataFrame:
    """One row per pair: `docs`, the hit chunks in rank order, and `context`, numbered and joined.

    A pair has at most `max_k` hits, so the group is small.
    """
    ranked = F.array_sort(F.collect_list(F.struct("rank", "chunk")))
    grouped = hits.groupBy("title", "q_idx").agg(ranked.alias("_ranked"))
    numbered = F.transform("_ranked", lambda h: F.concat(h["rank"].cast("string"), F.lit(".\n"), h["chunk"]))
    return grouped.select(
        "title",
        "q_idx",
        F.transform("_ranked", lambda h: h["chunk"]).alias("docs"),
        F.array_join(numbered, separator).alias("context"),
    )


def hits_of_row(
    row: pa.ListScalar, ids: list[str] | None, questions: np.ndarray, k: int, digits: int | None
) -> np.ndarray | list[list[tuple[int, int]]] | None:
    """Hits of one row's chunks, which are in the order of their ids, for each question; None for a row without vectors.

    An array has the places of the hits in the order of their ranks. `ids` are given where some of them are equal: a hit
    then stands for all chunks of its id, as it does where texts are joined by id, and there are lists of (rank, place).
    """
    vectors = row.values
    held = np.flatnonzero(vectors.is_valid().to_numpy(zero_copy_only=False)) if vectors is not None else ()
    if not len(held):
        return None
    flat = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(held), -1)
    distances = 1.0 - unit_rows(flat.astype(float)) @ questions.T
    if digits is not None:
        distances = np.round(distances, digits) + 0.0
    order = held[np.argsort(distances, axis=0, kind="stable")[:k]].T
    if ids is None:
        return order
    same = {}
    for place, name in enumerate(ids):
        if name is not None:
            same.setdefault(name, []).append(place)
    return [[(r, p) for r, hit in enumerate(hits, 1) for p in same.get(ids[hit], [])] for hits in order]


def _row_hits(asked, digits: int | None):
    """Task function: ranks and places of the hits of each row's chunks, for the questions of the row's part."""

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        parts = asked.value
        for embeddings, ids, ks, numbers in batches:
            sizes, lengths, ranks, places = [], [], [], []
            rows = zip(embeddings, ids, ks.to_pylist(), numbers.to_pylist(), strict=True)
            for row, names, k, number in rows:
                questions = parts[number]
                sizes.append(len(questions))
                found = hits_of_row(row, names.as_py(), questions, k, digits)
                if found is None:
                    lengths.append(np.zeros(len(questions), np.int64))
                elif isinstance(found, np.ndarray):
                    lengths.append(np.full(len(found), found.shape[1]))
                    ranks.append(np.tile(np.arange(1, found.shape[1] + 1), len(found)))
                    places.append(found.ravel())
                else:
                    lengths.append(np.array([len(hits) for hits in found]))
                    pairs = np.array([pair for hits in found for pair in hits], dtype=np.int64).reshape(-1, 2)
                    ranks.append(pairs[:, 0])
                    places.append(pairs[:, 1])
            columns = [np.concatenate([*c, np.zeros(0, np.int64)]).astype(np.int32) for c in (ranks, places)]
            pairs = pa.StructArray.from_arrays([pa.array(c, pa.int32()) for c in columns], ["rank", "place"])
            starts = [np.concatenate([[0], *c]).cumsum().astype(np.int32) for c in (lengths, [sizes])]
            inner = pa.ListArray.from_arrays(pa.array(starts[0], pa.int32()), pairs)
            yield pa.ListArray.from_arrays(pa.array(starts[1], pa.int32()), inner)

    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, ...]], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "array<array<struct<rank: int, place: int>>>")


def title_rows(
    store: DataFrame, titles: DataFrame, exponent: float = 0.4, factor: float = 2.0, max_k: int = 20
) -> DataFrame:
    """One row per title: `_chunks` and `_embeddings` in the order of their ids, `_ids` where some are equal, and `_k`.

    The exchange has as many parts as `spark.sql.shuffle.partitions`: narrowed by bytes there would be few more than
    cores, and a row is small beside the work of meeting all questions.
    """
    parts = int(store.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packed = F.array_sort(F.collect_list(F.struct("id", "chunk", "embedding")))
    held = store.select("id", "title", "chunk", "embedding").repartition(parts, "title").groupBy("title")
    rows = titles.select("title").repartition(parts, "title").join(held.agg(packed.alias("_held")), "title", "left")
    ids = F.col("_held.id")
    repeated = (F.size(F.array_distinct(ids)) < F.size(ids)) | F.exists(ids, lambda x: x.isNull())
    return rows.select(
        "title",
        F.col("_held.chunk").alias("_chunks"),
        F.col("_held.embedding").alias("_embeddings"),
        F.when(repeated, ids).alias("_ids"),
        adaptive_k(F.size("_held"), exponent, factor, max_k).alias("_k"),
    )


def question_slices(questions: DataFrame, embedder) -> Iterator[tuple[DataFrame, list[tuple[list[str], np.ndarray]]]]:
    """Blocks of questions of at most `QUESTION_BYTES` of vectors, each with its slices of `QUESTIONS_AT_ONCE` questions:
    their texts and unit vectors in the order of `q_idx`."""
    width = embed_questions(questions, embedder).select(F.max(F.size("vector"))).first()[0]
    for block in question_blocks(questions, max(1, QUESTION_BYTES // (8 * max(width or 1, 1)))):
        asked = block.select("q_idx", "question", embedder.embed(F.col("question")).alias("vector")).orderBy("q_idx").toArrow()
        if len(asked):
            texts = asked.column("question").to_pylist()
            matrix = unit_rows(np.array(asked.column("vector").to_pylist(), dtype=float))
            lows = range(0, len(texts), QUESTIONS_AT_ONCE)
            yield block, [(texts[low : low + QUESTIONS_AT_ONCE], matrix[low : low + QUESTIONS_AT_ONCE]) for low in lows]


def beside_slices(rows: DataFrame, slices: list) -> DataFrame:
    """`rows` with `_part`, the number of every slice of a block of questions."""
    return rows.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(len(slices) - 1))))


def question_at(block: DataFrame, part: Column, at: Column) -> Column:
    """`(q_idx, question)` of a block, by the number of its slice and its place in the slice."""
    texts = block.agg(F.sort_array(F.collect_list(F.struct("q_idx", "question"))).alias("q")).scalar()
    return F.get(texts, part * QUESTIONS_AT_ONCE + at)


def title_contexts(
    store: DataFrame,
    titles: DataFrame,
    questions: DataFrame,
    embedder,
    exponent: float = 0.4,
    factor: float = 2.0,
    max_k: int = 20,
    digits: int | None = None,
    separator: str = SEPARATOR,
) -> DataFrame:
    """`(title, q_idx, question, docs, context)` for every title and question: `context_blocks` beside its pairs.

    The chunks of a title become one row, which meets the questions in its task: nothing that is as long as the pairs
    is shuffled or sorted. For titles of at most `WHOLE_TITLE` chunks and questions of different `q_idx`.
    """
    spark = store.sparkSession
    rows = title_rows(store, titles, exponent, factor, max_k)
    parts = []
    for block, slices in question_slices(questions, embedder):
        hits = _row_hits(spark.sparkContext.broadcast([matrix for _, matrix in slices]), digits)
        met = beside_slices(rows, slices).withColumn("_hits", hits("_embeddings", "_ids", "_k", "_part"))
        # the outer form keeps the optimizer from adding a filter that finds all hits once more
        met = met.select("title", "_chunks", "_part", F.posexplode_outer("_hits").alias("_at", "_ranked"))
        parts.append(met.withColumn("_q", question_at(block, F.col("_part"), F.col("_at"))))
    if not parts:
        return spark.createDataFrame([], "title string, q_idx int, question string, docs array<string>, context string")
    chunk_of = lambda h: F.get(F.col("_chunks"), h["place"])
    numbered = F.transform("_ranked", lambda h: F.concat(h["rank"].cast("string"), F.lit(".\n"), chunk_of(h)))
    return reduce(DataFrame.unionByName, parts).select(
        "title",
        "_q.q_idx",
        "_q.question",
        F.transform("_ranked", chunk_of).alias("docs"),
        F.array_join(numbered, separator).alias("context"),
    )
