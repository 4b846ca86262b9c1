"""Approximate nearest neighbours: a hierarchical k-means tree, searched best bin first.

The tree is fitted on a sample that grows with the square root of the table (a parameter; leaves and their sizes
then both do); every vector is sent down to its leaf. A query keeps a priority
queue of unopened branches by distance and opens the nearest one next, which ranks the leaves for it. How many
leaves it visits is calibrated: a bounded set of queries is answered exactly against all vectors, and visits
are widened until the leaves visited hold the wanted share of the true neighbours.

Equal vectors are one row of the index, with their `k + 1` smallest ids: no more of a group of copies can be
among the `k` nearest, so this is exact and keeps copies out of the search. A leaf is searched in slots of
bounded size, and so are the queries that visit it: a large or much visited leaf is many tasks.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from quirefold.session import stage

SAMPLE, SAMPLE_GROWTH = 20_000, 20  # sampled vectors: at least, and per square root of the rows
LEAF_ROWS, LEAF_SAMPLE = 256, 8  # wanted rows of the whole index, and least sampled vectors, in a leaf
BRANCHES, STEPS = 8, 8
SLOT_ROWS = 1024
QUERY_ROWS = 4096
CALIBRATION = 128


@dataclass
class Node:
    centre: np.ndarray
    children: list[Node] = field(default_factory=list)
    leaf: int = -1


def grow(vectors: np.ndarray, least: int, draw: np.random.Generator, leaves: list[Node]) -> Node:
    """Split by k-means on the unit sphere until a node holds fewer than `2 * least` sampled vectors."""
    node = Node(_unit(vectors.sum(0, keepdims=True))[0] if len(vectors) else np.zeros(0))
    if len(vectors) >= 2 * least:
        branches = min(BRANCHES, len(vectors) // least)
        centres = vectors[draw.choice(len(vectors), branches, replace=False)]
        for _ in range(STEPS):
            owner = np.argmax(vectors @ centres.T, axis=1)
            sums = np.zeros_like(centres)
            np.add.at(sums, owner, vectors)
            centres = np.where(np.linalg.norm(sums, axis=1, keepdims=True) > 0, _unit(sums), centres)
        owner = np.argmax(vectors @ centres.T, axis=1)
        parts = [vectors[owner == b] for b in range(branches)]
        if max(map(len, parts)) < len(vectors):  # equal directions cannot be split
            node.children = [grow(p, least, draw, leaves) for p in parts if len(p)]
            return node
    node.leaf = len(leaves)
    leaves.append(node)
    return node


def _unit(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, dtype=np.float64)
    scale = np.abs(x).max(axis=-1, keepdims=True) if x.size else 1.0
    x = x / np.where(scale > 0, scale, 1)  # tiny and huge components neither vanish nor overflow
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-300)


def leaf_order(root: Node, vector: np.ndarray, most: int | None = None) -> list[int]:
    """Leaves by best bin first: the nearest unopened branch is opened next, down to a leaf."""
    order, queue, number = [], [(0.0, 0, root)], 0
    while queue and (most is None or len(order) < most):
        _, _, node = heapq.heappop(queue)
        while node.children:
            near = np.stack([c.centre for c in node.children]) @ vector
            best = int(np.argmax(near))
            for i, child in enumerate(node.children):
                if i != best:
                    number += 1
                    heapq.heappush(queue, (-float(near[i]), number, child))
            node = node.children[best]
        order.append(node.leaf)
    return order


def leaves_of(root: Node, vectors: np.ndarray) -> np.ndarray:
    """The first leaf of every vector: a batch goes down together, one matrix product per node."""
    out = np.zeros(len(vectors), dtype=np.int32)
    waiting = [(root, np.arange(len(vectors)))]
    while waiting:
        node, rows = waiting.pop()
        if not node.children:
            out[rows] = node.leaf
            continue
        owner = np.argmax(vectors[rows] @ np.stack([c.centre for c in node.children]).T, axis=1)
        waiting += [(child, rows[owner == i]) for i, child in enumerate(node.children) if (owner == i).any()]
    return out


def sample_size(total: int) -> int:
    return max(SAMPLE, SAMPLE_GROWTH * math.isqrt(total))


def usable(vector: str) -> Column:
    """Vectors with components that are all finite, and not all zero."""
    x = F.col(vector)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return x.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(x, lambda v: v != 0)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten(), dtype=np.float64).reshape(len(flat), -1)


def cosines(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Cosines in double precision, each pair by the same sums whatever the shape of the blocks."""
    a, b = _unit(queries), _unit(vectors)
    return np.clip(np.stack([np.einsum("ij,j->i", b, q) for q in a]) if len(a) else np.zeros((0, len(b))), -1, 1)


def nearest(
    vectors: DataFrame, is_query: Column, k: int = 5, target_recall: float = 0.97, sample: int | None = None
) -> DataFrame:
    """query_id, rank, vec_id, score: for each query the k nearest other rows found, nearest first.

    `vectors` holds vec_id and embedding; rows where `is_query` holds are the queries, all other rows are
    candidates, and so are the other queries. Nearness is the cosine on the original vectors in double
    precision; ties go to the smaller vec_id. Vectors that are null, zero or hold null or non-finite
    components take no part, nor do rows without vec_id and vectors of another length than most. Repeated rows of
    a vec_id count once. Fewer candidates than k give fewer rows; an empty table gives none. `sample` is about how
    many distinct vectors the tree is fitted on (default `sample_size`). Other columns are ignored.
    """
    spark = vectors.sparkSession
    kind = vectors.schema["vec_id"].dataType.simpleString()
    rows = vectors.where(F.col("vec_id").isNotNull() & usable("embedding"))
    rows = rows.select("vec_id", F.col("embedding").cast("array<double>").alias("v"), is_query.alias("q"))
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    rows = rows.where(F.size("v") == F.lit(lengths["d"] if lengths else 0))
    # Minus zero counts as zero, so that equal vectors are equal bit by bit.
    rows = rows.withColumn("v", F.transform("v", lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x)))
    keyed = rows.withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(1), "v")})
    keyed = stage(keyed, "vectors")
    few = Window.partitionBy("h1", "h2").orderBy("vec_id")
    smallest = keyed.dropDuplicates(["vec_id"]).select("h1", "h2", "vec_id")
    smallest = smallest.withColumn("n", F.row_number().over(few)).where(F.col("n") <= k + 1)
    ids = smallest.groupBy("h1", "h2").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    distinct = keyed.groupBy("h1", "h2").agg(F.first("v").alias("v"), F.bool_or("q").alias("q"))
    index = stage(distinct.join(ids, ["h1", "h2"]), "distinct-vectors")
    total = index.count()
    result = f"query_id {kind}, rank int, vec_id {kind}, score double"
    if not total:
        return spark.createDataFrame([], result)

    part = F.pmod("h2", F.lit(1 << 30))
    size = sample or sample_size(total)
    drawn = index.where(part < int((1 << 30) * min(1.0, size / total))).orderBy("h1", "h2").limit(2 * size)
    sampled = _unit(_matrix(drawn.select("v").toArrow().column("v")))
    leaves: list[Node] = []
    least = max(LEAF_SAMPLE, math.ceil(LEAF_ROWS * len(sampled) / total))
    root = grow(sampled, least, np.random.default_rng(3), leaves)
    tree = spark.sparkContext.broadcast(root)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = leaves_of(tree.value, _unit(_matrix(batch.column("v"))))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(leaf, pa.int32())], names=[*batch.schema.names, "leaf"]
            )

    fields = f"h1 long, h2 long, v array<double>, q boolean, ids array<{kind}>"
    placed = stage(index.mapInArrow(assign, f"{fields}, leaf int"), "placed-vectors")
    visits = _calibrated_visits(placed, root, len(leaves), k, target_recall)

    def orders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, cell = [], []
            for i, v in enumerate(_unit(_matrix(batch.column("v")))):
                leaves_ = leaf_order(tree.value, v, visits)
                cell += leaves_
                at += [i] * len(leaves_)
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c).take(take) for c in ("h1", "h2")], pa.array(cell, pa.int32())], names=["h1", "h2", "leaf"]
            )

    asked = placed.where("q").select("h1", "h2", "v")
    visited = stage(asked.mapInArrow(orders, "h1 long, h2 long, leaf int"), "visits")
    # One row per leaf: into how many slots its vectors, and the queries that visit it, are cut.
    held_rows = placed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"))
    query_rows = visited.groupBy("leaf").agg(F.count(F.lit(1)).alias("m"))
    slots = stage(
        held_rows.join(query_rows, "leaf").select(
            "leaf",
            (1 + F.call_function("div", "n", F.lit(SLOT_ROWS))).cast("int").alias("slots"),
            (1 + F.call_function("div", "m", F.lit(QUERY_ROWS))).cast("int").alias("parts"),
        ),
        "leaf-slots",
    )
    part = F.pmod("h2", F.col("parts")).cast("int").alias("part")
    routes = visited.join(F.broadcast(slots), "leaf").select(
        "h1", "h2", "leaf", part, F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("slot")
    )
    asked = routes.join(asked, ["h1", "h2"]).select("h1", "h2", F.col("v").alias("asked"), "leaf", "slot", "part")
    held = placed.join(F.broadcast(slots), "leaf").select(
        "leaf", F.pmod("h1", F.col("slots")).cast("int").alias("slot"), "v", "ids",
        F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
    )

    def search(queries: pa.Table, stored: pa.Table) -> pa.Table:
        out: dict[str, list] = {"h1": [], "h2": [], "vec_id": [], "score": []}
        ids = stored.column("ids").to_pylist() if len(stored) else []
        vectors = _matrix(stored.column("v")) if len(stored) else None
        h1, h2 = queries.column("h1").to_pylist(), queries.column("h2").to_pylist()
        for low in range(0, len(h1) if ids else 0, 256):
            near = cosines(_matrix(queries.column("asked").slice(low, 256)), vectors)
            for i, row in enumerate(near):
                # k + 1 distinct vectors and all that tie with the last hold the k nearest ids besides the query's.
                cut = np.partition(row, len(row) - k - 1)[len(row) - k - 1] if len(row) > k + 1 else -2.0
                best = [(-float(row[j]), x) for j in np.flatnonzero(row >= cut) for x in ids[j]]
                for score, x in heapq.nsmallest(k + 1, best):
                    out["h1"].append(h1[low + i]), out["h2"].append(h2[low + i])
                    out["vec_id"].append(x), out["score"].append(-score)
        return pa.table(out, schema=pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("vec_id", id_type), ("score", pa.float64())]))

    id_type = _arrow_type(vectors)
    pairs = asked.groupBy("leaf", "slot", "part").cogroup(held.groupBy("leaf", "slot", "part"))
    found = pairs.applyInArrow(search, f"h1 long, h2 long, vec_id {kind}, score double")
    # Of a distinct vector the best k + 1 are kept; each of its queries then leaves itself out.
    order = Window.partitionBy("h1", "h2").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
    lists = stage(
        found.groupBy("h1", "h2").agg(F.sort_array(F.collect_list(F.struct("n", "vec_id", "score"))).alias("best")), "nearest"
    )
    queries = keyed.where("q").select("h1", "h2", F.col("vec_id").alias("query_id")).distinct()
    others = F.slice(F.filter("best", lambda b: b["vec_id"] != F.col("query_id")), 1, k)
    answered = queries.join(lists, ["h1", "h2"]).select("query_id", F.posexplode(others).alias("rank", "b"))
    return answered.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), "b.vec_id", "b.score")


def _arrow_type(df: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema["vec_id"].dataType)


def _calibrated_visits(placed: DataFrame, root: Node, n_leaves: int, k: int, target: float) -> int:
    """Visits after which the leaves hold `target` of the true neighbours of at most CALIBRATION queries."""
    spark = placed.sparkSession
    total = placed.count()
    chance = int((1 << 30) * min(1.0, 4 * CALIBRATION / total))
    asked = placed.where(F.pmod("h1", F.lit(1 << 30)) < chance).orderBy("h1", "h2").limit(CALIBRATION)
    asked = asked.select("h1", "h2", "v").toArrow()
    if not len(asked):
        return n_leaves
    queries = _unit(_matrix(asked.column("v")))
    own = list(zip(asked.column("h1").to_pylist(), asked.column("h2").to_pylist()))
    sent = spark.sparkContext.broadcast((queries, own))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, own = sent.value
        best: list[list[tuple[float, int]]] = [[] for _ in own]
        for batch in batches:
            if not len(batch):
                continue
            near = queries @ _unit(_matrix(batch.column("v"))).T
            keys = list(zip(batch.column("h1").to_pylist(), batch.column("h2").to_pylist()))
            leaf = batch.column("leaf").to_pylist()
            for i, row in enumerate(near):
                top = np.argpartition(-row, min(k, len(row) - 1))[: k + 1]
                best[i] = heapq.nlargest(k, best[i] + [(float(row[j]), leaf[j]) for j in top if keys[j] != own[i]])
        rows = [(i, score, leaf) for i, found in enumerate(best) for score, leaf in found]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.float64()), pa.array([r[2] for r in rows], pa.int32())],
            names=["i", "score", "leaf"],
        )

    order = Window.partitionBy("i").orderBy(F.desc("score"), "leaf")
    truth = placed.select("h1", "h2", "v", "leaf").mapInArrow(exact, "i int, score double, leaf int")
    truth = truth.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).collect()  # CALIBRATION * k rows
    ranks = [{leaf: n for n, leaf in enumerate(leaf_order(root, q))} for q in queries]
    needed = np.sort([ranks[r["i"]][r["leaf"]] + 1 for r in truth])
    return int(needed[min(len(needed) - 1, math.ceil(target * len(needed)) - 1)]) if len(needed) else n_leaves
