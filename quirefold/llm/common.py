"""Helpers shared by the operators of this subpackage.

Internal columns start with `_q`; input columns that do so too wait under another name (`keeps_columns`).
Operators select the few columns they need before any exchange and attach their results to the rows by a
content key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from quirefold.session import stage

# The white space and the upper-case letters that the contracts name.
ASCII_SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

KEY = ["_q1", "_q2"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def content_key(*columns: str) -> list[Column]:
    """128 bits that name the content of a row; rows with equal content share it."""
    return [F.xxhash64(*columns).alias(KEY[0]), F.xxhash64(F.lit(1), *columns).alias(KEY[1])]


def remainder(n: int) -> Column:
    """The crc32 of `doc_id` as text modulo `n`; null without an id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def held_out(n: int, r: int) -> Column:
    """Rows kept out of training; a row without an id is not marked, and never learned from either."""
    return F.coalesce(remainder(n) == r, F.lit(False))


def sampled(limit: int, rows: int, *columns: str) -> Column:
    """True for about `limit` of `rows` rows, chosen by content: the same rows in every run."""
    parts = 1 << 30
    return F.pmod(F.xxhash64(F.lit(17), *columns), F.lit(parts)) < int(parts * min(1.0, limit / max(rows, 1)))


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The texts of a batch; null is the empty text."""
    return [t or "" for t in batch.column(name).to_pylist()]


def partition_sum(
    df: DataFrame, add: Callable[[pa.RecordBatch, np.ndarray], None], size: int, block: int = 4096, fan: int = 16
) -> np.ndarray:
    """Sum of vectors of `size` numbers over all rows: `add(batch, total)` adds a batch into a task's total.

    Every task emits its total once, in blocks; blocks are added up in two levels on the executors, so what
    reaches the driver is `size` numbers, whatever the number of rows and tasks.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            add(batch, total)
        slot = TaskContext.get().partitionId() % fan
        starts = [s for s in range(0, size, block) if total[s : s + block].any()]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([slot] * len(starts), pa.int32()),
                pa.array([s // block for s in starts], pa.int32()),
                pa.array([total[s : s + block].tobytes() for s in starts], pa.binary()),
            ],
            names=["slot", "block", "data"],
        )

    def summed(group: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(d) for d in sorted(group.column("data").to_pylist())], axis=0)
        return pa.table(
            {"slot": group.column("slot")[:1], "block": group.column("block")[:1], "data": pa.array([total.tobytes()])}
        )

    schema = "slot int, block int, data binary"
    rows = df.mapInArrow(partial, schema)
    rows = rows.groupBy("slot", "block").applyInArrow(summed, schema)
    rows = rows.groupBy("block").applyInArrow(summed, schema)
    out = np.zeros(size)
    for row in rows.collect():
        part = np.frombuffer(row["data"])
        out[row["block"] * block : row["block"] * block + len(part)] = part
    return out


def with_results(df: DataFrame, **columns: Column) -> DataFrame:
    """Add result columns; one of the same name in the input is replaced."""
    return df.withColumns(columns).drop(*KEY)


def keeps_columns(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """For operators that return their first argument's columns: those named like internal ones keep their values."""

    @wraps(operator)
    def run(rows: DataFrame, *args, **options) -> DataFrame:
        own = [c for c in rows.columns if c.lower().startswith("_q")]
        aside = {c: f"own{i}{c}" for i, c in enumerate(own)}
        while set(aside.values()) & set(rows.columns):
            aside = {c: f"own{a}" for c, a in aside.items()}
        out = operator(rows.withColumnsRenamed(aside), *args, **options)
        return out.withColumnsRenamed({a: c for c, a in aside.items()})

    return run


_ROW_BITS = 33  # of `monotonically_increasing_id`: the row inside its task's part


def _parts_in_order(df: DataFrame, order: list[str]) -> DataFrame:
    """`df` sorted by range, written, with `_qpart` and `_qrow`: the part and the row inside it."""
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order)
    parts = stage(parts.withColumn("_qmid", F.monotonically_increasing_id()), "ordered")
    return parts.withColumns(
        {
            "_qpart": F.shiftright("_qmid", _ROW_BITS),
            "_qrow": F.col("_qmid").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)),
        }
    ).drop("_qmid")


def in_order(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """`df` with `name`, the position from 0 in the order of columns `order` over the whole table, written.

    Rows are range partitioned by all of `order`, so a value that many rows share is split as long as the
    columns behind it differ. Only a count per part travels.
    """
    parts = _parts_in_order(df, order)
    counts = parts.groupBy("_qpart").agg(F.count(F.lit(1)).alias("_qn"))
    return _after_parts(parts, counts, F.col("_qrow"), name).drop("_qpart", "_qrow")


def rows_before(df: DataFrame, column: str, name: str) -> DataFrame:
    """(column, `name`): how many rows of `df` hold a smaller value, one row per distinct value; null is the smallest."""
    values = _parts_in_order(df.groupBy(column).agg(F.count(F.lit(1)).alias("_qsame")), [column])
    counts = values.groupBy("_qpart").agg(F.sum("_qsame").alias("_qn"))
    inside = Window.partitionBy("_qpart").orderBy("_qrow").rowsBetween(Window.unboundedPreceding, -1)
    smaller = values.withColumn("_qsum", F.coalesce(F.sum("_qsame").over(inside), F.lit(0)))
    return _after_parts(smaller, counts, F.col("_qsum"), name).select(column, name)


def _after_parts(parts: DataFrame, counts: DataFrame, inside: Column, name: str) -> DataFrame:
    """Add `name`: `inside` and the counts of all parts before; there is one count per part."""
    before = Window.orderBy("_qpart").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_qpart", F.coalesce(F.sum("_qn").over(before), F.lit(0)).alias("_qoffset"))
    return parts.join(F.broadcast(offsets), "_qpart").withColumn(name, inside + F.col("_qoffset")).drop("_qoffset")


def in_order_within(df: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """`df` with `name`, the position from 0 inside each `group` (never null) in the order of `order`, written.

    A group may hold any share of the rows: it is spread over the parts of the range partitioning, and at most
    one group reaches into a part from the part before, so one carried count per part is all that is joined.
    """
    parts = _parts_in_order(df, [group, *order])
    counts = parts.groupBy(group, "_qpart").agg(F.count(F.lit(1)).alias("_qn"))
    before = Window.partitionBy(group).orderBy("_qpart").rowsBetween(Window.unboundedPreceding, -1)
    carried = counts.select(group, "_qpart", F.sum("_qn").over(before).alias("_qoffset")).where("_qoffset > 0")
    inside = Window.partitionBy("_qpart", group).orderBy("_qrow")
    rows = parts.withColumn(name, (F.row_number().over(inside) - 1).cast("long"))
    rows = rows.join(F.broadcast(carried), ["_qpart", group], "left")
    rows = rows.withColumn(name, F.col(name) + F.coalesce("_qoffset", F.lit(0)))
    return stage(rows.drop("_qpart", "_qrow", "_qoffset"), "numbered")
