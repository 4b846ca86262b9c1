"""Positions inside a group, without ever putting a whole group into one task.

A group (a document, a title) may hold a large share of all rows. Every helper here therefore cuts
groups into blocks of `BLOCK` consecutive positions, works on (group, block), and carries only one
row per block between blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quirefold.session import stage

BLOCK = 4096


def block_of(position: str | Column, block: int = BLOCK) -> Column:
    position = F.col(position) if isinstance(position, str) else position
    return F.call_function("div", position, F.lit(block))  # integral: exact for positions of any size


def running_total(
    df: DataFrame, keys: list[str], position: str, value: Column, name: str, block: int = BLOCK
) -> DataFrame:
    """Add `name`: the sum of `value` over all rows of the group with a smaller position."""
    df = df.withColumns({"_block": block_of(position, block), "_value": value.cast("long")})
    blocks = df.groupBy(*keys, "_block").agg(F.sum("_value").alias("_total"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select(*keys, "_block", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset"))
    inside = (
        Window.partitionBy(*keys, "_block").orderBy(position).rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        df.join(offsets, [*keys, "_block"])
        .withColumn(name, F.coalesce(F.sum("_value").over(inside), F.lit(0)) + F.col("_offset"))
        .drop("_block", "_value", "_offset")
    )


def running_total_in_row_groups(
    df: DataFrame, keys: list[str], position: str, value: Column, name: str
) -> DataFrame:
    """`running_total` for groups that came out of one input row, which bounds them: one window."""
    before = Window.partitionBy(*keys).orderBy(position).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.sum(value.cast("long")).over(before), F.lit(0)))


def dense_index(
    df: DataFrame, keys: list[str], position: str, name: str, row_groups: bool = False, block: int = BLOCK
) -> DataFrame:
    """Add `name`: 0, 1, 2, ... in the order of `position`, which may have gaps.

    `row_groups=True` says that each group came out of one input row and is bounded by it.
    """
    if row_groups:
        return running_total_in_row_groups(df, keys, position, F.lit(1), name)
    return running_total(df, keys, position, F.lit(1), name, block)


def place_in_order(df: DataFrame, column: str, name: str) -> DataFrame:
    """`df` with `name`, the position from 0 of every row in the order of `column` over the whole table, written.

    Rows are sorted by range, and only a count per part travels. The values should differ.
    """
    parts = df.repartitionByRange(column).sortWithinPartitions(column)
    parts = stage(parts.withColumn("_row", F.monotonically_increasing_id()), "ordered")
    part, row = F.shiftright("_row", 33), F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))
    counts = parts.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))  # one row per part
    rows = parts.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return rows.withColumn(name, row + F.col("_offset")).drop("_row", "_part", "_offset")


def attach_facts(
    rows: DataFrame, facts: DataFrame, key: str, position: str, last: str, block: int = BLOCK
) -> DataFrame:
    """Join one fact row per group to the rows of the group, block by block.

    `last` is the fact column with the largest position of the group. Each fact row is repeated once
    per block, so ordinary groups are not repeated at all and no join key holds more than one block.
    The result keeps `_block`: a second call on it finds its rows already partitioned by the join key.
    """
    spread = facts.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), block_of(last, block))))
    if "_block" not in rows.columns:
        rows = rows.withColumn("_block", block_of(position, block))
    return rows.join(spread, [key, "_block"])
