"""Greedy cuts of a long sequence by a budget, found block by block.

Where a part ends depends on where it begins, so the cuts of a sequence form a chain. Inside a block of consecutive
rows the chain is followed from every row at which it could enter. A part has at most `budget` rows, so a block
is a map of `budget` entries onto the entries of the next one. Maps of neighbouring blocks are composed in rounds
of doubling, which tells every block its true entry; each then marks its own cuts.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quirefold.operators.ordering import block_of, running_total
from quirefold.session import stage

def next_starts(words: np.ndarray, budget: int) -> np.ndarray:
    """For a part that begins at each row, the row behind its end: as many as fit, and at least one."""
    sums = np.concatenate([[0], np.cumsum(words)])
    return np.maximum(np.searchsorted(sums, sums[:-1] + budget, "right") - 1, np.arange(1, len(words) + 1))


def block_map(words: np.ndarray, size: int, budget: int) -> np.ndarray:
    """For each of the first `budget` rows of a block of `size`, how far behind its end the chain leaves it.

    `words` holds the block and the rows behind it that a part may still reach.
    """
    target = next_starts(words, budget)
    leaves = np.zeros(size, dtype=np.int64)
    for i in range(size - 1, -1, -1):
        leaves[i] = target[i] - size if target[i] >= size else leaves[target[i]]
    return leaves[:budget]


def chain(words: np.ndarray, size: int, budget: int, entry: int) -> np.ndarray:
    """Rows of the block at which parts begin, when the chain enters at `entry`."""
    target, found = next_starts(words, budget), []
    while entry < size:
        found.append(entry)
        entry = int(target[entry])
    return np.array(found, dtype=np.int64)


def greedy_cuts(rows: DataFrame, keys: list[str], budget: int, block: int) -> DataFrame:
    """`(*keys, idx, nth)`: the number of the part each row belongs to.

    `rows` are `(*keys, idx, words)` with idx 0, 1, 2, ... per key and `words` of at least 1. A part takes rows as long as
    their words stay within `budget`; a row with more is a part by itself, and number 0 stays free where the first row has more. No task holds more than
    a block and its `budget` followers.
    """
    block = max(block, budget + 1)
    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    own = block_of("idx", block)
    reach = F.greatest(block_of(F.col("idx") - budget - 1, block), F.lit(0).cast("long"))
    spread = stage(rows.select(*keys, "idx", "words", F.explode(F.sequence(reach, own)).alias("_block")), "blocks")

    def per_block(work: Callable[[np.ndarray, int, pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
        def run(group: pa.Table) -> pa.Table:
            group = group.sort_by("idx")
            first = group.column("_block")[0].as_py() * block
            size = int(np.sum(np.asarray(group.column("idx")) < first + block))
            return work(np.asarray(group.column("words")), size, group)

        return run

    def to_map(words: np.ndarray, size: int, group: pa.Table) -> pa.Table:
        leaves = block_map(words, size, budget)
        return group.select([*keys, "_block"])[:1].append_column("map", pa.array([leaves.tolist()], pa.list_(pa.int64())))

    maps = spread.groupBy(*keys, "_block").applyInArrow(per_block(to_map), f"{kinds}, _block long, map array<bigint>")
    maps = stage(maps, "maps")
    blocks = (maps.agg(F.max("_block")).first()[0] or 0) + 1
    step, prefix = 1, maps  # `prefix` leads through the last `step` blocks; each round is one row per block
    while step < blocks:
        before = prefix.select(*keys, (F.col("_block") + step).alias("_block"), F.col("map").alias("_before"))
        joined = prefix.join(before, [*keys, "_block"], "left")
        through = F.transform("_before", lambda e: F.get("map", e.cast("int")))
        whole = F.coalesce(through, F.col("map"))
        prefix = stage(joined.select(*keys, "_block", whole.alias("map")), "prefix-maps")
        step *= 2
    entries = prefix.select(*keys, (F.col("_block") + 1).alias("_block"), F.get("map", F.lit(0)).alias("entry"))

    def to_starts(words: np.ndarray, size: int, group: pa.Table) -> pa.Table:
        entry = group.column("entry")[0].as_py()
        begins = chain(words, size, budget, entry or 0)
        marks = np.zeros(size, dtype=np.int64)
        marks[begins] = 1
        if entry is None and words[0] > budget:
            marks[0] = 2
        return group.select([*keys, "idx"])[:size].append_column("start", pa.array(marks))

    entered = spread.join(entries, [*keys, "_block"], "left")
    starts = entered.groupBy(*keys, "_block").applyInArrow(per_block(to_starts), f"{kinds}, idx long, start long")
    counted = running_total(stage(starts, "starts"), keys, "idx", F.col("start"), "_begun", block)
    return counted.select(*keys, "idx", (F.col("_begun") + F.col("start") - 1).alias("nth"))
