"""Exact order statistics per group, without ever sorting a large group in one task.

Every round counts the values between two bounds in bins of equal width, a few rows per group, and goes on with the
bin that holds the wanted rank, between the least and the largest value found in it. A group is done when its bounds
meet or so few values are left that they are one block; these are sorted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from quirefold.operators.ordering import BLOCK, attach_facts
from quirefold.session import stage

BINS = 1024


def _between(values: DataFrame, state: DataFrame, block: int) -> DataFrame:
    """Values inside the bounds of their group's targets, one row per value and target."""
    facts = state.groupBy("title").agg(
        F.first("last_idx").alias("last_idx"), F.collect_list(F.struct("rank", "skip", "lo", "hi")).alias("targets")
    )  # a handful of targets per group
    rows = attach_facts(values, facts, "title", "idx", "last_idx", block)
    inside = F.filter("targets", lambda t: F.col("metric").between(t["lo"], t["hi"]))
    return rows.select("title", "last_idx", "metric", F.inline(inside))


def order_statistics(values: DataFrame, wanted: DataFrame, block: int = BLOCK, bins: int = BINS) -> DataFrame:
    """(title, rank, value) for `wanted` (title, last_idx, rank): the value of each rank, from 0, in rising order.

    `values` holds (title, idx, metric); nulls do not count. `last_idx` is the largest position of the group.
    Ranks that a group does not have are left out. No task holds more than `block` values of a group.
    """
    spark = values.sparkSession
    values = values.where(F.col("metric").isNotNull()).select("title", "idx", "metric")
    spans = values.groupBy("title").agg(F.min("metric").alias("lo"), F.max("metric").alias("hi"), F.count(F.lit(1)).alias("n"))
    state = wanted.distinct().join(spans, "title").where((F.col("rank") >= 0) & (F.col("rank") < F.col("n")))
    state = stage(state.withColumn("skip", F.lit(0).cast("long")), "selection")
    out = spark.createDataFrame([], "title string, rank long, value double")
    found = [out]
    met, few = F.col("lo") == F.col("hi"), F.col("n") <= block
    while not state.isEmpty():
        found.append(state.where(met).select("title", "rank", F.col("lo").alias("value")))
        last = state.where(~met & few)
        if not last.isEmpty():
            order = Window.partitionBy("title", "rank").orderBy("metric")
            sorted_ = _between(values, last, block).withColumn("at", F.row_number().over(order) - 1 + F.col("skip"))
            found.append(sorted_.where(F.col("at") == F.col("rank")).select("title", "rank", F.col("metric").alias("value")))
        rest = state.where(~met & ~few)
        if rest.isEmpty():
            break
        rows = _between(values, rest, block)
        width = (F.col("metric") - F.col("lo")) / (F.col("hi") - F.col("lo"))
        rows = rows.withColumn("bin", F.least(F.floor(width * bins), F.lit(bins - 1)))
        counted = rows.groupBy("title", "last_idx", "rank", "skip", "bin").agg(
            F.min("metric").alias("lo"), F.max("metric").alias("hi"), F.count(F.lit(1)).alias("n")
        )
        before = Window.partitionBy("title", "rank").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
        counted = counted.withColumn("skip", F.col("skip") + F.coalesce(F.sum("n").over(before), F.lit(0)))
        held = (F.col("skip") <= F.col("rank")) & (F.col("rank") < F.col("skip") + F.col("n"))
        state = stage(counted.where(held).select("title", "last_idx", "rank", "lo", "hi", "n", "skip"), "selection")
    for part in found[1:]:
        out = out.unionByName(part)
    return out


def percentiles(values: DataFrame, sizes: DataFrame, shares: list[float], block: int = BLOCK) -> DataFrame:
    """(title, values): the exact percentiles `shares` (0 to 1) of each title of `sizes` (title, last_idx, n).

    Between two ranks the value is interpolated, as the aggregate `percentile` does.
    """
    at = [((F.col("n") - 1) * F.lit(s)) for s in shares]
    ranks = F.array(*[f(a).cast("long") for a in at for f in (F.floor, F.ceil)])
    wanted = sizes.select("title", "last_idx", F.explode(ranks).alias("rank"))
    found = order_statistics(values, wanted, block).groupBy("title").agg(
        F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("by_rank")
    )
    out = []
    for a in at:
        low, high = F.floor(a), F.ceil(a)
        below, above = F.element_at("by_rank", low.cast("long")), F.element_at("by_rank", high.cast("long"))
        out.append(F.when(low == high, below).otherwise((high - a) * below + (a - low) * above))
    return sizes.join(found, "title").select("title", F.array(*out).alias("values"))
