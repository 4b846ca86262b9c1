"""Cutting texts into units, and the text window around each unit."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from quirefold.functions.text import PARAGRAPH, unit_array

MAX_WORDS = 350
WINDOW_SEPARATOR = " \n\n"


def split_units(docs: DataFrame, split_regex: str = PARAGRAPH, max_words: int = MAX_WORDS) -> DataFrame:
    """One row per unit: the columns of `docs` without `text`, then `n_units`, `idx`, `sentence`.

    Regex split, packing and numbering happen inside the row, so this step never shuffles.
    """
    carried = [c for c in docs.columns if c != "text"]
    units = docs.select(*carried, unit_array(F.col("text"), split_regex, max_words).alias("_units"))
    # the outer form keeps the optimizer from adding a filter that computes the whole array once more
    return units.select(
        *carried, F.size("_units").alias("n_units"), F.posexplode_outer("_units").alias("idx", "sentence")
    ).where(F.col("idx").isNotNull())


def combine_window(units: DataFrame, buffer_size: int = 1, key: str = "title") -> DataFrame:
    """Add `combined`: the unit with `buffer_size` units before and after it."""
    around = Window.partitionBy(key).orderBy("idx").rowsBetween(-buffer_size, buffer_size)
    return units.withColumn("combined", F.array_join(F.collect_list("sentence").over(around), WINDOW_SEPARATOR))
