"""Chunk ids, batch numbers and per-title counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quirefold.operators.ordering import dense_index


def title_hash(title: Column, hash_chars: int = 16) -> Column:
    return F.substring(F.sha2(title.cast("binary"), 256), 1, hash_chars)


def assign_ids(chunks: DataFrame, hash_chars: int = 16, row_groups: bool = False) -> DataFrame:
    """Add `row_idx`, the 0-based row number inside the title, and `id` = title hash, dash, row number.

    Drop blank chunks first: ids count the rows that are left.
    """
    numbered = dense_index(chunks, ["title"], "chunk_idx", "row_idx", row_groups)
    return numbered.withColumn(
        "id", F.concat_ws("-", title_hash(F.col("title"), hash_chars), F.col("row_idx").cast("string"))
    )


def insert_batches(rows: DataFrame, batch_size: int = 32) -> DataFrame:
    """Add `batch`, the number of the fixed-size insert batch inside the title."""
    return rows.withColumn("batch", F.floor(F.col("row_idx") / batch_size))


def document_metadata(chunks: DataFrame) -> DataFrame:
    """One row per title: the metadata of its first chunk, which stands for all its chunks."""
    return chunks.groupBy("title").agg(F.min_by("zip_name", "chunk_idx").alias("zip_name"))


def title_counts(store: DataFrame) -> DataFrame:
    return store.groupBy("title").agg(F.count("*").alias("n_chunks"))
