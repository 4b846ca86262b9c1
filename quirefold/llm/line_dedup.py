"""Line dedup: lines whose normalised form occurs in many documents leave every document.

Explode the lines, hash their keys, count distinct documents per hash, and put each document together again
from the positions that stay. Only hashes and positions travel for the counting; a text moves once, to meet
its own list of dropped positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quirefold.llm.common import ASCII_SPACE, KEY, LOWER, UPPER, content_key, keeps_columns, with_results
from quirefold.session import stage


def line_key(line: str | Column) -> Column:
    """White space stripped at both ends, A-Z in lower case."""
    line = F.col(line) if isinstance(line, str) else line
    return F.translate(F.btrim(line, F.lit(ASCII_SPACE)), UPPER, LOWER)


def lines_of(text: str = "text") -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)


@keeps_columns
def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """`docs` with `text` reduced to the lines that stay, and `n_lines`, `n_dropped`.

    A key of at least `min_chars` code points found in at least `min_docs` documents loses all its lines.
    Null text is one empty line and becomes the empty text. A document is a distinct (doc_id, text): repeated
    rows count once and all lose the same lines, two texts under one id count as two. A very long text is one row; its
    lines are counted one by one like all others. An empty table stays empty. Other columns pass through;
    columns named `n_lines` or `n_dropped` are replaced.
    """
    lines = docs.select(*content_key("doc_id", "text"), F.posexplode(lines_of()).alias("_qpos", "_qline"))
    lines = lines.select(*KEY, "_qpos", line_key("_qline").alias("_qkey")).where(F.length("_qkey") >= min_chars)
    lines = lines.select(*KEY, "_qpos", F.xxhash64("_qkey").alias("_qh1"), F.xxhash64(F.lit(1), "_qkey").alias("_qh2"))
    lines = stage(lines, "lines")
    often = lines.groupBy("_qh1", "_qh2").agg(F.count_distinct(KEY[0]).alias("_qn")).where(F.col("_qn") >= min_docs)
    often = stage(often.select("_qh1", "_qh2"), "frequent-lines")  # staged: a skewed join on it can then be split
    dropped = lines.join(often, ["_qh1", "_qh2"], "left_semi").groupBy(*KEY).agg(F.collect_set("_qpos").alias("_qdrop"))
    # The hash side holds positions only, so that texts are not sorted.
    rows = docs.withColumns(dict(zip(KEY, content_key("doc_id", "text")))).join(
        dropped.hint("shuffle_hash"), KEY, "left"
    )
    rows = rows.withColumn("_qlines", lines_of())
    positions = F.array_except(F.sequence(F.lit(0), F.size("_qlines") - 1), F.col("_qdrop"))
    kept = F.array_join(F.transform(positions, lambda i: F.get("_qlines", i)), "\n")
    return with_results(
        rows,
        n_lines=F.size("_qlines").cast("long"),
        n_dropped=F.coalesce(F.size("_qdrop"), F.lit(0)).cast("long"),
        text=F.when(F.col("_qdrop").isNull(), F.coalesce("text", F.lit(""))).otherwise(kept),
    ).drop("_qlines", "_qdrop")
