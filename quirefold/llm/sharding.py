"""Sharding along a Hilbert curve: runs of equal size that are narrow in several metadata columns at once.

Every metadata column is quantised into levels that hold about the same number of rows (a value is never
cut, so a frequent value takes the room of several levels). The levels of a row are a point of a grid; the
Hilbert curve visits neighbouring points one after the other, so a run along the curve covers a small box
of the grid. Rows are sorted by curve index and the order is cut into runs, one per shard. A reader that
filters on any of the columns then skips the files whose minimum and maximum lie outside.

Level cuts are the only thing that reaches the driver: at most one value per level and column.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from quirefold.llm.common import in_order, keeps_columns, rows_before
from quirefold.session import stage

DIMENSIONS = ("lang", "source", "n_chars")
BITS = 5
OVERHEAD = 16  # fixed value: bytes a row counts beside its text


def level_cuts(docs: DataFrame, column: str, total: int, bits: int = BITS) -> list[tuple[int, object]]:
    """(level, smallest value) in rising order: a value's level is 2**bits times the share of rows with smaller ones.

    Nulls come first, at level 0. Exact, from counts per distinct value; `total` is the number of rows.
    """
    before = rows_before(docs.select(column), column, "_qbefore")
    level = F.call_function("div", F.col("_qbefore") * (1 << bits), F.lit(max(total, 1))).alias("_qlevel")
    smallest = before.where(F.col(column).isNotNull()).groupBy(level).agg(F.min(column).alias("_qleast"))
    return sorted((r["_qlevel"], r["_qleast"]) for r in smallest.collect())  # at most 2**bits rows


def level_of(column: str, cuts: list[tuple[int, object]]) -> Column:
    """The level of the last cut that is not above the value; 0 for null."""
    levels = [F.when(F.col(column) >= F.lit(least), F.lit(level)) for level, least in reversed(cuts)]
    return F.coalesce(*levels, F.lit(0)).cast("int")


def hilbert_tables(n: int) -> tuple[list[int], list[int], list[int]]:
    """For `n` dimensions, per corner of the unit cube in the order of the reflected binary code: where its
    sub-curve enters, and along which axis it runs; and the place of each corner in that order."""
    gray = [i ^ (i >> 1) for i in range(1 << n)]
    place = [0] * (1 << n)
    for i, g in enumerate(gray):
        place[g] = i
    ones = [(~i & (i + 1)).bit_length() - 1 for i in range(1 << n)]  # trailing one bits
    entry = [0 if i == 0 else gray[2 * ((i - 1) // 2)] for i in range(1 << n)]
    axis = [0 if i == 0 else (ones[i - 1] if i % 2 == 0 else ones[i]) % n for i in range(1 << n)]
    return entry, axis, place


def hilbert_index(levels: list[Column], bits: int) -> Column:
    """Position along the Hilbert curve of a grid point, by one step per bit from the highest down.

    A state says where the current cube's curve enters and along which axis it runs; the bits of all
    dimensions, seen from that state, give the next digit of the index and the state inside the sub-cube.
    """
    n = len(levels)
    if not n or n * bits > 62:
        raise ValueError("one dimension at least, and at most 62 bits in all")
    if n == 1:
        return levels[0].cast("long")
    entry, axis, place = (F.array(*[F.lit(v).cast("long") for v in t]) for t in hilbert_tables(n))
    full = F.lit((1 << n) - 1).cast("long")

    def right(x: Column, by: Column) -> Column:
        return F.call_function("shiftright", x, by.cast("int"))

    def left(x: Column, by: Column) -> Column:
        return F.call_function("shiftleft", x, by.cast("int"))

    def turned_right(x: Column, by: Column) -> Column:
        return right(x, by).bitwiseOR(left(x, F.lit(n) - by)).bitwiseAND(full)

    def step(state: Column, bit: Column) -> Column:
        corner = reduce(
            lambda x, y: x.bitwiseOR(y),
            [F.shiftleft(right(v.cast("long"), bit).bitwiseAND(F.lit(1).cast("long")), j) for j, v in enumerate(levels)],
        )
        turn = F.pmod(state["axis"] + 1, F.lit(n))
        digit = F.get(place, turned_right(corner.bitwiseXOR(state["entry"]), turn).cast("int"))
        inner = turned_right(F.get(entry, digit.cast("int")), F.pmod(F.lit(n) - turn, F.lit(n)))
        return F.struct(
            state["entry"].bitwiseXOR(inner).alias("entry"),
            F.pmod(state["axis"] + F.get(axis, digit.cast("int")) + 1, F.lit(n)).cast("long").alias("axis"),
            F.shiftleft(state["index"], n).bitwiseOR(digit).alias("index"),
        )

    zero = F.lit(0).cast("long")
    start = F.struct(zero.alias("entry"), zero.alias("axis"), zero.alias("index"))
    return F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1)), start, step)["index"]


@keeps_columns
def shard_documents(
    docs: DataFrame,
    shards: int = 40,
    law: str = "rows",
    dimensions: tuple[str, ...] = DIMENSIONS,
    bits: int = BITS,
    columns: list[str] | None = None,
) -> DataFrame:
    """`columns` of `docs` (default: all) with size, text_crc32, law, curve, shard and slot.

    `size` is the number of UTF-8 bytes of the text and 16 more; `text_crc32` is the unsigned CRC of those bytes
    (null text: size 16, no CRC). Rows are ordered by (curve index of `dimensions`, doc_id, size, CRC), nulls
    first, and cut into `shards` runs. With law `rows`, run lengths differ by at most one; with `bytes`, a row
    goes to the run in which the middle of its bytes falls, so that sizes differ by no more than the largest
    row. `slot` is the place inside the shard, from 0 without gaps.

    Null metadata have level 0. A very long text is one row of its size. Rows that tie in the whole order stand
    next to each other in any order; repeated rows are placed one by one. A shard may be empty when there are
    fewer rows than shards; an empty table gives no rows. Input columns named like a result are replaced, or
    used first if they are dimensions.
    """
    if law not in ("rows", "bytes"):
        raise ValueError("law is rows or bytes")
    columns = list(docs.columns) if columns is None else list(columns)
    text = F.col("text").cast("binary")
    total = docs.count()
    cuts = {d: level_cuts(docs, d, total, bits) for d in dimensions}
    facts = docs.withColumns(
        {
            "_qcurve": hilbert_index([level_of(d, cuts[d]) for d in dimensions], bits),
            "_qid": F.col("doc_id"),
            "_qsize": (F.coalesce(F.octet_length("text"), F.lit(0)) + OVERHEAD).cast("long"),
            "_qcrc": F.crc32(text),
        }
    ).select(*columns, "_qcurve", "_qid", "_qsize", "_qcrc")
    if "text" not in columns:
        facts = stage(facts, "facts")  # narrow: neither the sampling nor the sort reads the texts again
    rows = in_order(facts, ["_qcurve", "_qid", "_qsize", "_qcrc"], "_qat")
    if law == "rows":
        rows = _cut_by_rows(rows, shards, total)
    else:
        rows = _cut_by_bytes(rows, shards)
    results = {
        "size": F.col("_qsize"),
        "text_crc32": F.col("_qcrc"),
        "law": F.lit(law),
        "curve": F.col("_qcurve"),
        "shard": F.col("_qshard").cast("int"),
        "slot": F.col("_qslot").cast("long"),
    }
    kept = [c for c in columns if c.lower() not in results]
    return rows.select(*kept, *[v.alias(k) for k, v in results.items()])


def _cut_by_rows(rows: DataFrame, shards: int, total: int) -> DataFrame:
    shard = F.call_function("div", F.col("_qat") * shards, F.lit(max(total, 1)))
    first = F.call_function("div", shard * total + (shards - 1), F.lit(shards))  # rounded up
    return rows.withColumns({"_qshard": shard, "_qslot": F.col("_qat") - first})


def _cut_by_bytes(rows: DataFrame, shards: int) -> DataFrame:
    """Bytes before a row come from sums over blocks of positions; shard starts from one row per shard."""
    from quirefold.operators.ordering import running_total

    rows = running_total(rows.withColumn("_qall", F.lit(0)), ["_qall"], "_qat", F.col("_qsize"), "_qbytes")
    rows = stage(rows, "bytes-before")
    total = rows.agg(F.sum("_qsize")).first()[0] or 1
    middle = F.col("_qbytes") * 2 + F.col("_qsize")
    shard = F.least(F.call_function("div", middle * shards, F.lit(2 * total)), F.lit(shards - 1))
    rows = rows.withColumn("_qshard", shard)
    firsts = rows.groupBy("_qshard").agg(F.min("_qat").alias("_qfirst"))  # one row per shard
    return rows.join(F.broadcast(firsts), "_qshard").withColumn("_qslot", F.col("_qat") - F.col("_qfirst"))


def write_shards(docs: DataFrame, path: str, **options) -> DataFrame:
    """Write all columns of `docs` as Parquet, one folder per shard, each file in curve order; returns what was written.

    The ordered rows are in files already, so a task writes few shards and nothing is shuffled again. An
    unfiltered column costs nothing; a filter on a dimension meets only the files of its part of the curve.
    """
    rows = shard_documents(docs, **options)
    rows.write.partitionBy("shard").parquet(path)
    return docs.sparkSession.read.schema(rows.schema).parquet(path)
