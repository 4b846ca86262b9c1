from __future__ import annotations

import itertools
import zlib

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quirefold.llm.sharding import hilbert_index, level_cuts, shard_documents, write_shards
from quirefold.session import scratch_path
from tests.llm.helpers import AWKWARD, documents

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, slot string, _q1 int, size int"


def table(spark, n=500, hot=3):
    rows = [
        (i, f"text {i} " * (i % 7), "en" if i % hot else "fr", f"src{(i * 7) % 11}" if i % 3 else "src0", (i * 37) % 400, "s", 7, 5)
        for i in range(n)
    ]
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


@pytest.mark.parametrize("n,bits", [(1, 4), (2, 1), (2, 4), (3, 3), (4, 2)])
def test_the_curve_visits_every_point_and_only_steps_to_neighbours(spark, n, bits):
    points = list(itertools.product(range(1 << bits), repeat=n))
    df = spark.createDataFrame(points, ", ".join(f"l{i} int" for i in range(n)))
    rows = df.withColumn("at", hilbert_index([F.col(f"l{i}") for i in range(n)], bits)).orderBy("at").collect()
    assert [r["at"] for r in rows] == list(range(len(points)))
    for a, b in zip(rows, rows[1:]):
        assert sum(abs(a[i] - b[i]) for i in range(n)) == 1


def test_levels_hold_the_share_of_smaller_rows(spark):
    values = [None] * 5 + ["a"] * 40 + ["b"] * 3 + ["c"] * 50 + ["d"] * 2
    df = spark.createDataFrame([(v,) for v in values], "x string")
    for level, least in level_cuts(df, "x", len(values), 4):
        assert level == sum(v is None or v < least for v in values) * 16 // len(values)


def test_shards_are_runs_of_the_order_and_counts_differ_by_one(spark):
    docs = table(spark)
    rows = shard_documents(docs, shards=7).collect()
    shards = {}
    for r in sorted(rows, key=lambda r: (r["curve"], r["doc_id"])):
        shards.setdefault(r["shard"], []).append(r["slot"])
    assert list(shards) == sorted(shards) and len(shards) == 7
    assert all(s == list(range(len(s))) for s in shards.values())
    assert max(map(len, shards.values())) - min(map(len, shards.values())) <= 1
    for r in rows:
        assert r["size"] == len(r["text"].encode()) + 16 and r["text_crc32"] == zlib.crc32(r["text"].encode())
        assert r["_q1"] == 7 and r["law"] == "rows"


def test_law_of_bytes(spark):
    rows = shard_documents(table(spark), shards=5, law="bytes", columns=["doc_id"]).collect()
    sizes = {}
    for r in rows:
        sizes[r["shard"]] = sizes.get(r["shard"], 0) + r["size"]
    assert len(rows) == 500 and max(sizes.values()) - min(sizes.values()) <= 2 * max(r["size"] for r in rows)
    with pytest.raises(ValueError):
        shard_documents(table(spark), law="luck")


def test_a_filter_meets_few_files(spark):
    path = scratch_path(spark, "shards")
    docs = table(spark, n=4000)
    written = write_shards(docs, path, shards=32)
    assert written.count() == 4000
    import glob

    def met(column, low, high):
        hit = set()
        for file in glob.glob(f"{path}/shard=*/*.parquet"):
            meta = pq.ParquetFile(file).metadata
            for g in range(meta.num_row_groups):
                group = meta.row_group(g)
                stats = next(group.column(c).statistics for c in range(group.num_columns) if group.column(c).path_in_schema == column)
                if stats.min <= high and stats.max >= low:
                    hit.add(file.split("shard=")[1].split("/")[0])
        return len(hit)

    assert met("lang", "fr", "fr") <= 16 and met("source", "src5", "src5") <= 16 and met("n_chars", 0, 40) <= 16


def test_awkward_rows_and_one_value_everywhere(spark):
    docs = documents(spark, [(i, "copy") for i in range(200)], awkward=True)
    rows = shard_documents(docs, shards=8).collect()
    assert len(rows) == 200 + len(AWKWARD)
    seen = {r["shard"]: 0 for r in rows}
    for r in rows:
        seen[r["shard"]] += 1
    assert max(seen.values()) - min(seen.values()) <= 1
    null = [r for r in rows if r["text"] is None]
    assert [(r["size"], r["text_crc32"]) for r in null] == [(16, None)]
    long = documents(spark, [(1, "x" * 3_000_000), (2, "y")], awkward=False)
    assert {r["size"] for r in shard_documents(long, shards=2).collect()} == {3_000_016, 17}


def test_empty_table_and_fewer_rows_than_shards(spark):
    assert shard_documents(documents(spark, [], awkward=False)).count() == 0
    rows = shard_documents(documents(spark, [(1, "a"), (2, "b")], awkward=False), shards=5).collect()
    assert sorted(r["slot"] for r in rows) == [0, 0]


def test_only_native_operators(spark):
    plan = shard_documents(table(spark, 20))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
