from __future__ import annotations

import os
import time
import zipfile

import pytest

from quirefold import schemas
from quirefold.sources import store as stores
from quirefold.sources.archives import ArchiveReader, TextArchives
from quirefold.functions.embedders import HashEmbedder
from quirefold.streaming.ingest import ingest_documents


@pytest.fixture
def source(spark):
    spark.dataSource.register(TextArchives)
    return "text_archives"


def archive(path, members):
    with zipfile.ZipFile(path, "w") as out:
        for name, data in members:
            out.writestr(name, data)


def rows(frame):
    return sorted((r["title"], r["zip_name"], r["text"]) for r in frame.collect())


def test_members_are_rows_whatever_the_slices(spark, source, tmp_path):
    os.makedirs(tmp_path / "in" / "deep")
    archive(tmp_path / "in" / "a.zip", [
        ("x.txt", "one\r\ntwo\rthree"), ("north/y.v2.txt", b"bad \xff byte"), ("north/skip.pdf", "no"), ("empty.txt", ""),
        ("far/north/z.txt", "é" * 5000),
    ])
    archive(tmp_path / "in" / "deep" / "b.zip", [(f"m{i}.txt", f"text {i}") for i in range(50)])
    archive(tmp_path / "in" / "none.zip", [])
    archive(tmp_path / "in" / "_hidden.zip", [("h.txt", "h")])
    want = sorted(
        [("x", "a", "one\ntwo\nthree"), ("y", "north", "bad � byte"), ("empty", "a", ""), ("z", "north", "é" * 5000)]
        + [(f"m{i}", "b", f"text {i}") for i in range(50)]
    )
    for size in (97, 1000, 1 << 25):
        read = spark.read.format(source).option("sliceBytes", size)
        assert rows(read.load(str(tmp_path / "in"))) == want
        assert rows(read.load(f"file:{tmp_path}/in")) == want
    one = ArchiveReader(str(tmp_path / "in"), 1000)
    assert max(len([r for b in one.read(p) for r in b.to_pylist()]) for p in one.partitions()) < 50


def test_planning_reads_no_archive(spark, source, tmp_path):
    (tmp_path / "broken.zip").write_bytes(b"this is no archive")
    frame = spark.read.format(source).load(str(tmp_path))
    assert frame.columns == ["title", "zip_name", "text"]
    assert len(ArchiveReader(str(tmp_path), 5).partitions()) == 4
    frame.select("title").explain()
    with pytest.raises(Exception, match="zip"):
        frame.count()


def test_empty_folder_has_no_rows(spark, source, tmp_path):
    assert spark.read.format(source).load(str(tmp_path)).count() == 0


def test_written_archives_come_back(spark, source, tmp_path):
    docs = [(f"t{i % 90}", f"z{i % 3}", f"text\n{i}" if i % 7 else None) for i in range(100)]
    frame = spark.createDataFrame(docs, schemas.DOCS).repartition(4)
    for _ in range(2):
        frame.write.format(source).mode("append").save(str(tmp_path / "out"))
    want = sorted(2 * [(t, z, x or "") for t, z, x in docs])
    assert rows(spark.read.format(source).load(str(tmp_path / "out"))) == want
    assert not [n for n in os.listdir(tmp_path / "out") if n.startswith("_")]
    with pytest.raises(Exception, match="append"):
        frame.write.format(source).mode("overwrite").save(str(tmp_path / "out"))
    for bad in (("a.b", "z"), ("a/b", "z"), (None, "z"), ("a", ""), ("a", "..")):
        with pytest.raises(Exception, match="file name|first dot"):
            spark.createDataFrame([(*bad, "x")], schemas.DOCS).write.format(source).mode("append").save(str(tmp_path / "bad"))


def test_stream_of_archives_into_the_store(spark, source, tmp_path):
    folder, checkpoint = tmp_path / "in", str(tmp_path / "check")
    folder.mkdir()
    stores.get_or_create(spark, "from_archives", str(tmp_path / "store"))

    def run():
        options = {"split_regex": "\n", "embedder": HashEmbedder(8)}
        read = {"settleSeconds": "0"}
        ingest_documents(spark, str(folder), "from_archives", checkpoint, fmt=source, read_options=read, **options).awaitTermination()
        return sorted((r["title"], r["zip_name"]) for r in spark.table("from_archives").select("title", "zip_name").distinct().collect())

    archive(folder / "one.zip", [("a.txt", "x\ny"), ("b.txt", "u")])
    time.sleep(0.05)
    assert run() == [("a", "one"), ("b", "one")]
    count = spark.table("from_archives").count()
    assert run() == [("a", "one"), ("b", "one")] and spark.table("from_archives").count() == count
    archive(folder / "two.zip", [("b.txt", "changed"), ("south/c.txt", "new")])
    time.sleep(0.05)
    assert run() == [("a", "one"), ("b", "one"), ("c", "south")]
    spark.sql("DROP TABLE from_archives")
