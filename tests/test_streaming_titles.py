from __future__ import annotations

import pytest

from quirefold import schemas
from quirefold.functions.embedders import HashEmbedder
from quirefold.sources import store as stores
from quirefold.streaming.titles import follow_documents

OPTIONS = {"split_regex": "\n", "embedder": HashEmbedder(8)}


def put(spark, path, rows):
    spark.createDataFrame(rows, schemas.DOCS).write.mode("append").parquet(path)


def texts(spark, name):
    spark.catalog.refreshTable(name)  # a stream writes from a session of its own
    rows = spark.table(name).orderBy("id").collect()
    found = {}
    for r in rows:
        found.setdefault(r["title"], []).append(r["chunk"])
    return found


@pytest.mark.parametrize("replace", [False, True])
def test_two_streams_and_a_restart_add_nothing_twice(spark, tmp_path, replace):
    name = f"followed_{replace}".lower()
    stores.get_or_create(spark, name, str(tmp_path / "store"))
    one, two = str(tmp_path / "one"), str(tmp_path / "two")

    def run(source, check):
        query = follow_documents(spark, source, name, str(tmp_path / check), replace=replace, **OPTIONS)
        query.awaitTermination()
        return texts(spark, name)

    put(spark, one, [("a", "z", "red fox"), ("b", "z", "blue sea"), ("b", "y", "chosen")])
    assert run(one, "c1") == {"a": ["red fox"], "b": ["chosen"]}
    if not replace:
        assert run(one, "c1") == {"a": ["red fox"], "b": ["chosen"]}
    # the second stream starts from the titles that the first one stored
    put(spark, two, [("a", "z", "red fox"), ("c", "z", "new")])
    assert run(two, "c2") == {"a": ["red fox"], "b": ["chosen"], "c": ["new"]}
    # restarted with more files
    put(spark, one, [("a", "z", "brown bear"), ("d", "z", "late")])
    now = "brown bear" if replace else "red fox"
    assert run(one, "c1") == {"a": [now], "b": ["chosen"], "c": ["new"], "d": ["late"]}
    # the first stream has not seen `c`, its checkpoint knows only its own titles: the store decides
    put(spark, one, [("c", "z", "new")])
    assert run(one, "c1")["c"] == ["new"]
    assert spark.table(name).count() == 4
    spark.sql(f"DROP TABLE {name}")
