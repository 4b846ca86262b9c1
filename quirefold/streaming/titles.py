"""Which documents of a stream are new or changed, kept as state by title.

The store's title index is read once, as initial state of a new stream; from then on a micro-batch is decided by the state
of its own titles. No chunk is read for it. The state of a title is one number, the hash of the text it was
last taken from, in RocksDB on the executor of its partition and in the checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from quirefold import schemas
from quirefold.plans.comparison import add_documents
from quirefold.sources import store as stores

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = schemas.DOCS + ", source LONG"


class NewOrChanged(StatefulProcessor):
    """Lets a title's document through when the title is new or, with `replace`, when its hash is another one.

    Of several documents of one title in a micro-batch, one is taken: that with the smallest (folder, hash). An unknown
    hash (0, from chunks stored without a document) counts as changed.
    """

    def __init__(self, replace: bool) -> None:
        self.replace = replace

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.source = handle.getValueState("source", "source LONG")

    def handleInitialState(self, key: tuple, initialState: Row, timerValues) -> None:
        self.source.update((initialState["source"],))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known = self.source.exists()
        if known and not self.replace:
            return
        best = min(rows, key=lambda r: (r["zip_name"] or "", r["source"]))
        if not known or self.source.get()[0] != best["source"]:
            self.source.update((best["source"],))
            yield Row(title=key[0], zip_name=best["zip_name"], text=best["text"], source=best["source"])

    def close(self) -> None:
        pass


def new_documents(documents: DataFrame, stored: DataFrame, replace: bool = False) -> DataFrame:
    """A stream `(title, zip_name, text)` to its rows whose title is not stored, or stored from another text.

    `stored` is (title, source) of what is there when the stream first starts (`sources.store.stored_titles`); a
    restarted stream goes by its own state and ignores it. Adds `source`, the hash of the text. Titles that are null
    are one title. The state store must be RocksDB, see `use_rocksdb`.
    """
    hashed = documents.withColumn("source", stores.document_hash("text"))
    return hashed.groupBy("title").transformWithState(
        statefulProcessor=NewOrChanged(replace),
        outputStructType=OUT,
        outputMode="append",
        timeMode="none",
        initialState=stored.select("title", "source").groupBy("title"),
    )


def use_rocksdb(spark: SparkSession) -> None:
    """Choose the state store that keyed state of this kind needs, where the session has Spark's default one."""
    if spark.conf.get(PROVIDER).endswith(".HDFSBackedStateStoreProvider"):
        spark.conf.set(PROVIDER, ROCKSDB)


def follow_documents(
    spark: SparkSession,
    source: str,
    store: str,
    checkpoint: str,
    fmt: str = "parquet",
    read_options: dict[str, str] | None = None,
    replace: bool = False,
    **options,
) -> StreamingQuery:
    """Like `ingest_documents`, deciding by state before a document is looked at, and titles may repeat.

    With `replace`, a document whose text changed takes the place of the old one. `options` are those of
    `add_documents`, which still looks up the titles that are let through, so that a micro-batch that is run again
    after a failure adds nothing twice, nor does a second stream into the same store. The stream writes from a session
    of its own: others call `spark.catalog.refreshTable(store)` before they read replaced documents.
    """
    use_rocksdb(spark)

    def add(batch: DataFrame, _: int) -> None:
        add_documents(batch.drop("source"), store, replace=replace, **options)

    documents = spark.readStream.format(fmt).options(**(read_options or {})).schema(schemas.DOCS).load(source)
    stored = stores.stored_titles(spark, store).groupBy("title").agg(F.bit_xor("source").alias("source"))
    return (
        new_documents(documents, stored, replace)
        .writeStream.foreachBatch(add)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
