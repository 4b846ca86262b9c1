"""Incremental ingest: new document files are picked up once and known titles are skipped.

The file source remembers which files it has seen; each micro-batch then applies the same name-based
skip as a batch run, so a restart or a second stream adds nothing twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from quirefold import schemas
from quirefold.plans.comparison import add_documents


def ingest_documents(
    spark: SparkSession,
    source: str,
    store: str,
    checkpoint: str,
    fmt: str = "parquet",
    read_options: dict[str, str] | None = None,
    **options,
) -> StreamingQuery:
    """Run through all new files `(title, zip_name, text)` in `source` and append their chunks to `store`.

    `fmt` and `read_options` are those of the source, such as the `text_archives` of `sources.archives`;
    `options` are those of `add_documents`. Titles must be unique within the source. The query ends
    when the files present at the start are done.
    """

    def add(batch: DataFrame, _: int) -> None:
        add_documents(batch, store, **options)

    documents = spark.readStream.format(fmt).options(**(read_options or {})).schema(schemas.DOCS).load(source)
    return (
        documents.writeStream.foreachBatch(add)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
