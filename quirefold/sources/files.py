"""Readers and writers of stage files, and the checks on folders.

Every read has an explicit schema, so a title that looks like a number stays a string.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import islice
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quirefold import schemas
from quirefold.operators.cleaning import title_of
from quirefold.operators.ordering import dense_index, place_in_order
from quirefold.session import stage
from quirefold.sources.archives import BATCH_BYTES, opened

PATTERN_MATCHES = 10_000  # matches of a pattern that the driver hands to the tasks
LISTED_FILES = 10_000  # names, or texts, that a task sends on at a time
# Fixed value: the characters of a path that a URI escapes.
NOT_IN_URI = r"[\x00-\x20\"#%<>?\[\\\]^`{|}\x7f-\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def read_pages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Pages of all documents, one row per page: `(doc, page_num, text)`."""
    return spark.read.schema(schemas.PAGES).format(fmt).load(path)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """All `*.txt` files of a folder, one row per file, with line ends normalised: `(title, zip_name, text)`.

    The files are listed by tasks, when this is called, and their names written; the driver knows the folder alone, or
    what `path` matches if it is a pattern: give patterns that name folders. Empty and hidden files have no rows. Paths
    that `pyarrow.fs` does not open, and patterns of very many matches, are listed by Spark on the driver.
    """
    roots = _folders_to_list(spark, path)
    if roots is None:
        files = spark.read.option("pathGlobFilter", "*.txt").text(path, wholetext=True)
        files = files.select("value", F.col("_metadata.file_path").alias("location"))
    else:
        listed = spark.createDataFrame([(root,) for root in roots], "root string").mapInArrow(_listed, "root string, path string")
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        names = stage(listed, "text-files", compression="zstd").repartition(parts, "path")
        files = names.mapInArrow(_contents, "location string, value binary")
    location = F.col("location")
    return files.select(
        title_from_path(location).alias("title"),
        folder_from_path(location).alias("zip_name"),
        F.regexp_replace(F.col("value").cast("string"), "\r\n?", "\n").alias("text"),
    )


def _folders_to_list(spark: SparkSession, path: str) -> list[str] | None:
    """The folders (or files) that `path` names, as tasks open them; None if Spark has to list them."""
    asked = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = asked.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    found = system.globStatus(asked.makeQualified(system.getUri(), system.getWorkingDirectory()))
    if not found or len(found) > PATTERN_MATCHES:
        return None  # Spark says that there is nothing
    uris = [status.getPath().toUri() for status in found]
    roots = ["file:" + u.getPath() if u.getScheme() == "file" else u.toString() for u in uris]
    try:
        opened(roots[0])
    except (pa.ArrowException, OSError, NotImplementedError):
        return None
    return roots


def _entries(system: fs.FileSystem, folder: str) -> Iterator[tuple[str, str, bool]]:
    """(name, path, is a folder) of what lies in a folder; names of a local one are read as they come."""
    if isinstance(system, fs.LocalFileSystem):
        with os.scandir(folder) as entries:
            for entry in entries:
                yield entry.name, entry.path, entry.is_dir()
    else:
        for info in system.get_file_info(fs.FileSelector(folder)):
            yield info.base_name, info.path, info.type == fs.FileType.Directory


def _text_paths(system: fs.FileSystem, folder: str, wanted: bool = True, keyed: bool = False) -> Iterator[str]:
    """Visible `*.txt` files of a folder, and those anywhere below a folder `key=value`, as Spark lists them."""
    for name, path, is_folder in _entries(system, folder):
        if not is_folder:
            if wanted and _is_text(name):
                yield path
        elif _is_visible(name):
            inside = keyed or "=" in name
            yield from _text_paths(system, path, inside, inside)


def _is_visible(name: str) -> bool:
    return name[0] != "." and (name[0] != "_" or "=" in name)


def _is_text(name: str) -> bool:
    return name.endswith(".txt") and _is_visible(name)


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task function: the text files of each folder, or the file itself."""
    for root in (root for batch in batches for root in batch.column("root").to_pylist()):
        system, inside = opened(root)
        info = system.get_file_info(inside)
        if info.is_file:
            found = iter([inside] if _is_text(info.base_name) else [])
        else:
            found = _text_paths(system, inside or "/")
        while paths := list(islice(found, LISTED_FILES)):
            yield pa.RecordBatch.from_pydict({"root": [root] * len(paths), "path": paths})


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task function: name and bytes of each file that has any."""
    systems, rows, held = {}, [], 0
    schema = pa.schema([("location", pa.string()), ("value", pa.binary())])
    for batch in batches:
        for root, path in zip(batch.column("root").to_pylist(), batch.column("path").to_pylist(), strict=True):
            if root not in systems:
                systems[root] = opened(root)[0]
            with systems[root].open_input_stream(path, compression=None) as file:
                value = file.read()
            if value:
                rows.append((_in_uri(path), value))
                held += len(value)
            if held >= BATCH_BYTES or len(rows) >= LISTED_FILES:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema, strict=True)], schema=schema)
                rows, held = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema, strict=True)], schema=schema)


def _in_uri(path: str) -> str:
    """A path as Spark writes it in `_metadata.file_path`: letters of all scripts stay."""
    return re.sub(NOT_IN_URI, lambda m: quote(m[0], safe=""), path)


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/", -1), -1)


def title_from_path(path: Column) -> Column:
    return title_of(file_name(path))


def folder_from_path(path: Column) -> Column:
    """Name of the folder a file lies in; empty for a bare file name."""
    return F.coalesce(F.get(F.reverse(F.split(path, "/", -1)), F.lit(1)), F.lit(""))


def text_name(pdf_name: Column) -> Column:
    """Name of the cleaned text of a PDF."""
    return F.replace(pdf_name, F.lit(".pdf"), F.lit(".txt"))


def write_documents(docs: DataFrame, path: str) -> None:
    """Cleaned documents `(doc, text)`, one row per file, under the name of the text file."""
    docs.select(text_name(F.col("doc")).alias("name"), "text").write.mode("overwrite").parquet(path)


def write_stage(df: DataFrame, path: str, fmt: str = "json") -> None:
    df.write.mode("overwrite").format(fmt).save(path)


def read_chunks(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    return spark.read.schema(schemas.CHUNKS).format(fmt).load(path)


def read_embedded_chunks(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    return spark.read.schema(schemas.EMBEDDED_CHUNKS).format(fmt).load(path)


def questions_of(table: DataFrame, order_by: str) -> DataFrame:
    """Question list from a template: the second column by position, in the order of `order_by`.

    `order_by` is a numeric column. Empty questions are dropped before they are numbered.
    """
    text = F.col(f"`{table.columns[1]}`")
    asked = table.where(text.isNotNull()).select(
        F.lit(0).alias("_sheet"), F.col(f"`{order_by}`").alias("_order"), text.cast("string").alias("question")
    )
    return dense_index(asked, ["_sheet"], "_order", "q_idx").select(F.col("q_idx").cast("int"), "question")


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Question list from a CSV sheet with a header row, in file order."""
    table = spark.read.csv(path, header=True, multiLine=True, escape='"')
    # a multi-line CSV file is never split, so this id follows the rows of the sheet
    return questions_of(table.withColumn("_row", F.monotonically_increasing_id()), "_row")


def write_comparison(table: DataFrame, path: str, fmt: str = "csv") -> None:
    """The comparison table as one sheet; its rows are the questions of one list.

    The table is computed in parallel; only its finished rows meet in the one task that writes the sheet.
    """
    writer = table.repartition(1).sortWithinPartitions("q_idx").write.mode("overwrite")
    if fmt == "csv":
        writer.csv(
            path,
            header=True,
            quoteAll=True,
            escape='"',
            ignoreLeadingWhiteSpace=False,
            ignoreTrailingWhiteSpace=False,
        )
    else:
        writer.format(fmt).save(path)


def _cell(text: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.coalesce(text, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))


def write_sheets(answers: DataFrame, path: str, titles_per_sheet: int = 1000) -> DataFrame:
    """Answers of any number of titles as comparison sheets of `titles_per_sheet` titles each; returns the manifest.

    Titles are numbered in order and cut into groups; a sheet, in `path/sheets/sheet=<number>`, has the columns of
    `comparison_table` for its titles and a row per question, and is written by one task as lines of CSV,
    so no table gets as wide as there are titles. The manifest in `path/manifest` says which titles
    (from `first_title` to `last_title`) a sheet holds. A title without an answer to a question has empty cells.
    """
    titles = place_in_order(answers.select("title").distinct(), "title", "place")
    titles = titles.withColumn("sheet", F.call_function("div", F.col("place"), F.lit(titles_per_sheet)))
    titles = stage(titles, "sheet-titles")
    manifest = titles.groupBy("sheet").agg(
        F.min("title").alias("first_title"), F.max("title").alias("last_title"), F.count(F.lit(1)).alias("n_titles")
    )
    manifest.write.mode("overwrite").parquet(f"{path}/manifest")
    names = F.transform(F.sort_array(F.collect_list("title")), lambda t: F.concat_ws(
        ",", _cell(F.concat(t, F.lit("-response"))), _cell(F.concat(t, F.lit("-source_chunks")))
    ))
    heads = titles.groupBy("sheet").agg(F.sort_array(F.collect_list("title")).alias("titles"), names.alias("names"))
    named = F.array(F.lit('"q_idx"'), F.lit('"question"'))
    head = heads.select("sheet", F.lit(None).cast("int").alias("q_idx"), F.concat_ws(",", named, "names").alias("value"))
    cells = F.concat_ws(",", _cell(F.col("response")), _cell(F.col("source_chunks")))
    rows = answers.join(titles.select("title", "sheet"), "title").groupBy("sheet", "q_idx", "question").agg(
        F.map_from_entries(F.collect_list(F.struct("title", cells.alias("cells")))).alias("by_title")
    )  # at most `titles_per_sheet` answers
    line = F.transform("titles", lambda t: F.coalesce(F.element_at("by_title", t), F.lit('"",""')))
    first = F.array(_cell(F.col("q_idx").cast("string")), _cell(F.col("question")))
    rows = rows.join(heads.select("sheet", "titles"), "sheet").select("sheet", "q_idx", F.concat_ws(",", first, line).alias("value"))
    lines = head.unionByName(rows).repartition("sheet").sortWithinPartitions("sheet", F.asc_nulls_first("q_idx"))
    lines.select("sheet", "value").write.mode("overwrite").partitionBy("sheet").text(f"{path}/sheets")
    return answers.sparkSession.read.parquet(f"{path}/manifest")


def read_sheet(spark: SparkSession, path: str, sheet: int) -> DataFrame:
    """One sheet of `write_sheets`, as `read_comparison` reads a single one."""
    return read_comparison(spark, f"{path}/sheets/sheet={sheet}")


def read_comparison(spark: SparkSession, path: str) -> DataFrame:
    """A written CSV sheet; empty answers stay empty texts."""
    sheet = spark.read.csv(path, header=True, multiLine=True, escape='"', nullValue="\0")
    return sheet.withColumn("q_idx", F.col("q_idx").cast("int"))


def pdf_names(files: DataFrame) -> DataFrame:
    """Files that are processed: the extension is matched case-sensitively."""
    return files.where(F.col("name").endswith(".pdf"))


def ingest_guard(files: DataFrame, threshold: int = 20) -> DataFrame:
    """Per folder: number of PDFs in any case, and whether it reaches the threshold."""
    n = F.count_if(F.lower("name").endswith(".pdf"))
    return files.groupBy("folder").agg(n.alias("n_pdfs"), (n >= threshold).alias("over_limit"))


def check_ingest(files: DataFrame, threshold: int = 20, allow_large: bool = False) -> None:
    """Refuse a large folder unless the caller allows it."""
    if not allow_large and not ingest_guard(files, threshold).where("over_limit").isEmpty():
        raise ValueError(f"a folder holds {threshold} PDFs or more; pass allow_large=True to go on")


def check_unique_titles(pages: DataFrame, whole_names: bool = False) -> None:
    """Refuse documents that would share a title: the part of their names before the first dot.

    With `whole_names` the rows are documents and `doc` is the title itself.
    """
    if whole_names:
        names = pages.select(F.col("doc").alias("title"))
    else:
        names = pages.select("doc").distinct().select(title_of(F.col("doc")).alias("title"))
    shared = names.groupBy("title").count().where("count > 1")
    example = shared.first()
    if example is not None:
        raise ValueError(f"several documents have the title {example['title']!r}; rename them")


def folder_up_to_date(source: DataFrame, processed: DataFrame) -> DataFrame:
    """Per source folder: whether the names after `.pdf` -> `.txt` equal the processed names as sets.

    All files count, also those that are not PDFs.
    """
    want = source.select("folder", text_name(F.col("name")).alias("name"), F.lit(1).alias("w"), F.lit(0).alias("h"))
    have = processed.select("folder", "name", F.lit(0).alias("w"), F.lit(1).alias("h"))
    names = want.unionByName(have).groupBy("folder", "name").agg(F.max("w").alias("w"), F.max("h").alias("h"))
    return (
        names.groupBy("folder")
        .agg(F.max("w").alias("is_source"), F.bool_and(F.col("w") == F.col("h")).alias("up_to_date"))
        .where(F.col("is_source") == 1)
        .drop("is_source")
    )


# What Spark puts in place of a folder's value that is null or empty, and the characters it escapes.
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"
ESCAPED = r"[\x01-\x1f\"#%'*/:=?\\\x7f{\[\]^]"


def _folder_name(column: str, value: str | None) -> str:
    return f"{column}=" + (re.sub(ESCAPED, lambda m: f"%{ord(m[0]):02X}", value) if value else NO_VALUE)


def write_texts(docs: DataFrame, path: str, by: str | None = None) -> int:
    """Write `value` of every row as a text file of its own, `part-*.txt`, ended by a line end; returns their number.

    With `by`, files lie in a folder per value of that column, named as `partitionBy` names them. Tasks write through
    `pyarrow.fs`; a task that is run again writes the same names. `path` must be new and shared by the cluster.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, root = opened(path)
        task, written, made = TaskContext.get().partitionId(), 0, set()
        for batch in batches:
            values = batch.column("value").to_pylist()
            folders = [_folder_name(by, v) for v in batch.column("folder").to_pylist()] if by else [""] * len(values)
            for folder, value in zip(folders, values, strict=True):
                place = f"{root}/{folder}".rstrip("/")
                if place not in made:
                    target.create_dir(place, recursive=True)
                    made.add(place)
                with target.open_output_stream(f"{place}/part-{task:05d}-{written:09d}.txt", compression=None) as out:
                    out.write((value or "").encode() + b"\n")
                written += 1
        yield pa.RecordBatch.from_pydict({"n": [written]})

    columns = [F.col("value"), *([F.col(by).cast("string").alias("folder")] if by else [])]
    return docs.select(*columns).mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0
