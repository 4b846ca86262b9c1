"""Zip archives of text files as a Spark data source: batch reader, stream reader and writer.

    spark.dataSource.register(TextArchives)
    docs = spark.read.format("text_archives").load("/folder/of/archives")       # title, zip_name, text
    docs.write.format("text_archives").mode("append").save("/another/folder")

Planning lists names and sizes only. A large archive is cut into slices of its bytes; a task reads the archive's
directory and the members that begin in its slice, so neither an archive nor the folder is one task's work.
Paths are local or URIs that `pyarrow.fs` opens (`file:`, `hdfs:`, `s3:`, `gs:`); all executors must reach them.
"""

from __future__ import annotations

import io
import time
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.errors import PySparkValueError
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    DataSourceWriter,
    InputPartition,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

from quirefold import schemas

SLICE_BYTES = 32 << 20
BATCH_BYTES = 4 << 20
SMALL_BYTES = 1 << 16


@dataclass
class Slice(InputPartition):
    """Members of `path` whose entry begins at a byte from `start` up to `stop`."""

    path: str
    start: int
    stop: int


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


def opened(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path[len("file:") :].lstrip("/")
    if "://" not in path:
        return fs.LocalFileSystem(), path.rstrip("/")
    system, inside = fs.FileSystem.from_uri(path)
    return system, inside.rstrip("/")


def _archives(path: str) -> list[fs.FileInfo]:
    """Archives of a folder and its subfolders, or the one archive; names that begin with `_` or `.` are hidden."""
    system, inside = opened(path)
    info = system.get_file_info(inside)
    found = [info] if info.is_file else system.get_file_info(fs.FileSelector(inside, recursive=True))
    visible = [f for f in found if f.is_file and f.base_name.endswith(".zip") and f.base_name[0] not in "_."]
    return sorted(visible, key=lambda f: f.path)


def _slices(archives: list[fs.FileInfo], size: int) -> list[Slice]:
    return [
        Slice(a.path, start, min(start + size, a.size)) for a in archives for start in range(0, max(a.size, 1), size)
    ]


def _names(member: str, archive: str) -> tuple[str, str]:
    """(title, zip_name) of a member, as if the archive were unpacked into a folder of its name."""
    folders, _, name = member.rpartition("/")
    within = folders.rpartition("/")[2] or archive.rpartition("/")[2].removesuffix(".zip")
    return name.split(".")[0], within


def _read(path: str, part: Slice) -> Iterator[pa.RecordBatch]:
    system, _ = opened(path)
    names = [c.split()[0] for c in schemas.DOCS.split(", ")]
    rows, held = [], 0
    with system.open_input_file(part.path) as raw:
        # the reader of zip files looks before the start of very short ones, which only a buffer bears
        archive = zipfile.ZipFile(io.BytesIO(raw.read()) if raw.size() <= SMALL_BYTES else raw)
        for member in archive.infolist():
            if not part.start <= member.header_offset < part.stop or not member.filename.endswith(".txt"):
                continue
            text = archive.read(member).decode("utf-8", "replace").replace("\r\n", "\n").replace("\r", "\n")
            rows.append((*_names(member.filename, part.path), text))
            held += len(text)
            if held >= BATCH_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], names=names)
                rows, held = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], names=names)


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str, slice_bytes: int) -> None:
        self.path, self.slice_bytes = path, slice_bytes

    def partitions(self) -> list[Slice]:
        # an empty list would make Spark ask for one partition without a value
        return _slices(_archives(self.path), self.slice_bytes) or [Slice("", 0, 0)]

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        return _read(self.path, partition) if partition.path else iter(())


class ArchiveStream(DataSourceStreamReader):
    """Archives in the order of their time of change. An offset is the newest time read.

    An archive counts once it has been still for `settle_seconds`, so that one that is written in the same instant
    as another is not passed over. Archives are not changed after they were put there, and come with the present time.
    """

    def __init__(self, path: str, slice_bytes: int, settle_seconds: float) -> None:
        self.path, self.slice_bytes, self.settle = path, slice_bytes, int(settle_seconds * 1e9)

    def initialOffset(self) -> dict:
        return {"until": 0}

    def latestOffset(self) -> dict:
        still = time.time_ns() - self.settle
        return {"until": max((a.mtime_ns for a in _archives(self.path) if a.mtime_ns <= still), default=0)}

    def partitions(self, start: dict, end: dict) -> list[Slice]:
        new = [a for a in _archives(self.path) if start["until"] < a.mtime_ns <= end["until"]]
        return _slices(new, self.slice_bytes)

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        return _read(self.path, partition)


class ArchiveWriter(DataSourceWriter):
    """One archive per task, written under a hidden name and shown when all tasks are done."""

    def __init__(self, path: str) -> None:
        self.path = path

    def write(self, rows: Iterator) -> Written:
        system, folder = opened(self.path)
        system.create_dir(folder)
        name, archive, raw = f"part-{uuid.uuid4().hex}.zip", None, None
        try:
            for row in rows:
                for column in (row["title"], row["zip_name"]):
                    if not column or "/" in column or column in (".", ".."):
                        raise ValueError(f"no file name: {column!r}")
                if "." in row["title"]:
                    raise ValueError(f"a title ends at its first dot: {row['title']!r}")
                if archive is None:
                    raw = system.open_output_stream(f"{folder}/_{name}")
                    archive = zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED)
                # a text of more than 2 GB is beyond one Spark value; the entry's size is known before it is written
                archive.writestr(f"{row['zip_name']}/{row['title']}.txt", (row["text"] or "").encode("utf-8"))
        finally:
            if archive is not None:
                archive.close()
                raw.close()
        return Written([name] if archive is not None else [])

    def commit(self, messages: list[Written | None]) -> None:
        system, folder = opened(self.path)
        for name in [n for m in messages if m for n in m.names]:
            system.move(f"{folder}/_{name}", f"{folder}/{name}")

    def abort(self, messages: list[Written | None]) -> None:
        system, folder = opened(self.path)
        for name in [n for m in messages if m for n in m.names]:
            system.delete_file(f"{folder}/_{name}")


class TextArchives(DataSource):
    """`text_archives`: the `*.txt` members of zip archives, one row each: `(title, zip_name, text)`.

    The title is the member's file name up to its first dot; `zip_name` is the member's folder, or the archive's name
    for a member without one. Line ends become `\\n`; bytes that are no UTF-8 become U+FFFD. Members of equal name are
    rows of their own; an empty folder gives no rows. Options: `sliceBytes` (archive bytes per task), `settleSeconds`
    (streams). Writing appends only, takes titles and folders that are file names, and writes null texts as empty ones.
    """

    @classmethod
    def name(cls) -> str:
        return "text_archives"

    def schema(self) -> str:
        return schemas.DOCS

    def _path(self) -> str:
        if not self.options.get("path"):
            raise PySparkValueError("text_archives needs a path")
        return self.options["path"]

    def _slice_bytes(self) -> int:
        return int(self.options.get("sliceBytes", SLICE_BYTES))

    def reader(self, schema: StructType) -> ArchiveReader:
        return ArchiveReader(self._path(), self._slice_bytes())

    def streamReader(self, schema: StructType) -> ArchiveStream:
        return ArchiveStream(self._path(), self._slice_bytes(), float(self.options.get("settleSeconds", 2)))

    def writer(self, schema: StructType, overwrite: bool) -> ArchiveWriter:
        if overwrite:
            raise PySparkValueError("text_archives appends only; use mode('append')")
        return ArchiveWriter(self._path())
