"""One Markdown file for each document under its own name, written by Spark's tasks, and numbers of batches over many files.

``write`` is a data source writer: a task writes any number of files, each under
a name of its own first and then renamed, so a reader never sees half a file.
Names follow from the rows alone, so a task that runs again writes the same
files; a job that fails deletes what its tasks have told of. Files are written
and read through Arrow's file systems, which reach what their URI names.

``listed`` and ``read`` are for very many files: folders are listed by tasks, and
paths are dealt among tasks that open them. The driver sees no path, where
``spark.read.text`` lists them all there and plans a task for every few.
"""

from __future__ import annotations

import os
import posixpath
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from corpuslode.sources.files import BATCH_FILES, described, safe_name, workspace

#: Ranges of paths that are put in order beside each other, tasks that folders are dealt to, and files of a task that reads them.
RANGES, LISTERS, TASK_FILES = 64, 64, 4_000
#: Paths of a batch of a listing, and bytes of texts of a batch that is read.
LISTED, READ_BYTES = 4_096, 4 << 20


def _located(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if ":" in path.split("/")[0] else f"file://{posixpath.abspath(path)}")


def _names(system: fs.FileSystem, folder: str, directories: bool) -> Iterator[str]:
    """Names in a folder but those that begin with a dot, as drafts do; of a folder that is mounted they come as they are found."""
    if isinstance(system, fs.LocalFileSystem):
        with os.scandir(folder) as found:
            names = (e.name for e in found if (e.is_dir() if directories else e.is_file()))
            yield from (n for n in names if n[0] != ".")
        return
    kind = fs.FileType.Directory if directories else fs.FileType.File
    yield from (x.base_name for x in system.get_file_info(fs.FileSelector(folder)) if x.type == kind and x.base_name[0] != ".")


@dataclass
class Written(WriterCommitMessage):
    folders: dict[str, int]
    names: bytes  # all files' paths below the root, compressed: a message comes from every task

    @property
    def files(self) -> list[str]:
        return [n for n in zlib.decompress(self.names).decode().split("\n") if n]


class FilesWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def _root(self) -> tuple[fs.FileSystem, str]:
        return _located(self.path)

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        system, root = self._root()
        folders: dict[str, int] = {}
        files: list[str] = []
        for b in batches:
            for folder, name, text in zip(*(b.column(c).to_pylist() for c in ("folder", "name", "text")), strict=True):
                if folder not in folders:
                    system.create_dir(f"{root}/{folder}", recursive=True)
                    folders[folder] = 0
                place, draft = f"{root}/{folder}/{name}", f"{root}/{folder}/.{name}-{uuid.uuid4().hex}"
                with system.open_output_stream(draft) as out:
                    out.write((text or "").encode())
                system.move(draft, place)
                folders[folder] += 1
                files.append(f"{folder}/{name}")
        return Written(folders, zlib.compress("\n".join(files).encode()))

    def commit(self, messages: list[Written | None]) -> None:
        system, root = self._root()
        system.create_dir(root, recursive=True)
        with system.open_output_stream(f"{root}/_SUCCESS") as out:
            out.write(b"")

    def abort(self, messages: list[Written | None]) -> None:
        system, root = self._root()
        for m in messages:
            for f in (f"{root}/{n}" for n in m.files) if m else ():
                if system.get_file_info(f).type == fs.FileType.File:
                    system.delete_file(f)


class MarkdownFiles(DataSource):
    """Format ``markdown_files``: rows (folder, name, text)."""

    @classmethod
    def name(cls) -> str:
        return "markdown_files"

    def schema(self) -> str:
        return "folder string, name string, text string"

    def writer(self, schema, overwrite: bool) -> FilesWriter:
        return FilesWriter(self.options["path"])


def named(docs: DataFrame, group: str, id_col: str = "doc_id") -> DataFrame:
    """folder, name and text of each document: ``<group>/<id>.md``.

    A null id is named by its text's hash. Where different texts have one id, each name carries its text's hash; equal rows are one file.
    """
    known = F.coalesce(F.col(id_col).cast("string"), F.md5(F.coalesce("text", F.lit(""))))
    rows = docs.select(safe_name(F.col(group).cast("string")).alias("folder"), safe_name(known).alias("base"), F.col("text"), F.md5(F.coalesce("text", F.lit(""))).alias("hash"))
    # names that several texts have, of which there are few
    shared = rows.groupBy("folder", "base").agg(F.min("hash").alias("a"), F.max("hash").alias("b")).where("a != b").select("folder", "base", F.lit(True).alias("shared"))
    rows = rows.join(shared, ["folder", "base"], "left")
    return rows.select("folder", F.concat("base", F.when(F.col("shared"), F.concat(F.lit("-"), F.substring("hash", 1, 12))).otherwise(""), F.lit(".md")).alias("name"), "text")


def write(docs: DataFrame, path: str, group: str = "province", id_col: str = "doc_id") -> None:
    """Each document as ``<path>/<group>/<id>.md``."""
    docs.sparkSession.dataSource.register(MarkdownFiles)
    named(docs, group, id_col).write.format("markdown_files").mode("append").save(path)


def listed(spark: SparkSession, path: str, suffix: str = ".md") -> DataFrame:
    """file_path of each file ``<path>/<folder>/<name>``: a folder is listed by one task, and the paths are kept in a table."""
    kept = workspace(spark, "listed")

    def folders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                system, root = _located(path)
                yield pa.RecordBatch.from_arrays([pa.array(sorted(_names(system, root, True)), pa.string())], ["folder"])

    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for folder in b.column(0).to_pylist():
                system, root = _located(path)
                some: list[str] = []
                for name in _names(system, f"{root}/{folder}", False):
                    if name.endswith(suffix):
                        some.append(f"{root}/{folder}/{name}")
                    if len(some) >= LISTED:
                        yield pa.RecordBatch.from_arrays([pa.array(some, pa.string())], ["file_path"])
                        some = []
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.string())], ["file_path"])

    found = spark.range(1).mapInArrow(folders, "folder string").repartition(LISTERS, "folder")
    found.mapInArrow(paths, "file_path string").write.parquet(kept)
    return spark.read.schema("file_path string").parquet(kept)


def opened(files: DataFrame, path: str) -> DataFrame:
    """``files`` (file_path and any other columns) with text, file_name, file_size and modified; files are dealt among tasks by their number."""
    spark = files.sparkSession
    others = files.columns
    tasks = max(spark.sparkContext.defaultParallelism, -(-files.count() // TASK_FILES))

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = _located(path)

        def packed(b: pa.RecordBatch, start: int, rows: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.string(), pa.string(), pa.int64(), pa.timestamp("us", "UTC"))
            new = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            return pa.RecordBatch.from_arrays([*b.slice(start, len(rows)).columns, *new], [*others, "text", "file_name", "file_size", "modified"])

        for b in batches:
            start, rows, held = 0, [], 0
            for f in b.column(b.schema.get_field_index("file_path")).to_pylist():
                with system.open_input_stream(f) as held_open:
                    data = held_open.read()
                modified = datetime.fromtimestamp(system.get_file_info(f).mtime_ns // 1000 / 1e6, timezone.utc)
                rows.append((data.decode(errors="replace"), posixpath.basename(f), len(data), modified))
                held += len(data)
                if held >= READ_BYTES:
                    yield packed(b, start, rows)
                    start, rows, held = start + len(rows), [], 0
            if rows:
                yield packed(b, start, rows)

    kinds = ", ".join(f"`{c}` {k}" for c, k in files.dtypes)
    return files.repartition(tasks).mapInArrow(texts, f"{kinds}, text string, file_name string, file_size long, modified timestamp")


def read(spark: SparkSession, path: str, profiles: bool = False, size: int | None = None) -> DataFrame:
    """What ``files.read_markdown`` tells of each file that ``write`` wrote, its folder, and with ``size`` its batch_number.

    Batches are numbered by the paths alone, before a text is read.
    """
    files = listed(spark, path)
    raw = opened(numbered(files, size) if size else files, path)
    return described(raw, profiles).withColumn("folder", F.regexp_extract("file_path", "/([^/]*)/[^/]*$", 1))


def numbered(files: DataFrame, size: int = BATCH_FILES, by: str = "file_path") -> DataFrame:
    """``files`` with batch_number, of ``size`` files each in the order of their paths.

    Paths are dealt into ranges and put in order in each; a file's place is the number of paths in the ranges before, a row for each range, and its place in its own.
    """
    spark = files.sparkSession
    path = workspace(spark, "paths")
    ranged = files.select(by).distinct().repartitionByRange(RANGES, by).sortWithinPartitions(by)
    # written, since the places hold for one run alone; an id is the partition's number and the place in it
    ranged.withColumn("at", F.monotonically_increasing_id()).write.parquet(path)
    place = spark.read.schema(f"`{by}` string, at long").parquet(path)
    place = place.select(by, F.expr("shiftright(at, 33)").alias("range"), F.expr("at & 8589934591").alias("at"))
    before, total = {}, 0
    for r in sorted(place.groupBy("range").count().collect()):
        before[r["range"]] = total
        total += r["count"]
    start = F.element_at(F.create_map(*[F.lit(x) for pair in before.items() for x in pair]), F.col("range")) if before else F.lit(0)
    number = (F.floor((start + F.col("at")) / size) + 1).cast("int")
    return files.join(place.select(by, number.alias("batch_number")), by)
