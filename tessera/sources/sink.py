"""A sink that makes a file of each row: column ``name`` is its path below the target, ``content`` what it holds.

Tasks write to a folder of their own below ``_staged-<job>``; a job that fails is undone by removing that one folder, so
nothing of it is ever seen.  Of a job that succeeds, only the folders of its successful attempts are published: tasks
move their files to the target, so the driver neither lists nor renames files.  Any store that Arrow opens will do.
"""

from __future__ import annotations

import json
import posixpath
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path or URI, and the path inside it."""
    return fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", re.sub("^file:/+", "/", path)))


@dataclass
class Attempt(WriterCommitMessage):
    folder: str
    files: int


class FileWriter(DataSourceWriter):
    def __init__(self, path: str, staged: str) -> None:
        self.path, self.staged = path.rstrip("/"), staged

    def write(self, rows: Iterator[Row]) -> Attempt:
        store, root = opened(f"{self.path}/{self.staged}")
        context = TaskContext.get()
        folder = f"{context.partitionId() if context else 0}-{uuid.uuid4().hex}"
        seen: set[str] = set()
        for row in rows:
            name = row["name"]
            if not name or name != posixpath.normpath(name) or name.startswith(("/", "..")):
                raise ValueError(f"{name!r} is not the path of a file below the target")
            if name in seen:
                raise ValueError(f"{name!r} comes twice")
            seen.add(name)
            content = row["content"]
            at = f"{root}/{folder}/{name}"
            store.create_dir(posixpath.dirname(at), recursive=True)
            with store.open_output_stream(at) as out:
                out.write(content.encode() if isinstance(content, str) else bytes(content or b""))
        return Attempt(folder, len(seen))

    def commit(self, messages: list[Attempt | None]) -> None:
        """Name the attempts that count; there is one for each task."""
        store, root = opened(f"{self.path}/{self.staged}")
        store.create_dir(root, recursive=True)
        with store.open_output_stream(f"{root}/_attempts.json") as out:
            out.write(json.dumps([m.folder for m in messages if m is not None and m.files]).encode())

    def abort(self, messages: list[Attempt | None]) -> None:
        store, root = opened(f"{self.path}/{self.staged}")
        store.delete_dir_contents(root, missing_dir_ok=True)
        if store.get_file_info(root).type == fs.FileType.Directory:
            store.delete_dir(root)


class FileSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "row_files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema: StructType, overwrite: bool) -> FileWriter:
        return FileWriter(self.options["path"], self.options["staged"])


def _published(attempts: DataFrame, path: str, staged: str) -> DataFrame:
    """Move the files of each attempt (folder) to the target; files that were moved before are no longer there, so this can be repeated."""

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = opened(path)
        for b in batches:
            for folder in b.column("folder").to_pylist():
                base, n = f"{root}/{staged}/{folder}", 0
                for f in store.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True)):
                    if f.type == fs.FileType.File:
                        target = f"{root}/{posixpath.relpath(f.path, base)}"
                        store.create_dir(posixpath.dirname(target), recursive=True)
                        store.move(f.path, target)
                        n += 1
                yield pa.RecordBatch.from_arrays([pa.array([n])], ["n"])

    return attempts.mapInArrow(move, "n long")


def publish(spark: SparkSession, path: str, staged: str) -> int:
    """Move what the job ``staged`` wrote to ``path``, and return how many files these are."""
    store, root = opened(path)
    with store.open_input_stream(f"{root}/{staged}/_attempts.json") as f:
        folders = json.loads(f.read())  # a name for each task
    moved = 0
    if folders:
        attempts = spark.createDataFrame([(x,) for x in folders], "folder string").repartition(len(folders))
        moved = _published(attempts, path, staged).agg(F.sum("n")).first()[0]
    store.delete_dir(f"{root}/{staged}")
    return moved


def write_files(rows: DataFrame, path: str) -> int:
    """Write the rows (name, content: text or bytes) as files below ``path`` and return how many were moved there.

    A file of that name is replaced; others stay.  Null content makes an empty file.  A name that is null, comes twice or
    leads out of the target fails the job, which then leaves no file.
    """
    spark = rows.sparkSession
    spark.dataSource.register(FileSource)
    path, staged = path.rstrip("/"), f"_staged-{uuid.uuid4().hex}"
    content = F.col("content") if rows.schema["content"].dataType.simpleString() == "binary" else F.encode(F.col("content").cast("string"), "utf-8")
    dealt = rows.select(F.col("name").cast("string").alias("name"), content.alias("content")).repartition("name")  # so that a repeated name meets itself
    dealt.write.format("row_files").option("path", path).option("staged", staged).mode("append").save()
    return publish(spark, path, staged)
