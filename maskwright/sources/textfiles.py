"""A sink that writes one text file for each row, as a Spark data source.

Tasks write to a folder of their own attempt below the target; the names that count are those of the attempts Spark
commits, and only then they are moved into place. What tasks of a failed write may leave behind lies in folders whose
names readers skip, and the next overwrite deletes it.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT = "maskwright_textfiles"


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    """(file system, path) of a URI; a plain path is local."""
    if "://" in uri or uri.startswith("file:"):
        return pafs.FileSystem.from_uri("file://" + uri.removeprefix("file:") if uri.startswith("file:/") and not uri.startswith("file://") else uri)
    return pafs.LocalFileSystem(), os.path.abspath(uri)


@dataclass
class Written(WriterCommitMessage):
    folder: str
    names: list[str]


class TextFilesWriter(DataSourceWriter):
    def __init__(self, path: str, schema: StructType, encoding: str, overwrite: bool):
        for column in ("name", "text"):
            if column not in schema.names:
                raise ValueError(f"rows need a column {column!r}")
        self.path, self.encoding, self.overwrite = path.rstrip("/"), encoding, overwrite
        self.attempt = f"{self.path}/_attempts-{uuid.uuid4().hex}"

    def write(self, rows: Iterator[Row]) -> Written:
        folder = f"{self.attempt}/{uuid.uuid4().hex}"
        system, root = opened(folder)
        system.create_dir(root, recursive=True)
        names = []
        for row in rows:
            name = row["name"]
            if not name or "/" in name or name.startswith((".", "_")):
                raise ValueError(f"not a file name: {name!r}")
            with system.open_output_stream(f"{root}/{name}") as out:
                out.write((row["text"] or "").encode(self.encoding))
            names.append(name)
        return Written(folder, names)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = opened(self.path)
        done = [m for m in messages if m is not None]
        names = [name for m in done for name in m.names]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("two rows have one file name")
        if self.overwrite:
            own = os.path.basename(self.attempt)
            for found in system.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
                if found.type == pafs.FileType.File:
                    system.delete_file(found.path)
                elif found.base_name.startswith("_attempts-") and found.base_name != own:
                    system.delete_dir(found.path)
        for m in done:
            _, folder = opened(m.folder)
            for name in m.names:
                system.move(f"{folder}/{name}", f"{root}/{name}")
        self._clean()

    def abort(self, messages: list[Written | None]) -> None:
        self._clean()

    def _clean(self) -> None:
        system, root = opened(self.attempt)
        if system.get_file_info(root).type == pafs.FileType.Directory:
            system.delete_dir(root)


class TextFiles(DataSource):
    """``df.write.format("maskwright_textfiles").mode(...).save(path)``: rows (name, text) as files; option ``encoding``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: StructType, overwrite: bool) -> TextFilesWriter:
        return TextFilesWriter(self.options["path"], schema, self.options.get("encoding", "utf-8"), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TextFiles)
