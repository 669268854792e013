"""A sink that writes a file for each row, with a commit in two steps.

A task writes its files into a folder of its own under ``_writing`` and names that folder when it is
done. Once all tasks are, the driver moves one folder for each task to where readers look; if the
write fails, it removes them. So files are there all at once or not at all, and a task that is run
again or twice leaves one copy. The driver sees folders, never files.

Paths are those of a file system that driver and executors share, local ones or URIs.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import Row, StructType

WRITING = "_writing"


def _store(path: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system of a path, and the path in it."""
    return arrow_fs.FileSystem.from_uri(path) if ":" in path else (arrow_fs.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    """What a task is done with: its folder, or none if it had no rows."""

    folder: str | None
    files: int


class FilesWriter(DataSourceWriter):
    """Writes (file, content): names and bytes."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[Row]) -> Written:
        store, root = _store(self.path)
        folder, n = None, 0
        for row in iterator:
            if folder is None:
                folder = posixpath.join(WRITING, self.job, uuid.uuid4().hex)
                store.create_dir(posixpath.join(root, folder), recursive=True)
            if not row["file"] or "/" in row["file"]:
                raise ValueError(f"no name of a file: {row['file']!r}")
            with store.open_output_stream(posixpath.join(root, folder, row["file"])) as out:
                out.write(bytes(row["content"] or b""))
            n += 1
        return Written(folder, n)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = _store(self.path)
        before = [f.path for f in store.get_file_info(arrow_fs.FileSelector(root, allow_not_found=True)) if posixpath.basename(f.path).startswith("part-")] if self.overwrite else []
        for message in messages:  # one for each task
            if message is not None and message.folder is not None:
                store.move(posixpath.join(root, message.folder), posixpath.join(root, f"part-{posixpath.basename(message.folder)}"))
        for old in before:
            store.delete_dir(old)
        self._clear(store, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*_store(self.path))

    def _clear(self, store: arrow_fs.FileSystem, root: str) -> None:
        """Remove what tasks of this write have left, those that failed or were run twice too."""
        own = posixpath.join(root, WRITING, self.job)
        if store.get_file_info(own).type != arrow_fs.FileType.NotFound:
            store.delete_dir(own)


class Files(DataSource):
    """The sink by name; the path is that of the folder."""

    @classmethod
    def name(cls) -> str:
        return "files"

    def schema(self) -> str:
        return "file string, content binary"

    def writer(self, schema: StructType, overwrite: bool) -> FilesWriter:
        return FilesWriter(self.options["path"], overwrite)


def write(df: DataFrame, path: str, file: str = "file", content: str = "content", overwrite: bool = False) -> None:
    """A file for each row, named by one column, with the bytes of another; null contents are empty files."""
    spark = df.sparkSession
    spark.dataSource.register(Files)
    df.select(F.col(file).alias("file"), F.col(content).cast("binary").alias("content")).write.format("files").mode("overwrite" if overwrite else "append").save(path)
