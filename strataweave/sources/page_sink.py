"""A Spark data source that writes one file a row: executors stage files, one commit puts all in place."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import Row, StructType

from . import store


@dataclass
class Staged(WriterCommitMessage):
    """What a task has written: its staging folder and the files in it."""

    folder: str
    files: list[str]


class TextFiles(DataSource):
    """Rows ``(file, body)`` as text files below the option ``path``; files that are not named stay as they are."""

    @classmethod
    def name(cls) -> str:
        return "strataweave-files"

    def writer(self, schema: StructType, overwrite: bool) -> FileWriter:
        return FileWriter(self.options["path"], f".staging-{uuid.uuid4().hex}")


class FileWriter(DataSourceWriter):
    """A task writes into a folder of its own, so tries of a task never meet; only the tries that Spark commits are moved into place."""

    def __init__(self, path: str, staging: str) -> None:
        self.path, self.staging = path.rstrip("/"), f"{path.rstrip('/')}/{staging}"

    def write(self, iterator: Iterator[Row]) -> Staged:
        folder, files = f"{self.staging}/{uuid.uuid4().hex}", {}
        for row in iterator:
            store.write(f"{folder}/{row.file}", row.body.encode("utf-8", "surrogatepass"))
            files[row.file] = None
        return Staged(folder, list(files))

    def commit(self, messages: list[Staged | None]) -> None:
        moves = [(f"{m.folder}/{f}", f"{self.path}/{f}") for m in messages if m for f in m.files]
        with ThreadPoolExecutor(16) as pool:
            list(pool.map(lambda pair: store.move(*pair), moves))
        store.delete(self.staging)

    def abort(self, messages: list[Staged | None]) -> None:
        store.delete(self.staging)
