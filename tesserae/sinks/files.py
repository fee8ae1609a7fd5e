"""Files written whole or not at all: a data source for many of them, and one from the driver.

df.write.format("slide_files").mode("append").save(folder) writes rows (name, data) as files of
the folder. Tasks write beside their targets, in parts of a few megabytes; the files take their
names when all tasks have succeeded, and go if one has failed. A file of the same name is
replaced, others stay. The folder must be shared.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from tesserae.session import reachable

PART_BYTES = 4 << 20


class PartFile:
    """A file beside its target that takes its place on close(); writes are gathered into large ones."""

    def __init__(self, target: str):
        self.target, self.path = target, f"{target}.{uuid.uuid4().hex}.part"
        self._file, self._waiting, self._size = open(self.path, "wb"), [], 0
        self.written = 0

    def write(self, data: bytes) -> int:
        self._waiting.append(data)
        self._size += len(data)
        self.written += len(data)
        if self._size >= PART_BYTES:
            self.flush()
        return len(data)

    def flush(self) -> None:
        self._file.write(b"".join(self._waiting))
        self._waiting, self._size = [], 0

    def finish(self) -> None:
        """Everything is on disk, beside the target."""
        self.flush()
        self._file.close()

    def close(self) -> None:
        self.finish()
        os.replace(self.path, self.target)

    def abort(self) -> None:
        self._file.close()
        if os.path.exists(self.path):
            os.remove(self.path)


def write_file(target: str, data: bytes) -> int:
    out = PartFile(target)
    try:
        out.write(data)
        out.close()
    except BaseException:
        out.abort()
        raise
    return len(data)


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]] = field(default_factory=list)


class FilesWriter(DataSourceWriter):
    def __init__(self, options: dict):
        self.folder = options["path"].removeprefix("file://").removeprefix("file:")
        os.makedirs(self.folder, exist_ok=True)

    def write(self, rows: Iterator) -> Written:
        done = Written()
        try:
            for row in rows:
                name = os.path.basename(row["name"])
                if name != row["name"] or not name:
                    raise ValueError(f"{row['name']!r} is no plain file name")
                out = PartFile(os.path.join(self.folder, name))
                done.files.append((out.path, out.target))
                data = memoryview(bytes(row["data"] or b""))
                for at in range(0, len(data), PART_BYTES):
                    out.write(data[at : at + PART_BYTES])
                out.finish()
        except BaseException:
            self._remove([done])
            raise
        return done

    def _remove(self, messages: list) -> None:
        for m in messages:
            for part, _ in m.files if m else ():
                if os.path.exists(part):
                    os.remove(part)

    def commit(self, messages: list) -> None:
        every = [x for m in messages if m for x in m.files]
        if len({target for _, target in every}) < len(every):
            self._remove(messages)
            raise ValueError("two rows have the same name")
        for part, target in every:
            os.replace(part, target)

    def abort(self, messages: list) -> None:
        self._remove(messages)


class FilesSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "slide_files"

    def schema(self) -> str:
        return "name string, data binary"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return FilesWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    reachable(spark)
    spark.dataSource.register(FilesSource)
