"""The page source and sink as a Python Data Source: spark.read.format("quire_pages") and df.write.format("quire_pages").

Reading: each file of a folder is a document in the text codec, and a partition of the scan; the option `pages` (such
as "1,3") keeps only those page numbers, before pages leave the reader. Writing: a file for each document of a
partition; rows of a document must be together and in page order. Paths must be visible to all executors.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import groupby

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import Row, StructType

from quire.sources.codecs import TextCodec

SUFFIX = ".pages"


def _folder(options: dict) -> str:
    return options["path"].removeprefix("file://")


class File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = _folder(options)
        self.pages = {int(x) for x in options.get("pages", "").split(",") if x.strip().isdigit()}

    def partitions(self) -> list[InputPartition]:
        return [File(os.path.join(self.folder, x)) for x in sorted(os.listdir(self.folder)) if x.endswith(SUFFIX)]

    def read(self, partition: File) -> Iterator[tuple]:
        with open(partition.path, "rb") as file:
            parts = TextCodec().decode(file.read())
        ident = int(os.path.basename(partition.path).removesuffix(SUFFIX))
        for number, text in enumerate(parts, 1):
            if not self.pages or number in self.pages:
                yield ident, number, text


class Written(WriterCommitMessage):
    def __init__(self, names: list[str]):
        self.names = names


class Writer(DataSourceWriter):
    def __init__(self, options: dict):
        self.folder = _folder(options)

    def write(self, rows: Iterator[Row]) -> WriterCommitMessage:
        from pyspark import TaskContext

        os.makedirs(self.folder, exist_ok=True)
        attempt, names = TaskContext.get().taskAttemptId(), []
        for ident, pages in groupby(rows, key=lambda r: r["doc_id"]):
            name = f"{ident}{SUFFIX}"
            with open(os.path.join(self.folder, f".{name}.{attempt}"), "wb") as file:
                file.write(TextCodec().encode([r["text"] or "" for r in pages]))
            names.append(f".{name}.{attempt}")
        return Written(names)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        names = [n.rpartition(".")[0] for m in messages if m for n in m.names]
        if len(set(names)) < len(names):
            raise ValueError("a document's rows are in more than one partition, or not together in one: repartition by doc_id and sort")
        for name in (n for m in messages if m for n in m.names):
            os.replace(os.path.join(self.folder, name), os.path.join(self.folder, name[1:].rpartition(".")[0]))

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        for name in {n for m in messages if m for n in m.names}:
            os.unlink(os.path.join(self.folder, name))


class PagesSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "quire_pages"

    def schema(self) -> str:
        return "doc_id long, page long, text string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return Reader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return Writer(self.options)


def register(spark) -> None:
    from quire.workers import reach

    reach(spark)
    spark.dataSource.register(PagesSource)
