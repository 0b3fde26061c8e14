"""A Spark data source of pre-extracted pages: a folder of JSON lines files, one file per document.

``spark.read.format("extracted_pages").load(folder)`` gives source, page, text. A document is a
partition; conditions on ``source`` (``=``, IN, and these joined by AND) reach the source, which
then opens no other files, and conditions on ``page`` skip lines before their text is decoded
further. What can't be pushed down is left to Spark. The folder must be one that ``pyarrow.fs`` opens. Lines that aren't JSON objects are passed
over, as one bad page is no reason to lose a document.
"""

from __future__ import annotations

import json
import posixpath
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

NAME = "extracted_pages"
SCHEMA = "source string, page int, text string"
SUFFIX = ".jsonl"
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


@dataclass
class Document(InputPartition):
    source: str
    path: str


def _system(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


class PagesReader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder
        self.sources: set[str] | None = None
        self.pages: set[int] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes ``=`` and IN on source and page, which come joined by AND, and gives back the others."""
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is not None and f.attribute == ("source",):
                self.sources = values if self.sources is None else self.sources & values
            elif values is not None and f.attribute == ("page",):
                self.pages = values if self.pages is None else self.pages & values
            else:
                yield f

    def partitions(self) -> list[Document]:
        from pyarrow import fs

        system, root = _system(self.folder)
        if self.sources is not None:  # named documents aren't searched for
            paths = [(s, posixpath.join(root, quote(s, safe="") + SUFFIX)) for s in sorted(s for s in self.sources if s is not None)]
            there = [i.type == fs.FileType.File for i in system.get_file_info([p for _, p in paths])]
            return [Document(s, p) for (s, p), ok in zip(paths, there, strict=True) if ok]
        infos = system.get_file_info(fs.FileSelector(root, allow_not_found=False))
        return [Document(unquote(i.base_name[: -len(SUFFIX)]), i.path) for i in sorted(infos, key=lambda i: i.path) if i.base_name.endswith(SUFFIX)]

    def read(self, partition: Document) -> Iterator[tuple]:
        if partition is None or not isinstance(partition, Document):
            return
        system, _ = _system(self.folder)
        with system.open_input_stream(partition.path) as stream:
            for line in _lines(stream):
                try:
                    row = json.loads(line)
                except ValueError:
                    continue
                if not isinstance(row, dict):
                    continue
                page = row.get("page")
                page = page if isinstance(page, int) else None
                if self.pages is None or page in self.pages:
                    yield partition.source, page, row.get("text") if isinstance(row.get("text"), str) else None


def _lines(stream, size: int = 1 << 20) -> Iterator[bytes]:
    """Lines of a stream of bytes, a block at a time."""
    rest = b""
    while block := stream.read(size):
        *whole, rest = (rest + block).split(b"\n")
        yield from whole
    if rest:
        yield rest


class PagesSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PagesReader:
        folder = self.options.get("path")
        if not folder:
            raise ValueError("load() needs the folder of the documents")
        return PagesReader(folder)


def extracted_pages(spark: SparkSession, folder: str) -> DataFrame:
    """source, page, text of all documents in the folder."""
    spark.dataSource.register(PagesSource)
    spark.conf.set(PUSHDOWN, "true")
    return spark.read.format(NAME).load(folder)
