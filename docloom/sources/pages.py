"""Landed result pages as a Spark data source, read at once or as a stream.

A page is a JSON file ``day=D/page=P/*.json`` of the object that a listing service answers: ``count`` of all results of the
day, ``limit`` of a page, ``results`` with ids. A file may also hold many pages, one a line with its number in ``page``, and
then lies in the folder of the first (``.json`` or ``.txt``). Each file is a partition of its own, so one that can't be read
costs one task's retry; beyond some hundreds, files in a row share one. A stream's offset is the last page read, by day and then number; what lands behind it later is left to
:func:`docloom.sources.records.missing_pages`, which names every page that the counts call for and that is not there.
"""

from __future__ import annotations

import datetime
import json
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow.fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

NAME = "landed_pages"
SCHEMA = "day date, page bigint, count bigint, limit bigint, results array<struct<id:bigint>>"
_FILE = re.compile(r"day=(\d{4}-\d{2}-\d{2})/page=(\d+)/[^/_.][^/]*\.(?:json|txt)$")


PARTS = 512  # partitions, at most


@dataclass(frozen=True)
class Page:
    day: str
    number: int  # of the file's first page
    file: str


@dataclass
class Part(InputPartition):
    pages: list[Page]

    def __post_init__(self) -> None:
        super().__init__(None)


def _open(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path)


def _landed(path: str) -> list[Page]:
    """All pages of a folder in order; names only, no page is opened."""
    fs, folder = _open(path)
    found = [(m[1], int(m[2]), f.path) for f in fs.get_file_info(pyarrow.fs.FileSelector(folder, recursive=True, allow_not_found=True)) if (m := _FILE.search(f.path))]
    return [Page(*f) for f in sorted(found)]


def _parts(pages: list[Page]) -> list[Part]:
    """Files in a row, as many to a partition as keep these few."""
    each = -(-len(pages) // PARTS)
    return [Part(pages[at : at + each]) for at in range(0, len(pages), each or 1)]


def _bodies(text: bytes) -> list[dict]:
    """The objects of a file: one, or one a line that tells its page; what is neither is one without fields."""
    try:
        body = json.loads(text)
        return [body if isinstance(body, dict) else {}]
    except ValueError:
        pass
    try:
        bodies = [json.loads(line) for line in text.splitlines() if line.strip()]
    except ValueError:
        return [{}]
    return bodies if bodies and all(isinstance(b, dict) and isinstance(b.get("page"), int) for b in bodies) else [{}]


def _rows(path: str, part: Part | None) -> Iterator[tuple]:
    """A row for each page; one that is no JSON object has no count and no results. No part, as of an empty folder, has no row."""
    if part is None:
        return
    fs, _ = _open(path)
    for page in part.pages:
        with fs.open_input_stream(page.file) as source:
            text = source.read()
        for body in _bodies(text):
            ids = [(r.get("id"),) for r in body.get("results") or [] if isinstance(r, dict)]
            number = body.get("page")
            yield datetime.date.fromisoformat(page.day), number if isinstance(number, int) else page.number, body.get("count"), body.get("limit"), ids


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> Sequence[Part]:
        return _parts(_landed(self.path))

    def read(self, partition: Part) -> Iterator[tuple]:
        return _rows(self.path, partition)


class _Stream(DataSourceStreamReader):
    def __init__(self, path: str):
        self.path = path

    def initialOffset(self) -> dict:
        return {"day": "", "page": 0}

    def latestOffset(self) -> dict:
        landed = _landed(self.path)
        return {"day": landed[-1].day, "page": landed[-1].number} if landed else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> Sequence[Part]:
        first, last = (start["day"], start["page"]), (end["day"], end["page"])
        return _parts([p for p in _landed(self.path) if first < (p.day, p.number) <= last])

    def read(self, partition: Part) -> Iterator[tuple]:
        return _rows(self.path, partition)

    def commit(self, end: dict) -> None:
        """Pages stay where they landed."""


class PageSource(DataSource):
    """``spark.read.format("landed_pages").load(folder)``; the same with ``readStream``."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"])

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Stream(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PageSource)
