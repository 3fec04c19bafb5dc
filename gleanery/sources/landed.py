"""Landed item files as a Spark data source: spark.read.format("landed_items") and readStream.

A folder holds JSON files of items, one object per line or one array per file, named `<kind>-<name>-<yyyyMMddHH>.json`
after the kind of source, the source and the hour of landing. Each file is a partition. Filters on `kind` and
`landed_at` choose files before any is opened; Spark evaluates all other filters. As a stream, each trigger takes the
files that landed since the last one, in the order of their hours and names.

The folder is read by the workers as a local or mounted path. A file without the name's form is no source; a line that
is no JSON object gives an item with its text in `broken`. Python data sources run next to the JVM, so this is for
landed files of services, not for the large tables.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

NAME = re.compile(r"([a-z]+)-(.+)-([0-9]{10})\.json")
SCHEMA = "kind string, source string, landed_at timestamp, file string, pos int, id string, title string, url string, summary string, author string, published_at string, metrics map<string, long>, broken string"
FIELDS = ("id", "title", "url", "summary", "author", "published_at")


class Landed(InputPartition):
    """One file."""

    def __init__(self, path: str, kind: str, source: str, hour: str):
        super().__init__(path)
        self.path, self.kind, self.source = path, kind, source
        self.at = datetime.strptime(hour, "%Y%m%d%H").replace(tzinfo=timezone.utc)
        self.key = f"{hour}/{os.path.basename(path)}"


def landed(folder: str) -> list[Landed]:
    """The files of a folder by hour and name."""
    found = [(m, os.path.join(folder, name)) for name in os.listdir(folder) if (m := NAME.fullmatch(name))]
    return sorted((Landed(path, *m.groups()) for m, path in found), key=lambda f: f.key)


def _text(value) -> str | None:
    return None if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def _items(file: Landed) -> Iterator[tuple]:
    with open(file.path, encoding="utf-8", errors="replace") as f:
        text = f.read()
    try:
        rows = json.loads(text)
        rows = rows if isinstance(rows, list) else [rows]
    except ValueError:
        rows = []
        for line in filter(str.strip, text.splitlines()):
            try:
                rows.append(json.loads(line))
            except ValueError:
                rows.append(line)
    for pos, row in enumerate(rows):
        head = (file.kind, file.source, file.at, os.path.basename(file.path), pos)
        if not isinstance(row, dict):
            yield (*head, *[None] * len(FIELDS), None, _text(row))
            continue
        metrics = row.get("metrics")
        counts = {str(k): int(v) for k, v in metrics.items() if isinstance(v, int | float) and not isinstance(v, bool) and v == v and abs(v) < 2**63} if isinstance(metrics, dict) else None
        yield (*head, *[_text(row.get(f)) for f in FIELDS], counts, None)


class LandedReader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder, self.tests = folder, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes filters on kind and landed_at, which names of files decide, and leaves the rest to Spark."""
        compare = {EqualTo: lambda x, y: x == y, GreaterThan: lambda x, y: x > y, GreaterThanOrEqual: lambda x, y: x >= y, LessThan: lambda x, y: x < y, LessThanOrEqual: lambda x, y: x <= y, In: lambda x, y: x in y}
        for f in filters:
            column = getattr(f, "attribute", None)
            if type(f) in compare and column in (("kind",), ("landed_at",)):
                self.tests.append(("kind" if column == ("kind",) else "at", compare[type(f)], f.value))
            else:
                yield f

    def partitions(self) -> list[Landed]:
        return [f for f in landed(self.folder) if all(test(getattr(f, what), value) for what, test, value in self.tests)]

    def read(self, partition: Landed) -> Iterator[tuple]:
        return _items(partition) if partition is not None else iter(())


class LandedStream(DataSourceStreamReader):
    """Offsets are the hour and name of the last file taken."""

    def __init__(self, folder: str):
        self.folder = folder

    def initialOffset(self) -> dict:
        return {"after": ""}

    def latestOffset(self) -> dict:
        files = landed(self.folder)
        return {"after": files[-1].key if files else ""}

    def partitions(self, start: dict, end: dict) -> list[Landed]:
        return [f for f in landed(self.folder) if start["after"] < f.key <= end["after"]]

    def read(self, partition: Landed) -> Iterator[tuple]:
        return _items(partition)


class LandedItems(DataSource):
    @classmethod
    def name(cls) -> str:
        return "landed_items"

    def schema(self) -> str:
        return SCHEMA

    def _folder(self) -> str:
        folder = self.options.get("path")
        if not folder:
            raise ValueError("landed_items needs a path")
        return folder.removeprefix("file:")

    def reader(self, schema) -> LandedReader:
        return LandedReader(self._folder())

    def streamReader(self, schema) -> LandedStream:
        return LandedStream(self._folder())


def register(spark: SparkSession) -> None:
    """Makes the format known to a session and lets its filters reach the files."""
    spark.dataSource.register(LandedItems)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
