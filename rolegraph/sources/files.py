"""Files below some folders as a Spark data source: names, sizes and times, no contents, and nothing left out but dot names.

Spark's own file index passes over names that begin with ``_``; this source keeps them.  The driver lists folders level by
level only until there are enough of them to share out; tasks walk what is below.  Conditions on path, size and mtime reach
the source: a walk enters no folder that can't hold a path asked for, and rows that don't fit never leave Python.  Folders that
can't be read are passed over; links are not followed.

Places are anything that ``pyarrow.fs`` opens: plain paths, ``file:``, ``s3:``, ``gs:``, ``hdfs:``.
"""

from __future__ import annotations

import json
import operator
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D

from rolegraph.operators.frozen import ship

NAME = "rolegraph_files"
SCHEMA = "path string, size bigint, mtime bigint"
#: Folders to share out, and rows of a batch.
SHARES, BATCH = 64, 8192
COMPARE = {D.EqualTo: operator.eq, D.GreaterThan: operator.gt, D.GreaterThanOrEqual: operator.ge, D.LessThan: operator.lt, D.LessThanOrEqual: operator.le, D.In: lambda x, many: x in many, D.StringStartsWith: str.startswith, D.StringEndsWith: str.endswith, D.StringContains: lambda x, y: y in x}


def opened(place: str) -> tuple[fs.FileSystem, str, str]:
    """(file system, path in it, what to put before its paths to get those of the table)."""
    if "://" not in place and not place.startswith("file:"):
        return fs.LocalFileSystem(), place, ""
    system, path = fs.FileSystem.from_uri(place)
    if isinstance(system, fs.LocalFileSystem):
        return system, path, ""
    return system, path, place[: len(place) - len(path)] if place.endswith(path) else place.partition("://")[0] + "://"


@dataclass
class Share(D.InputPartition):
    place: str
    path: str
    deep: bool

    def __init__(self, place: str, path: str, deep: bool) -> None:
        super().__init__(None)
        self.place, self.path, self.deep = place, path, deep


def _entries(system: fs.FileSystem, folder: str) -> list[fs.FileInfo]:
    try:
        found = system.get_file_info(fs.FileSelector(folder, recursive=False))
    except OSError:
        return []
    found = [x for x in found if not x.base_name.startswith(".")]
    if isinstance(system, fs.LocalFileSystem):
        import os

        found = [x for x in found if not os.path.islink(x.path)]
    return sorted(found, key=lambda x: x.path)


class FileReader(D.DataSourceReader):
    def __init__(self, places: list[str]) -> None:
        self.places, self.asked = places, []

    def pushFilters(self, filters: list[D.Filter]) -> Iterable[D.Filter]:
        for f in filters:
            if type(f) in COMPARE and len(f.attribute) == 1:
                self.asked.append((f.attribute[0], type(f), f.value))
            elif not isinstance(f, D.IsNotNull):  # no column here is ever null
                yield f

    def _inside(self, folder: str) -> bool:
        """Whether a path below the folder can meet the conditions."""
        below = folder.rstrip("/") + "/"
        for column, kind, value in self.asked:
            if column == "path" and kind in (D.EqualTo, D.StringStartsWith) and not (value.startswith(below) or (kind is D.StringStartsWith and below.startswith(value))):
                return False
            if column == "path" and kind is D.In and not any(v.startswith(below) for v in value if v is not None):
                return False
        return True

    def _fits(self, row: tuple[str, int, int]) -> bool:
        values = dict(zip(("path", "size", "mtime"), row, strict=True))
        return all(COMPARE[kind](values[column], value) for column, kind, value in self.asked)

    def partitions(self) -> list[Share]:
        flat, deep = [], []
        for place in self.places:
            system, path, before = opened(place)
            level = [path]
            for _ in range(8):
                if not level or len(level) >= SHARES:
                    break
                below = []
                for folder in level:
                    flat.append(Share(place, folder, False))
                    below += [x.path for x in _entries(system, folder) if x.type == fs.FileType.Directory and self._inside(before + x.path)]
                level = below
            deep += [Share(place, folder, True) for folder in level]
        return [*flat, *deep]

    def read(self, share: Share) -> Iterator[pa.RecordBatch]:
        system, _, before = opened(share.place)
        rows, folders = [], [share.path]
        batch = lambda: pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["path", "size", "mtime"])
        while folders:
            for x in _entries(system, folders.pop()):
                if x.type == fs.FileType.Directory:
                    if share.deep and self._inside(before + x.path):
                        folders.append(x.path)
                elif self._fits(row := (before + x.path, x.size or 0, (x.mtime_ns or 0) // 10**9)):
                    rows.append(row)
                    if len(rows) == BATCH:
                        yield batch()
                        rows.clear()
        if rows:
            yield batch()


class FileSource(D.DataSource):
    """``spark.read.format("rolegraph_files").option("places", <JSON list>)``."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FileReader:
        return FileReader(json.loads(self.options["places"]))


def listed(spark: SparkSession, places: list[str]) -> DataFrame:
    """(path, size, mtime) of all files below the places."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FileSource)
    return spark.read.format(NAME).option("places", json.dumps(places)).load()
