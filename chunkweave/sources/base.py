"""Parsers: from files to groups of virtual arrays.

A parser for single files describes one file with :class:`Parsed` arrays; :class:`FileParser` runs it in Spark tasks,
a file each, through a Python data source, and gathers only metadata on the driver.  References stay distributed.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

from ..dataset import VGroup
from ..functions.keys import uri
from ..meta import ArrayMeta
from ..read import open_input
from ..varray import VArray

ROWS = "file string, grp string, name string, kind string, meta string, idx array<bigint>, path string, offset bigint, length bigint, data binary"


@dataclass
class Parsed:
    """One array of a file. chunks: (idx, path, offset, length, data) each."""

    name: str
    meta: ArrayMeta
    chunks: list[tuple]
    group: str = ""


@dataclass
class ParsedFile:
    arrays: list[Parsed] = field(default_factory=list)
    #: Attributes by group path; '' is the root.
    groups: dict[str, dict] = field(default_factory=dict)


class _File(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.parser, self.urls = _parser(options), json.loads(options["urls"])
        self.only: set[str] | None = None

    def partitions(self):
        return [_File(u) for u in self.urls]

    def read(self, partition):
        found = self.parser.parse(partition.path)
        for g, attrs in found.groups.items():
            yield (partition.path, g, "", "group", json.dumps(attrs), None, None, None, None, None)
        for a in found.arrays:
            if a.name in self.parser.skip_variables or self.only is not None and a.name not in self.only:
                continue
            yield (partition.path, a.group, a.name, "array", json.dumps(a.meta.to_row()), None, None, None, None, None)
            for idx, path, offset, length, data in a.chunks:
                yield (partition.path, a.group, a.name, "chunk", None, [int(i) for i in idx], path, offset, length, data)


class _PushingReader(_Reader):
    """For sessions that push filters down to such sources: Spark refuses one that could where they don't."""

    def pushFilters(self, filters):
        """Names of variables are left out as files are parsed; Spark still applies every filter."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("name",):
                self.only = {f.value}
            elif isinstance(f, In) and f.attribute == ("name",):
                self.only = set(f.value)
            yield f


class ChunkRefs(DataSource):
    """``spark.read.format("chunkrefs").option("parser", "<module>:<class>").option("urls", "[...]")``."""

    @classmethod
    def name(cls):
        return "chunkrefs"

    def schema(self):
        return ROWS

    def reader(self, schema):
        options = dict(self.options)
        return _PushingReader(options) if options.get("push") == "true" else _Reader(options)


def _parser(options: dict) -> FileParser:
    import importlib

    module, _, name = options["parser"].partition(":")
    return getattr(importlib.import_module(module), name)(**json.loads(options.get("arguments", "{}")))


class FileParser:
    """Base of parsers of single files: override :meth:`parse`.  ``group`` picks a group; ``skip_variables`` are left out."""

    def __init__(self, group: str | None = None, skip_variables: list[str] | None = None):
        self.group, self.skip_variables = group, list(skip_variables or ())

    def arguments(self) -> dict[str, Any]:
        """What the class is built from again in the tasks."""
        return {"group": self.group, "skip_variables": self.skip_variables}

    def parse(self, url: str) -> ParsedFile:
        raise NotImplementedError

    def open(self, url: str):
        return open_input(url)

    def rows(self, spark: SparkSession, urls: list[str]) -> DataFrame:
        """:data:`ROWS` of all files, one task each."""
        spark.dataSource.register(ChunkRefs)
        made = f"{type(self).__module__}:{type(self).__qualname__}"
        return spark.read.format("chunkrefs").options(parser=made, arguments=json.dumps(self.arguments()), urls=json.dumps([uri(u) for u in urls]), push=spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")).load()

    def __call__(self, spark: SparkSession, url: str) -> VGroup:
        return group_of(self.rows(spark, [url]), self.group)


def group_of(rows: DataFrame, group: str | None = None, file: str | None = None) -> VGroup:
    """The group tree of one file's :data:`ROWS`."""
    if file is not None:
        rows = rows.where(F.col("file") == file)
    return _tree(rows, rows.where("kind <> 'chunk'").select("grp", "name", "kind", "meta").collect()).group(group)


def groups_of(rows: DataFrame, group: str | None = None) -> dict[str, VGroup]:
    """The group trees of all files in :data:`ROWS`, whose metadata come in one job."""
    found: dict[str, list] = {}
    for r in rows.where("kind <> 'chunk'").select("file", "grp", "name", "kind", "meta").collect():
        found.setdefault(r["file"], []).append(r)
    return {file: _tree(rows.where(F.col("file") == file), own).group(group) for file, own in found.items()}


def _tree(rows: DataFrame, found: list) -> VGroup:
    root = VGroup()

    def at(path: str) -> VGroup:
        node = root
        for p in path.strip("/").split("/"):
            if p:
                node = node.groups.setdefault(p, VGroup())
        return node

    for r in found:
        node = at(r["grp"])
        if r["kind"] == "group":
            node.attributes.update(json.loads(r["meta"]))
        else:
            own = (F.col("kind") == "chunk") & (F.col("grp") == r["grp"]) & (F.col("name") == r["name"])
            refs = rows.where(own).select("idx", "path", "offset", "length", "data")
            node.arrays[r["name"]] = VArray(ArrayMeta.from_row(json.loads(r["meta"])), refs)
    return root
