"""Chunk keys, URIs and byte ranges, as Column expressions and as plain functions for the driver."""

from __future__ import annotations

import posixpath
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY_RULE = r"^(0|[1-9]\d*)(\.(0|[1-9]\d*))*$"
SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:"


def at_axis(idx: Column, axis: int, f) -> Column:
    """The index with ``f`` applied to one axis."""
    return F.transform(idx, lambda x, i: F.when(i == axis, f(x)).otherwise(x))


def format_key(idx: Column, separator: str = ".") -> Column:
    """Chunk key of a grid index; the empty index gives the empty key."""
    return F.concat_ws(separator, F.transform(idx, lambda x: x.cast("string")))


def parse_key(key: Column, separator: str = ".") -> Column:
    """Grid index of a chunk key; '' gives the empty index."""
    parts = F.split(key, re.escape(separator))
    return F.when(key == "", F.array().cast("array<bigint>")).otherwise(F.transform(parts, lambda x: x.cast("bigint")))


def store_key_index(key: Column, separator: str = ".") -> Column:
    """Grid index of a store key that ends in ``c``, or in numbers with or without ``c`` before them; null where it doesn't match.

    ``foo/c`` is the empty index; ``foo/bar/c/1/23`` and ``foo/bar.c.1.23`` are (1, 23) with their separators.
    """
    s = re.escape(separator)
    tail = F.regexp_extract(key, rf"(?:^|[/{s}])(?:c{s})?(\d+(?:{s}\d+)*)$", 1)
    return F.when(key.rlike(r"(^|/)c$"), F.array().cast("array<bigint>")).when(tail != "", F.transform(F.split(tail, s), lambda x: x.cast("bigint")))


def parse_store_key(key: str, separator: str = ".") -> tuple[int, ...]:
    """The same on the driver; ValueError where the key doesn't match."""
    if re.search(r"(^|/)c$", key):
        return ()
    s = re.escape(separator)
    if not (m := re.search(rf"(?:^|[/{s}])(?:c{s})?(\d+(?:{s}\d+)*)$", key)):
        raise ValueError(f"Invalid chunk key {key!r} for separator {separator!r}")
    return tuple(map(int, m[1].split(separator)))


def bad_keys(df: DataFrame, key: str = "chunk_key") -> DataFrame:
    """Rows whose key isn't numbers joined by '.'."""
    return df.where(~F.col(key).rlike(KEY_RULE))


def check_keys(keys: list[str]) -> int:
    """Rank of the keys; ValueError on a malformed key or on mixed ranks."""
    ranks = set()
    for k in keys:
        if not re.fullmatch(KEY_RULE, k):
            raise ValueError(f"Invalid format for chunk key: {k!r}")
        ranks.add(k.count(".") + 1)
    if len(ranks) > 1:
        raise ValueError(f"Inconsistent number of dimensions between chunk keys: {sorted(ranks)}")
    return ranks.pop() if ranks else 0


def _dots(path: Column) -> Column:
    """Resolve '.' and '..' in an absolute posix path, by one fold over its parts."""
    keep = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    stack = F.aggregate(keep, F.array().cast("array<string>"), lambda acc, p: F.when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p))))
    return F.concat(F.lit("/"), F.concat_ws("/", stack))


def normalise_uri(path: Column, fs_root: str | None = None) -> Column:
    """URI of a path: with a scheme as it is, absolute posix paths as ``file://``, relative ones under ``fs_root``; null where that is missing."""
    out = F.when(path == "", path).when(path.rlike(SCHEME), path).when(F.startswith(path, F.lit("/")), F.concat(F.lit("file://"), path))
    if fs_root is not None:
        root = check_root(fs_root)
        if root.startswith("file://"):
            out = out.otherwise(F.concat(F.lit("file://"), _dots(F.concat(F.lit(root.removeprefix("file://").rstrip("/") + "/"), path))))
        else:
            out = out.otherwise(F.concat(F.lit(join_root(root, "")), path))
    return out


def join_root(root: str, path: str) -> str:
    return f"{root}{path}" if root.endswith("/") else f"{root}/{path}"


def check_root(fs_root: str) -> str:
    """A root as URI; ValueError unless it is an absolute folder."""
    last = fs_root.rstrip("/").rpartition("/")[2]
    scheme = re.match(SCHEME, fs_root)
    if not (scheme or fs_root.startswith("/")) or not scheme and "." in last:
        raise ValueError(f"fs_root must be an absolute filesystem directory path or URI, not {fs_root!r}")
    return fs_root if scheme else f"file://{fs_root}"


def uri(path: str, fs_root: str | None = None) -> str:
    """The same on the driver; ValueError for a relative path without a root."""
    if path == "" or re.match(SCHEME, path):
        return path
    if path.startswith("/"):
        return f"file://{path}"
    if fs_root is None:
        raise ValueError(f"paths must be absolute posix paths or URIs, not {path!r}")
    root = check_root(fs_root)
    if root.startswith("file://"):
        return "file://" + posixpath.normpath(posixpath.join(root.removeprefix("file://"), path))
    return join_root(root, path)


def resolve_range(offset: Column, length: Column, start: int | None = None, end: int | None = None, suffix: int | None = None) -> tuple[Column, Column]:
    """Offset and length of a part of a chunk, kept inside the chunk: [start, end), from ``start`` on, or the last ``suffix`` bytes."""
    if suffix is not None:
        n = F.least(F.lit(suffix).cast("bigint"), length)
        return offset + length - n, n
    a = F.least(F.lit(start or 0).cast("bigint"), length)
    b = length if end is None else F.least(F.lit(end).cast("bigint"), length)
    return offset + a, F.greatest(b - a, F.lit(0).cast("bigint"))


def prefix_of(path: Column) -> Column:
    """scheme://netloc of a URI."""
    return F.regexp_extract(path, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/]*)", 1)
