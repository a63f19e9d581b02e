"""A virtual array: metadata on the driver, chunk references in a DataFrame.

References are sparse: ``idx ARRAY<BIGINT>, path STRING, offset BIGINT, length BIGINT, data BINARY``.  A row with
``data`` is inlined, others are virtual; a missing chunk has no row.  Operators change metadata at once and add
projections, filters and joins to the DataFrame; no chunk is read and nothing runs until asked.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import keys
from .meta import ArrayMeta

REFS = "idx array<bigint>, path string, offset bigint, length bigint, data binary"
COLUMNS = ["idx", "path", "offset", "length", "data"]
#: Bytes that a dense grid position takes in memory: path, offset and length.
POSITION_BYTES = 32


class VArray:
    """One virtual array. Supports slicing, ``==``, and the functions of :mod:`chunkweave.operators`."""

    def __init__(self, meta: ArrayMeta, refs: DataFrame):
        self.meta, self.refs = meta, refs

    # construction

    @classmethod
    def from_dict(cls, spark: SparkSession, meta: ArrayMeta, entries: dict[str, dict], fs_root: str | None = None) -> VArray:
        """From {chunk key: {path, offset, length[, data]}}; every entry is checked. Empty paths are missing chunks."""
        names = {"path", "offset", "length"}
        for k, e in entries.items():
            if not isinstance(e, dict) or not names <= set(e) <= names | {"data"}:
                raise ValueError(f"entry {k!r} must be a dict with keys path, offset and length, and data at most")
            for name in ("offset", "length"):
                if isinstance(e[name], bool) or not isinstance(e[name], (int, np.integer)):
                    raise TypeError(f"{name} of {k!r} must be an integer")
                if e[name] < 0:
                    raise ValueError(f"{name} of {k!r} must not be negative")
        given = [k for k in entries if k]
        rank = keys.check_keys(given)
        if given and rank != meta.ndim and not (meta.ndim == 0 and given == ["0"]):
            raise ValueError(f"chunk keys of rank {rank} for an array of rank {meta.ndim}")
        rows = []
        for k, e in entries.items():
            idx = [] if meta.ndim == 0 else [int(x) for x in k.split(".")]
            if e.get("data") is not None:
                rows.append((idx, None, 0, len(e["data"]), bytearray(e["data"])))
            elif e["path"]:
                rows.append((idx, keys.uri(str(e["path"]), fs_root), int(e["offset"]), int(e["length"]), None))
        return cls(meta, spark.createDataFrame(rows, REFS))

    @classmethod
    def empty(cls, spark: SparkSession, meta: ArrayMeta) -> VArray:
        return cls(meta, spark.createDataFrame([], REFS))

    def with_refs(self, refs: DataFrame, **changes) -> VArray:
        return VArray(self.meta.replace(**changes) if changes else self.meta, refs.select(*COLUMNS))

    @property
    def spark(self) -> SparkSession:
        return self.refs.sparkSession

    # properties

    shape = property(lambda self: self.meta.shape)
    chunks = property(lambda self: self.meta.chunks)
    dtype = property(lambda self: self.meta.dtype)
    ndim = property(lambda self: self.meta.ndim)
    size = property(lambda self: self.meta.size)
    grid = property(lambda self: self.meta.grid)

    def __repr__(self) -> str:
        return f"VArray<shape={self.shape}, dtype={self.dtype}, chunks={self.chunks}>"

    def __array__(self, dtype=None, copy=None):
        raise NotImplementedError("virtual arrays can't be converted into numpy arrays; read them with chunkweave.read")

    def __array_function__(self, func, types, args, kwargs):
        """numpy's functions on virtual arrays, where there is an operator for them."""
        from .operators.dispatch import FUNCTIONS

        return FUNCTIONS[func](*args, **kwargs) if func in FUNCTIONS else NotImplemented

    def __array_ufunc__(self, ufunc, method, *inputs, **kwargs):
        from .operators.dispatch import UFUNCS

        return UFUNCS[ufunc](*inputs) if method == "__call__" and ufunc in UFUNCS and not kwargs else NotImplemented

    # enumeration and lookup

    def keyed(self) -> DataFrame:
        """chunk_key, path, offset, length, data."""
        return self.refs.select(keys.format_key(F.col("idx")).alias("chunk_key"), "path", "offset", "length", "data")

    def dict(self) -> dict[str, dict]:
        """{chunk key: entry} of the chunks that are there, on the driver: for small arrays and tests."""
        out = {}
        for r in self.keyed().toLocalIterator():
            out[r["chunk_key"]] = {"path": r["path"] or "", "offset": r["offset"], "length": r["length"]} | ({"data": bytes(r["data"])} if r["data"] is not None else {})
        return dict(sorted(out.items(), key=lambda kv: [int(x) for x in kv[0].split(".") if x]))

    def lookup(self, key: str | tuple[int, ...]) -> dict | None:
        """The entry of one chunk, or None where it is missing."""
        idx = tuple(int(x) for x in key.split(".") if x) if isinstance(key, str) else tuple(key)
        rows = self.refs.where(F.col("idx") == F.array(*[F.lit(int(i)).cast("bigint") for i in idx]).cast("array<bigint>")).limit(1).collect()
        if not rows:
            return None
        r = rows[0]
        return {"path": r["path"] or "", "offset": r["offset"], "length": r["length"]} | ({"data": bytes(r["data"])} if r["data"] is not None else {})

    def virtual_refs(self) -> DataFrame:
        return self.refs.where("data is null")

    def iter_refs(self):
        """(idx, entry) of every chunk that is there, streamed partition by partition."""
        for r in self.refs.toLocalIterator():
            yield tuple(r["idx"]), {"path": r["path"], "offset": r["offset"], "length": r["length"], "data": r["data"]}

    # renaming

    def rename_paths(self, new: str | Callable[[str], str] | Column) -> VArray:
        """Other paths for the virtual chunks: one path, a Column made from column ``path``, or a function of strings, run on Arrow batches."""
        if isinstance(new, Column):
            path = new
        elif isinstance(new, str):
            path = F.lit(keys.uri(new))
        elif callable(new):
            path = _of_strings(new)(F.col("path"))
        else:
            raise TypeError(f"new paths must be a string, Column or function, not {type(new).__name__}")
        return self.with_refs(self.refs.withColumn("path", F.when(F.col("data").isNull(), keys.normalise_uri(path))))

    # metrics

    def n_refs_dense(self) -> int:
        """Grid positions, whether or not a chunk is there."""
        return self.meta.n_chunks

    def n_refs(self) -> int:
        """Chunks that are there."""
        return self.refs.count()

    def nbytes_virtual(self) -> int:
        """Bytes to hold the references of all grid positions, and inlined chunks."""
        inlined = self.refs.agg(F.coalesce(F.sum(F.octet_length("data")), F.lit(0)).alias("n")).first()["n"]
        return POSITION_BYTES * self.meta.n_chunks + inlined

    @property
    def nbytes(self) -> int:
        """Bytes of the array that the references stand for."""
        return self.meta.size * self.meta.itemsize

    # comparison and indexing live with the operators

    def __getitem__(self, key) -> VArray:
        from .operators.indexing import index

        return index(self, key)

    def __eq__(self, other):
        from .operators.compare import array_eq

        return array_eq(self, other)

    __hash__ = None

    def astype(self, dtype) -> VArray:
        if np.issubdtype(self.dtype, np.dtype(dtype)):
            return self
        raise NotImplementedError("the dtype of virtual arrays can't change")

    def with_fill_value_only(self, fill_value) -> VArray:
        """The same array without chunks, so that it reads as ``fill_value`` everywhere."""
        return VArray(self.meta.replace(fill_value=fill_value), self.spark.createDataFrame([], REFS))


def _of_strings(f: Callable[[str], str]) -> Callable[[Column], Column]:
    import pyarrow as pa
    from pyspark.sql.functions import arrow_udf

    return arrow_udf(lambda c: pa.array([None if p is None else str(f(p)) for p in c.to_pylist()], pa.string()), "string")
