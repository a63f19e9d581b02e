"""Selection on the chunk grid: filters and shifts of the index column, never of bytes, but for whole-row cuts of raw chunks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import SubChunkIndexingError
from ..functions.keys import at_axis
from ..meta import ceil_div
from ..varray import VArray


def _indexers(key, ndim: int) -> tuple[list, list[int]]:
    """One indexer for each axis, and the places of new axes in the result's order of indexers."""
    key = key if isinstance(key, tuple) else (key,)
    for k in key:
        if not (k is None or k is Ellipsis or isinstance(k, (int, np.integer, slice, np.ndarray, list)) and not isinstance(k, bool)):
            raise TypeError(f"indexer must be of type int, slice, Ellipsis, None or array, not {type(k).__name__}")
    if sum(k is Ellipsis for k in key) > 1:
        raise ValueError("an indexer with multiple Ellipses isn't valid")
    real = [k for k in key if k is not None]
    if Ellipsis in [k for k in real if k is Ellipsis]:
        at = next(i for i, k in enumerate(key) if k is Ellipsis)
        free = ndim - (len(real) - 1)
        if free < 0:
            raise ValueError(f"Invalid indexer for array with ndim={ndim}: {key}")
        key = key[:at] + (slice(None),) * free + key[at + 1 :]
    elif len(real) != ndim:
        raise ValueError(f"Invalid indexer for array with ndim={ndim}: {key}")
    return [k for k in key if k is not None], [i for i, k in enumerate(key) if k is None]


def _step(indexer, length: int, chunk: int) -> tuple:
    """('all',), ('chunks', lo, hi, new length), ('drop', chunk number) or ('sub', start, stop); or SubChunkIndexingError."""
    if isinstance(indexer, (int, np.integer)):
        i = int(indexer)
        if not -length <= i < length:
            raise IndexError(f"index {i} is out of bounds for length {length}")
        if chunk != 1:
            raise SubChunkIndexingError(f"integer index {i} on an axis of chunk length {chunk}: the slice would split individual chunks")
        return ("drop", i % length)
    start, stop, step = indexer.indices(length)
    stop = max(start, stop)
    if step != 1:
        raise SubChunkIndexingError(f"a slice with step {step} would split individual chunks: the slice would split individual chunks")
    if (start, stop) == (0, length):
        return ("all",)
    if start % chunk == 0 and (stop == length or stop % chunk == 0):
        return ("chunks", start // chunk, ceil_div(stop, chunk), stop - start)
    return ("sub", start, stop)


def _axis(idx: Column, a: int) -> Column:
    return F.get(idx, F.lit(a))


def _without(idx: Column, axes: set[int], ndim: int) -> Column:
    kept = [_axis(idx, a) for a in range(ndim) if a not in axes]
    return F.array(*kept) if kept else F.array().cast("array<bigint>")


def _raw_axis(arr: VArray) -> int | None:
    """The axis along which an uncompressed chunk's bytes can be cut."""
    names = [c["name"] for c in arr.meta.codecs]
    if names == ["bytes"]:
        return 0
    if names == ["transpose", "bytes"]:
        return arr.meta.codecs[0]["configuration"]["order"][0]
    return None


def _sub(arr: VArray, axis: int, start: int, stop: int) -> VArray:
    """A slice inside one chunk of the slowest axis of raw chunks: offsets and lengths are moved."""
    chunk = arr.chunks[axis]
    n = stop - start
    if axis != _raw_axis(arr) or n <= 0 or start // chunk != (stop - 1) // chunk:
        raise SubChunkIndexingError(f"slice {start}:{stop} on axis {axis} with chunk length {chunk}: the slice would split individual chunks")
    stride = arr.meta.itemsize * int(np.prod([c for i, c in enumerate(arr.chunks) if i != axis], dtype=np.int64))
    k, inner = start // chunk, start % chunk
    refs = (
        arr.refs.where(_axis(F.col("idx"), axis) == k)
        .withColumn("idx", at_axis(F.col("idx"), axis, lambda _: F.lit(0).cast("bigint")))
        .withColumns({"offset": F.when(F.col("data").isNull(), F.col("offset") + inner * stride).otherwise(F.col("offset")), "length": F.lit(n * stride).cast("bigint"), "data": F.substring("data", inner * stride + 1, n * stride)})
    )
    shape = tuple(n if i == axis else s for i, s in enumerate(arr.shape))
    chunks = tuple(n if i == axis else c for i, c in enumerate(arr.chunks))
    return arr.with_refs(refs, shape=shape, chunks=chunks)


def index(arr: VArray, key) -> VArray:
    """``arr[key]``: integers, aligned slices, Ellipsis, None; arrays of positions reindex by whole chunks."""
    indexers, new_axes = _indexers(key, arr.ndim)
    if any(isinstance(k, (np.ndarray, list)) for k in indexers):
        if new_axes:
            raise NotImplementedError("new axes together with arrays of positions")
        return _by_positions(arr, indexers)
    steps = [_step(k, s, c) for k, s, c in zip(indexers, arr.shape, arr.chunks, strict=True)]
    subs = [a for a, s in enumerate(steps) if s[0] == "sub"]
    if len(subs) > 1:
        raise SubChunkIndexingError("slices on several axes: the slice would split individual chunks")
    dims = arr.meta.dims
    if subs:
        arr = _sub(arr, subs[0], *steps[subs[0]][1:])
        steps[subs[0]] = ("all",)
    if any(s[0] != "all" for s in steps):
        idx, refs = F.col("idx"), arr.refs
        lows = [s[1] if s[0] == "chunks" else 0 for s in steps]
        for a, s in enumerate(steps):
            if s[0] == "chunks":
                refs = refs.where((_axis(idx, a) >= s[1]) & (_axis(idx, a) < s[2]))
            elif s[0] == "drop":
                refs = refs.where(_axis(idx, a) == s[1])
        gone = {a for a, s in enumerate(steps) if s[0] == "drop"}
        moved = [(_axis(idx, a) - lows[a]) if lows[a] else _axis(idx, a) for a in range(arr.ndim) if a not in gone]
        refs = refs.withColumn("idx", F.array(*moved) if moved else F.array().cast("array<bigint>"))
        keep = [a for a in range(arr.ndim) if a not in gone]
        changes = {"shape": tuple(steps[a][3] if steps[a][0] == "chunks" else arr.shape[a] for a in keep)}
        if gone:
            changes |= {"chunks": tuple(arr.chunks[a] for a in keep), "dims": tuple(dims[a] for a in keep) if dims else None}
            if any(c["name"] == "transpose" for c in arr.meta.codecs):
                changes["codecs"] = _without_axes(arr.meta.codecs, gone)
        arr = arr.with_refs(refs, **changes)
    if new_axes:
        # places count in the indexer as written; dropped axes before them move them left
        full = list(key if isinstance(key, tuple) else (key,))
        if any(k is Ellipsis for k in full):
            at = next(i for i, k in enumerate(full) if k is Ellipsis)
            full[at : at + 1] = [slice(None)] * (len(indexers) + len(new_axes) - len(full) + 1)
        out = 0
        for k in full:
            if k is None:
                from .combine import expand_dims

                arr = expand_dims(arr, out)
            if k is None or not isinstance(k, (int, np.integer)):
                out += 1
    return arr


def _without_axes(codecs, gone: set[int]) -> tuple[dict, ...]:
    out = []
    for c in codecs:
        if c["name"] == "transpose":
            order = [a - sum(g < a for g in gone) for a in c["configuration"]["order"] if a not in gone]
            if order == list(range(len(order))):
                continue
            c = {"name": "transpose", "configuration": {"order": order}}
        out.append(c)
    return tuple(out)


def _by_positions(arr: VArray, indexers: list) -> VArray:
    """Arrays of source positions, -1 for none, one axis after the other; broadcast shapes such as (N, 1) count as one axis each."""
    from .align import reindex_axis

    for a, k in enumerate(indexers):
        if isinstance(k, (np.ndarray, list)):
            k = np.asarray(k)
            if k.dtype == bool:
                raise NotImplementedError("boolean indexing of virtual arrays")
            if k.ndim > 1:
                if sum(n != 1 for n in k.shape) > 1:
                    raise NotImplementedError("pointwise indexing of virtual arrays")
                k = k.ravel()
            elif k.ndim == 1 and sum(isinstance(x, (np.ndarray, list)) for x in indexers) > 1 and len({np.asarray(x).shape for x in indexers if isinstance(x, (np.ndarray, list))}) == 1 and k.size > 1:
                raise NotImplementedError("pointwise indexing of virtual arrays")
            if np.array_equal(k, np.arange(arr.shape[a])):
                continue
            try:
                arr = reindex_axis(arr, a, [int(x) for x in k])
            except NotImplementedError as e:
                raise NotImplementedError(f"Cannot align/reindex this virtual array along axis {a}: {e}; rechunk the files, or read the array first") from e
        elif not (isinstance(k, slice) and k.indices(arr.shape[a]) == (0, arr.shape[a], 1)):
            raise NotImplementedError("arrays of positions together with other indexers")
    return arr
