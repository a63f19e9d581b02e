"""Concatenate, stack, expand and broadcast: unions and shifts of references.

Any number of inputs becomes one ``UNION ALL`` with a literal shift each, a narrow plan without a shuffle.  Inputs
that already live in one DataFrame (many files) get their shifts from a window over the files, not over the
references: see :func:`concat_files`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import at_axis
from ..meta import ArrayMeta, ceil_div
from ..varray import COLUMNS, VArray
from . import checks, ranges


def _metas(arrays: list[VArray]) -> list[ArrayMeta]:
    if not arrays:
        raise ValueError("nothing to combine")
    return [a.meta for a in arrays]


def _union(parts: list[DataFrame]) -> DataFrame:
    """A balanced union, so that plans of thousands of inputs stay shallow."""
    while len(parts) > 1:
        parts = [reduce(DataFrame.unionByName, parts[i : i + 8]) for i in range(0, len(parts), 8)]
    return parts[0]


def _axis_of(axis, ndim: int) -> int:
    if axis is None:
        raise NotImplementedError("axis=None, which flattens, isn't supported")
    if isinstance(axis, bool) or not isinstance(axis, int):
        raise TypeError("axis must be an integer")
    if not -ndim <= axis < ndim:
        raise ValueError(f"axis {axis} is out of bounds for {ndim} dimensions")
    return axis % ndim


def _shifted(refs: DataFrame, axis: int, by: int) -> DataFrame:
    return refs.withColumn("idx", at_axis(F.col("idx"), axis, lambda x: x + by))


def concatenate(arrays: list[VArray], axis: int = 0) -> VArray:
    """Join along an axis; the first array's metadata count."""
    metas = _metas(arrays)
    checks.same_ndim(metas)
    axis = _axis_of(axis, metas[0].ndim)
    checks.combinable(metas)
    checks.same_shape_except(metas, {axis})
    checks.no_partial_chunks(metas, axis)
    shift, parts = 0, []
    for a in arrays:
        parts.append(_shifted(a.refs, axis, shift) if shift else a.refs)
        shift += a.grid[axis]
    shape = tuple(sum(m.shape[axis] for m in metas) if i == axis else s for i, s in enumerate(metas[0].shape))
    return arrays[0].with_refs(_union([p.select(*COLUMNS) for p in parts]), shape=shape)


def _moved_codecs(codecs, axis: int):
    """Transposes of the old axes, with the new axis stored slowest."""
    return tuple({"name": "transpose", "configuration": {"order": [axis, *[a + (a >= axis) for a in c["configuration"]["order"]]]}} if c["name"] == "transpose" else c for c in codecs)


def _with_axis(meta: ArrayMeta, axis: int, length: int) -> dict:
    chunks = meta.chunks[:axis] + (1,) + meta.chunks[axis:]
    changes: dict = {"shape": meta.shape[:axis] + (length,) + meta.shape[axis:], "chunks": chunks}
    if any(c["name"] == "transpose" for c in meta.codecs):
        changes["codecs"] = _moved_codecs(meta.codecs, axis)
    return changes


def stack(arrays: list[VArray], axis: int = 0) -> VArray:
    """Join along a new axis of chunk length 1; negative axes count in the result, as in numpy."""
    metas = _metas(arrays)
    checks.same_ndim(metas)
    checks.combinable(metas)
    checks.same_shape(metas)
    axis = _axis_of(axis, metas[0].ndim + 1)
    parts = [a.refs.withColumn("idx", F.array_insert("idx", axis + 1, F.lit(k).cast("bigint"))) for k, a in enumerate(arrays)]
    return arrays[0].with_refs(_union([p.select(*COLUMNS) for p in parts]), **_with_axis(metas[0], axis, len(arrays)))


def expand_dims(array: VArray, axis: int = 0) -> VArray:
    return stack([array], axis)


def broadcast_to(array: VArray, shape: tuple[int, ...]) -> VArray:
    """Repeat chunks over new leading axes and axes of length 1."""
    meta, shape = array.meta, tuple(int(s) for s in shape)
    lead = len(shape) - meta.ndim
    if lead < 0 or any(s not in (1, t) for s, t in zip(meta.shape, shape[max(0, lead) :], strict=True)):
        raise ValueError(f"array of shape {meta.shape} can't be broadcast to {shape}")
    chunks = (1,) * lead + meta.chunks
    refs = array.refs
    if lead:
        refs = refs.withColumn("idx", F.concat(F.array(*[F.lit(0).cast("bigint")] * lead), F.col("idx")))
    old = (1,) * lead + meta.shape
    for a, (was, is_) in enumerate(zip(old, shape, strict=True)):
        n = ceil_div(is_, chunks[a])
        if was == 1 and n != 1:
            copies = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))) if n else F.explode(F.array().cast("array<bigint>"))
            refs = refs.withColumn("_at", copies).withColumn("idx", at_axis(F.col("idx"), a, lambda _: F.col("_at"))).drop("_at")
    changes: dict = {"shape": shape, "chunks": chunks}
    if lead and any(c["name"] == "transpose" for c in meta.codecs):
        codecs = meta.codecs
        for _ in range(lead):
            codecs = _moved_codecs(codecs, 0)
        changes["codecs"] = codecs
    return array.with_refs(refs, **changes)


def concat_files(refs: DataFrame, files: DataFrame, axis: int) -> DataFrame:
    """References of many files joined along an axis in one pass.

    refs: file, idx, ...; files: file, ord, grid_len (chunks on the axis).  The prefix sum runs over the files,
    a row each, and joins the references by file.
    """
    starts = ranges.sums_before(files.select("file", "ord", "grid_len"), "ord", "grid_len", "_start").select("file", "_start")
    return refs.join(starts, "file").withColumn("idx", at_axis(F.col("idx"), axis, lambda x: x + F.col("_start"))).drop("_start")


def result_dtype(*operands):
    """The one dtype of the arrays among the operands; arrays that differ are refused."""
    found = [o.meta for o in operands if isinstance(o, VArray)]
    if not found:
        raise TypeError("no virtual array among the operands")
    checks.same_dtype(found)
    return found[0].dtype


def replace_box(array: VArray, patch: VArray, at: dict[int, int]) -> VArray:
    """``patch`` in the place of a box of chunks that begins at chunk ``at[axis]`` on the given axes."""
    checks.combinable([array.meta, patch.meta])
    checks.same_ndim([array.meta, patch.meta])
    checks.same_shape_except([array.meta, patch.meta], set(at))
    inside = F.lit(True)
    for a, lo in at.items():
        if lo + patch.grid[a] > array.grid[a]:
            raise ValueError(f"the box leaves the array on axis {a}")
        inside = inside & (F.get("idx", F.lit(a)) >= lo) & (F.get("idx", F.lit(a)) < lo + patch.grid[a])
    shifts = F.array(*[F.lit(at.get(a, 0)).cast("bigint") for a in range(array.ndim)])
    moved = patch.refs.withColumn("idx", F.zip_with("idx", shifts, lambda x, y: x + y))
    return array.with_refs(array.refs.where(~inside).select(*COLUMNS).unionByName(moved.select(*COLUMNS)))
