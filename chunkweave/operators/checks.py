"""Whether arrays can be combined; every check raises."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..meta import ArrayMeta


def _same(values, error: Exception) -> None:
    values = list(values)
    if any(v != values[0] for v in values[1:]):
        raise error


def same_dtype(metas: list[ArrayMeta]) -> None:
    _same((m.dtype for m in metas), ValueError(f"Cannot combine arrays with inconsistent dtypes: {[str(m.dtype) for m in metas]}"))


def same_codecs(metas: list[ArrayMeta]) -> None:
    _same((m.codecs for m in metas), NotImplementedError("Arrays with different codecs can't be combined; chunks of one array share their codecs"))


def same_chunks(metas: list[ArrayMeta]) -> None:
    _same((m.chunks for m in metas), ValueError(f"Cannot combine arrays with inconsistent chunk shapes: {[m.chunks for m in metas]}"))


def same_ndim(metas: list[ArrayMeta]) -> None:
    _same((m.ndim for m in metas), ValueError(f"Cannot combine arrays with differing number of dimensions: {[m.ndim for m in metas]}"))


def same_shape(metas: list[ArrayMeta]) -> None:
    _same((m.shape for m in metas), ValueError(f"Cannot stack arrays with differing shapes: {[m.shape for m in metas]}"))


def same_shape_except(metas: list[ArrayMeta], axes: set[int]) -> None:
    _same((tuple(s for i, s in enumerate(m.shape) if i not in axes) for m in metas), ValueError(f"Cannot concatenate arrays with shapes {[m.shape for m in metas]} along axes {sorted(axes)}"))


def no_partial_chunks(metas: list[ArrayMeta], axis: int) -> None:
    for i, m in enumerate(metas):
        if m.shape[axis] % m.chunks[axis]:
            raise ValueError(f"Cannot concatenate arrays with partial chunks: input {i} has length {m.shape[axis]} and chunk length {m.chunks[axis]} on axis {axis}")


def combinable(metas: list[ArrayMeta]) -> None:
    same_dtype(metas)
    same_codecs(metas)
    same_chunks(metas)


def same_encoding(*encodings: dict) -> None:
    """Encodings agree wherever they share a key."""
    seen: dict = {}
    for e in encodings:
        for k, v in e.items():
            if k in seen and seen[k] != v and not (seen[k] != seen[k] and v != v):
                raise ValueError(f"Encodings have different values for encoding key {k!r}: {seen[k]!r} and {v!r}")
            seen.setdefault(k, v)


def appendable(existing: ArrayMeta, new: ArrayMeta, axes: set[int]) -> None:
    """``new`` can go into a stored array along ``axes``."""
    combinable([existing, new])
    same_ndim([existing, new])
    same_shape_except([existing, new], axes)


# the same checks over a relation of arrays (name, shape, chunks, dtype, codec_fp), for many files at once


def incompatible(arrays: DataFrame) -> DataFrame:
    """name, n_dtypes, n_codecs, n_chunk_shapes, n_ranks of variables whose arrays can't be combined."""
    g = arrays.groupBy("name").agg(F.countDistinct("dtype").alias("n_dtypes"), F.countDistinct("codec_fp").alias("n_codecs"), F.countDistinct(F.concat_ws(",", F.transform("chunks", lambda x: x.cast("string")))).alias("n_chunk_shapes"), F.countDistinct(F.size("shape")).alias("n_ranks"))
    return g.where("n_dtypes > 1 or n_codecs > 1 or n_chunk_shapes > 1 or n_ranks > 1")


def partial_arrays(arrays: DataFrame, axis: int) -> DataFrame:
    """Arrays with a partial chunk on an axis."""
    return arrays.where(F.get("shape", F.lit(axis)) % F.get("chunks", F.lit(axis)) > 0)


def oversize_arrays(arrays: DataFrame) -> DataFrame:
    """Arrays with a chunk longer than the array on some axis."""
    return arrays.where(F.exists(F.zip_with("chunks", "shape", lambda c, s: c > s), lambda x: x))


def name_conflicts(arrays: DataFrame) -> DataFrame:
    """name, n of variables whose definitions (fp) differ between datasets."""
    return arrays.groupBy("name").agg(F.countDistinct("fp").alias("n")).where("n > 1")


def container_violations(refs: DataFrame, prefixes: list[str]) -> DataFrame:
    """Virtual references below no allowed prefix."""
    ok = F.lit(False)
    for p in prefixes:
        ok = ok | F.startswith("path", F.lit(p))
    return refs.where(F.col("data").isNull() & ~ok)


def default_loadable(arrays: DataFrame) -> DataFrame:
    """Arrays named after their only dimension."""
    return arrays.where((F.size("dims") == 1) & (F.get("dims", F.lit(0)) == F.col("name")))


def absent(expected: DataFrame, present: DataFrame) -> DataFrame:
    """(file, name) pairs that are expected and not there."""
    return expected.join(present, ["file", "name"], "left_anti")
