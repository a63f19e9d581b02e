"""Equality of references and arrays."""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..varray import VArray


def elementwise_eq(a: VArray, b: VArray) -> DataFrame:
    """idx, equal for every chunk that either array has."""
    x, y = a.refs.alias("x"), b.refs.alias("y")
    same = F.expr("x.path <=> y.path and x.offset <=> y.offset and x.length <=> y.length and x.data <=> y.data and x.idx is not null and y.idx is not null")
    return x.join(y, F.col("x.idx") == F.col("y.idx"), "full_outer").select(F.coalesce("x.idx", "y.idx").alias("idx"), same.alias("equal"))


def refs_equal(a: VArray, b: VArray) -> bool:
    """All references are the same, inlined bytes too."""
    return elementwise_eq(a, b).where("not equal").isEmpty()


def array_eq(a: VArray, other) -> np.ndarray:
    """A boolean array, all true or all false: chunks aren't compared in part."""
    if isinstance(other, (int, float, bool, complex, str, bytes, np.generic, np.ndarray)):
        return np.zeros(a.shape, bool)
    if not isinstance(other, VArray):
        raise TypeError(f"can't compare a virtual array with {type(other).__name__}")
    if a.shape != other.shape:
        raise NotImplementedError("comparison of virtual arrays of different shapes")
    if a.meta.comparable() != other.meta.comparable():
        return np.zeros(a.shape, bool)
    if refs_equal(a, other):
        return np.ones(a.shape, bool)
    warnings.warn("some chunks differ; elements aren't compared one by one, so all count as different", UserWarning, stacklevel=3)
    return np.zeros(a.shape, bool)


def isnan(a: VArray) -> np.ndarray:
    """All false: values can't be seen."""
    return np.zeros(a.shape, bool)


def full_like(a: VArray, fill_value, dtype=None) -> np.ndarray:
    return np.full(a.shape, fill_value, dtype or a.dtype)
