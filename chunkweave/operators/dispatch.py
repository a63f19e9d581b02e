"""What numpy's own functions do when they are given virtual arrays."""

from __future__ import annotations

import numpy as np

from . import align, combine, compare


def _concatenate(arrays, axis=0, out=None, *, dtype=None, casting="same_kind"):
    _plain(out=out, dtype=dtype)
    return combine.concatenate(list(arrays), axis)


def _stack(arrays, axis=0, out=None, *, dtype=None, casting="same_kind"):
    _plain(out=out, dtype=dtype)
    return combine.stack(list(arrays), axis)


def _broadcast_to(array, shape, subok=False):
    return combine.broadcast_to(array, (shape,) if isinstance(shape, (int, np.integer)) else tuple(shape))


def _full_like(a, fill_value, dtype=None, order="K", subok=True, shape=None, *, device=None):
    _plain(shape=shape)
    return compare.full_like(a, fill_value, dtype)


def _plain(**given) -> None:
    """Options of numpy that mean nothing for virtual arrays must be left at their defaults."""
    for name, value in given.items():
        if value is not None:
            raise NotImplementedError(f"{name} can't be given for virtual arrays")


FUNCTIONS = {
    np.concatenate: _concatenate,
    np.stack: _stack,
    np.expand_dims: combine.expand_dims,
    np.broadcast_to: _broadcast_to,
    np.where: align.where,
    np.full_like: _full_like,
    np.result_type: combine.result_dtype,
    np.shape: lambda a: a.shape,
    np.ndim: lambda a: a.ndim,
    np.size: lambda a, axis=None: a.size if axis is None else a.shape[axis],
}
UFUNCS = {np.equal: lambda a, b: compare.array_eq(*((a, b) if not isinstance(a, np.ndarray) else (b, a))), np.isnan: compare.isnan}
