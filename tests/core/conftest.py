import numpy as np
import pytest

from chunkweave.meta import ArrayMeta
from chunkweave.varray import VArray


@pytest.fixture
def make(spark):
    """make(shape, chunks, dtype, codecs...): every chunk in one file, one after the other from byte ``first``."""

    def build(shape, chunks, dtype="<i4", first=100, path="/foo.nc", present=None, **meta):
        m = ArrayMeta(shape, chunks, dtype, **meta)
        n = int(np.prod(chunks, dtype=np.int64)) * m.itemsize
        entries = {}
        for k, idx in enumerate(np.ndindex(*m.grid)):
            key = ".".join(map(str, idx)) or "0"
            if present is None or key in present:
                entries[key] = {"path": path, "offset": first + k * n, "length": n}
        return VArray.from_dict(spark, m, entries)

    return build


def offsets(arr):
    return {k: e["offset"] for k, e in arr.dict().items()}
