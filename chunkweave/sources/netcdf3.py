"""netCDF classic files (CDF-1, CDF-2, CDF-5), by their header."""

from __future__ import annotations

import math

import numpy as np

from ..meta import BYTES_BIG, ArrayMeta
from .base import FileParser, Parsed, ParsedFile

#: Type codes of the format. Fixed values.
_TYPES = {1: "i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: "u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}


class _Header:
    def __init__(self, data: bytes):
        self.data, self.at = data, 4
        if data[:3] != b"CDF" or data[3] not in (1, 2, 5):
            raise ValueError("no netCDF classic file")
        self.wide, self.far = data[3] == 5, data[3] >= 2

    def number(self, size: int) -> int:
        if self.at + size > len(self.data):
            raise IndexError
        out = int.from_bytes(self.data[self.at : self.at + size], "big")
        self.at += size
        return out

    def count(self) -> int:
        return self.number(8 if self.wide else 4)

    def name(self) -> str:
        n = self.count()
        out = self.data[self.at : self.at + n].decode()
        self.at += -(-n // 4) * 4
        return out

    def attributes(self) -> dict:
        self.number(4)
        out = {}
        for _ in range(self.count()):
            name, kind, n = self.name(), self.number(4), self.count()
            dtype = np.dtype(_TYPES[kind])
            raw = self.data[self.at : self.at + n * dtype.itemsize]
            if len(raw) < n * dtype.itemsize:
                raise IndexError
            self.at += -(-len(raw) // 4) * 4
            values = np.frombuffer(raw, dtype)
            out[name] = raw.decode("utf-8", "replace").rstrip("\0") if kind == 2 else values[0].item() if n == 1 else values.tolist()
        return out


class NetCDF3Parser(FileParser):
    """Fixed variables are one chunk; record variables have a chunk for each record."""

    def parse(self, url: str) -> ParsedFile:
        with self.open(url) as f:
            size, n = f.size(), 1 << 16
            while True:
                head = f.read_at(min(n, size), 0)
                try:
                    return self._parsed(_Header(head), url, size)
                except IndexError:
                    if n >= size:
                        raise ValueError("the header is cut short") from None
                    n *= 4

    def _parsed(self, h: _Header, url: str, size: int) -> ParsedFile:
        records = h.count()
        h.number(4)
        dims = [(h.name(), h.count()) for _ in range(h.count())]
        attrs = h.attributes()
        h.number(4)
        variables = []
        for _ in range(h.count()):
            name = h.name()
            own = [h.count() for _ in range(h.count())]
            a = h.attributes()
            kind, vsize = h.number(4), h.count()
            variables.append((name, own, a, kind, vsize, h.number(8 if h.far else 4)))
        is_record = lambda own: bool(own) and dims[own[0]][1] == 0
        of_records = [v for v in variables if is_record(v[1])]
        exact = lambda v: np.dtype(_TYPES[v[3]]).itemsize * math.prod(dims[d][1] for d in v[1][1:])
        # a lone record variable isn't padded
        step = exact(of_records[0]) if len(of_records) == 1 else sum(-(-exact(v) // 4) * 4 for v in of_records)
        if records in (0xFFFFFFFF, 2**64 - 1) and of_records:
            records = (size - min(v[5] for v in of_records)) // step
        out = ParsedFile(groups={"": attrs})
        for v in variables:
            name, own, a, kind, _, begin = v
            dtype = np.dtype(_TYPES[kind])
            names = tuple(dims[d][0] for d in own)
            codecs = (BYTES_BIG,) if dtype.byteorder == ">" else ()
            if is_record(own):
                rest = tuple(dims[d][1] for d in own[1:])
                meta = ArrayMeta((records, *rest), (1, *rest), dtype, a.get("_FillValue"), codecs, a, names)
                chunks = [([k, *[0] * len(rest)], url, begin + k * step, exact(v), None) for k in range(records)] if all(rest) else []
            else:
                shape = tuple(dims[d][1] for d in own)
                meta = ArrayMeta(shape, tuple(max(1, s) for s in shape), dtype, a.get("_FillValue"), codecs, a, names)
                n = dtype.itemsize * math.prod(shape)
                chunks = [([0] * len(shape), url, begin, n, None)] if n else []
            out.arrays.append(Parsed(name, meta, chunks))
        return out
