"""FITS files: images and binary tables by their header cards."""

from __future__ import annotations

import math
import re

import numpy as np

from ..meta import BYTES_BIG, ArrayMeta
from .base import FileParser, Parsed, ParsedFile

_BLOCK, _CARD = 2880, 80
#: BITPIX and TFORM codes of the format. Fixed values.
_IMAGE = {8: "u1", 16: ">i2", 32: ">i4", 64: ">i8", -32: ">f4", -64: ">f8"}
_FIELD = {"L": "S1", "X": "u1", "B": "u1", "I": ">i2", "J": ">i4", "K": ">i8", "A": "S", "E": ">f4", "D": ">f8", "C": ">c8", "M": ">c16"}


def _value(text: str):
    text = text.strip()
    if text.startswith("'"):
        return re.match(r"'((?:[^']|'')*)'", text)[1].replace("''", "'").rstrip()
    text = text.partition("/")[0].strip()
    if text in ("T", "F"):
        return text == "T"
    for kind in (int, lambda x: float(x.replace("D", "E"))):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def header(file, at: int) -> tuple[dict, int]:
    """Cards of the header at a place, and where its data begin."""
    cards: dict = {}
    while True:
        block = file.read_at(_BLOCK, at)
        if len(block) < _BLOCK:
            raise ValueError("the header is cut short")
        at += _BLOCK
        for i in range(0, _BLOCK, _CARD):
            card = block[i : i + _CARD].decode("ascii", "replace")
            name = card[:8].strip()
            if name == "END":
                return cards, at
            if card[8:10] == "= ":
                cards[name] = _value(card[10:])


class FITSParser(FileParser):
    """Each image or binary table is an array, named as the header says or by its place, in one chunk a row of the slowest axis' whole extent."""

    def parse(self, url: str) -> ParsedFile:
        out = ParsedFile(groups={"": {}})
        with self.open(url) as f:
            size, at, n = f.size(), 0, 0
            while at + _BLOCK <= size:
                cards, data = header(f, at)
                shape = tuple(int(cards[f"NAXIS{k}"]) for k in range(int(cards.get("NAXIS", 0)), 0, -1))
                bits = abs(int(cards.get("BITPIX", 8)))
                used = bits // 8 * int(cards.get("GCOUNT", 1)) * (int(cards.get("PCOUNT", 0)) + math.prod(shape)) if shape else 0
                name = str(cards.get("EXTNAME") or ("PRIMARY" if n == 0 else f"HDU{n}"))
                attrs = {k: v for k, v in cards.items() if k not in ("SIMPLE", "XTENSION", "EXTEND")}
                meta = None
                if cards.get("XTENSION") == "BINTABLE":
                    meta = self._table(cards, attrs)
                elif shape and all(shape):
                    dtype = np.dtype(_IMAGE[int(cards["BITPIX"])])
                    if "BSCALE" in cards or "BZERO" in cards:
                        attrs |= {"scale_factor": cards.get("BSCALE", 1), "add_offset": cards.get("BZERO", 0)}
                    if "BLANK" in cards:
                        attrs["_FillValue"] = cards["BLANK"]
                    meta = ArrayMeta(shape, shape, dtype, None, (BYTES_BIG,) if dtype.itemsize > 1 else (), attrs, tuple("zyx"[-len(shape) :]) if len(shape) <= 3 else tuple(f"axis{k}" for k in range(len(shape))))
                if meta is not None:
                    length = meta.itemsize * meta.size
                    out.arrays.append(Parsed(name, meta, [([0] * meta.ndim, url, data, length, None)] if length else []))
                at, n = data + -(-used // _BLOCK) * _BLOCK, n + 1
        return out

    @staticmethod
    def _table(cards: dict, attrs: dict) -> ArrayMeta:
        fields = []
        for k in range(1, int(cards["TFIELDS"]) + 1):
            count, code = re.match(r"(\d*)([A-Z])", cards[f"TFORM{k}"]).groups()
            count = int(count or 1)
            name = str(cards.get(f"TTYPE{k}", f"col{k}"))
            if code == "A":
                fields.append((name, f"S{count}"))
            else:
                fields.append((name, _FIELD[code]) if count == 1 else (name, _FIELD[code], (count,)))
        rows = int(cards["NAXIS2"])
        return ArrayMeta((rows,), (max(1, rows),), np.dtype(fields), None, (BYTES_BIG,), attrs, ("row",))
