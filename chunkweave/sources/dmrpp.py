"""DMR++ documents: chunk maps of HDF5 files, as XML."""

from __future__ import annotations

import re
import warnings
import xml.etree.ElementTree as ET

import numpy as np

from ..meta import ArrayMeta, codec_from_v2
from .base import FileParser, Parsed, ParsedFile

#: DAP types. Fixed values.
_TYPES = {"Byte": "u1", "UByte": "u1", "Int8": "i1", "UInt8": "u1", "Int16": "i2", "UInt16": "u2", "Int32": "i4", "UInt32": "u4", "Int64": "i8", "UInt64": "u8", "Url": "O", "Float32": "f4", "Float64": "f8", "String": "O", "Char": "S1"}


def _tag(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2]


def _children(e: ET.Element, *names: str) -> list[ET.Element]:
    return [c for c in e if _tag(c) in names]


class DMRPPParser(FileParser):
    """The data are in the file that the document is named after, or in the one it names."""

    def parse(self, url: str) -> ParsedFile:
        with self.open(url) as f:
            root = ET.fromstring(f.read())
        out, path = ParsedFile(), url.removesuffix(".dmrpp")
        self._group(root, "", path, {}, out)
        return out

    def _group(self, node: ET.Element, where: str, path: str, dims: dict, out: ParsedFile) -> None:
        dims = dims | {(f"{where}/" if where else "/") + d.get("name"): int(d.get("size")) for d in _children(node, "Dimension")} if not where else dims | {f"/{where}/{d.get('name')}": int(d.get("size")) for d in _children(node, "Dimension")}
        out.groups[where] = self._attributes(node)
        for v in node:
            if _tag(v) in _TYPES:
                try:
                    out.arrays.append(self._variable(v, where, path, dims))
                except (ValueError, KeyError, NotImplementedError) as e:
                    warnings.warn(f"variable {v.get('name')!r} could not be parsed: {e}", UserWarning, stacklevel=2)
            elif _tag(v) == "Group":
                self._group(v, f"{where}/{v.get('name')}".lstrip("/"), path, dims, out)

    def _attributes(self, node: ET.Element) -> dict:
        out = {}
        for a in _children(node, "Attribute"):
            kind, name = a.get("type"), a.get("name")
            if kind in ("Container", "OtherXML"):
                warnings.warn(f"attribute {name!r} is nested and is dropped", UserWarning, stacklevel=2)
                continue
            values = [x.get("value") if x.get("value") is not None else (x.text or "") for x in _children(a, "Value")]
            if kind not in ("String", "Url", "Char", None):
                dtype = np.dtype(_TYPES[kind])
                values = [np.array(float(v) if dtype.kind == "f" else int(v)).astype(dtype).item() for v in values]
            out[name] = values[0] if len(values) == 1 else values
        return out

    def _variable(self, v: ET.Element, where: str, path: str, dims: dict) -> Parsed:
        names, shape = [], []
        for k, d in enumerate(_children(v, "Dim")):
            if (full := d.get("name")) is not None:
                full = full if full.startswith("/") else f"/{where}/{full}".replace("//", "/")
                names.append(full.rpartition("/")[2])
                shape.append(dims[full])
            else:
                names.append(f"phony_dim_{k}")
                shape.append(int(d.get("size")))
        dtype = np.dtype(_TYPES[_tag(v)])
        attrs = self._attributes(v)
        found = _children(v, "chunks")
        codecs, chunks, edges, fill = [], [], tuple(shape), attrs.get("_FillValue")
        if found:
            c = found[0]
            fill = c.get("fillValue", fill)
            if isinstance(fill, str) and dtype.kind in "iufb":
                fill = float(fill) if dtype.kind == "f" else int(float(fill))
            edges = tuple(int(x) for x in (_children(c, "chunkDimensionSizes")[0].text or "").split()) if _children(c, "chunkDimensionSizes") else tuple(shape)
            codecs = self._codecs(c, dtype)
            for e in _children(c, "chunk"):
                at = [int(x) for x in re.findall(r"\d+", e.get("chunkPositionInArray") or "")] or [0] * len(shape)
                chunks.append(([a // max(1, n) for a, n in zip(at, edges, strict=True)], e.get("href") or path, int(e.get("offset")), int(e.get("nBytes")), None))
            if c.get("byteOrder") == "BE":
                dtype = dtype.newbyteorder(">")
        else:
            warnings.warn(f"variable {v.get('name')!r} has no chunks: it is empty", UserWarning, stacklevel=2)
        return Parsed(v.get("name"), ArrayMeta(tuple(shape), tuple(max(1, e) for e in edges), dtype, fill, tuple(codecs), attrs, tuple(names)), chunks, where)

    @staticmethod
    def _codecs(c: ET.Element, dtype: np.dtype) -> list[dict]:
        out, levels = [], [int(x) for x in (c.get("deflateLevel") or "").split()]
        for name in (c.get("compressionType") or "").split():
            if name == "shuffle":
                out.append(codec_from_v2({"id": "shuffle", "elementsize": dtype.itemsize}))
            elif name == "deflate":
                out.append(codec_from_v2({"id": "zlib", "level": levels.pop(0) if levels else 6}))
            elif name == "fletcher32":
                out.append(codec_from_v2({"id": "fletcher32"}))
            else:
                raise NotImplementedError(f"compression {name!r}")
        return out
