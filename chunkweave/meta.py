"""Array metadata: the small, driver-side half of a virtual array.

Codecs are dicts ``{"name": ..., "configuration": {...}}``, in encoding order; codecs of the numcodecs family
are named ``numcodecs.<id>``.
"""

from __future__ import annotations

import base64
import dataclasses
import json
import math
from dataclasses import dataclass, field
from typing import Any

import numpy as np

BYTES_LITTLE = {"name": "bytes", "configuration": {"endian": "little"}}
BYTES_BIG = {"name": "bytes", "configuration": {"endian": "big"}}
ARRAY_TO_BYTES = frozenset({"bytes", "vlen-utf8", "vlen-bytes", "sharding_indexed"})
ARRAY_TO_ARRAY = frozenset({"transpose", "numcodecs.delta", "numcodecs.fixedscaleoffset", "numcodecs.quantize", "numcodecs.astype", "numcodecs.packbits", "numcodecs.bitround"})
#: Names that both metadata versions share, without the numcodecs prefix.
_PLAIN = frozenset({"bytes", "transpose", "sharding_indexed", "crc32c", "gzip", "zstd", "blosc", "vlen-utf8", "vlen-bytes"})


def ceil_div(a: int, b: int) -> int:
    return -(-a // b)


def grid_shape(shape, chunks) -> tuple[int, ...]:
    """Chunks along each axis; a zero chunk edge counts as one."""
    return tuple(ceil_div(s, max(1, c)) for s, c in zip(shape, chunks, strict=True))


def _as_dtype(dtype) -> np.dtype:
    if isinstance(dtype, list):
        return np.dtype([tuple(f) if len(f) < 3 else (f[0], f[1], tuple(f[2])) for f in dtype])
    if isinstance(dtype, str) and dtype in ("string", "str", "|O", "object"):
        return np.dtype(object)
    return np.dtype(dtype)


def default_fill(dtype: np.dtype) -> Any:
    """The dtype's zero, as metadata holds it."""
    if dtype == np.dtype(object):
        return ""
    if dtype.names:
        return base64.b64encode(np.zeros((), dtype).tobytes()).decode()
    return jsonable(np.zeros((), dtype).item())


def jsonable(value: Any) -> Any:
    """numpy scalars and arrays, bytes, NaN and infinities as JSON values."""
    if isinstance(value, np.ndarray):
        return [jsonable(v) for v in value.tolist()]
    if isinstance(value, np.generic):
        value = value.item()
    if isinstance(value, bytes):
        return value.rstrip(b"\0").decode("utf-8", "replace")
    if isinstance(value, float) and not math.isfinite(value):
        return "NaN" if value != value else "Infinity" if value > 0 else "-Infinity"
    if isinstance(value, complex):
        return [jsonable(value.real), jsonable(value.imag)]
    if isinstance(value, dict):
        return {str(k): jsonable(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [jsonable(v) for v in value]
    return value


def encode_cf_fill_value(value: Any, dtype: Any) -> Any:
    """A ``_FillValue`` attribute as metadata hold it: base64 of a little-endian double for floats, text for bytes, else a number."""
    dtype = np.dtype(dtype)
    value = np.asarray(value).ravel()[0]
    if dtype.kind == "f":
        return base64.standard_b64encode(np.array(value, "<f8").tobytes()).decode()
    if dtype.kind == "c":
        return [encode_cf_fill_value(x, "<f8") for x in (value.real, value.imag)]
    return jsonable(value)


def codec_from_v2(config: dict) -> dict:
    """numcodecs configuration to a named codec."""
    name = config["id"]
    rest = {k: v for k, v in config.items() if k != "id"}
    return {"name": f"numcodecs.{name}", "configuration": rest}


def codec_to_v2(codec: dict) -> dict:
    return {"id": codec["name"].removeprefix("numcodecs."), **codec.get("configuration", {})}


def codec_kind(codec: dict) -> str:
    """'array_array', 'array_bytes' or 'bytes_bytes'."""
    name = codec["name"]
    return "array_bytes" if name in ARRAY_TO_BYTES else "array_array" if name in ARRAY_TO_ARRAY else "bytes_bytes"


def endianness(dtype: np.dtype) -> str | None:
    """'little', 'big', or None where bytes have no order; mixed orders in a record are refused."""
    if dtype.names:
        found = {e for n in dtype.names if (e := endianness(dtype.fields[n][0]))}
        if len(found) > 1:
            raise ValueError("a structured dtype with mixed byte orders isn't supported")
        return found.pop() if found else None
    if dtype.subdtype:
        return endianness(dtype.subdtype[0])
    if dtype.byteorder == "|" or dtype == np.dtype(object):
        return None
    return "big" if dtype.newbyteorder("=") != dtype and dtype.byteorder == ">" else "little"


def array_bytes_codec(dtype: np.dtype) -> dict:
    if dtype == np.dtype(object):
        return {"name": "vlen-utf8"}
    return BYTES_BIG if endianness(dtype) == "big" else BYTES_LITTLE


def codec_pipeline(codecs: list[dict], dtype: np.dtype) -> tuple[dict, ...]:
    """Codecs in encoding order, with an array-to-bytes codec put in where it is missing."""
    a = [c for c in codecs if codec_kind(c) == "array_array"]
    b = [c for c in codecs if codec_kind(c) == "array_bytes"]
    if len(b) > 1:
        raise ValueError("more than one array-to-bytes codec")
    return (*a, *(b or [array_bytes_codec(dtype)]), *[c for c in codecs if codec_kind(c) == "bytes_bytes"])


@dataclass(frozen=True)
class ArrayMeta:
    """Shape, regular chunks, type, fill value, codecs, attributes and dimension names of one array."""

    shape: tuple[int, ...]
    chunks: tuple[int, ...]
    dtype: Any
    fill_value: Any = None
    codecs: tuple[dict, ...] = ()
    attributes: dict = field(default_factory=dict)
    dims: tuple[str, ...] | None = None
    separator: str = "."

    def __post_init__(self):
        set_ = lambda k, v: object.__setattr__(self, k, v)
        dtype = _as_dtype(self.dtype)
        set_("shape", tuple(int(s) for s in self.shape))
        set_("chunks", tuple(max(1, int(c)) for c in self.chunks))
        if len(self.shape) != len(self.chunks):
            raise ValueError(f"Only RegularChunkGrid is supported: shape {self.shape} and chunks {self.chunks} differ in rank")
        order = endianness(dtype)
        codecs = tuple(self.codecs) or (array_bytes_codec(dtype),)
        set_("codecs", tuple(json.loads(json.dumps(jsonable(c))) for c in codec_pipeline(list(codecs), dtype)))
        set_("dtype", dtype.newbyteorder("<") if order == "big" else dtype)
        fill = default_fill(dtype) if self.fill_value is None else jsonable(self.fill_value)
        set_("fill_value", fill)
        set_("attributes", jsonable(dict(self.attributes)))
        if self.dims is not None:
            set_("dims", tuple(self.dims))
            if len(self.dims) != len(self.shape):
                raise ValueError(f"{len(self.dims)} dimension names for {len(self.shape)} dimensions")

    @property
    def ndim(self) -> int:
        return len(self.shape)

    @property
    def size(self) -> int:
        return math.prod(self.shape)

    @property
    def grid(self) -> tuple[int, ...]:
        return grid_shape(self.shape, self.chunks)

    @property
    def itemsize(self) -> int:
        return self.dtype.itemsize

    @property
    def n_chunks(self) -> int:
        """Dense number of grid positions."""
        return math.prod(self.grid)

    @property
    def is_sharded(self) -> bool:
        return any(c["name"] == "sharding_indexed" for c in self.codecs)

    @property
    def inner_chunks(self) -> tuple[int, ...] | None:
        return next((tuple(c["configuration"]["chunk_shape"]) for c in self.codecs if c["name"] == "sharding_indexed"), None)

    def replace(self, **changes) -> ArrayMeta:
        """A copy with changes; when the chunks change rank, a shard codec's inner chunks follow."""
        if "chunks" in changes and "codecs" not in changes and self.is_sharded and tuple(changes["chunks"]) != self.chunks:
            changes["codecs"] = realign_shards(self.codecs, self.chunks, tuple(changes["chunks"]))
        if "shape" in changes and "dims" not in changes and len(changes["shape"]) != self.ndim:
            changes["dims"] = None
        return dataclasses.replace(self, **changes)

    def comparable(self) -> dict:
        """What two arrays' metadata are compared by; NaN fills are text and so equal."""
        return {"shape": self.shape, "chunks": self.chunks, "dtype": self.dtype.descr if self.dtype.names else self.dtype.str, "fill": self.fill_value, "codecs": self.codecs, "attributes": self.attributes, "dims": self.dims}

    def fill_scalar(self) -> np.ndarray:
        """The fill value as a 0-d array."""
        if self.dtype.names:
            raw = base64.b64decode(self.fill_value) if isinstance(self.fill_value, str) else bytes(self.itemsize)
            return np.frombuffer(raw, self.dtype)[0]
        if isinstance(self.fill_value, list):
            return np.array(complex(*map(float, self.fill_value)), self.dtype)
        if isinstance(self.fill_value, str) and self.dtype.kind in "fc":
            return np.array(float(self.fill_value.replace("Infinity", "inf")), self.dtype)
        return np.array(self.fill_value, self.dtype)

    # metadata documents

    def to_v3(self) -> dict:
        """Zarr v3 metadata document."""
        return {
            "zarr_format": 3, "node_type": "array", "shape": list(self.shape), "data_type": _v3_type(self.dtype),
            "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": list(self.chunks)}},
            "chunk_key_encoding": {"name": "default", "configuration": {"separator": self.separator}},
            "fill_value": self.fill_value, "codecs": list(self.codecs), "attributes": self.attributes,
            **({"dimension_names": list(self.dims)} if self.dims is not None else {}),
        }

    def to_v2(self) -> tuple[dict, dict]:
        """``.zarray`` and ``.zattrs`` documents."""
        names = [c["name"] for c in self.codecs]
        if "sharding_indexed" in names:
            raise NotImplementedError("sharded arrays have no version 2 form")
        order = "C"
        for c in self.codecs:
            if c["name"] == "transpose":
                if tuple(c["configuration"]["order"]) != tuple(range(self.ndim))[::-1]:
                    raise NotImplementedError("only the reversed axis order has a version 2 form")
                order = "F"
        big = BYTES_BIG in self.codecs
        filters = [codec_to_v2(c) for c in self.codecs if codec_kind(c) == "array_array" and c["name"] != "transpose"]
        packed = [codec_to_v2(c) for c in self.codecs if codec_kind(c) == "bytes_bytes"]
        if "vlen-utf8" in names:
            filters.append({"id": "vlen-utf8"})
        filters += packed[:-1]
        dtype = self.dtype.newbyteorder(">") if big else self.dtype
        zarray = {
            "zarr_format": 2, "shape": list(self.shape), "chunks": list(self.chunks), "dtype": [list(f) for f in dtype.descr] if dtype.names else dtype.str if dtype != np.dtype(object) else "|O",
            "fill_value": self.fill_value, "order": order, "filters": filters or None, "compressor": packed[-1] if packed else None, "dimension_separator": self.separator,
        }
        return zarray, {**self.attributes, **({"_ARRAY_DIMENSIONS": list(self.dims)} if self.dims is not None else {})}

    @classmethod
    def from_v2(cls, zarray: dict, zattrs: dict | None = None) -> ArrayMeta:
        """From ``.zarray`` and ``.zattrs`` documents; dimension names leave the attributes."""
        if zarray.get("zarr_format", 2) not in (2, 3):
            raise ValueError(f"unknown zarr_format {zarray['zarr_format']}")
        dtype = _as_dtype(zarray["dtype"])
        attrs = dict(zattrs or {})
        dims = attrs.pop("_ARRAY_DIMENSIONS", None)
        fill = zarray.get("fill_value")
        if fill is None and dtype.kind == "f":
            fill = "NaN"
        codecs = []
        if zarray.get("order", "C") == "F" and len(zarray["shape"]) > 1:
            codecs.append({"name": "transpose", "configuration": {"order": list(range(len(zarray["shape"])))[::-1]}})
        for f in [*(zarray.get("filters") or []), *([zarray["compressor"]] if zarray.get("compressor") else [])]:
            codecs.append({"name": f["id"]} if f["id"] in ("vlen-utf8", "vlen-bytes") else codec_from_v2(f))
        return cls(zarray["shape"], zarray["chunks"], dtype, fill, codec_pipeline(codecs, dtype), attrs, dims if dims is None or len(dims) == len(zarray["shape"]) else None, zarray.get("dimension_separator", "."))

    @classmethod
    def from_v3(cls, doc: dict) -> ArrayMeta:
        grid = doc["chunk_grid"]
        if grid["name"] != "regular":
            raise NotImplementedError(f"Only RegularChunkGrid is supported, not {grid['name']!r}")
        encoding = doc.get("chunk_key_encoding", {})
        dims = doc.get("dimension_names")
        attrs = dict(doc.get("attributes") or {})
        dtype = _numpy_type(doc["data_type"])
        return cls(doc["shape"], grid["configuration"]["chunk_shape"], dtype, doc.get("fill_value"), codec_pipeline(list(doc.get("codecs", [])), dtype), attrs, dims, encoding.get("configuration", {}).get("separator", "/"))

    def to_row(self) -> dict:
        """The array's row in the table of arrays, as JSON-safe values."""
        return {"shape": list(self.shape), "chunks": list(self.chunks), "dtype": json.dumps(self.dtype.descr if self.dtype.names else self.dtype.str), "fill_value": json.dumps(self.fill_value), "codecs": json.dumps(list(self.codecs)), "attributes": json.dumps(self.attributes), "dims": list(self.dims) if self.dims is not None else None, "separator": self.separator}

    @classmethod
    def from_row(cls, row: dict) -> ArrayMeta:
        dtype = json.loads(row["dtype"])
        return cls(row["shape"], row["chunks"], _as_dtype(dtype), json.loads(row["fill_value"]), tuple(json.loads(row["codecs"])), json.loads(row["attributes"]), row["dims"], row["separator"])


_V3 = {"bool": "|b1", "string": "|O", **{f"{k}{b}": f"<{c}{b // 8}" for k, c in (("int", "i"), ("uint", "u"), ("float", "f"), ("complex", "c")) for b in (8, 16, 32, 64, 128) if not (k in ("int", "uint") and b == 128) and not (k == "float" and b in (8, 128)) and not (k == "complex" and b < 64)}}


def _numpy_type(name: Any) -> np.dtype:
    if isinstance(name, str) and name in _V3:
        return _as_dtype(_V3[name])
    if isinstance(name, dict):
        size = name["configuration"].get("length_bytes") or name["configuration"].get("length_bits", 0) // 8
        return np.dtype(f"S{size}")
    if isinstance(name, str) and name.startswith("r") and name[1:].isdigit():
        return np.dtype(f"V{int(name[1:]) // 8}")
    return _as_dtype(name)


def _v3_type(dtype: np.dtype) -> Any:
    if dtype == np.dtype(object):
        return "string"
    if dtype.kind == "S":
        return {"name": "null_terminated_bytes", "configuration": {"length_bytes": dtype.itemsize}}
    return [list(f) for f in dtype.descr] if dtype.names else dtype.name


def realign_shards(codecs: tuple[dict, ...], old: tuple[int, ...], new: tuple[int, ...]) -> tuple[dict, ...]:
    """Shard codecs whose inner chunks follow the outer chunks from rank to rank: axes of length 1 come and go."""
    out = []
    for c in codecs:
        if c["name"] == "sharding_indexed":
            config = c["configuration"]
            inner = tuple(config["chunk_shape"])
            moved = _realigned(inner, old, new)
            c = {"name": c["name"], "configuration": {**config, "chunk_shape": list(moved), "codecs": list(realign_shards(tuple(config.get("codecs", ())), inner, moved))}}
        out.append(c)
    return tuple(out)


def _realigned(inner, old, new) -> tuple[int, ...]:
    if len(old) == len(new):
        return tuple(inner)
    shorter, longer = (old, new) if len(old) < len(new) else (new, old)
    grows, i, at = len(old) < len(new), 0, []
    extra = len(longer) - len(shorter)
    for edge in longer:  # axes of the longer side that the shorter one lacks
        if edge == 1 and extra and (i >= len(shorter) or shorter[i] != edge or len(longer) - len(at) - i > len(shorter) - i):
            at.append(True)
            extra -= 1
        else:
            at.append(False)
            if i >= len(shorter) or shorter[i] != edge:
                raise ValueError(f"can't align shards of chunks {old} with chunks {new}")
            i += 1
    if grows:
        left = iter(inner)
        return tuple(1 if gone else next(left) for gone in at)
    if any(gone and x != 1 for gone, x in zip(at, inner, strict=True)):
        raise ValueError(f"can't drop an axis of inner chunks {inner}")
    return tuple(x for gone, x in zip(at, inner, strict=True) if not gone)
