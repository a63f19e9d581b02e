"""HDF5 and netCDF4 files as virtual arrays: rules about chunks, filters, dimensions and attributes."""

from __future__ import annotations

import math
import warnings

import numpy as np

from ..meta import ArrayMeta, codec_from_v2, jsonable
from . import hdf5
from .base import FileParser, Parsed, ParsedFile

#: Attributes that the format uses itself. Fixed values.
_HIDDEN = frozenset({"REFERENCE_LIST", "CLASS", "DIMENSION_LIST", "NAME", "_Netcdf4Dimid", "_Netcdf4Coordinates", "_nc3_strict", "_NCProperties"})
_NO_COORDINATE = "This is a netCDF dimension but not a netCDF variable"


def chunk_shape(shape: tuple[int, ...], chunks: tuple[int, ...] | None, filtered: bool) -> tuple[int, ...]:
    """Chunks of a dataset: the whole array where it is contiguous; a chunk longer than its array on the leading axis alone is cut, if bytes aren't filtered."""
    if chunks is None:
        return tuple(max(1, s) for s in shape)
    longer = [i for i, (s, c) in enumerate(zip(shape, chunks, strict=True)) if c > s]
    if longer == [0] and not filtered and shape[0] > 0:
        return (shape[0], *chunks[1:])
    return tuple(chunks)


def filter_codecs(filters: dict, itemsize: int) -> list[dict]:
    """Codecs of HDF5 filters {name or number: options}, in order."""
    out = []
    for name, options in filters.items():
        key = str(name)
        if key in ("gzip", "deflate", "1"):
            level = options if isinstance(options, int) else options[0]
            out.append(codec_from_v2({"id": "zlib", "level": int(level)}))
        elif key in ("shuffle", "2"):
            out.append(codec_from_v2({"id": "shuffle", "elementsize": itemsize}))
        elif key in ("fletcher32", "3"):
            out.append(codec_from_v2({"id": "fletcher32"}))
        elif key in ("lzf", "32000"):
            out.append(codec_from_v2({"id": "imagecodecs_lzf"}))
        elif key in ("32001", "blosc"):
            names = ("blosclz", "lz4", "lz4hc", "snappy", "zlib", "zstd")
            out.append(codec_from_v2({"id": "blosc", "cname": names[options[6]] if len(options) > 6 else "blosclz", "clevel": options[4], "shuffle": options[5], "blocksize": 0}))
        elif key in ("32004", "lz4"):
            out.append(codec_from_v2({"id": "imagecodecs_lz4h5"}))
        elif key in ("32015", "zstd"):
            out.append(codec_from_v2({"id": "zstd", "level": options[0] if options else 3}))
        elif key in ("307", "bzip2"):
            out.append(codec_from_v2({"id": "bz2", "level": options[0] if options else 9}))
        else:
            raise NotImplementedError(f"HDF5 filter {name!r}")
    return out


def scale_codec(attributes: dict) -> dict | None:
    """scale_factor and add_offset as a codec; parsers leave them to CF decoding."""
    scale, offset = attributes.get("scale_factor"), attributes.get("add_offset")
    if scale is None and offset is None:
        return None
    return codec_from_v2({"id": "fixedscaleoffset", "scale": 1 / (1 if scale is None else scale), "offset": 0 if offset is None else offset, "dtype": "<f8"})


def dimension_names(name: str, rank: int, scales: list[list[str]], is_scale: bool) -> tuple[str, ...]:
    """One attached scale names a dimension; a scale names its own; more are an error; none is ``phony_dim_n``."""
    out = []
    for n in range(rank):
        own = scales[n] if n < len(scales) else []
        if len(own) > 1:
            raise ValueError(f"{name}: {len(own)} dimension scales attached to dimension {n}")
        out.append(own[0].rpartition("/")[2] if own else name.rpartition("/")[2] if is_scale else f"phony_dim_{n}")
    return tuple(out)


def visible_attributes(attributes: dict) -> dict:
    """Those that the format doesn't use itself, arrays of one number as the number; ``_FillValue`` is set by its array."""
    out = {}
    for k, v in attributes.items():
        if k not in _HIDDEN and k != "_FillValue":
            single = isinstance(v, np.ndarray) and v.size == 1 and v.dtype.kind not in "SV"
            out[k] = jsonable(v.ravel()[0] if single else v)
    return out


class HDFParser(FileParser):
    """HDF5 and netCDF4 files, read by the format itself (:mod:`.hdf5`).

    Contiguous and chunked datasets become references, compact ones inlined bytes; what was never written is missing
    and reads as fill.  Text of variable length keeps its metadata only, with a warning; other types without a numpy
    counterpart, skipped filters, external and virtual storage are refused.  Links are followed inside the file.
    """

    def __init__(self, group: str | None = None, drop_variables: list[str] | None = None, skip_variables: list[str] | None = None):
        super().__init__(group, [*(drop_variables or ()), *(skip_variables or ())])

    def parse(self, url: str) -> ParsedFile:
        out = ParsedFile()
        with self.open(url) as raw:
            f = hdf5.File(raw)
            found = list(f.walk())
            names: dict[int, str] = {}
            for path, node in found:
                names.setdefault(node.address, "/" + path)
            for path, node in found:
                where, _, name = path.rpartition("/")
                if any(p in self.skip_variables for p in path.split("/")):
                    continue
                if isinstance(node, hdf5.Group):
                    out.groups[path] = visible_attributes(node.attributes)
                elif not _text(node.attributes.get("NAME", "")).startswith(_NO_COORDINATE):
                    out.arrays.append(self._array(f, node, where, name, url, names))
        return out

    def _array(self, f: hdf5.File, d: hdf5.Dataset, where: str, name: str, url: str, names: dict[int, str]) -> Parsed:
        dtype, shape = d.type.dtype, d.shape
        if d.type.kind == "text":
            warnings.warn(f"{name}: text of variable length has references to metadata only", UserWarning, stacklevel=2)
            dtype = np.dtype(object)
        elif d.type.kind != "plain" or dtype.subdtype:
            raise NotImplementedError(f"{name}: values of a type that numpy's arrays of one type don't hold")
        if shape is None:
            raise NotImplementedError(f"{name}: a dataset without a shape")
        codecs = filter_codecs(dict(d.filters), d.type.size)
        edges = chunk_shape(shape, d.chunks, bool(codecs))
        attrs = visible_attributes(d.attributes)
        if "_FillValue" in d.attributes:
            attrs["_FillValue"] = jsonable(np.asarray(d.attributes["_FillValue"]).ravel()[0])
        listed = d.attributes.get("DIMENSION_LIST", [])
        scales = [[names[int(a)] for a in own if int(a) in names] for own in listed]
        is_scale = _text(d.attributes.get("CLASS", "")) == "DIMENSION_SCALE"
        fill = jsonable(d.fill) if dtype.kind in "iufb" and d.fill is not None else None
        meta = ArrayMeta(shape, edges, dtype, fill, tuple(codecs), attrs, dimension_names(name, len(shape), scales, is_scale))
        return Parsed(name, meta, [] if dtype == np.dtype(object) else self._chunks(f, d, edges, url), where)

    def _chunks(self, f: hdf5.File, d: hdf5.Dataset, edges: tuple[int, ...], url: str) -> list[tuple]:
        origin = [0] * len(d.shape)
        if 0 in d.shape:
            return []
        if d.data is not None:
            return [(origin, None, None, len(d.data), d.data)]
        if d.chunks is None:
            return [(origin, url, d.offset + f.base, d.size, None)] if d.offset is not None else []
        cut = math.prod(edges) * d.type.size if edges != d.chunks else None
        return [(list(idx), url, at, cut or n, None) for idx, at, n in f.chunks(d)]


def _text(value) -> str:
    return value.rstrip(b"\0").decode("utf-8", "replace") if isinstance(value, bytes) else str(value)
