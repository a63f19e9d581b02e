"""Reading referenced bytes: range reads, codecs, missing chunks, CF attributes.

Chunks are read where tasks run, grouped by file and in order of offset, so that a task opens each of its files
once.  Whole arrays are put together on the driver only for small variables, such as coordinates.
"""

from __future__ import annotations

import base64
import bz2
import datetime
import gzip
import json
import lzma
import math
import re
import struct
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import keys
from .meta import ArrayMeta
from .varray import VArray


_V2_DOCUMENTS = (".zarray", ".zattrs", ".zgroup", ".zmetadata")


def open_input(uri: str):
    """Random-access file of a URI, by the filesystems that Arrow knows."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem().open_input_file(re.sub(r"^file:/*", "/", uri))
    found, path = fs.FileSystem.from_uri(uri)
    return found.open_input_file(path)


def _ranges(batches: Iterator[pa.RecordBatch], kept: tuple[str, ...] = ("idx",)) -> Iterator[pa.RecordBatch]:
    held, name = None, None
    try:
        for batch in batches:
            out = []
            for path, offset, length, data in zip(*(batch.column(c).to_pylist() for c in ("path", "offset", "length", "data")), strict=True):
                if data is not None:
                    out.append(data[offset : offset + length] if offset or length != len(data) else data)
                    continue
                if path is None:
                    out.append(None)
                    continue
                if path != name:
                    if held is not None:
                        held.close()
                    held, name = open_input(path), path
                out.append(held.read_at(length, offset))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(out, pa.binary())], [*kept, "bytes"])
    finally:
        if held is not None:
            held.close()


def read_bytes(arr: VArray, start: int | None = None, end: int | None = None, suffix: int | None = None) -> DataFrame:
    """idx, bytes: the stored bytes of each chunk that is there, or a part of each."""
    return _read(_parts(arr, start, end, suffix))


def _parts(arr: VArray, start: int | None, end: int | None, suffix: int | None) -> DataFrame:
    base_ = F.when(F.col("data").isNull(), F.col("offset")).otherwise(F.lit(0))
    off, n = keys.resolve_range(base_.cast("bigint"), F.col("length"), start, end, suffix)
    return arr.refs.select("idx", "path", off.alias("offset"), n.alias("length"), "data")


def _read(refs: DataFrame, kept: tuple[str, ...] = ("idx",)) -> DataFrame:
    parts = int(refs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kinds = ", ".join(f"{c} {refs.schema[c].dataType.simpleString()}" for c in kept)
    # a large file's chunks are dealt to several tasks, a span of neighbours each; what is in no file is dealt out by itself
    place = F.when(F.col("path").isNull(), F.xxhash64(*kept)).otherwise(F.expr("offset div 268435456"))
    return refs.repartition(parts, "path", place).sortWithinPartitions("path", "offset").mapInArrow(partial(_ranges, kept=kept), f"{kinds}, bytes binary")


def get(group, key: str, start: int | None = None, end: int | None = None, suffix: int | None = None) -> bytes | None:
    """The document or chunk under a store key such as ``air/c.0.0``; None where there is none, as for version 2 documents.

    A part of a chunk is [start, end), from ``start`` on, or the last ``suffix`` bytes.
    """
    node, rest = group.deepest(key)
    if rest.rpartition("/")[2] in _V2_DOCUMENTS:
        return None
    if not isinstance(node, VArray):
        if rest == "zarr.json":
            return json.dumps({"zarr_format": 3, "node_type": "group", "attributes": node.attributes}).encode()
        if rest:
            return None
        raise ValueError(f"{key!r} is a group, not a document or chunk")
    if rest == "zarr.json":
        return json.dumps(node.meta.to_v3()).encode()
    idx = keys.parse_store_key(rest, "/" if "/" in rest else ".")
    at = F.array(*[F.lit(i).cast("bigint") for i in idx]) if idx else F.array().cast("array<bigint>")
    rows = read_bytes(VArray(node.meta, node.refs.where(F.col("idx") == at)), start, end, suffix).collect()
    return bytes(rows[0]["bytes"]) if rows else None


def get_all(group, prefix: str, wanted: DataFrame, start: int | None = None, end: int | None = None, suffix: int | None = None) -> DataFrame:
    """key, bytes: what :func:`get` gives under ``<prefix>/<key>`` of an array for every row of ``wanted`` (key), read where tasks run."""
    node, rest = group.deepest(prefix)
    if rest or not isinstance(node, VArray):
        raise ValueError(f"{prefix!r} is no array")
    key, document = F.col("key"), bytearray(json.dumps(node.meta.to_v3()).encode())
    index = F.when(F.contains(key, F.lit("/")), keys.store_key_index(key, "/")).otherwise(keys.store_key_index(key, "."))
    index = F.coalesce(index, F.raise_error(F.concat(F.lit("Invalid chunk key "), key)).cast("array<bigint>"))
    no_chunk = F.substring_index(key, "/", -1).isin(*_V2_DOCUMENTS) | (key == "zarr.json")
    rows = wanted.select("key", F.when(~no_chunk, index).alias("idx")).join(_parts(node, start, end, suffix), "idx", "left")
    is_document = key == "zarr.json"
    return _read(rows.select("key", "path", F.when(is_document, 0).otherwise(F.col("offset")).alias("offset"), F.when(is_document, len(document)).otherwise(F.col("length")).alias("length"), F.when(is_document, F.lit(document)).otherwise(F.col("data")).alias("data")), ("key",))


# codecs


def _crc32c_table() -> np.ndarray:
    """The checksum's step of each byte, from its polynomial."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = (t >> np.uint32(1)) ^ np.where(t & np.uint32(1), np.uint32(0x82F63B78), np.uint32(0))
    return t


_STEP = _crc32c_table()


def _stepped(crc: np.ndarray, column) -> np.ndarray:
    return _STEP[(crc ^ column) & np.uint32(255)] ^ (crc >> np.uint32(8))


def _crc32c(data: bytes) -> int:
    """The data lie in lanes of equal length, worked through side by side; then each lane's sum is moved on by the length of a lane and the next one added."""
    whole = np.frombuffer(data, np.uint8).astype(np.uint32)
    if len(whole) < 4:
        crc = np.full(1, 0xFFFFFFFF, np.uint32)
        for x in whole:
            crc = _stepped(crc, x)
        return int(crc[0]) ^ 0xFFFFFFFF
    whole[:4] ^= np.uint32(255)  # the start value, without which zeros in front change nothing
    lanes = max(1, math.isqrt(len(whole)))
    length = -(-len(whole) // lanes)
    rows = np.concatenate([np.zeros(lanes * length - len(whole), np.uint32), whole]).reshape(lanes, length)
    crc, bits = np.zeros(lanes, np.uint32), np.uint32(1) << np.arange(32, dtype=np.uint32)
    for k in range(length):
        crc, bits = _stepped(crc, rows[:, k]), _stepped(bits, np.uint32(0))
    total = 0
    for own in crc.tolist():
        moved, k = 0, 0
        while total:
            if total & 1:
                moved ^= int(bits[k])
            total, k = total >> 1, k + 1
        total = moved ^ own
    return total ^ 0xFFFFFFFF


def _fletcher32(data: bytes) -> int:
    """Of big-endian 16-bit words, sums by ones' complement: never 0 but for zeros."""
    words = np.frombuffer(data + b"\0" * (len(data) % 2), ">u2").astype(np.uint64)
    first = second = 0
    for i in range(0, len(words), 1 << 16):  # products stay below 2**64
        own = words[i : i + (1 << 16)]
        second += first * len(own) + int((own * np.arange(len(own), 0, -1, dtype=np.uint64)).sum())
        first += int(own.sum())
    fold = lambda x: x % 65535 or 65535 * bool(x)
    return fold(second) << 16 | fold(first)


def _lzf(data: bytes) -> bytes:
    """Literal runs, and copies of what came up to 8192 bytes before."""
    out, at = bytearray(), 0
    while at < len(data):
        head = data[at]
        at += 1
        if head < 32:
            out += data[at : at + head + 1]
            at += head + 1
            continue
        n = head >> 5
        if n == 7:
            n += data[at]
            at += 1
        back = ((head & 31) << 8 | data[at]) + 1
        at += 1
        n += 2
        if back > len(out):
            raise ValueError("a copy from before the beginning of lzf data")
        start = len(out) - back
        whole = bytes(out[start : start + n])
        out += (whole * (n // len(whole) + 1))[:n]  # a copy may run into itself
    return bytes(out)


def _lz4_blocks(data: bytes) -> bytes:
    """HDF5's own framing: the whole size and that of a block, then blocks behind their sizes, big-endian; stored where as long as they were."""
    total, block = struct.unpack_from(">qi", data)
    at, out = 12, []
    for start in range(0, total, block or 1):
        own, n = min(block, total - start), struct.unpack_from(">i", data, at)[0]
        raw = data[at + 4 : at + 4 + n]
        out.append(raw if n == own else pa.Codec("lz4_raw").decompress(raw, own).to_pybytes())
        at += 4 + n
    return b"".join(out)


def _blosc(data: bytes) -> bytes:
    """Version 1 containers: blocks, each whole or in a stream for each byte of an element, then unshuffled."""
    if len(data) < 16 or data[0] not in (1, 2) or not data[3]:
        raise ValueError("no blosc container of version 1")
    flags, size = data[2], data[3]
    total, block = struct.unpack_from("<ii", data, 4)
    if total < 0 or total and not flags & 2 and not 0 < block:
        raise ValueError("wrong sizes in a blosc container")
    if flags & 2:
        return data[16 : 16 + total]
    if not total:
        return b""
    out = []
    for k in range(-(-total // block)):
        at = struct.unpack_from("<i", data, 16 + 4 * k)[0]
        own = min(block, total - k * block)
        split = not flags & 16 and own == block and 1 < size <= 16 and block // size >= 128
        parts = []
        for _ in range(size if split else 1):
            n, whole = struct.unpack_from("<i", data, at)[0], own // size if split else own
            raw = data[at + 4 : at + 4 + n]
            parts.append(raw if n == whole else _blosc_stream(raw, whole, flags >> 5))
            at += 4 + n
        out.append(_unshuffled(b"".join(parts), size, flags))
    return b"".join(out)


def _blosc_stream(raw: bytes, n: int, kind: int) -> bytes:
    if kind == 3:
        return zlib.decompress(raw)
    if kind == 4:
        import zstandard

        return zstandard.ZstdDecompressor().decompress(raw, max_output_size=n)
    if kind in (1, 2):
        return pa.Codec("lz4_raw" if kind == 1 else "snappy").decompress(raw, n).to_pybytes()
    raise NotImplementedError("blosc data packed by blosclz can't be decoded here")


def _unshuffled(data: bytes, size: int, flags: int) -> bytes:
    n = len(data) // size
    whole, rest = np.frombuffer(data[: n * size], np.uint8), data[n * size :]
    if flags & 1 and size > 1:
        return whole.reshape(size, n).T.tobytes() + rest
    if flags & 4 and n:
        if n % 8:
            raise NotImplementedError("blosc bits of a number of elements that isn't a multiple of eight")
        bits = np.unpackbits(whole.reshape(size * 8, n // 8), axis=1, bitorder="little")
        return np.packbits(bits.T, axis=1, bitorder="little").tobytes() + rest
    return data


def _unpack(data: bytes, codec: dict) -> bytes:
    name, config = codec["name"].removeprefix("numcodecs."), codec.get("configuration", {})
    if name == "zlib":
        return zlib.decompress(data)
    if name == "gzip":
        return gzip.decompress(data)
    if name == "bz2":
        return bz2.decompress(data)
    if name == "lzma":
        return lzma.decompress(data)
    if name == "zstd":
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(data)
    if name == "lz4":
        size = struct.unpack("<I", data[:4])[0]
        return pa.Codec("lz4_raw").decompress(data[4:], size).to_pybytes()
    if name in ("lzf", "imagecodecs_lzf"):
        return _lzf(data)
    if name == "imagecodecs_lz4h5":
        return _lz4_blocks(data)
    if name == "blosc":
        return _blosc(data)
    if name == "shuffle":
        n = config["elementsize"]
        whole = len(data) // n * n
        return np.frombuffer(data[:whole], np.uint8).reshape(n, -1).T.tobytes() + data[whole:]
    if name in ("crc32", "adler32"):
        want, body = struct.unpack("<I", data[:4])[0], data[4:]
        if (zlib.crc32(body) if name == "crc32" else zlib.adler32(body)) != want:
            raise ValueError(f"wrong {name} checksum")
        return body
    if name == "crc32c":
        if _crc32c(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError("wrong crc32c checksum")
        return data[:-4]
    if name == "fletcher32":
        want, found = struct.unpack("<I", data[-4:])[0], _fletcher32(data[:-4])
        # old writers swapped the bytes of each half
        if want not in (found, (found & 0xFF00FF) << 8 | (found & 0xFF00FF00) >> 8):
            raise ValueError("wrong fletcher32 checksum")
        return data[:-4]
    if name == "base64":
        return base64.b64decode(data)
    raise NotImplementedError(f"codec {codec['name']!r} can't be decoded here")


def _strings(data: bytes) -> np.ndarray:
    n, at, out = struct.unpack_from("<I", data)[0], 4, []
    for _ in range(n):
        size = struct.unpack_from("<I", data, at)[0]
        out.append(data[at + 4 : at + 4 + size].decode())
        at += 4 + size
    return np.array(out, object)


def decode(data: bytes, meta: ArrayMeta, shape: tuple[int, ...] | None = None, codecs=None) -> np.ndarray:
    """The values of a stored chunk."""
    shape = meta.chunks if shape is None else shape
    codecs = list(meta.codecs if codecs is None else codecs)
    at = next(i for i, c in enumerate(codecs) if c["name"] in ("bytes", "vlen-utf8", "vlen-bytes", "sharding_indexed"))
    for c in reversed(codecs[at + 1 :]):
        data = _unpack(data, c)
    stored, order = shape, None
    for c in codecs[:at]:
        if c["name"] == "transpose":
            order = c["configuration"]["order"]
            stored = tuple(stored[a] for a in order)
    kind, dtype = codecs[at], meta.dtype
    for c in reversed(codecs[:at]):
        if c["name"] in ("numcodecs.delta", "numcodecs.fixedscaleoffset") and c["configuration"].get("astype"):
            dtype = np.dtype(c["configuration"]["astype"])
    if kind["name"] == "sharding_indexed":
        return _shard(data, meta, kind["configuration"], shape)
    if kind["name"] == "vlen-utf8":
        values = _strings(data)
    else:
        big = kind.get("configuration", {}).get("endian") == "big"
        values = np.frombuffer(data, dtype.newbyteorder(">") if big else dtype)
        if big:
            values = values.astype(dtype)
    n = math.prod(stored)
    if values.size < n and values.size and values.size % math.prod(stored[1:]) == 0:
        # a short last chunk along the slowest axis
        full = np.full(n, meta.fill_scalar(), values.dtype)
        full[: values.size] = values
        values = full
    values = values[:n].reshape(stored)
    for c in reversed(codecs[:at]):
        name, config = c["name"], c.get("configuration", {})
        if name == "transpose":
            values = values.transpose(np.argsort(order))
        elif name == "numcodecs.delta":
            values = np.cumsum(values.ravel(), dtype=np.dtype(config["dtype"])).reshape(values.shape)
        elif name == "numcodecs.fixedscaleoffset":
            values = (values / config["scale"] + config["offset"]).astype(config["dtype"])
        else:
            raise NotImplementedError(f"codec {name!r} can't be decoded here")
    return values


def _shard(data: bytes, meta: ArrayMeta, config: dict, shape) -> np.ndarray:
    inner = tuple(config["chunk_shape"])
    per = tuple(s // i for s, i in zip(shape, inner, strict=True))
    size = 16 * math.prod(per) + (4 if any(c["name"] == "crc32c" for c in config.get("index_codecs", [])) else 0)
    raw = data[-size:] if config.get("index_location", "end") == "end" else data[:size]
    for c in reversed(config.get("index_codecs", [])):
        if c["name"] != "bytes":
            raw = _unpack(raw, c)
    table = np.frombuffer(raw, "<u8").reshape(*per, 2)
    out = np.full(shape, meta.fill_scalar(), meta.dtype)
    for at in np.ndindex(*per):
        offset, length = map(int, table[at])
        if offset != 2**64 - 1:
            out[tuple(slice(i * c, (i + 1) * c) for i, c in zip(at, inner, strict=True))] = decode(data[offset : offset + length], meta, inner, config["codecs"])
    return out


def read_chunks(arr: VArray) -> DataFrame:
    """idx, values: each chunk that is there, decoded, as little-endian bytes in C order."""
    meta = arr.meta

    def run(batches):
        for batch in batches:
            out = [np.ascontiguousarray(decode(b, meta)).tobytes() for b in batch.column("bytes").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("idx"), pa.array(out, pa.binary())], ["idx", "values"])

    return read_bytes(arr).mapInArrow(run, "idx array<bigint>, values binary")


def read_elements(arr: VArray) -> DataFrame:
    """i0, i1, ..., value of every element of the chunks that are there; real numbers only. Stays distributed."""
    meta = arr.meta
    if meta.dtype.kind not in "iufb":
        raise NotImplementedError(f"elements of dtype {meta.dtype}")

    def run(batches):
        for batch in batches:
            for idx, b in zip(batch.column("idx").to_pylist(), batch.column("bytes").to_pylist(), strict=True):
                values = decode(b, meta)
                inside = tuple(slice(0, min(c, s - i * c)) for i, c, s in zip(idx, meta.chunks, meta.shape, strict=True))
                values = values[inside]
                at = np.indices(values.shape).reshape(meta.ndim, -1)
                cols = [pa.array(at[k] + idx[k] * meta.chunks[k], pa.int64()) for k in range(meta.ndim)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(values.ravel().astype(np.float64), pa.float64())], [*[f"i{k}" for k in range(meta.ndim)], "value"])

    return read_bytes(arr).mapInArrow(run, ", ".join([*[f"i{k} bigint" for k in range(meta.ndim)], "value double"]))


def read_array(arr: VArray) -> np.ndarray:
    """The whole array on the driver, missing chunks filled: for small arrays."""
    out = _unwritten(arr.meta)
    for r in read_bytes(arr).toLocalIterator():
        _place(out, arr.meta, r["idx"], bytes(r["bytes"]))
    return out


def read_arrays(rows: DataFrame, metas: dict[tuple[str, str], ArrayMeta]) -> dict[tuple[str, str], np.ndarray]:
    """Whole small arrays of many files by (file, name), in one job: rows are file, name, idx, path, offset, length, data."""
    out = {k: _unwritten(m) for k, m in metas.items()}
    rows = rows.withColumn("offset", F.when(F.col("data").isNull(), F.col("offset")).otherwise(F.lit(0)))
    for r in _read(rows, ("file", "name", "idx")).toLocalIterator():
        key = r["file"], r["name"]
        if key in out:
            _place(out[key], metas[key], r["idx"], bytes(r["bytes"]))
    return out


def _unwritten(meta: ArrayMeta) -> np.ndarray:
    return np.full(meta.shape, meta.fill_scalar() if meta.dtype != np.dtype(object) else "", meta.dtype)


def _place(out: np.ndarray, meta: ArrayMeta, idx, data: bytes) -> None:
    at = tuple(slice(i * c, min((i + 1) * c, s)) for i, c, s in zip(idx, meta.chunks, meta.shape, strict=True))
    out[at] = decode(data, meta)[tuple(slice(0, s.stop - s.start) for s in at)]


# CF conventions


def cf_decode(values: np.ndarray, attributes: dict, decode_times: bool = True) -> tuple[np.ndarray, dict]:
    """Values with missing ones masked, then scaled, and times decoded; and the attributes left over."""
    attrs = dict(attributes)
    fills = [f for k in ("_FillValue", "missing_value") if (f := attrs.pop(k, None)) is not None]
    scale, offset = attrs.pop("scale_factor", None), attrs.pop("add_offset", None)
    units = attrs.get("units")
    if decode_times and isinstance(units, str) and " since " in units and values.dtype.kind in "iuf":
        attrs.pop("units")
        return _times(values, units, attrs.pop("calendar", "standard")), attrs
    masked = np.zeros(values.shape, bool)
    if values.dtype.kind in "iuf":
        for f in fills:
            f = _cf_fill(f, values.dtype)
            masked |= np.isnan(values) if isinstance(f, float) and f != f else values == f
        if masked.any() or scale is not None or offset is not None:
            values = values.astype(np.float32 if values.dtype.itemsize <= 2 or values.dtype == np.float32 else np.float64)
            values = values * values.dtype.type(1 if scale is None else scale) + values.dtype.type(0 if offset is None else offset)
            values[masked] = np.nan
    return values, attrs


def _cf_fill(f, dtype):
    if isinstance(f, str) and dtype.kind == "f":
        try:
            return float(f)
        except ValueError:
            return struct.unpack("<d", base64.b64decode(f))[0]
    return f


_UNITS = {"day": 86400, "hour": 3600, "hr": 3600, "h": 3600, "minute": 60, "min": 60, "second": 1, "sec": 1, "s": 1, "millisecond": 1e-3, "microsecond": 1e-6}  # fixed values: seconds


def _times(values: np.ndarray, units: str, calendar: str) -> np.ndarray:
    if calendar not in ("standard", "gregorian", "proleptic_gregorian"):
        raise NotImplementedError(f"calendar {calendar!r}")
    unit, _, start = units.partition(" since ")
    unit = unit.strip().lower()
    step = _UNITS.get(unit, _UNITS.get(unit.rstrip("s")))
    if step is None:
        raise ValueError(f"unknown time unit {unit!r}")
    start = re.sub(r"\s*(UTC|Z)$", "", start.strip())
    m = re.match(r"(\d{1,4})-(\d{1,2})-(\d{1,2})(?:[T ](\d{1,2}):(\d{1,2})(?::(\d{1,2})(?:\.\d+)?)?)?", start)
    epoch = np.datetime64(datetime.datetime(*(int(x or 0) for x in m.groups())), "ns")
    ns = np.round(values.astype(np.float64) * step * 1e9) if values.dtype.kind == "f" or step < 1 else values.astype(np.int64) * (step * 10**9)
    lost = ~np.isfinite(ns) if np.asarray(ns).dtype.kind == "f" else np.zeros(values.shape, bool)
    out = epoch + np.where(lost, 0, ns).astype(np.int64).astype("timedelta64[ns]")
    out[lost] = np.datetime64("NaT")
    return out


def cf_column(raw: Column, attributes: dict) -> Column:
    """The same for a column of numbers: null where missing, else scaled."""
    value = raw.cast("double") * float(attributes.get("scale_factor", 1.0)) + float(attributes.get("add_offset", 0.0))
    fill = attributes.get("_FillValue")
    if fill is None:
        return value
    fill = json.loads(json.dumps(fill))
    return F.when(F.isnan(raw.cast("double")) if fill == "NaN" else raw == fill, None).otherwise(value)
