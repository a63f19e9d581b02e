"""Kerchunk reference documents out of datasets: dict, JSON file, or the Parquet layout."""

from __future__ import annotations

import base64
import json
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..dataset import Loaded, VDataset
from ..functions import keys
from ..hfs import Folder
from ..meta import ArrayMeta
from ..varray import VArray


def _loaded_meta(v: Loaded) -> ArrayMeta:
    for k in ("scale_factor", "add_offset"):
        if k in v.encoding:
            raise NotImplementedError(f"loaded variables with encoding {k!r} can't be written as references")
    values, attrs = encoded(v)
    return ArrayMeta(values.shape, values.shape, values.dtype, None, (), attrs, v.dims)


def encoded(v: Loaded) -> tuple[np.ndarray, dict]:
    """Values and attributes as stored: times become numbers since an epoch."""
    values, attrs = v.values, dict(v.attributes)
    if values.dtype.kind == "M":
        units = v.encoding.get("units", "seconds since 1970-01-01")
        unit, _, start = units.partition(" since ")
        step = {"days": "D", "hours": "h", "minutes": "m", "seconds": "s", "milliseconds": "ms", "microseconds": "us", "nanoseconds": "ns"}[unit]
        span = (values - np.datetime64(start.replace(" ", "T"), "ns")).astype("timedelta64[ns]")
        per = np.timedelta64(1, step).astype("timedelta64[ns]").astype(np.int64)
        number = span.astype(np.int64)
        values = number // per if (number % per == 0).all() else number / per
        attrs |= {"units": units, "calendar": v.encoding.get("calendar", "standard")}
    if values.dtype.kind == "U":
        values = np.char.encode(values, "utf-8")
    return np.ascontiguousarray(values), attrs


def ref_rows(v: VArray, name: str) -> DataFrame:
    """key, value of an array's chunks; value is JSON: text or [path, offset, length]."""
    key = keys.format_key(F.col("idx"), v.meta.separator) if v.ndim else F.lit("0")
    plain = F.regexp_replace("path", "^file://", "")
    virtual = F.concat(F.lit("["), F.regexp_replace(F.to_json(F.array(plain)), r"^\[|\]$", ""), F.lit(","), F.col("offset").cast("string"), F.lit(","), F.col("length").cast("string"), F.lit("]"))
    inlined = F.concat(F.lit('"base64:'), F.regexp_replace(F.base64("data"), "[\r\n]", ""), F.lit('"'))
    return v.refs.select(F.concat(F.lit(f"{name}/"), key).alias("key"), F.when(F.col("data").isNotNull(), inlined).otherwise(virtual).alias("value"))


def _metadata(ds: VDataset) -> dict:
    attrs = dict(ds.attributes)
    if named := sorted(n for n in ds.coords if n not in ds.sizes):
        attrs["coordinates"] = " ".join(named)
    out = {".zgroup": {"zarr_format": 2}, ".zattrs": attrs}
    for n, v in ds.variables.items():
        meta = v.meta if isinstance(v, VArray) else _loaded_meta(v)
        zarray, zattrs = meta.to_v2()
        out[f"{n}/.zarray"], out[f"{n}/.zattrs"] = zarray, zattrs
    return out


def _loaded_refs(ds: VDataset) -> dict[str, str]:
    return {f"{n}/{'.'.join(['0'] * v.values.ndim) or '0'}": "base64:" + base64.b64encode(encoded(v)[0].tobytes()).decode() for n, v in ds.loaded.items() if v.values.size}


def refs_frame(ds: VDataset) -> DataFrame | None:
    """key, value of all chunks as a relation; None without virtual variables."""
    parts = [ref_rows(v, n) for n, v in ds.virtual.items()]
    spark = next((v.spark for v in ds.virtual.values()), None)
    if spark is None:
        return None
    loaded = [(k, json.dumps(v)) for k, v in _loaded_refs(ds).items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.unionByName(spark.createDataFrame(loaded, "key string, value string")) if loaded else out


def document_rows(ds: VDataset) -> DataFrame:
    """key, value of the whole document, its metadata and its chunks; value is JSON text. Nothing of it passes the driver but metadata and loaded variables."""
    rows = {k: json.dumps(v, separators=(",", ":")) for k, v in _metadata(ds).items()}
    chunks = refs_frame(ds)
    if chunks is None:
        rows |= {k: json.dumps(v) for k, v in _loaded_refs(ds).items()}
    out = _spark(ds).createDataFrame(list(rows.items()), "key string, value string")
    return out if chunks is None else out.unionByName(chunks)


def to_kerchunk(ds: VDataset, path: str | None = None, format: str = "dict", record_size: int = 100_000, categorical_threshold: int = 10):
    """A document as dict, JSON file, Parquet folder, or ``rows`` of a relation (:func:`document_rows`). ``categorical_threshold`` is taken for compatibility: Parquet encodes paths by dictionary itself."""
    if format == "json" and not path:
        raise ValueError("Filepath must be provided when format is 'json'")
    if format == "parquet":
        return _to_parquet(ds, path, record_size)
    if format == "rows":
        return document_rows(ds)
    if format not in ("dict", "json"):
        raise ValueError(f"Unrecognized output format: {format}")
    refs = {k: json.dumps(v, separators=(",", ":")) for k, v in _metadata(ds).items()}
    frame = refs_frame(ds)
    if frame is not None:
        # a document is one file by its format: it must fit the driver; the Parquet layout and the rows needn't
        for r in frame.orderBy("key").toLocalIterator():
            refs[r["key"]] = json.loads(r["value"])
    else:
        refs |= _loaded_refs(ds)
    document = {"version": 1, "refs": refs}
    if format == "dict":
        return document
    _write_text(ds, path, json.dumps(document))
    return None


def _spark(ds: VDataset):
    from pyspark.sql import SparkSession

    return next((v.spark for v in ds.virtual.values()), None) or SparkSession.getActiveSession()


def _write_text(ds: VDataset, path: str, text: str) -> None:
    folder, _, name = keys.uri(path).rpartition("/")
    Folder(_spark(ds), folder).write(name, text.encode(), overwrite=True)


def _to_parquet(ds: VDataset, path: str, record_size: int) -> None:
    """Into a folder beside the wanted one, which takes its place when all is written, so that nothing of an older one stays."""
    wanted = keys.uri(path).rstrip("/")
    spark = _spark(ds)
    old = Folder(spark, wanted)
    if old.list() and not old.exists(".zmetadata"):
        raise FileExistsError(f"{wanted} holds something other than references")
    root = f"{wanted}.writing-{uuid.uuid4().hex[:8]}"
    folder = Folder(spark, root)
    folder.write(".zmetadata", json.dumps({"metadata": _metadata(ds), "record_size": record_size}).encode(), overwrite=True)
    for n, v in ds.variables.items():
        if isinstance(v, Loaded):
            values = encoded(v)[0]
            if not values.size:
                continue
            v = VArray(_loaded_meta(v), spark.createDataFrame([([0] * values.ndim, None, 0, values.nbytes, bytearray(values.tobytes()))], "idx array<bigint>, path string, offset bigint, length bigint, data binary"))
        linear, stride = F.lit(0).cast("bigint"), 1
        for a in range(v.ndim - 1, -1, -1):
            linear = linear + F.get("idx", F.lit(a)) * stride
            stride *= v.grid[a]
        total = v.meta.n_chunks
        rows = v.refs.select(linear.alias("at"), F.regexp_replace("path", "^file://", "").alias("path"), "offset", "length", "data")
        # a row for each record, so that those without chunks are written too
        records = spark.range(-(-total // record_size)).select((F.col("id") * record_size).alias("at"), *[F.lit(None).cast(t).alias(c) for c, t in (("path", "string"), ("offset", "bigint"), ("length", "bigint"), ("data", "binary"))])
        rows = rows.unionByName(records).withColumn("record", F.expr(f"at div {record_size}"))
        rows.groupBy("record").applyInArrow(_record_writer(f"{root}/{n}", record_size, total), "record bigint").write.format("noop").mode("overwrite").save()
    old.delete()
    if not Folder(spark, wanted.rpartition("/")[0]).rename(root.rpartition("/")[2], wanted.rpartition("/")[2]):
        raise OSError(f"{root} couldn't be renamed to {wanted}")


def _record_writer(where: str, record_size: int, total: int):
    """Writes one ``refs.<n>.parq``: a row a grid position, at most ``record_size``."""

    def write(table: pa.Table) -> pa.Table:
        import pyarrow.parquet as pq
        from pyarrow import fs

        record = table.column("record")[0].as_py()
        n = min(record_size, total - record * record_size)
        place = table.column("at").to_numpy() - record * record_size
        cols: dict[str, list] = {"path": [None] * n, "offset": [0] * n, "size": [0] * n, "raw": [None] * n}
        for p, path, offset, length, data in zip(place, *(table.column(c).to_pylist() for c in ("path", "offset", "length", "data")), strict=True):
            if path is None and data is None:
                continue
            cols["path"][p], cols["raw"][p] = path, data
            if data is None:
                cols["offset"][p], cols["size"][p] = offset, length
        out = pa.table({"path": pa.array(cols["path"], pa.string()), "offset": pa.array(cols["offset"], pa.int64()), "size": pa.array(cols["size"], pa.int64()), "raw": pa.array(cols["raw"], pa.binary())})
        system, path = (fs.LocalFileSystem(), where.removeprefix("file://")) if where.startswith("file:") else fs.FileSystem.from_uri(where)
        system.create_dir(path, recursive=True)
        pq.write_table(out, f"{path}/refs.{record}.parq", filesystem=system, use_dictionary=["path"])
        return pa.table({"record": pa.array([record], pa.int64())})

    return write


def comparable(document: dict) -> dict:
    """A document with its nested JSON parsed, for comparisons."""
    return {k: json.loads(v) if isinstance(v, str) and k.rpartition("/")[2].startswith(".z") else v for k, v in document["refs"].items()}
