"""Files made from the shared tables, for queries that open files by their parsers.

Chunks and netCDF files are written where tasks run.  Everything goes below ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import io
import json
import struct
import tempfile
import uuid
import zipfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys
from ..hfs import Folder
from ..read import open_input  # noqa: F401  the reading counterpart of :func:`put`
from . import manifests as M
from .hdf5_files import Array, Writer

#: Rows and columns of a chunk of the array of embeddings.
ROWS, COLUMNS = 50, 16


def place(spark: SparkSession, name: str) -> str:
    """A new folder's URI in the folder that all tasks share."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="chunkweave-")
        spark.conf.set("spark.checkpoint.dir", shared)
    return f"{keys.uri(shared.rstrip('/'))}/{name}-{uuid.uuid4().hex[:12]}"


def put(uri: str, data: bytes) -> None:
    """Write a file from a task."""
    from pyarrow import fs

    system, path = (fs.LocalFileSystem(), uri.removeprefix("file://")) if uri.startswith("file:") else fs.FileSystem.from_uri(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    with system.open_output_stream(path) as out:
        out.write(data)


def done(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def embeddings_zarr(spark: SparkSession, sf: str, version: int = 2, compress: bool = False, separator: str = ".") -> str:
    """Zarr folder with array ``v`` of all embeddings, row by vec_id, and a group attribute."""
    root = place(spark, f"zarr{version}")
    rows = M.table(spark, sf, "embeddings").select("vec_id", "embedding")
    size = rows.agg(F.max("vec_id").alias("n"), F.max(F.size("embedding")).alias("width")).first()
    shape = [size["n"] + 1, size["width"]]

    def cut(table: pa.Table) -> pa.Table:
        import zlib

        block = np.zeros((ROWS, shape[1]), "<f4")
        first = table.column("vec_id")[0].as_py() // ROWS
        for at, values in zip(table.column("vec_id").to_pylist(), table.column("embedding").to_pylist(), strict=True):
            block[at - first * ROWS] = values
        for k in range(0, shape[1], COLUMNS):
            raw = np.ascontiguousarray(block[:, k : k + COLUMNS]).tobytes()
            name = f"{first}{separator}{k // COLUMNS}"
            put(f"{root}/v/{name if version == 2 else f'c{separator}{name}'}", zlib.compress(raw, 1) if compress else raw)
        return pa.table({"first": pa.array([first], pa.int64())})

    done(rows.groupBy(F.expr(f"vec_id div {ROWS}")).applyInArrow(cut, "first bigint"))
    folder, dims = Folder(spark, root), ["vec", "component"]
    if version == 2:
        doc = {"zarr_format": 2, "shape": shape, "chunks": [ROWS, COLUMNS], "dtype": "<f4", "fill_value": 0, "order": "C", "filters": None, "compressor": {"id": "zlib", "level": 1} if compress else None, "dimension_separator": separator}
        folder.write(".zgroup", b'{"zarr_format": 2}')
        folder.write("v/.zarray", json.dumps(doc).encode())
        folder.write("v/.zattrs", json.dumps({"_ARRAY_DIMENSIONS": dims}).encode())
    else:
        doc = {"zarr_format": 3, "node_type": "array", "shape": shape, "data_type": "float32", "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": [ROWS, COLUMNS]}}, "fill_value": 0.0, "attributes": {}, "dimension_names": dims}
        doc |= {"chunk_key_encoding": {"name": "default", "configuration": {"separator": separator}}, "codecs": [{"name": "bytes", "configuration": {"endian": "little"}}]}
        folder.write("zarr.json", json.dumps({"zarr_format": 3, "node_type": "group", "attributes": {"title": "t"}}).encode())
        folder.write("v/zarr.json", json.dumps(doc).encode())
    return root


def zipped(spark: SparkSession, root: str) -> str:
    """An archive of a folder's files, stored as they are."""
    folder, raw = Folder(spark, root), io.BytesIO()
    with zipfile.ZipFile(raw, "w") as archive:
        for top in folder.list():
            inner = [f"{top}/{n}" for n in folder.list(top) if not n.endswith(".crc")]
            for name in [top] if inner in ([], [f"{top}/{top}"]) else inner:
                if not name.endswith(".crc"):
                    archive.writestr(name, folder.read(name))
    out = f"{root}.zip"
    Folder(spark, root.rpartition("/")[0]).write(out.rpartition("/")[2], raw.getvalue())
    return out


def netcdf(labels, values) -> bytes:
    """A classic netCDF file: record dimension ``day``, its labels (32-bit integers) and variable ``total`` (doubles), a record a chunk."""
    name = lambda s: struct.pack(">I", len(s)) + s.encode() + b"\0" * (-len(s) % 4)

    def head(begins):
        out = b"CDF\1" + struct.pack(">I", len(labels)) + struct.pack(">II", 10, 1) + name("day") + struct.pack(">I", 0) + struct.pack(">II", 0, 0) + struct.pack(">II", 11, 2)
        for n, kind, size, begin in (("day", 4, 4, begins[0]), ("total", 6, 8, begins[1])):
            out += name(n) + struct.pack(">II", 1, 0) + struct.pack(">II", 0, 0) + struct.pack(">III", kind, size, begin)
        return out

    at = len(head([0, 0]))
    return head([at, at + 4]) + b"".join(struct.pack(">id", a, b) for a, b in zip(labels, values, strict=True))


def order_days_netcdf(spark: SparkSession, sf: str) -> str:
    """Folder with a netCDF file a year: the total price of each day's orders, days since 1990."""
    root = place(spark, "netcdf")
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1990-01-01").cast("date"))
    days = M.table(spark, sf, "orders").groupBy(F.year("o_orderdate").alias("year"), day.alias("day")).agg(F.round(F.sum("o_totalprice"), 2).alias("total"))

    def write(table: pa.Table) -> pa.Table:
        table = table.sort_by("day")
        put(f"{root}/y{table.column('year')[0].as_py()}.nc", netcdf(table.column("day").to_pylist(), table.column("total").to_pylist()))
        return table.select(["year"]).slice(0, 1)

    done(days.groupBy("year").applyInArrow(write, "year int"))
    return root


def order_days_hdf5(spark: SparkSession, sf: str) -> str:
    """Folder with an HDF5 file a year: each day's total a chunk each, behind another chunk index from year to year."""
    root = place(spark, "hdf5")
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1990-01-01").cast("date"))
    days = M.table(spark, sf, "orders").groupBy(F.year("o_orderdate").alias("year"), day.alias("day")).agg(F.round(F.sum("o_totalprice"), 2).alias("total"))

    def write(table: pa.Table) -> pa.Table:
        table = table.sort_by("day")
        year = table.column("year")[0].as_py()
        storage = ("tree", "fixed", "extensible", "tree2")[year % 4]
        label = Array("day", table.column("day").to_numpy().astype("<i4"), is_scale=True)
        limits = (None,) if storage in ("extensible", "tree2") else None
        total = Array("total", table.column("total").to_numpy(), storage, (1,), limits, deflate=True, scales=("day",))
        put(f"{root}/y{year}.h5", Writer(new=storage != "tree").file([label, total]))
        return table.select(["year"]).slice(0, 1)

    done(days.groupBy("year").applyInArrow(write, "year int"))
    return root


def regions_hdf5(spark: SparkSession, sf: str) -> str:
    """HDF5 file with a group a region: the keys of its nations as a whole array, and the region's name as an attribute of it."""
    root = place(spark, "regions")
    groups = {}
    for r in M.table(spark, sf, "nation").join(M.table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_regionkey", "r_name").agg(F.sort_array(F.collect_list("n_nationkey")).alias("keys")).collect():
        groups[f"r{r['r_regionkey']}"] = [Array("nations", np.array(r["keys"], ">i4"), attributes={"region": r["r_name"]})]
    Folder(spark, root).write("regions.h5", Writer(dense=True).file([], groups))
    return f"{root}/regions.h5"


def names_file(spark: SparkSession, sf: str, width: int = 16) -> tuple[str, DataFrame]:
    """One file with the name of each part in ``width`` bytes, and (n, offset): which part lies where."""
    root = place(spark, "names")
    rows = M.table(spark, sf, "part").select(F.col("p_partkey").alias("n"), F.rpad(F.substring("p_name", 1, width), width, " ").alias("name")).orderBy("n")
    text, where = [], []
    for r in rows.toLocalIterator():  # a fixture of one small file
        where.append((r["n"], len(text) * width))
        text.append(r["name"].encode("ascii", "replace"))
    Folder(spark, root).write("names.bin", b"".join(text))
    return f"{root}/names.bin", spark.createDataFrame(where, "n bigint, offset bigint")


def sizes_fits(spark: SparkSession, sf: str) -> str:
    """FITS image of 10 columns with the sizes of all parts in order of key."""
    root = place(spark, "fits")
    values = np.array([r["p_size"] for r in M.table(spark, sf, "part").orderBy("p_partkey").select("p_size").toLocalIterator()], ">i4")
    card = lambda k, v: f"{k:8}= {v:>20}".ljust(80)
    head = "".join([card("SIMPLE", "T"), card("BITPIX", 32), card("NAXIS", 2), card("NAXIS1", 10), card("NAXIS2", len(values) // 10), "END".ljust(80)]).encode()
    body = values[: len(values) // 10 * 10].tobytes()
    Folder(spark, root).write("a.fits", head + b" " * (-len(head) % 2880) + body + b"\0" * (-len(body) % 2880))
    return f"{root}/a.fits"


def documents_dmrpp(spark: SparkSession, sf: str) -> str:
    """DMR++ description: variable ``n`` with a chunk a document at doc_id * 100, and the same in group ``g``."""
    root = place(spark, "dmrpp")
    rows = M.table(spark, sf, "documents").orderBy("doc_id").select("doc_id", "n_chars")
    chunks = "".join(f'<dmrpp:chunk offset="{r["doc_id"] * 100}" nBytes="{r["n_chars"]}" chunkPositionInArray="[{r["doc_id"]}]"/>' for r in rows.toLocalIterator())
    variable = f'<Int16 name="n"><Dim name="/doc"/><dmrpp:chunks compressionType="deflate" byteOrder="LE"><dmrpp:chunkDimensionSizes>1</dmrpp:chunkDimensionSizes>{chunks}</dmrpp:chunks></Int16>'
    spaces = 'xmlns="http://xml.opendap.org/ns/DAP/4.0#" xmlns:dmrpp="http://xml.opendap.org/dap/dmrpp/1.0.0#"'
    text = f'<Dataset {spaces} name="d"><Dimension name="doc" size="{rows.count()}"/>{variable}<Group name="g">{variable}</Group></Dataset>'
    Folder(spark, root).write("docs.nc.dmrpp", text.encode())
    return f"{root}/docs.nc.dmrpp"
