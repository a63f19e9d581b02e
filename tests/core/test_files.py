"""Parsers, read path, sinks, store and datasets, on files made here."""

import bz2
import datetime
import json
import struct
import zipfile
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from chunkweave import api, read
from chunkweave import dataset as D
from chunkweave.dataset import Loaded, VDataset, VGroup
from chunkweave.meta import ArrayMeta, codec_from_v2
from chunkweave.operators import checks, combine
from chunkweave.sinks.kerchunk import comparable
from chunkweave.sinks.store import ConflictError, Store, resolve_mode
from chunkweave.sources import hdf
from chunkweave.sources.dmrpp import DMRPPParser
from chunkweave.sources.fits import FITSParser
from chunkweave.sources.kerchunk import KerchunkJSONParser, KerchunkParquetParser
from chunkweave.sources.netcdf3 import NetCDF3Parser
from chunkweave.sources.zarr import ZarrParser, ZippedZarrParser
from chunkweave.streaming.ingest import append_batch, ingest, pending
from chunkweave.varray import VArray

# Kerchunk

ZARRAY = {"chunks": [2, 3], "compressor": None, "dtype": "<i8", "fill_value": None, "filters": None, "order": "C", "shape": [2, 3], "zarr_format": 2}


def document(chunks, shape=(2, 3), edges=(2, 3), prefix="", **zarray):
    z = {**ZARRAY, "shape": list(shape), "chunks": list(edges), **zarray}
    return {"version": 1, "refs": {".zgroup": '{"zarr_format":2}', **({f"{prefix.strip('/')}/.zgroup": '{"zarr_format":2}'} if prefix else {}), f"{prefix}a/.zarray": json.dumps(z), f"{prefix}a/.zattrs": json.dumps({"_ARRAY_DIMENSIONS": [f"{prefix}{d}" for d in "xyz"[: len(shape)]], "value": "1"}), **{f"{prefix}a/{k}": v for k, v in chunks.items()}}}


def test_kerchunk_forms(spark, tmp_path):
    (tmp_path / "whole.bin").write_bytes(b"12345")
    chunks = {"0.0": ["/test1.nc", 6144, 48], "0.1": "base64:AQIDBAUGBwg=", "1.0": "raw text é", "1.1": [f"{tmp_path}/whole.bin"], "2.0": [float("nan")], "2.1": '["x"]'}
    doc = document(chunks, (6, 6), (2, 3))
    path = tmp_path / "refs.json"
    path.write_text(json.dumps(doc))
    for source in (doc, str(path)):
        g = KerchunkJSONParser()(spark, source)
        got = g["a"].dict()
        assert got["0.0"] == {"path": "file:///test1.nc", "offset": 6144, "length": 48}
        assert got["0.1"]["data"] == bytes(range(1, 9)) and got["1.0"]["data"] == "raw text é".encode() and got["2.1"]["data"] == b'["x"]'
        assert got["1.1"] == {"path": f"file://{tmp_path}/whole.bin", "offset": 0, "length": 5} and "2.0" not in got
        assert g["a"].meta.dims == ("x", "y") and g["a"].meta.attributes == {"value": "1"} and g["a"].meta.fill_value == 0


def test_kerchunk_groups_and_errors(spark):
    doc = document({"0.0": ["s3://b/f", 1, 2]}, prefix="sub/")
    assert KerchunkJSONParser(group="sub")(spark, doc)["a"].meta.dims == ("x", "y")
    assert list(KerchunkJSONParser()(spark, doc)["sub"]) == ["a"]
    with pytest.raises(ValueError, match="not found"):
        KerchunkJSONParser(group="nope")(spark, doc)
    assert len(KerchunkJSONParser(group="sub", skip_variables=["a"])(spark, doc)) == 0
    with pytest.raises(TypeError):
        KerchunkJSONParser()(spark, document({"0.0": ["s3://b/f", 1]}))
    with pytest.raises(ValueError):
        KerchunkJSONParser()(spark, document({"0.0": ["rel.nc", 1, 2]}))
    assert KerchunkJSONParser(fs_root="s3://b")(spark, document({"0.0": ["rel.nc", 1, 2]}))["a"].dict()["0.0"]["path"] == "s3://b/rel.nc"
    g = KerchunkJSONParser()(spark, document({}, (100, 200), (50, 100)))
    assert g["a"].dict() == {} and g["a"].grid == (2, 2)
    assert KerchunkJSONParser()(spark, document({"0": ["/t.nc", 100, 4]}, (), ()))["a"].dict() == {"": {"path": "file:///t.nc", "offset": 100, "length": 4}}


@pytest.fixture
def ds(spark):
    m = ArrayMeta((4, 3), (2, 3), "<f4", "NaN", (codec_from_v2({"id": "zlib", "level": 1}),), {"units": "K"}, ("time", "x"))
    a = VArray.from_dict(spark, m, {"0.0": {"path": "s3://b/f.nc", "offset": 10, "length": 20}, "1.0": {"path": "", "offset": 0, "length": 8, "data": bytes(range(1, 9))}})
    return VDataset({"air": a, "time": Loaded(("time",), np.arange(4.0), {"axis": "T"}), "lon": Loaded(("x",), np.array([1, 2, 3]))}, ["lon"], {"title": "t"})


def test_kerchunk_write(spark, ds, tmp_path):
    doc = ds.to_kerchunk()
    got = comparable(doc)
    assert got["air/0.0"] == ["s3://b/f.nc", 10, 20] and got["air/1.0"] == "base64:AQIDBAUGBwg=" and got[".zattrs"] == {"title": "t", "coordinates": "lon"}
    assert got["air/.zarray"]["fill_value"] == "NaN" and got["air/.zattrs"] == {"units": "K", "_ARRAY_DIMENSIONS": ["time", "x"]}
    with pytest.raises(ValueError, match="Filepath must be provided"):
        ds.to_kerchunk(format="json")
    with pytest.raises(ValueError, match="Unrecognized output format"):
        ds.to_kerchunk(format="xml")
    with pytest.raises(NotImplementedError):
        VDataset({"v": Loaded(("x",), np.arange(2), encoding={"scale_factor": 2})}).to_kerchunk()
    ds.to_kerchunk(str(tmp_path / "r.json"), format="json")
    ds.to_kerchunk(str(tmp_path / "r.parq"), format="parquet", record_size=1)
    assert pq.read_table(tmp_path / "r.parq/air/refs.0.parq").to_pylist() == [{"path": "s3://b/f.nc", "offset": 10, "size": 20, "raw": None}]
    for parser, name in ((KerchunkJSONParser(), "r.json"), (KerchunkParquetParser(), "r.parq")):
        back = api.open_virtual_dataset(spark, str(tmp_path / name), parser, loadable_variables=["time", "lon"])
        assert back.equals(ds) and back.attributes == {"title": "t"} and "lon" in back.coords


def test_kerchunk_rows(spark, ds):
    """The document as rows is the document, also without virtual variables."""
    for given in (ds, VDataset({"time": ds["time"]}, attributes={"title": "t"})):
        rows = given.to_kerchunk(format="rows").collect()
        assert len(rows) == len({r["key"] for r in rows}) and {r["key"]: json.loads(r["value"]) for r in rows} == comparable(given.to_kerchunk())


@pytest.fixture
def to_driver(spark, monkeypatch):
    """Rows that have come to the driver, one count a call."""
    kind, counts = type(spark.range(0)), []
    collect, iterate = kind.collect, kind.toLocalIterator

    def collected(self):
        counts.append(len(rows := collect(self)))
        return rows

    def iterated(self, *args, **kwargs):
        rows = list(iterate(self, *args, **kwargs))
        counts.append(len(rows))
        return iter(rows)

    monkeypatch.setattr(kind, "collect", collected)
    monkeypatch.setattr(kind, "toLocalIterator", iterated)
    return counts


def test_kerchunk_metadata_stays_distributed(spark, to_driver):
    from chunkweave.plans.catalogue import QUERIES

    out = QUERIES["kerchunk_metadata"](spark, "/root/testdata/sf0.001")
    assert sum(to_driver) <= 2 and out.first()["chunks"] > 1000


def test_kerchunk_times(spark, tmp_path):
    t = np.array(["2000-01-01", "2000-01-02T12"], "datetime64[ns]")
    ds = VDataset({"time": Loaded(("time",), t, {}, {"units": "hours since 2000-01-01"})})
    back = api.open_virtual_dataset(spark, ds.to_kerchunk(), KerchunkJSONParser())
    assert (back["time"].values == t).all()


# Zarr


def write_zarr(root, name, values, chunks, version=2, separator=".", skip=(), compressor=None):
    d = root / name
    d.mkdir(parents=True)
    dims = [f"{name}_{k}" for k in range(values.ndim)]
    if version == 2:
        (d / ".zarray").write_text(json.dumps({"zarr_format": 2, "shape": values.shape, "chunks": chunks, "dtype": values.dtype.str, "fill_value": 0, "order": "C", "filters": None, "compressor": compressor, "dimension_separator": separator}))
        (d / ".zattrs").write_text(json.dumps({"_ARRAY_DIMENSIONS": dims}))
    else:
        (d / "zarr.json").write_text(json.dumps({"zarr_format": 3, "node_type": "array", "shape": values.shape, "data_type": values.dtype.name, "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": chunks}}, "chunk_key_encoding": {"name": "default", "configuration": {"separator": separator}}, "fill_value": 0, "codecs": [{"name": "bytes", "configuration": {"endian": "little"}}], "attributes": {}, "dimension_names": dims}))
    grid = [-(-s // c) for s, c in zip(values.shape, chunks, strict=True)]
    for idx in np.ndindex(*grid):
        key = separator.join(map(str, idx))
        if key in skip:
            continue
        block = np.zeros(chunks, values.dtype)
        part = values[tuple(slice(i * c, (i + 1) * c) for i, c in zip(idx, chunks, strict=True))]
        block[tuple(slice(0, n) for n in part.shape)] = part
        raw = block.tobytes()
        if compressor:
            raw = zlib.compress(raw) if compressor["id"] == "zlib" else bz2.compress(raw)
        f = d / (key or "0") if version == 2 else d / (f"c{separator}{key}" if key else "c")
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(raw)


@pytest.fixture(params=[(2, "."), (2, "/"), (3, "/"), (3, ".")])
def zarr_store(request, tmp_path):
    version, sep = request.param
    root = tmp_path / "s.zarr"
    (root / "sub").mkdir(parents=True)
    for d, attrs in ((root, {"title": "t"}), (root / "sub", {"k": 1})):
        if version == 2:
            (d / ".zgroup").write_text('{"zarr_format": 2}')
            (d / ".zattrs").write_text(json.dumps(attrs))
        else:
            (d / "zarr.json").write_text(json.dumps({"zarr_format": 3, "node_type": "group", "attributes": attrs}))
    full = np.arange(30 * 20, dtype="<i4").reshape(30, 20)
    sparse = full.copy()
    sparse[10:20, 10:20] = 0
    write_zarr(root, "full", full, [10, 10], version, sep, compressor={"id": "zlib", "level": 1} if version == 2 else None)
    write_zarr(root, "sparse", sparse, [10, 10], version, sep, skip={f"1{sep}1"})
    write_zarr(root, "scalar", np.array(7, "<i8"), [], version, sep)
    write_zarr(root / "sub", "odd", np.arange(7, dtype="<f8"), [3], version, sep)
    return root, {"full": full, "sparse": sparse, "scalar": np.array(7)}, version


def test_zarr_folder_and_zip(spark, zarr_store, tmp_path):
    root, want, version = zarr_store
    z = tmp_path / "s.zarr.zip"
    with zipfile.ZipFile(z, "w") as f:
        for p in sorted(root.rglob("*")):
            f.write(p, p.relative_to(root))
    for parser, url in ((ZarrParser(), root), (ZippedZarrParser(), z)):
        g = parser(spark, str(url))
        assert g.attributes == {"title": "t"} and set(g) == {"full", "sparse", "scalar", "sub"} and g["sub"].attributes == {"k": 1}
        for n, values in want.items():
            assert (read.read_array(g[n]) == values).all()
        assert g["sparse"].n_refs() == 5 and g["full"].n_refs_dense() == 6
        assert read.read_array(g["sub"]["odd"]).tolist() == list(range(7))
        part = read.read_elements(g["full"][10:20, :])
        assert part.count() == 200 and part.agg(F.sum("value")).first()[0] == want["full"][10:20].sum()
        assert g.list_dir("scalar") == ["zarr.json", "c"] and g.deepest("sub/odd/c.0")[1] == "c.0"
        if url is root:
            assert set(ZarrParser(group="sub")(spark, str(root))) == {"odd"} and "full" not in ZarrParser(skip_variables=["full"])(spark, str(root))
    with zipfile.ZipFile(tmp_path / "bad.zip", "w", zipfile.ZIP_DEFLATED) as f:
        f.writestr(".zgroup", '{"zarr_format": 2}' * 50)
    with pytest.raises(Exception, match="compressed"):
        ZippedZarrParser().parse(f"file://{tmp_path}/bad.zip")


def test_listing(spark, make):
    """The relation lists what the driver's list does: chunks that are there, a group's members, nothing below a chunk."""
    g = VGroup({"v": make((4, 30), (2, 2), present={"0.0", "1.10"}), "none": make((4,), (2,), present=set()), "scalar": make((), ()), "no_scalar": make((), (), present=set())}, {"sub": VGroup()})
    for prefix in ("", "v", "none", "scalar", "no_scalar", "sub", "v/c.0.0", "nope"):
        assert sorted(r["key"] for r in g.listing(prefix).collect()) == sorted(g.list_dir(prefix))
    assert g.list_dir("v") == ["zarr.json", "c.0.0", "c.1.10"]


def test_list_dir_stays_distributed(spark, to_driver):
    from chunkweave.plans.catalogue import QUERIES

    out = QUERIES["list_dir"](spark, "/root/testdata/sf0.001")
    assert sum(to_driver) <= 2 and out.count() > 1000


def test_zip_with_local_extras(tmp_path):
    from chunkweave.sources.zarr import data_offsets, zip_index

    z = tmp_path / "x.zip"
    with zipfile.ZipFile(z, "w") as f:
        with f.open(zipfile.ZipInfo("a"), "w", force_zip64=True) as m:
            m.write(b"hello")
        f.writestr("b", b"world")
        f.mkdir("d")
    with read.open_input(f"file://{z}") as f:
        index, cd = zip_index(f, f.size())
        at = data_offsets(f, index, cd)
        assert {n: f.read_at(index[n][1], at[n]) for n in index} == {"a": b"hello", "b": b"world"}


# codecs and CF


def test_decode(spark):
    v = np.arange(12, dtype="<i4").reshape(3, 4)
    m = lambda *c, **k: ArrayMeta((3, 4), (3, 4), "<i4", codecs=c, **k)
    z, sh = codec_from_v2({"id": "zlib", "level": 1}), codec_from_v2({"id": "shuffle", "elementsize": 4})
    shuffled = np.frombuffer(v.tobytes(), np.uint8).reshape(-1, 4).T.tobytes()
    assert (read.decode(zlib.compress(shuffled), m(sh, z)) == v).all()
    assert (read.decode(v.astype(">i4").tobytes(), ArrayMeta((3, 4), (3, 4), ">i4")) == v).all()
    assert (read.decode(v.T.tobytes(), m({"name": "transpose", "configuration": {"order": [1, 0]}})) == v).all()
    d = np.diff(v.ravel(), prepend=0).astype("<i4")
    assert (read.decode(d.tobytes(), m(codec_from_v2({"id": "delta", "dtype": "<i4"}))) == v).all()
    assert (read.decode(struct.pack("<I", zlib.crc32(v.tobytes())) + v.tobytes(), m(codec_from_v2({"id": "crc32"}))) == v).all()
    with pytest.raises(ValueError):
        read.decode(b"0000" + v.tobytes(), m(codec_from_v2({"id": "crc32"})))
    with pytest.raises(NotImplementedError):
        read.decode(v.tobytes(), m(codec_from_v2({"id": "pcodec"})))
    import zstandard

    assert (read.decode(zstandard.compress(v.tobytes()), m(codec_from_v2({"id": "zstd"}))) == v).all()
    rec = np.array([(1, 2.5), (3, 4.5)], [("id", "<i4"), ("t", "<f4")])
    assert (read.decode(rec.tobytes(), ArrayMeta((2,), (2,), rec.dtype)) == rec).all()
    words = b"".join([struct.pack("<I", 2), struct.pack("<I", 2), b"ab", struct.pack("<I", 0)])
    assert read.decode(words, ArrayMeta((2,), (2,), object)).tolist() == ["ab", ""]


def test_shard_decode():
    inner = [np.full((2, 2), k, "<i4").tobytes() for k in range(3)]
    table = np.full((2, 2, 2), 2**64 - 1, "<u8")
    for k, at in enumerate([(0, 0), (0, 1), (1, 1)]):
        table[at] = [16 * k, 16]
    index = table.tobytes()
    body = b"".join(inner) + index + struct.pack("<I", read._crc32c(index))
    shard = {"name": "sharding_indexed", "configuration": {"chunk_shape": [2, 2], "codecs": [{"name": "bytes", "configuration": {"endian": "little"}}], "index_codecs": [{"name": "bytes"}, {"name": "crc32c"}], "index_location": "end"}}
    got = read.decode(body, ArrayMeta((4, 4), (4, 4), "<i4", 9, (shard,)))
    assert got.tolist() == [[0, 0, 1, 1], [0, 0, 1, 1], [9, 9, 2, 2], [9, 9, 2, 2]]


def test_cf(spark):
    v, left = read.cf_decode(np.array([1, -9, 3], "i2"), {"scale_factor": 0.5, "add_offset": 10, "_FillValue": -9, "k": 1})
    assert v.dtype == np.float32 and np.allclose(v, [10.5, np.nan, 11.5], equal_nan=True) and left == {"k": 1}
    t, left = read.cf_decode(np.array([0, 1.5]), {"units": "days since 2000-01-01 06:00:00"})
    assert (t == np.array(["2000-01-01T06", "2000-01-02T18"], "datetime64[ns]")).all() and not left
    with pytest.raises(NotImplementedError):
        read.cf_decode(np.array([0]), {"units": "days since 2000-01-01", "calendar": "360_day"})


@pytest.mark.parametrize("args,want", [({"start": 1, "end": 2}, b"\2"), ({"start": 1}, b"\2\3\4"), ({"suffix": 2}, b"\3\4"), ({"suffix": 99}, b"\1\2\3\4"), ({"start": 3, "end": 99}, b"\4"), ({}, b"\1\2\3\4")])
def test_byte_ranges(spark, tmp_path, args, want):
    (tmp_path / "f").write_bytes(b"xx\1\2\3\4yy")
    a = VArray.from_dict(spark, ArrayMeta((8,), (4,), "u1"), {"0": {"path": str(tmp_path / "f"), "offset": 2, "length": 4}, "1": {"path": "", "offset": 0, "length": 4, "data": b"\1\2\3\4"}})
    assert [bytes(r["bytes"]) for r in read.read_bytes(a, **args).collect()] == [want, want]


# other formats


def netcdf3(path, records, version=1):
    name = lambda s: struct.pack(">I", len(s)) + s.encode() + b"\0" * (-len(s) % 4)
    attr = lambda k, s: name(k) + struct.pack(">II", 2, len(s)) + s.encode() + b"\0" * (-len(s) % 4)
    x = np.arange(6, dtype=">f8")
    far = ">Q" if version == 2 else ">I"

    def head(begins):
        h = b"CDF" + bytes([version]) + struct.pack(">I", len(records)) + struct.pack(">II", 10, 2) + name("time") + struct.pack(">I", 0) + name("x") + struct.pack(">I", 6)
        h += struct.pack(">II", 12, 1) + attr("title", "hello") + struct.pack(">II", 11, 3)
        h += name("x") + struct.pack(">II", 1, 1) + struct.pack(">II", 0, 0) + struct.pack(">II", 6, 48) + struct.pack(far, begins[0])
        h += name("time") + struct.pack(">II", 1, 0) + struct.pack(">II", 12, 1) + attr("units", "days since 2000-01-01") + struct.pack(">II", 4, 4) + struct.pack(far, begins[1])
        return h + name("v") + struct.pack(">III", 2, 0, 1) + struct.pack(">II", 0, 0) + struct.pack(">II", 3, 12) + struct.pack(far, begins[2])

    n = len(head([0, 0, 0]))
    body = x.tobytes() + b"".join(struct.pack(">i", t) + (np.arange(6) + 10 * t).astype(">i2").tobytes() for t in records)
    path.write_bytes(head([n, n + 48, n + 52]) + body)


@pytest.mark.parametrize("version", [1, 2])
def test_netcdf3(spark, tmp_path, version):
    netcdf3(tmp_path / "a.nc", [0, 1, 2], version)
    ds = api.open_virtual_dataset(spark, str(tmp_path / "a.nc"), NetCDF3Parser())
    assert ds.attributes == {"title": "hello"} and ds.sizes == {"x": 6, "time": 3} and ds["x"].values.tolist() == list(range(6))
    assert ds["time"].values[2] == np.datetime64("2000-01-03") and read.read_array(ds["v"])[2].tolist() == [20, 21, 22, 23, 24, 25]
    assert ds.encoding["source"] == f"file://{tmp_path}/a.nc" and ds["v"].n_refs() == 3
    only = api.open_virtual_dataset(spark, str(tmp_path / "a.nc"), NetCDF3Parser(), drop_variables=["v"], loadable_variables=[])
    assert set(only.variables) == {"x", "time"} and not only.loaded
    with pytest.raises(ValueError, match="both drop and load"):
        api.open_virtual_dataset(spark, str(tmp_path / "a.nc"), NetCDF3Parser(), drop_variables=["v"], loadable_variables=["v"])
    with pytest.raises(ValueError):
        NetCDF3Parser().parse(f"file://{__file__}")


def test_mfdataset(spark, tmp_path):
    for k, records in enumerate(([4, 5], [0, 1], [2, 3])):
        netcdf3(tmp_path / f"f{k}.nc", records)
    want = np.array([np.arange(6) + 10 * t for t in range(6)])
    open_ = lambda *a, **k: api.open_virtual_mfdataset(spark, *a, **k)
    by = open_(str(tmp_path / "f*.nc"), NetCDF3Parser())
    assert (read.read_array(by["v"]) == want).all() and by.sizes["time"] == 6
    names = [str(tmp_path / f"f{k}.nc") for k in (1, 2, 0)]
    nested = open_(names, NetCDF3Parser(), combine="nested", concat_dim="time", preprocess=lambda d: d.rename_vars({"v": "w"}), attrs_file=names[1])
    assert (read.read_array(nested["w"]) == want).all()
    fast = api.concat_parsed(spark, NetCDF3Parser(), names, "time")
    assert (read.read_array(fast["v"]) == want).all() and fast["x"].shape == (6,)
    with pytest.raises(OSError):
        open_([], NetCDF3Parser())
    with pytest.raises(ValueError):
        open_(names, NetCDF3Parser(), concat_dim="time")


def test_pushdown(spark, tmp_path):
    netcdf3(tmp_path / "a.nc", [0, 1])
    rows = NetCDF3Parser(skip_variables=["x"]).rows(spark, [str(tmp_path / "a.nc")])
    assert {r["name"] for r in rows.collect()} == {"", "time", "v"} and rows.where("name = 'v'").count() == 3


def test_fits(spark, tmp_path):
    card = lambda k, v: f"{k:8}= {v:>20}".ljust(80)
    block = lambda s, fill=b" ": s.encode() + fill * (-len(s) % 2880) if isinstance(s, str) else s + b"\0" * (-len(s) % 2880)
    data = np.arange(6, dtype=">i2").reshape(2, 3)
    table = np.array([(1, 2.5), (3, 4.5)], [("ID", ">i4"), ("T", ">f8")])
    raw = block("".join([card("SIMPLE", "T"), card("BITPIX", 16), card("NAXIS", 2), card("NAXIS1", 3), card("NAXIS2", 2), card("BSCALE", 2.0), "END".ljust(80)])) + block(data.tobytes())
    raw += block("".join([card("XTENSION", "'BINTABLE'"), card("BITPIX", 8), card("NAXIS", 2), card("NAXIS1", 12), card("NAXIS2", 2), card("PCOUNT", 0), card("GCOUNT", 1), card("TFIELDS", 2), card("TFORM1", "'J'"), card("TTYPE1", "'ID'"), card("TFORM2", "'1D'"), card("TTYPE2", "'T'"), card("EXTNAME", "'TAB'"), "END".ljust(80)])) + block(table.tobytes())
    (tmp_path / "a.fits").write_bytes(raw)
    g = FITSParser()(spark, str(tmp_path / "a.fits"))
    assert read.read_array(g["PRIMARY"]).tolist() == data.tolist() and g["PRIMARY"].meta.attributes["scale_factor"] == 2.0
    assert read.read_array(g["TAB"])["T"].tolist() == [2.5, 4.5]


DMR = """<Dataset xmlns="http://xml.opendap.org/ns/DAP/4.0#" xmlns:dmrpp="http://xml.opendap.org/dap/dmrpp/1.0.0#" name="t">
<Dimension name="y" size="4"/>{extra}
<Float32 name="v"><Dim name="/y"/><Dim size="2"/><Attribute name="k" type="Int32"><Value value="3"/></Attribute>
<dmrpp:chunks compressionType="shuffle deflate" fillValue="-1" byteOrder="LE"><dmrpp:chunkDimensionSizes>2 2</dmrpp:chunkDimensionSizes>
<dmrpp:chunk offset="10" nBytes="5" chunkPositionInArray="[0,0]"/><dmrpp:chunk offset="15" nBytes="6" chunkPositionInArray="[2,0]"/></dmrpp:chunks></Float32>
<Int16 name="bad"><Dim name="/nope"/></Int16></Dataset>"""


def test_dmrpp(spark, tmp_path):
    extra = '<Attribute name="c" type="Container"/><Group name="g"><Dimension name="z" size="1"/><Int32 name="w"><Dim name="/g/z"/><dmrpp:chunks><dmrpp:chunk offset="1" nBytes="4"/></dmrpp:chunks></Int32></Group>'
    (tmp_path / "a.nc.dmrpp").write_text(DMR.format(extra=extra))
    with pytest.warns(UserWarning, match="could not be parsed"):
        DMRPPParser().parse(f"file://{tmp_path}/a.nc.dmrpp")
    g = DMRPPParser()(spark, str(tmp_path / "a.nc.dmrpp"))
    v = g["v"]
    assert v.dict() == {"0.0": {"path": f"file://{tmp_path}/a.nc", "offset": 10, "length": 5}, "1.0": {"path": f"file://{tmp_path}/a.nc", "offset": 15, "length": 6}}
    assert v.meta.dims == ("y", "phony_dim_1") and v.meta.fill_value == -1 and [c["name"] for c in v.meta.codecs] == ["bytes", "numcodecs.shuffle", "numcodecs.zlib"] and v.meta.attributes == {"k": 3}
    assert g["g"]["w"].dict()["0"]["offset"] == 1 and set(DMRPPParser(group="g")(spark, str(tmp_path / "a.nc.dmrpp"))) == {"w"}
    tree = api.open_virtual_datatree(spark, str(tmp_path / "a.nc.dmrpp"), DMRPPParser(), drop_variables=["v"])
    assert set(tree) == {"/", "/g"} and set(tree["g"].variables) == {"w"}
    with pytest.raises(NotImplementedError):
        api.open_virtual_datatree(spark, "/x", DMRPPParser(), loadable_variables=["v"])


def test_hdf_rules():
    assert hdf.chunk_shape((5, 4), (10, 4), False) == (5, 4) and hdf.chunk_shape((5, 4), (10, 4), True) == (10, 4) and hdf.chunk_shape((0, 4), None, False) == (1, 4) and hdf.chunk_shape((5, 4), (10, 8), False) == (10, 8)
    assert [c["name"] for c in hdf.filter_codecs({"shuffle": (), "gzip": 4}, 4)] == ["numcodecs.shuffle", "numcodecs.zlib"]
    assert hdf.dimension_names("v", 2, [["/x"]], False) == ("x", "phony_dim_1") and hdf.dimension_names("t", 1, [[]], True) == ("t",)
    with pytest.raises(ValueError):
        hdf.dimension_names("v", 1, [["/x", "/y"]], False)
    assert hdf.scale_codec({}) is None and hdf.visible_attributes({"CLASS": b"x", "a": np.int32(3)}) == {"a": 3}
    with pytest.raises((ImportError, OSError)):
        hdf.HDFParser().parse("file:///nope.h5")


# datasets


def piece(spark, t0, n=2, x=(0, 1, 2), first=0, attrs=None, chunk=1):
    m = ArrayMeta((n, len(x)), (chunk, 1), "<f4", "NaN", dims=("time", "x"))
    e = {f"{i}.{j}": {"path": f"/f{t0}.nc", "offset": first + 4 * (i * len(x) + j), "length": 4} for i in range(m.grid[0]) for j in range(len(x))}
    return VDataset({"v": VArray.from_dict(spark, m, e), "time": Loaded(("time",), np.arange(t0, t0 + n)), "x": Loaded(("x",), np.array(x))}, attributes=attrs or {"a": 1})


def test_combine(spark):
    a, b = piece(spark, 0), piece(spark, 2)
    by = D.combine_by_coords([b, a])
    assert by["time"].values.tolist() == [0, 1, 2, 3] and by["v"].shape == (4, 3) and by["v"].dict()["2.0"]["path"] == "file:///f2.nc"
    assert D.combine_nested([[a], [b]], ["time", "x"]).equals(by)
    grid = [[piece(spark, t, x=x) for x in ((0, 1), (2, 3))] for t in (0, 2)]
    flat = [d for r in grid for d in r]
    assert D.combine_by_coords(flat[::-1]).equals(D.combine_nested(grid, ["time", "x"]))
    down = [VDataset({**p.variables, "time": Loaded(("time",), p["time"].values[::-1])}) for p in (a, b)]
    assert D.combine_by_coords(down)["time"].values.tolist() == [3, 2, 1, 0]
    with pytest.raises(ValueError):
        D.combine_by_coords([a, piece(spark, 1)])
    with pytest.raises(ValueError):
        D.combine_by_coords([a, a])
    new = D.concat([a, piece(spark, 0, first=100)], "run")
    assert new["v"].shape == (2, 2, 3) and new["v"].meta.dims == ("run", "time", "x") and new["time"].dims == ("time",)
    merged = D.merge([a, VDataset({"w": a["v"]})])
    assert set(merged.variables) == {"v", "w", "time", "x"}
    with pytest.raises(ValueError, match="conflicting values"), pytest.warns(UserWarning):
        D.merge([a, piece(spark, 0, first=9)])
    assert D.merge([a, piece(spark, 0, first=9)], compat="override")["v"] is a["v"]


def test_attributes():
    c = D.combine_attributes
    x, y = {"a": 1, "b": 2}, {"a": 1, "b": 3, "c": 4}
    assert c([x, y]) == x and c([x, y], "drop") == {} and c([x, y], "drop_conflicts") == {"a": 1, "c": 4}
    for how in ("identical", "no_conflicts", "odd"):
        with pytest.raises(ValueError):
            c([x, y], how)


def test_align(spark):
    a, b = piece(spark, 0, x=(0, 1)), piece(spark, 0, x=(1, 2))
    x, y = D.align_datasets(a, b)
    assert x["x"].values.tolist() == [0, 1, 2] and set(x["v"].dict()) == {"0.0", "0.1", "1.0", "1.1"} and set(y["v"].dict()) == {"0.1", "0.2", "1.1", "1.2"}
    assert D.align_datasets(a, b, join="inner")[0]["v"].shape == (2, 1)
    with pytest.raises(ValueError):
        D.align_datasets(a, b, join="exact")
    r = a.reindex(time=[0, 5, 1], x=[1, 9])
    assert r["v"].shape == (3, 2) and set(r["v"].dict()) == {"0.0", "2.0"}
    out = D.concat([a, piece(spark, 2, x=(1, 2))], "time")
    assert out["v"].shape == (4, 3) and "0.2" not in out["v"].dict()


def test_select_and_rename(spark):
    a = piece(spark, 10, 4)
    assert set(a.isel(time=slice(1, 3))["v"].dict()) == {f"{i}.{j}" for i in range(2) for j in range(3)} and a.isel(time=1)["v"].shape == (3,)
    assert a.sel(time=12)["v"].dict()["0"]["offset"] == 24 and a.sel(time=12.4, method="nearest").variables["time"].values == 12 and a.sel(time=slice(11, 12)).sizes["time"] == 2
    with pytest.raises(KeyError):
        a.sel(time=99)
    with pytest.raises(ValueError):
        a.isel(nope=0)
    r = a.rename({"v": "w", "time": "t"})
    assert r["w"].meta.dims == ("t", "x") and "t" in r and r.sizes["t"] == 4
    assert a.drop_vars("v").variables.keys() == {"time", "x"} and a.copy().equals(a) and not a.equals(r)
    with pytest.raises(ValueError):
        a.drop_vars("nope")
    e = a.isel(time=0).assign_coords(time=((), 5)).expand_dims("time")
    assert e["v"].shape == (1, 3) and e["time"].values.tolist() == [5]
    assert a.rename_paths("/z.nc")["v"].dict()["0.0"]["path"] == "file:///z.nc"
    assert a.n_refs() == 12 == a.n_refs_dense() and a.nbytes_virtual == 12 * 32 + 4 * 8 + 3 * 8
    assert a.validate({"v": {"dims": ("time", "x"), "dtype": "f4"}, "time": {"values": lambda t: (np.diff(t) > 0).all()}}) == []
    assert len(a.validate({"v": {"dims": ("x",), "virtual": False, "attributes": {"u": 1}}, "q": {}})) == 4
    full = D.fill_absent(a, {"u": ArrayMeta((4, 3), (1, 1), "<f4", "NaN", dims=("time", "x"))}, spark)
    assert np.isnan(read.read_array(full["u"])).all()
    assert api.calibration_eras({"f": a, "g": a}, "v", ["scale_factor"]) == {(None,): ["f", "g"]}


def test_groups(spark):
    a = piece(spark, 0)["v"]
    g = VGroup({"v": a}, {"sub": VGroup({"w": a})}, {"coordinates": "v", "t": 1})
    assert g.to_dataset().coords == {"v"} and set(g.to_tree()) == {"/", "/sub"} and g.nbytes_virtual() == 2 * 6 * 32
    for bad in (lambda: VGroup({"x": a}, {"x": VGroup()}), lambda: g["sub/w"], lambda: g.group("nope")):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(TypeError):
        VGroup({"x": 3})


# store


def test_store_modes():
    assert resolve_mode(None, None, None) == "w-" and resolve_mode(None, "t", None) == "r+" and resolve_mode("a", "t", None) == "a"
    with pytest.raises(ValueError, match="cannot be used together"):
        resolve_mode("w", "t", None)
    with pytest.raises(ValueError):
        resolve_mode("x", None, None)
    with pytest.raises(TypeError):
        resolve_mode(3, None, None)


def test_store(spark, ds, tmp_path):
    s = Store(spark, str(tmp_path / "st"), ["s3://b/"])
    first = s.write(ds, message="one")
    assert s.open_dataset().equals(ds) and s.open_dataset()["lon"].values.tolist() == [1, 2, 3] and "lon" in s.open_dataset().coords
    with pytest.raises(ValueError, match="exists"):
        s.write(ds)
    s.write(ds, group="deep/er")
    assert s.open(group="deep/er").to_dataset().equals(ds) and set(s.open()) == {"air", "time", "lon", "deep"}
    s.tag("v1", first)
    assert "deep" not in s.open(tag="v1") and "deep" not in s.open(snapshot_id=first) and "air" not in s.open(skip_variables=["air"])
    for bad in ({"tag": "v1", "branch": "main"}, {"tag": "no"}, {"branch": "no"}, {"snapshot_id": "no"}):
        with pytest.raises(ValueError):
            s.open(**bad)
    s.create_branch("dev").write(ds, mode="w")
    assert "deep" in s.open() and "deep" not in s.open(branch="dev") and [c["message"] for c in s.commits()][0] == "one"
    with pytest.raises(ValueError, match="No Virtual Chunk Container set which supports prefix"):
        Store(spark, str(tmp_path / "x"), ["s3://c/"]).write(ds)
    with pytest.raises(ValueError, match="No Virtual Chunk Containers set"):
        Store(spark, str(tmp_path / "x")).write(ds)
    with pytest.raises(ValueError, match="read-only"):
        Store(spark, str(tmp_path / "st"), read_only=True).write(ds)
    with pytest.raises(ConflictError):
        s._commit({"id": first}, {}, "", {})
    with pytest.warns(UserWarning, match="no virtual"):
        s.write(VDataset({"q": Loaded(("y",), np.arange(2))}), group="plain")


def test_get_all(spark, tmp_path):
    """Of many keys at once what get gives one by one: chunks in files and inlined, documents, and null for chunks that aren't there."""
    (tmp_path / "f").write_bytes(b"xx\1\2\3\4yy")
    v = VArray.from_dict(spark, ArrayMeta((12, 2), (4, 2), "u1"), {"0.0": {"path": str(tmp_path / "f"), "offset": 2, "length": 4}, "2.0": {"path": "", "offset": 0, "length": 3, "data": b"abc"}})
    scalar = VArray.from_dict(spark, ArrayMeta((), (), "u1"), {"0": {"path": str(tmp_path / "f"), "offset": 0, "length": 1}})
    g = VGroup({"v": v, "scalar": scalar}, {"sub": VGroup({"v": v})})
    for prefix, names in (("v", ["c.0.0", "c/0/0", "c.2.0", "c.1.0", "c.9.9", "0.0", "c", "zarr.json", ".zarray", "c.2.0"]), ("scalar", ["c", "zarr.json"]), ("sub/v", ["c.0.0"])):
        wanted = spark.createDataFrame([(n,) for n in names], "key string")
        for part in ({}, {"start": 1, "end": 3}, {"suffix": 2}):
            got = [(r["key"], r["bytes"] and bytes(r["bytes"])) for r in read.get_all(g, prefix, wanted, **part).collect()]
            assert sorted(got, key=str) == sorted(((n, read.get(g, f"{prefix}/{n}", **part)) for n in names), key=str)
    assert read.get_all(g, "v", g.listing("v")).where("bytes is not null").count() == 3
    with pytest.raises(Exception, match="Invalid chunk key foo"):
        read.get_all(g, "v", spark.createDataFrame([("foo",)], "key string")).collect()
    for prefix in ("", "sub", "v/c.0.0", "nope"):
        with pytest.raises(ValueError, match="is no array"):
            read.get_all(g, prefix, g.listing("v"))


def test_store_keys_in_one_job(spark, to_driver):
    from chunkweave.plans.catalogue import QUERIES

    out = QUERIES["store_keys"](spark, "/root/testdata/sf0.001")
    assert sum(to_driver) <= 2 and {r["n"] for r in out.collect()} == {3200}


def test_get_and_store_parser(spark, tmp_path):
    from chunkweave.meta import encode_cf_fill_value
    from chunkweave.sources import StoreParser

    (tmp_path / "f").write_bytes(b"xx\1\2\3\4yy")
    v = VArray.from_dict(spark, ArrayMeta((8,), (4,), "u1", dims=("x",)), {"0": {"path": str(tmp_path / "f"), "offset": 2, "length": 4}})
    s = Store(spark, str(tmp_path / "st"), ["file:///"])
    s.write(VDataset({"v": v}, attributes={"k": 1}))
    g = StoreParser(branch="main")(spark, str(tmp_path / "st"))
    assert read.get(g, "v/c.0") == b"\1\2\3\4" and read.get(g, "v/c/0", suffix=1) == b"\4" and read.get(g, "v/c.1") is None
    assert json.loads(read.get(g, "v/zarr.json"))["shape"] == [8] and json.loads(read.get(g, "zarr.json"))["attributes"] == {"k": 1}
    assert read.get(g, "v/.zarray") is None and read.get(g, "nope") is None
    with pytest.raises(ValueError):
        read.get(g, "")
    with pytest.raises(ValueError):
        StoreParser(branch="a", tag="b")
    with pytest.raises(ValueError, match="Invalid value for `parallel`"):
        api.open_virtual_mfdataset(spark, ["/x"], NetCDF3Parser(), parallel="dask")
    assert encode_cf_fill_value(1.0, "f4") == "AAAAAAAA8D8=" and encode_cf_fill_value(np.int16(-9), "i2") == -9 and read._cf_fill("AAAAAAAA8D8=", np.dtype("f4")) == 1.0


def test_append_and_region(spark, tmp_path):
    s = Store(spark, str(tmp_path / "st"), ["file:///"])
    a, b = piece(spark, 0), piece(spark, 2, first=100)
    s.write(a)
    s.write(b, append_dim="time")
    got = s.open_dataset()
    assert got["v"].shape == (4, 3) and got["time"].values.tolist() == [0, 1, 2, 3]
    assert (got["v"] == combine.concatenate([a["v"], b["v"]], 0)).all()
    new = piece(spark, 1, first=1000)
    s.write(new, region="auto")
    got = s.open_dataset()["v"].dict()
    assert {k: got[k]["offset"] for k in ("0.0", "1.0", "2.0", "3.0")} == {"0.0": 0, "1.0": 1000, "2.0": 1012, "3.0": 112} and len(got) == 12
    s.write(new.drop_vars("time"), region={"time": slice(2, 4)})
    assert s.open_dataset()["v"].dict()["3.0"]["offset"] == 1012
    assert s.open_dataset()["v"][1:3, :].dict()["0.0"]["offset"] == 1000
    with pytest.raises(ValueError, match="does not match any existing dataset dimensions"):
        s.write(b, append_dim="nope")
    for bad in (piece(spark, 4, chunk=2), piece(spark, 4, x=(0, 1))):
        with pytest.raises(ValueError):
            s.write(bad, append_dim="time")
    with pytest.raises(ValueError):
        s.write(piece(spark, 90), region="auto")
    two = Store(spark, str(tmp_path / "two"), ["file:///"])
    two.write(piece(spark, 0, 4, chunk=2))
    with pytest.raises(ValueError, match="is not aligned to whole chunks"):
        two.write(piece(spark, 1, chunk=2), region={"time": slice(1, 3)})
    assert len(two.open_dataset()["v"].dict()) == 6


def test_stale(spark, tmp_path):
    f = tmp_path / "f.nc"
    f.write_bytes(b"x" * 10)
    v = VArray.from_dict(spark, ArrayMeta((1,), (1,), "u1", dims=("x",)), {"0": {"path": str(f), "offset": 0, "length": 1}})
    s = Store(spark, str(tmp_path / "st"), ["file:///"])
    s.write(VDataset({"v": v}), last_updated_at=datetime.datetime(2000, 1, 1))
    assert [r["path"] for r in s.stale_refs().collect()] == [f"file://{f}"]
    s.write(VDataset({"v": v}), mode="w")
    assert s.stale_refs().count() == 0


def test_tree_store(spark, tmp_path):
    a = piece(spark, 0)
    from chunkweave.dataset import VTree

    s = Store(spark, str(tmp_path / "st"), ["file:///"])
    s.write_tree(VTree({"/": a, "/g": VDataset({"w": a["v"]})}), write_inherited_coords=True)
    assert len(s.log()) == 1 and s.open()["g"].to_dataset()["time"].values.tolist() == [0, 1]


def test_streaming(spark, tmp_path):
    (tmp_path / "in").mkdir()
    s = Store(spark, str(tmp_path / "st"), ["file:///"])
    open_ = lambda u: api.open_virtual_dataset(spark, u, NetCDF3Parser(), decode_times=False).drop_vars("x")
    for batch in ([0, 1], [2]):
        netcdf3(tmp_path / f"in/{batch[0]}.nc", batch)
        ingest(spark, str(tmp_path / "in"), "*.nc", open_, s, "time", str(tmp_path / "cp")).awaitTermination()
    ds = s.open_dataset()
    assert ds["time"].values.tolist() == [0, 1, 2] and read.read_array(ds["v"])[2][0] == 20 and len(s.log()) == 2
    netcdf3(tmp_path / "late.nc", [1])
    assert append_batch(s, [open_(str(tmp_path / "late.nc"))], "time", "ingest", 1) is None  # written before
    with pytest.raises(ValueError, match="late labels"):
        append_batch(s, [open_(str(tmp_path / "late.nc"))], "time", "ingest", 7)
    planned = spark.createDataFrame([(0, "a"), (5, "b")], "batch bigint, what string")
    assert [r["what"] for r in pending(s, planned, "ingest").collect()] == ["b"]


# relations of arrays


def test_relational_checks(spark):
    arrays = spark.createDataFrame([("v", [4], [2], "<f4", "c", ["v"], "1"), ("v", [5], [2], "<f8", "c", ["x"], "2"), ("w", [1], [2], "<f4", "c", ["w"], "1")], "name string, shape array<bigint>, chunks array<bigint>, dtype string, codec_fp string, dims array<string>, fp string")
    assert [(r["name"], r["n_dtypes"]) for r in checks.incompatible(arrays).collect()] == [("v", 2)]
    assert checks.partial_arrays(arrays, 0).count() == 2 and checks.oversize_arrays(arrays).count() == 1 and checks.default_loadable(arrays).count() == 2 and checks.name_conflicts(arrays).count() == 1
    with pytest.raises(ValueError, match="different values for encoding key"):
        checks.same_encoding({"a": 1}, {"a": 2})


# checksums, names, rewriting


def test_checksums():
    def slow_crc(data):
        crc = 0xFFFFFFFF
        for b in data:
            crc ^= b
            for _ in range(8):
                crc = (crc >> 1) ^ (0x82F63B78 & -(crc & 1))
        return crc ^ 0xFFFFFFFF

    def slow_fletcher(data):
        a = b = 0
        for k in range(0, len(data), 2):
            a += data[k] << 8 | (data[k + 1] if k + 1 < len(data) else 0)
            a = (a & 0xFFFF) + (a >> 16)
            b += a
            b = (b & 0xFFFF) + (b >> 16)
        return b << 16 | a

    rnd = np.random.default_rng(3)
    for n in (0, 1, 3, 4, 5, 63, 64, 65, 1000, 4097):
        data = rnd.integers(0, 256, n, dtype=np.uint8).tobytes()
        assert read._crc32c(data) == slow_crc(data) and read._fletcher32(data) == slow_fletcher(data)
    assert read._crc32c(b"123456789") == 0xE3069283 and read._fletcher32(b"\xff\xff" * 4) == 0xFFFFFFFF == slow_fletcher(b"\xff\xff" * 4)
    body = b"some bytes!"
    assert read._unpack(body + struct.pack("<I", slow_fletcher(body)), {"name": "numcodecs.fletcher32"}) == body
    with pytest.raises(ValueError, match="fletcher32"):
        read._unpack(body + b"\0\0\0\0", {"name": "numcodecs.fletcher32"})


@pytest.mark.parametrize("group", ["a(1", "a.b", r"q\\Ex", "plain"])
def test_group_names_are_taken_literally(spark, group):
    doc = document({"0.0": ["s3://b/f", 1, 2]}, prefix=f"{group}/")
    assert KerchunkJSONParser(group=group)(spark, doc)["a"].meta.dims == ("x", "y")


def test_kerchunk_parquet_rewrite(spark, tmp_path):
    """A sparser dataset in the place of an older one: neither its references nor its variables stay."""
    m = ArrayMeta((4,), (1,), "<i4", dims=("x",))
    entry = lambda k: {"path": f"s3://b/f{k}", "offset": k, "length": 4}
    full = VArray.from_dict(spark, m, {str(k): entry(k) for k in range(4)})
    path = str(tmp_path / "refs.parq")
    VDataset({"v": full, "old": full}).to_kerchunk(path, format="parquet", record_size=2)
    VDataset({"v": VArray.from_dict(spark, m, {"0": entry(9)})}).to_kerchunk(path, format="parquet", record_size=2)
    g = KerchunkParquetParser()(spark, path)
    assert set(g) == {"v"} and {k: e["path"] for k, e in g["v"].dict().items()} == {"0": "s3://b/f9"}
    assert sorted(p.name for p in (tmp_path / "refs.parq/v").glob("*.parq")) == ["refs.0.parq", "refs.1.parq"] and [p.name for p in tmp_path.iterdir()] == ["refs.parq"]
    (tmp_path / "mine").mkdir()
    (tmp_path / "mine/data").write_text("x")
    with pytest.raises(FileExistsError):
        VDataset({"v": full}).to_kerchunk(str(tmp_path / "mine"), format="parquet")


def test_parsers_without_pushdown(spark, tmp_path):
    """A session as Spark sets it up by itself opens files too."""
    netcdf3(tmp_path / "a.nc", [0, 1])
    name = "spark.sql.python.filterPushdown.enabled"
    spark.conf.set(name, "false")
    try:
        assert api.open_virtual_dataset(spark, str(tmp_path / "a.nc"), NetCDF3Parser())["v"].n_refs() == 2
    finally:
        spark.conf.set(name, "true")
