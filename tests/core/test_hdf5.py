"""HDF5 files by their format: every layout and chunk index, groups, attributes, types; files from the builder."""

import numpy as np
import pytest

from chunkweave import api, read
from chunkweave.plans.hdf5_files import Array, Writer
from chunkweave.sources import HDFParser
from chunkweave.sources.hdf5 import File, FormatError

GRID = np.arange(23 * 9, dtype="<i4").reshape(23, 9)
STORAGES = ["tree", "fixed", "extensible", "tree2", "implicit"]


def parsed(tmp_path, data, **options):
    path = tmp_path / "f.h5"
    path.write_bytes(data)
    found = HDFParser(**options).parse(f"file://{path}")
    return found, {(a.group, a.name): (a, whole(a, data)) for a in found.arrays}


def whole(a, data):
    """The array put together from its chunks, without Spark."""
    m = a.meta
    out = np.full([g * c for g, c in zip(m.grid, m.chunks, strict=True)], m.fill_scalar(), m.dtype)
    for idx, path, offset, length, inlined in a.chunks:
        raw = inlined if path is None else data[offset : offset + length]
        out[tuple(slice(i * c, (i + 1) * c) for i, c in zip(idx, m.chunks, strict=True))] = read.decode(raw, m)
    return out[tuple(slice(0, s) for s in m.shape)]


@pytest.mark.parametrize("deflate", [False, True])
@pytest.mark.parametrize("storage", STORAGES)
def test_chunk_indexes(tmp_path, storage, deflate):
    if storage == "implicit" and deflate:
        pytest.skip("implicit indexes have no filters")
    limits = (None, 9) if storage == "extensible" else (None, None) if storage == "tree2" else None
    w = Writer(new=storage != "tree", leaf=128)
    data = w.file([Array("v", GRID, storage, (2, 4), limits, deflate)])
    _, got = parsed(tmp_path, data)
    a, values = got["", "v"]
    assert a.meta.chunks == (2, 4) and len(a.chunks) == 36
    np.testing.assert_array_equal(values, GRID)


@pytest.mark.parametrize("storage", ["tree", "fixed", "extensible", "tree2"])
def test_absent_chunks_and_fill(tmp_path, storage):
    limits = (None, 9) if storage == "extensible" else None
    absent = frozenset({(0, 0), (5, 2), (11, 1)})
    data = Writer(new=storage != "tree").file([Array("v", GRID, storage, (2, 4), limits, fill=-7, absent=absent)])
    a, values = parsed(tmp_path, data)[1]["", "v"]
    want = GRID.copy()
    for i, j in absent:
        want[2 * i : 2 * i + 2, 4 * j : 4 * j + 4] = -7
    assert a.meta.fill_value == -7 and len(a.chunks) == 33
    np.testing.assert_array_equal(values, want)


@pytest.mark.parametrize(("storage", "limits"), [("fixed", None), ("fixed", (6000,)), ("extensible", (None,))])
def test_pages(tmp_path, storage, limits):
    """More chunks than a page or a data block holds, some pages empty."""
    values = np.arange(5000, dtype="<u2")
    absent = frozenset((k,) for k in range(1000, 1400))
    data = Writer(page_bits=5).file([Array("v", values, storage, (1,), limits, fill=9, absent=absent)])
    got = parsed(tmp_path, data)[1]["", "v"][1]
    values[1000:1400] = 9
    np.testing.assert_array_equal(got, values)


def test_endless_axis_that_is_not_the_first(tmp_path):
    data = Writer().file([Array("v", GRID, "extensible", (2, 4), (23, None))])
    np.testing.assert_array_equal(parsed(tmp_path, data)[1]["", "v"][1], GRID)


def test_limits_count_for_numbers_of_chunks(tmp_path):
    data = Writer().file([Array("v", GRID, "fixed", (2, 4), (40, 30)), Array("w", GRID, "implicit", (2, 4))])
    got = parsed(tmp_path, data)[1]
    np.testing.assert_array_equal(got["", "v"][1], GRID)
    np.testing.assert_array_equal(got["", "w"][1], GRID)


@pytest.mark.parametrize("new", [False, True])
def test_whole_arrays(tmp_path, new):
    arrays = [
        Array("compact", np.array([[1.5, -2], [3, 4]])),
        Array("contiguous", GRID.astype(">i2")),
        Array("empty", np.zeros((0, 3), "<f4")),
        Array("flag", np.array([True, False, True])),
        Array("record", np.array([(1, 2.5), (3, 4.5)], [("a", "<i4"), ("b", "<f8")])) if new else Array("record", np.arange(3.0)),
        Array("scalar", np.array(0.1, "<f4")),
        Array("text", np.array([b"one", b"three"])),
    ]
    arrays[0].storage = "compact"
    if new:
        arrays += [Array("single", GRID, "single", (23, 9)), Array("single_packed", GRID, "single", (23, 9), deflate=True)]
    found, got = parsed(tmp_path, Writer(new).file(arrays))
    assert [a.name for a in found.arrays] == sorted(a.name for a in arrays)
    for a in arrays:
        np.testing.assert_array_equal(got["", a.name][1], a.values)
    assert got["", "empty"][0].chunks == [] and got["", "compact"][0].chunks[0][1] is None
    assert got["", "contiguous"][0].meta.codecs[0]["configuration"]["endian"] == "big"


@pytest.mark.parametrize(("new", "dense"), [(False, False), (True, False), (True, True)])
@pytest.mark.parametrize("front", [0, 512, 2048])
def test_groups_attributes_scales(tmp_path, new, dense, front):
    x, t = Array("x", np.arange(9.0), is_scale=True), Array("t", np.arange(23), is_scale=True)
    unnamed = Array("nav", np.zeros(4, "<f4"), is_scale=True, attributes={})
    v = Array("v", GRID, attributes={"units": "K", "_FillValue": np.int32(5), "range": np.array([1, 2]), "one": np.array([4.5]), "who": np.bytes_(b"me")}, scales=("t", "x"))
    own = [Array(f"a{k:03}", np.arange(k + 1)) for k in range(60)]
    data = Writer(new, dense, leaf=128, front=front).file([x, t, v, unnamed], {"g": own}, {"title": "a name é", "n": np.int64(3)}, {"same": "v", "gone": "nothing"})
    found, got = parsed(tmp_path, data)
    assert found.groups == {"": {"title": "a name é", "n": 3}, "g": {}}
    assert got["", "v"][0].meta.dims == ("t", "x") and got["", "x"][0].meta.dims == ("x",)
    assert got["", "v"][0].meta.attributes == {"units": "K", "range": [1, 2], "one": 4.5, "who": "me", "_FillValue": 5}
    assert {n for g, n in got if g == "g"} == {f"a{k:03}" for k in range(60)} and ("", "gone") not in got
    np.testing.assert_array_equal(got["g", "a059"][1], np.arange(60))
    np.testing.assert_array_equal(got["", "same"][1], GRID)


def test_leading_chunk_longer_than_its_array(tmp_path):
    data = Writer().file([Array("v", GRID, "tree2", (40, 9), (None, 9)), Array("w", GRID, "tree2", (40, 9), (None, 9), deflate=True)])
    got = parsed(tmp_path, data)[1]
    assert got["", "v"][0].meta.chunks == (23, 9) and got["", "v"][0].chunks[0][3] == 23 * 9 * 4
    assert got["", "w"][0].meta.chunks == (40, 9)
    for n in "vw":
        np.testing.assert_array_equal(got["", n][1], GRID)


def test_left_out(tmp_path):
    hidden = Array("dim", np.zeros(3, "<f4"), attributes={"NAME": np.bytes_(b"This is a netCDF dimension but not a netCDF variable.         3")})
    data = Writer().file([Array("v", GRID), hidden], {"g": [Array("w", GRID)]})
    assert set(parsed(tmp_path, data)[1]) == {("", "v"), ("g", "w")}
    assert set(parsed(tmp_path, data, drop_variables=["v"])[1]) == {("g", "w")}


def test_refused(tmp_path):
    class Source:
        def __init__(self, data):
            self.data = data

        def size(self):
            return len(self.data)

        def read_at(self, n, offset):
            return self.data[offset : offset + n]

    for data in (b"", b"x" * 5000, b"\x89HDF\r\n\x1a\n"):
        with pytest.raises(FormatError):
            File(Source(data))
    whole_file = Writer().file([Array("v", GRID)])
    with pytest.raises(FormatError):
        list(File(Source(whole_file[: len(whole_file) // 2])).walk())
    with pytest.raises(OSError):
        HDFParser().parse("file:///nope.h5")


def test_through_spark(spark, tmp_path):
    for k in range(3):
        t = Array("t", np.arange(4 * k, 4 * k + 4), is_scale=True)
        v = Array("v", np.arange(20.0).reshape(4, 5) + 20 * k, "tree2", (2, 5), (None, 5), deflate=True, scales=("t", ""))
        (tmp_path / f"f{k}.nc").write_bytes(Writer().file([t, v], {"g": [Array("w", GRID)]}))
    ds = api.open_virtual_mfdataset(spark, str(tmp_path / "f*.nc"), HDFParser())
    assert ds["v"].shape == (12, 5) and list(ds["t"].values) == list(range(12))
    got = read.read_elements(ds["v"]).orderBy("i0", "i1").toPandas()
    np.testing.assert_array_equal(got["value"], np.arange(60.0))
    inner = api.open_virtual_dataset(spark, str(tmp_path / "f0.nc"), HDFParser(group="g"), loadable_variables=["w"])
    np.testing.assert_array_equal(inner["w"].values, GRID)


def test_lzf():
    unpack = lambda data: read._unpack(data, {"name": "numcodecs.imagecodecs_lzf"})
    assert unpack(b"") == b"" and unpack(b"\x02abc") == b"abc"
    assert unpack(b"\x02abc\x20\x02") == b"abcabc"  # three bytes from three back
    assert unpack(b"\x00a\xe0\x0a\x00") == b"a" * 20  # a copy that runs into itself
    with pytest.raises(ValueError):
        unpack(b"\x00a\x20\x05")


def packed(values, kind, shuffle, split, block):
    """A blosc container by its rules, written here."""
    import struct
    import zlib

    import pyarrow as pa
    import zstandard

    press = {1: lambda b: pa.Codec("lz4_raw").compress(b).to_pybytes(), 2: lambda b: pa.Codec("snappy").compress(b).to_pybytes(), 3: zlib.compress, 4: zstandard.ZstdCompressor().compress}[kind]
    raw, size = values.tobytes(), values.itemsize
    starts, body = [], b""
    blocks = [raw[k : k + block] for k in range(0, len(raw), block)]
    for b in blocks:
        a = np.frombuffer(b, np.uint8).reshape(-1, size)
        if shuffle == 1:
            b = a.T.tobytes()
        elif shuffle == 4:
            b = np.packbits(np.unpackbits(a, axis=1, bitorder="little").T, axis=1, bitorder="little").tobytes()
        starts.append(16 + 4 * len(blocks) + len(body))
        streams = [b[k : k + len(b) // size] for k in range(0, len(b), len(b) // size)] if split and len(b) == block else [b]
        for s in streams:
            p = press(s)
            p = s if len(p) >= len(s) else p
            body += struct.pack("<i", len(p)) + p
    head = bytes([2, 1, shuffle | kind << 5 | (0 if split else 16), size]) + struct.pack("<iii", len(raw), block, 0)
    return head + b"".join(struct.pack("<i", s) for s in starts) + body


@pytest.mark.parametrize("kind", [1, 2, 3, 4])
@pytest.mark.parametrize("shuffle", [0, 1, 4])
@pytest.mark.parametrize("split", [False, True])
def test_blosc(kind, shuffle, split):
    values = (np.arange(5000, dtype="<i4") ** 2)[: 4096 + 800]
    unpack = lambda data: read._unpack(data, {"name": "numcodecs.blosc"})
    assert unpack(packed(values, kind, shuffle, split, 4096)) == values.tobytes()


def test_blosc_stored_and_refused():
    raw = bytes(range(100))
    head = lambda flags: bytes([2, 1, flags, 1]) + len(raw).to_bytes(4, "little") + (100).to_bytes(4, "little") + bytes(4)
    assert read._unpack(head(2) + raw, {"name": "numcodecs.blosc"}) == raw
    for wrong in (b"", raw[:10], bytes(40)):
        with pytest.raises(ValueError):
            read._unpack(wrong, {"name": "numcodecs.blosc"})
    with pytest.raises(NotImplementedError):
        read._unpack(head(16) + (20).to_bytes(4, "little") + (5).to_bytes(4, "little") + raw[:5], {"name": "numcodecs.blosc"})


def test_lz4_blocks():
    import struct

    import pyarrow as pa

    raw = b"abcd" * 100 + bytes(range(50))
    body = b""
    for k in range(0, len(raw), 128):
        p = pa.Codec("lz4_raw").compress(raw[k : k + 128]).to_pybytes()
        p = raw[k : k + 128] if len(p) >= len(raw[k : k + 128]) else p
        body += struct.pack(">i", len(p)) + p
    assert read._unpack(struct.pack(">qi", len(raw), 128) + body, {"name": "numcodecs.imagecodecs_lz4h5"}) == raw
