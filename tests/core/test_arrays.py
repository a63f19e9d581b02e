"""Grid operators against golden cases, and against dense numpy arrays."""

import warnings

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chunkweave.errors import SubChunkIndexingError
from chunkweave.functions import keys
from chunkweave.meta import ArrayMeta, codec_from_v2, codec_kind, codec_to_v2, endianness, realign_shards
from chunkweave.operators import align, combine, compare, metrics
from chunkweave.varray import VArray

from .conftest import offsets

ENTRY = {"path": "s3://b/a.nc", "offset": 1, "length": 2}


# references


def test_from_dict_checks(spark):
    m = ArrayMeta((4,), (2,), "<i4")
    build = lambda e: VArray.from_dict(spark, m, e)
    with pytest.raises(ValueError, match="Invalid format for chunk key"):
        build({"0.": ENTRY})
    with pytest.raises(ValueError, match="Inconsistent number of dimensions"):
        build({"0": ENTRY, "0.1": ENTRY})
    with pytest.raises(ValueError, match="must be a dict with keys"):
        build({"0": {"path": "s3://b/a"}})
    with pytest.raises(ValueError, match="must not be negative"):
        build({"0": ENTRY | {"offset": -1}})
    with pytest.raises(TypeError):
        build({"0": ENTRY | {"length": 1.5}})
    with pytest.raises(ValueError, match="must be absolute posix paths or URIs"):
        build({"0": ENTRY | {"path": "a.nc"}})
    with pytest.raises(ValueError, match="fs_root must be an absolute"):
        VArray.from_dict(spark, m, {"0": ENTRY | {"path": "a.nc"}}, fs_root="dir/")
    a = VArray.from_dict(spark, m, {"0": ENTRY | {"path": "../file.nc"}, "1": ENTRY | {"path": ""}}, fs_root="file:///tom/home/")
    assert a.dict() == {"0": {"path": "file:///tom/file.nc", "offset": 1, "length": 2}}
    assert a.lookup("0")["length"] == 2 and a.lookup((1,)) is None


def test_rename(spark):
    a = VArray.from_dict(spark, ArrayMeta((4,), (2,), "<i4"), {"0": ENTRY, "1": {"path": "", "offset": 0, "length": 3, "data": b"abc"}})
    assert a.rename_paths("/moved.nc").dict()["0"]["path"] == "file:///moved.nc"
    assert a.rename_paths(lambda p: p.replace("b/", "c/")).dict()["0"]["path"] == "s3://c/a.nc"
    assert a.rename_paths(F.concat("path", F.lit("x"))).dict()["0"]["path"] == "s3://b/a.ncx"
    assert a.rename_paths(lambda p: "https://mirror/" + p.rpartition("/")[2]).dict()["0"]["path"] == "https://mirror/a.nc"
    assert a.rename_paths("/moved.nc").dict()["1"] == {"path": "", "offset": 0, "length": 3, "data": b"abc"}
    with pytest.raises(TypeError):
        a.rename_paths(3)


def test_metrics(make):
    a = make((4, 4), (2, 2), present={"0.0", "1.1"})
    assert (a.n_refs_dense(), a.n_refs(), a.nbytes_virtual(), a.nbytes, a.size) == (4, 2, 128, 64, 16)
    assert metrics.grid_from_keys(a.refs, 2) == (2, 2) and metrics.missing_ratio(a.refs, 4) == 0.5
    for shape in ((0,), (0, 0), (2, 0), (0, 2)):
        assert make(shape, (1,) * len(shape)).dict() == {}


@pytest.mark.parametrize("key,sep,want", [("foo/bar/c/1/23/45", "/", (1, 23, 45)), ("c1.2/abc/c", ".", ()), ("c/c/c.1.23.45", ".", (1, 23, 45)), ("foo/1.2", ".", (1, 2)), ("c/0", "/", (0,)), ("c", "/", ())])
def test_store_keys(spark, key, sep, want):
    assert keys.parse_store_key(key, sep) == want
    assert tuple(spark.createDataFrame([(key,)], "k string").select(keys.store_key_index(F.col("k"), sep).alias("i")).first()["i"]) == want
    with pytest.raises(ValueError):
        keys.parse_store_key("foo/bar", sep)


def test_normalise(spark):
    given = ["/local/foo.nc", "s3://b/x y", "", "../file.nc", "a/./b//c.nc"]
    got = [r["u"] for r in spark.createDataFrame([(p,) for p in given], "p string").select(keys.normalise_uri(F.col("p"), "/tom/home").alias("u")).collect()]
    assert got == [keys.uri(p, "/tom/home") for p in given] == ["file:///local/foo.nc", "s3://b/x y", "", "file:///tom/file.nc", "file:///tom/home/a/b/c.nc"]
    for root, want in (("s3://b/", "s3://b/test1.nc"), ("s3://b", "s3://b/test1.nc"), ("s3://", "s3://test1.nc")):
        assert keys.uri("test1.nc", root) == want


# selection


@pytest.mark.parametrize("shape,chunks,key,new_shape,new_chunks", [((8,), (2,), slice(2, 6), (4,), (2,)), ((5,), (2,), slice(2, 5), (3,), (2,)), ((4, 4), (1, 2), (2, slice(0, 4)), (4,), (2,)), ((8,), (2,), slice(None), (8,), (2,)), ((8,), (2,), ..., (8,), (2,)), ((8,), (2,), slice(4, 2), (0,), (2,)), ((6, 6), (2, 3), (..., slice(3, 6)), (6, 3), (2, 3)), ((4,), (1,), -1, (), ())])
def test_slices(make, shape, chunks, key, new_shape, new_chunks):
    got = make(shape, chunks)[key]
    assert (got.shape, got.chunks) == (new_shape, new_chunks)


@pytest.mark.parametrize("key", [0, slice(1, 3), slice(0, 3), slice(0, 4, 2), slice(None, None, -1), slice(1, None)])
def test_misaligned(make, key):
    with pytest.raises(SubChunkIndexingError, match="slice would split individual chunks"):
        make((4,), (2,), codecs=({"name": "numcodecs.zlib", "configuration": {"level": 1}},))[key]


def test_index_errors(make):
    a = make((4, 4), (1, 1))
    with pytest.raises(TypeError, match="indexer must be of type"):
        a["x"]
    with pytest.raises(ValueError, match="multiple Ellipses"):
        a[..., ...]
    with pytest.raises(ValueError, match="Invalid indexer for array"):
        a[0]
    with pytest.raises(ValueError, match="Invalid indexer for array"):
        a[0, 0, 0]
    with pytest.raises(IndexError):
        a[4, 0]
    with pytest.raises(NotImplementedError):
        a[np.array([True, False, True, True]), :]
    with pytest.raises(NotImplementedError):
        np.asarray(a)


def test_int_and_newaxis(make):
    a = make((4, 2), (1, 2), first=0)
    assert offsets(a[2, ...]) == {"0": 16} and a[2, ...].shape == (2,)
    b = a[None, 1:3, None, :]
    assert b.shape == (1, 2, 1, 2) and offsets(b) == {"0.0.0.0": 8, "0.1.0.0": 16}


@pytest.mark.parametrize("shape,chunks,key,want", [((8,), (4,), slice(1, 3), {"0": (1008, 16)}), ((8,), (4,), slice(5, 7), {"0": (1040, 16)}), ((8, 4), (4, 4), (slice(1, 3), slice(None)), {"0.0": (1032, 64)}), ((8, 6), (4, 3), (slice(1, 3), slice(None)), {"0.0": (1024, 48), "0.1": (1120, 48)})])
def test_sub_chunk(make, shape, chunks, key, want):
    got = make(shape, chunks, "<f8", first=1000)[key]
    assert {k: (e["offset"], e["length"]) for k, e in got.dict().items()} == want and got.chunks[0] == 2


@pytest.mark.parametrize("shape,chunks,key,want", [((8, 4), (4, 4), (slice(None), slice(1, 3)), {"0.0": (1032, 64), "1.0": (1160, 64)}), ((6, 8), (3, 4), (slice(None), slice(5, 7)), {"0.0": (1120, 48), "1.0": (1312, 48)})])
def test_sub_chunk_transposed(make, shape, chunks, key, want):
    got = make(shape, chunks, "<f8", first=1000, codecs=({"name": "transpose", "configuration": {"order": [1, 0]}}, {"name": "bytes", "configuration": {"endian": "little"}}))[key]
    assert {k: (e["offset"], e["length"]) for k, e in got.dict().items()} == want


def test_sub_chunk_of_inlined(spark):
    a = VArray.from_dict(spark, ArrayMeta((4,), (4,), "<i4"), {"0": {"path": "", "offset": 0, "length": 16, "data": np.arange(4, dtype="<i4").tobytes()}})
    assert a[1:3].dict()["0"]["data"] == np.array([1, 2], "<i4").tobytes()


# combining


def test_concat(make, spark):
    empty = make((5, 1, 20), (5, 1, 10)).with_fill_value_only(0)
    b = VArray.from_dict(spark, ArrayMeta((5, 1, 20), (5, 1, 10), "<i4", 0), {"0.0.0": ENTRY | {"offset": 300}, "0.0.1": ENTRY | {"offset": 400}})
    got = combine.concatenate([empty, b], axis=1)
    assert got.shape == (5, 2, 20) and offsets(got) == {"0.1.0": 300, "0.1.1": 400}
    assert combine.concatenate([b, b], axis=-2).shape == (5, 2, 20)


def test_stack(make):
    a, b = make((5, 20), (5, 10), first=100), make((5, 20), (5, 10), first=1000)
    got = combine.stack([a, b], axis=1)
    assert (got.shape, got.chunks) == ((5, 2, 20), (5, 1, 10)) and offsets(got) == {"0.0.0": 100, "0.0.1": 300, "0.1.0": 1000, "0.1.1": 1200}
    assert combine.stack([a, b], axis=-1).shape == (5, 20, 2)


def test_broadcast(make):
    assert offsets(combine.broadcast_to(make((1, 2), (1, 2), first=7), (3, 2))) == {"0.0": 7, "1.0": 7, "2.0": 7}
    assert set(combine.broadcast_to(make((3,), (1,)), (1, 3)).dict()) == {"0.0", "0.1", "0.2"}
    for shape, target in (((1,), ()), ((2,), (1,)), ((3,), (5, 4, 4)), ((3, 2), (2, 3, 4))):
        with pytest.raises(ValueError, match="broadcast"):
            combine.broadcast_to(make(shape, shape), target)


def test_refusals(make):
    a = make((4,), (2,))
    with pytest.raises(NotImplementedError, match="different codecs"):
        combine.concatenate([a, make((4,), (2,), codecs=(codec_from_v2({"id": "zlib", "level": 1}),))])
    with pytest.raises(ValueError, match="inconsistent dtypes"):
        combine.concatenate([a, make((4,), (2,), "<i8")])
    with pytest.raises(ValueError, match="inconsistent chunk shapes"):
        combine.concatenate([a, make((4,), (4,))])
    with pytest.raises(ValueError, match="differing number of dimensions"):
        combine.concatenate([a, make((4, 4), (2, 2))])
    with pytest.raises(ValueError, match="differing shapes"):
        combine.stack([a, make((6,), (2,))])
    with pytest.raises(ValueError, match="Cannot concatenate arrays with shapes"):
        combine.concatenate([make((4, 4), (2, 2)), make((4, 6), (2, 2))])
    with pytest.raises(ValueError, match="partial chunks"):
        combine.concatenate([a, make((3,), (2,))])
    with pytest.raises(TypeError):
        combine.concatenate([a, a], axis=1.5)
    with pytest.raises(NotImplementedError):
        combine.concatenate([a, a], axis=None)
    assert combine.result_dtype(a, 1.5) == np.dtype("<i4")


def test_replace_box(make):
    got = combine.replace_box(make((8,), (2,), first=0), make((4,), (2,), first=1000), {0: 1})
    assert offsets(got) == {"0": 0, "1": 1000, "2": 1008, "3": 24}
    with pytest.raises(ValueError):
        combine.replace_box(make((4,), (2,)), make((4,), (2,)), {0: 1})


# alignment


@pytest.mark.parametrize("n,chunk,indexer,want", [(3, 1, [0, 1, 2, -1, -1], {"0": 100, "1": 104, "2": 108}), (4, 2, [0, 1, -1, -1, 2, 3], {"0": 100, "2": 108}), (4, 2, [2, 3, 0, 1], {"0": 108, "1": 100}), (5, 2, [4], {"0": 116}), (4, 2, [0, 1, 0, 1], {"0": 100, "1": 100})])
def test_reindex(make, n, chunk, indexer, want):
    got = make((n,), (chunk,))[(np.array(indexer),)]
    assert got.shape == (len(indexer),) and offsets(got) == want


@pytest.mark.parametrize("indexer", [[0, 1, 2, -1], [1, 0, 2, 3], [1, 2], [0, 1, 2]])
def test_reindex_rejects(make, indexer):
    with pytest.raises(NotImplementedError, match="Cannot align/reindex this virtual array along axis 0.*chunk boundaries"):
        make((4,), (2,))[(np.array(indexer),)]


def test_reindex_by_labels(make, spark):
    a = make((6,), (2,))
    got = align.reindex_to(a, 0, align.coords_frame(spark, [10, 11, 12, 13, 14, 15]), align.coords_frame(spark, [12, 13, 90, 91, 10, 11]))
    assert got.shape == (6,) and offsets(got) == {"0": 108, "2": 100}
    with pytest.raises(NotImplementedError):
        align.reindex_to(a, 0, align.coords_frame(spark, range(6)), align.coords_frame(spark, [1, 2, 3, 4]))


def test_two_axes(make):
    got = make((2, 2), (1, 1))[np.array([[0], [-1], [1]]), np.array([[0, -1, 1]])]
    assert got.shape == (3, 3) and offsets(got) == {"0.0": 100, "0.2": 104, "2.0": 108, "2.2": 112}


def test_where_and_masks(make):
    a = make((4,), (2,), present={"0"})
    mask = align.missing_mask(a)
    assert mask.tolist() == [False, False, True, True]
    assert align.where(~mask, a, 0) is a
    with pytest.raises(NotImplementedError):
        align.where(mask, a, 0)


# comparison


def test_equality(make, spark):
    a = make((4,), (2,))
    assert (a == make((4,), (2,))).all() and not (a == 3).any()
    with pytest.warns(UserWarning, match="chunks differ"):
        assert not (a == make((4,), (2,), first=5)).any()
    assert not (a == make((4,), (2,), fill_value=3)).any()
    with pytest.raises(NotImplementedError):
        _ = a == make((6,), (2,))
    with pytest.raises(TypeError):
        _ = a == object()
    nan = make((4,), (2,), "<f4", fill_value="NaN")
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        assert (nan == make((4,), (2,), "<f4", fill_value=float("nan"))).all()
    e = compare.elementwise_eq(a, make((4,), (2,), present={"1"}))
    assert {tuple(r["idx"]): r["equal"] for r in e.collect()} == {(0,): False, (1,): True}
    assert not compare.isnan(a).any() and compare.full_like(a, 2).tolist() == [2] * 4
    with pytest.raises(NotImplementedError):
        a.astype("f8")
    assert a.astype("i4") is a


# metadata


def test_codecs():
    z = {"id": "zlib", "level": 1}
    assert codec_to_v2(codec_from_v2(z)) == z and codec_kind(codec_from_v2(z)) == "bytes_bytes"
    assert codec_kind({"name": "transpose"}) == "array_array" and codec_kind({"name": "bytes"}) == "array_bytes"
    assert endianness(np.dtype(">i4")) == "big" and endianness(np.dtype("u1")) is None
    with pytest.raises(ValueError):
        endianness(np.dtype([("a", ">i4"), ("b", "<i4")]))
    m = ArrayMeta((4, 4), (2, 2), ">i4", codecs=(codec_from_v2(z),))
    assert [c["name"] for c in m.codecs] == ["bytes", "numcodecs.zlib"] and m.codecs[0]["configuration"] == {"endian": "big"}
    for meta in (m, ArrayMeta((4, 4), (2, 2), "<f4", "NaN", ({"name": "transpose", "configuration": {"order": [1, 0]}}, codec_from_v2(z)), {"a": [1]}, ("x", "y")), ArrayMeta((), (), "<i8"), ArrayMeta((3,), (3,), [("id", "<i4"), ("t", "<f4")])):
        assert ArrayMeta.from_row(meta.to_row()) == meta
        assert ArrayMeta.from_v2(*meta.to_v2()).comparable() == meta.comparable()
    v3 = ArrayMeta((4,), (2,), "<f4", "NaN", dims=("x",), separator="/")
    assert ArrayMeta.from_v3(v3.to_v3()) == v3
    with pytest.raises(ValueError, match="Only RegularChunkGrid"):
        ArrayMeta((4, 4), (2,), "<i4")
    with pytest.raises(NotImplementedError, match="Only RegularChunkGrid"):
        ArrayMeta.from_v3({**v3.to_v3(), "chunk_grid": {"name": "rectilinear"}})


@pytest.mark.parametrize("axis,want", [(0, [1, 45, 45]), (1, [45, 1, 45]), (2, [45, 45, 1])])
def test_shards(make, axis, want):
    shard = {"name": "sharding_indexed", "configuration": {"chunk_shape": [45, 45], "codecs": [{"name": "bytes"}], "index_codecs": [{"name": "bytes"}, {"name": "crc32c"}]}}
    a = make((90, 180), (90, 180), codecs=(shard,))
    got = combine.expand_dims(a, axis)
    assert list(got.meta.inner_chunks) == want
    assert got.meta.replace(shape=a.shape, chunks=a.chunks).inner_chunks == (45, 45)
    with pytest.raises(ValueError):
        realign_shards((shard,), (90, 180), (2, 90, 180))


# properties, against dense arrays of offsets


def dense(arr):
    out = np.full(arr.grid, -1)
    for idx, e in arr.iter_refs():
        out[idx] = e["offset"]
    return out


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.data())
def test_like_numpy(make, data):
    grid = data.draw(st.lists(st.integers(1, 4), min_size=1, max_size=3))
    a = make(tuple(grid), (1,) * len(grid), present=None)
    d = dense(a)
    key = tuple(data.draw(st.one_of(st.integers(-n, n - 1), st.tuples(st.integers(0, n), st.integers(0, n)).map(lambda t: slice(min(t), max(t))))) for n in grid)
    assert np.array_equal(dense(a[key]), d[key])
    axis = data.draw(st.integers(-len(grid), len(grid) - 1))
    assert np.array_equal(dense(combine.concatenate([a, a], axis)), np.concatenate([d, d], axis))
    axis = data.draw(st.integers(-len(grid) - 1, len(grid)))
    stacked = combine.stack([a, a], axis)
    assert np.array_equal(dense(stacked), np.stack([d, d], axis))
    assert np.array_equal(dense(combine.broadcast_to(a, (2, *grid))), np.broadcast_to(d, (2, *grid)))
    at = [slice(None)] * len(grid)
    at.insert(axis % (len(grid) + 1), 1)
    assert (stacked[tuple(at)] == a).all()


def test_numpy_functions(make):
    a, b = make((4, 2), (2, 2)), make((4, 2), (2, 2), first=900)
    assert offsets(np.concatenate([a, b])) == offsets(combine.concatenate([a, b], 0)) and np.stack([a, b], axis=1).shape == (4, 2, 2)
    assert np.expand_dims(a, 0).shape == (1, 4, 2) and np.broadcast_to(a, (3, 4, 2)).grid == (3, 2, 1) and np.shape(a) == (4, 2) and np.ndim(a) == 2 and np.size(a) == 8
    assert np.full_like(a, 3).tolist() == [[3, 3]] * 4 and np.result_type(a, b) == np.dtype("<i4") and not np.isnan(a).any() and np.equal(a, a).all()
    assert np.where(np.ones((4, 2), bool), a, -1) is a
    for wrong in (lambda: np.sum(a), lambda: np.add(a, b), lambda: np.sin(a)):
        with pytest.raises(TypeError):
            wrong()
    with pytest.raises(NotImplementedError):
        np.concatenate([a, b], dtype="f8")
