"""Queries through the operators that a user calls: parsers, opening, datasets, sinks, the store, reading, streaming.

Each makes its files from the shared tables, goes through the operator, and has SQL over the tables as its twin.
"""

from __future__ import annotations

import datetime
import functools

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import api
from .. import dataset as D
from .. import read
from ..dataset import Loaded, VDataset, VGroup, VTree
from ..hfs import Folder
from ..meta import ArrayMeta, codec_from_v2
from ..operators import align, checks, combine
from ..sinks.store import Store
from ..sources.dmrpp import DMRPPParser
from ..sources.fits import FITSParser
from ..sources.hdf import HDFParser
from ..sources.kerchunk import KerchunkJSONParser, KerchunkParquetParser
from ..sources.netcdf3 import NetCDF3Parser
from ..sources.store import StoreParser
from ..sources.zarr import ZarrParser, ZippedZarrParser
from ..streaming.ingest import ingest
from ..varray import VArray
from . import fixtures as X
from . import manifests as M
from .catalogue import _DOCS, _WITH, _WITH_R, flat, query

_LAKE = ["s3://lake/"]
_M1 = "SELECT i0, i1, path, off, len FROM m1"
_R = "l_returnflag = 'R'"


def _grid(s, sf, where=None) -> VDataset:
    return VDataset({"v": M.lineitem_grid(s, sf, where)})


def _named(arrays: dict[str, VArray]):
    """name and :func:`flat` columns of arrays of one rank."""
    parts = [flat(a).withColumn("name", F.lit(n)) for n, a in arrays.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# reference documents

_INLINED = "SELECT i0, path, CASE WHEN path IS NULL THEN 0 ELSE off END AS off, CASE WHEN path IS NULL THEN octet_length(encode(text)) ELSE len END AS len, CASE WHEN path IS NULL THEN text END AS inlined FROM d"


def _with_data(a: VArray):
    return a.refs.select(F.get("idx", F.lit(0)).alias("i0"), "path", F.col("offset").alias("off"), F.col("length").alias("len"), F.decode("data", "utf-8").alias("inlined"))


@query("kerchunk_json_roundtrip", _DOCS + _INLINED)
def _(s, sf):
    path = X.place(s, "refs") + ".json"
    VDataset({"doc": M.documents_1d(s, sf)}).to_kerchunk(path, format="json")
    return _with_data(KerchunkJSONParser()(s, path)["doc"])


@query("kerchunk_dict_roundtrip", _DOCS + _INLINED)
def _(s, sf):
    return _with_data(KerchunkJSONParser()(s, VDataset({"doc": M.documents_1d(s, sf)}).to_kerchunk())["doc"])


@query("kerchunk_parquet_roundtrip", _WITH + _M1)
def _(s, sf):
    path = X.place(s, "refs") + ".parq"
    _grid(s, sf).to_kerchunk(path, format="parquet", record_size=10_000)
    return flat(KerchunkParquetParser()(s, path)["v"])


@query("kerchunk_parquet_rewrite", _WITH_R + "SELECT i0, i1, path, off, len FROM r")
def _(s, sf):
    """A second, sparser dataset in the place of a first one: nothing of that is read back."""
    path = X.place(s, "refs") + ".parq"
    _grid(s, sf).to_kerchunk(path, format="parquet", record_size=20_000)
    _grid(s, sf, _R).to_kerchunk(path, format="parquet", record_size=5_000)
    return flat(KerchunkParquetParser()(s, path)["v"])


@query("kerchunk_inline_parquet", _DOCS + _INLINED)
def _(s, sf):
    path = X.place(s, "refs") + ".parq"
    VDataset({"doc": M.documents_1d(s, sf)}).to_kerchunk(path, format="parquet", record_size=100)
    return _with_data(KerchunkParquetParser()(s, path)["doc"])


def _nations(s, sf) -> dict:
    """A document with a group a region and an array of one chunk a nation."""
    zarray = '{"zarr_format":2,"shape":[4],"chunks":[4],"dtype":"<i2","fill_value":0,"order":"C","filters":null,"compressor":null}'
    refs = {".zgroup": '{"zarr_format":2}'}
    for r in M.table(s, sf, "nation").toLocalIterator():
        at = f"r{r['n_regionkey']}/n{r['n_nationkey']}"
        refs[f"{at}/.zarray"] = zarray
        refs[f"{at}/.zattrs"] = f'{{"_ARRAY_DIMENSIONS":["r{r["n_regionkey"]}/x"]}}'
        refs[f"{at}/0"] = [f"nations/{r['n_regionkey']}.nc", r["n_nationkey"] * 10, len(r["n_name"])]
    return {"version": 1, "refs": refs}


_NATIONS = "SELECT concat('n', CAST(n_nationkey AS VARCHAR)) AS name, CAST(0 AS BIGINT) AS i0, concat('s3://b/nations/', CAST(n_regionkey AS VARCHAR), '.nc') AS path, CAST(n_nationkey * 10 AS BIGINT) AS off, CAST(length(n_name) AS BIGINT) AS len FROM nation"


@query("kerchunk_groups", _NATIONS)
def _(s, sf):
    groups = KerchunkJSONParser(fs_root="s3://b")(s, _nations(s, sf)).groups
    return _named({n: a for g in groups.values() for n, a in g.arrays.items()})


@query("kerchunk_one_group", _NATIONS + " WHERE n_regionkey = 1 AND n_nationkey <> 1")
def _(s, sf):
    return _named(KerchunkJSONParser(group="r1", fs_root="s3://b", skip_variables=["n1"])(s, _nations(s, sf)).arrays)


@query("datatree_open", "SELECT concat('/r', CAST(n_regionkey AS VARCHAR)) AS node, concat('n', CAST(n_nationkey AS VARCHAR)) AS name, 'x' AS dim FROM nation WHERE n_nationkey <> 2")
def _(s, sf):
    tree = api.open_virtual_datatree(s, _nations(s, sf), lambda spark, doc: VGroup(groups={n: KerchunkJSONParser(group=n, fs_root="s3://b")(spark, doc) for n in KerchunkJSONParser(fs_root="s3://b")(spark, doc).groups}), drop_variables=["n2"])
    return s.createDataFrame([(p, n, tree[p][n].meta.dims[0]) for p in tree if p != "/" for n in tree[p].variables], "node string, name string, dim string")


@query("kerchunk_metadata", _WITH + "SELECT CAST(n0 AS BIGINT) AS s0, CAST(7 AS BIGINT) AS s1, '<f8' AS dtype, 'order,line' AS dims, CAST((SELECT count(*) FROM m1) AS BIGINT) AS chunks FROM n")
def _(s, sf):
    """Of the document as rows, which needn't fit the driver."""
    of = lambda key: F.max(F.when(F.col("key") == key, F.col("value")))
    chunks = F.count_if(~F.startswith(F.substring_index("key", "/", -1), F.lit(".z")))
    doc = _grid(s, sf).to_kerchunk(format="rows").agg(of("v/.zarray").alias("zarray"), of("v/.zattrs").alias("zattrs"), chunks.alias("chunks"))
    z, dims = F.from_json("zarray", "shape array<bigint>, dtype string"), F.from_json("zattrs", "_ARRAY_DIMENSIONS array<string>")["_ARRAY_DIMENSIONS"]
    return doc.select(z["shape"][0].alias("s0"), z["shape"][1].alias("s1"), z["dtype"].alias("dtype"), F.array_join(dims, ",").alias("dims"), "chunks")


# Zarr

_CHUNKS = "SELECT CAST(vec_id // 50 AS BIGINT) AS i0, CAST((j - 1) // 16 AS BIGINT) AS i1, count(*) AS n, round(sum(CAST(v AS DOUBLE)), 3) AS total FROM (SELECT vec_id, generate_subscripts(embedding, 1) AS j, unnest(embedding) AS v FROM embeddings) GROUP BY 1, 2"


def _by_chunk(a: VArray):
    return read.read_elements(a).groupBy(F.expr("i0 div 50").alias("i0"), F.expr("i1 div 16").alias("i1")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total"))


@query("element_chunks", _CHUNKS)
def _(s, sf):
    return _by_chunk(ZarrParser()(s, X.embeddings_zarr(s, sf, compress=True))["v"])


@query("zarr_v3_elements", _CHUNKS)
def _(s, sf):
    return _by_chunk(ZarrParser()(s, X.embeddings_zarr(s, sf, 3, separator="/"))["v"])


@query("zarr_zip_elements", _CHUNKS)
def _(s, sf):
    return _by_chunk(ZippedZarrParser()(s, X.zipped(s, X.embeddings_zarr(s, sf)))["v"])


@query("zarr_refs", "SELECT CAST(a AS BIGINT) AS i0, CAST(b AS BIGINT) AS i1, concat('v/', CAST(a AS VARCHAR), '.', CAST(b AS VARCHAR)) AS path, CAST(0 AS BIGINT) AS off, CAST(3200 AS BIGINT) AS len FROM (SELECT DISTINCT vec_id // 50 AS a FROM embeddings), (SELECT unnest(generate_series(0, 3)) AS b)")
def _(s, sf):
    return flat(ZarrParser()(s, X.embeddings_zarr(s, sf))["v"]).withColumn("path", F.regexp_extract("path", r"(v/[^/]*)$", 1))


@query("zarr_slice_elements", "SELECT CAST(vec_id - 50 AS BIGINT) AS i0, CAST(j - 17 AS BIGINT) AS i1, CAST(v AS DOUBLE) AS value FROM (SELECT vec_id, generate_subscripts(embedding, 1) AS j, unnest(embedding) AS v FROM embeddings) WHERE vec_id >= 50 AND vec_id < 100 AND j > 16 AND j <= 48")
def _(s, sf):
    return read.read_elements(ZarrParser()(s, X.embeddings_zarr(s, sf))["v"][50:100, 16:48])


@query("store_keys", "SELECT concat('c.', CAST(a AS VARCHAR), '.', CAST(b AS VARCHAR)) AS key, CAST(3200 AS BIGINT) AS n FROM (SELECT DISTINCT vec_id // 50 AS a FROM embeddings), (SELECT unnest(generate_series(0, 3)) AS b)")
def _(s, sf):
    """Keys of an array as a Zarr store lists them, and bytes got under each of them."""
    g = ZarrParser()(s, X.embeddings_zarr(s, sf, 3, separator="/"))
    found = g.listing("v").where("key <> 'zarr.json'")
    return read.get_all(g, "v", found).select("key", F.octet_length("bytes").cast("bigint").alias("n"))


# opening

_TOTALS = "SELECT CAST(date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS day, round(sum(o_totalprice), 2) AS total FROM orders {where} GROUP BY 1"


def _by_label(ds: VDataset, name: str = "total"):
    """Labels of the loaded coordinate beside the elements that are read."""
    s = ds[name].spark
    labels = s.createDataFrame([(k, int(x)) for k, x in enumerate(ds["day"].values)], "i0 bigint, day bigint")
    return read.read_elements(ds[name]).join(labels, "i0").select("day", F.round("value", 2).alias("total"))


@query("netcdf_open", _TOTALS.format(where="WHERE year(o_orderdate) = (SELECT min(year(o_orderdate)) FROM orders)"))
def _(s, sf):
    root = X.order_days_netcdf(s, sf)
    first = min(n for n in Folder(s, root).list() if n.endswith(".nc"))
    return _by_label(api.open_virtual_dataset(s, f"{root}/{first}", NetCDF3Parser()))


@query("mfdataset_by_coords", _TOTALS.format(where=""))
def _(s, sf):
    return _by_label(api.open_virtual_mfdataset(s, X.order_days_netcdf(s, sf) + "/y*.nc", NetCDF3Parser()))


@query("mfdataset_nested", _TOTALS.format(where=""))
def _(s, sf):
    root = X.order_days_netcdf(s, sf)
    files = [f"{root}/{n}" for n in sorted(Folder(s, root).list()) if n.endswith(".nc")]
    ds = api.open_virtual_mfdataset(s, files, NetCDF3Parser(), combine="nested", concat_dim="day", preprocess=lambda d: d.rename_vars({"total": "t"}))
    return _by_label(ds, "t")


@query("concat_parsed", "SELECT CAST(row_number() OVER (ORDER BY day) - 1 AS BIGINT) AS i0, total AS value FROM (" + _TOTALS.format(where="") + ")")
def _(s, sf):
    root = X.order_days_netcdf(s, sf)
    files = [f"{root}/{n}" for n in Folder(s, root).list() if n.endswith(".nc")]
    return read.read_elements(api.concat_parsed(s, NetCDF3Parser(), files, "day")["total"]).withColumn("value", F.round("value", 2))


@query("parser_rows", "SELECT concat('y', CAST(y AS VARCHAR), '.nc') AS file, 'total' AS name, count(*) AS n FROM (SELECT DISTINCT year(o_orderdate) AS y, CAST(o_orderdate AS DATE) FROM orders) GROUP BY y")
def _(s, sf):
    """Chunks of many files as one relation, a task a file; the skipped variable is never parsed."""
    root = X.order_days_netcdf(s, sf)
    rows = NetCDF3Parser(skip_variables=["day"]).rows(s, [f"{root}/{n}" for n in Folder(s, root).list() if n.endswith(".nc")])
    return rows.where("kind = 'chunk'").groupBy(F.regexp_extract("file", "([^/]*)$", 1).alias("file"), "name").agg(F.count("*").alias("n"))


@query("hdf5_mfdataset", _TOTALS.format(where=""))
def _(s, sf):
    return _by_label(api.open_virtual_mfdataset(s, X.order_days_hdf5(s, sf) + "/y*.h5", HDFParser()))


@query("hdf5_parser_rows", "SELECT concat('y', CAST(y AS VARCHAR), '.h5') AS file, count(*) AS n FROM (SELECT DISTINCT year(o_orderdate) AS y, CAST(o_orderdate AS DATE) FROM orders) GROUP BY y")
def _(s, sf):
    root = X.order_days_hdf5(s, sf)
    rows = HDFParser(skip_variables=["day"]).rows(s, [f"{root}/{n}" for n in Folder(s, root).list() if n.endswith(".h5")])
    return rows.where("kind = 'chunk'").groupBy(F.regexp_extract("file", "([^/]*)$", 1).alias("file")).agg(F.count("*").alias("n"))


@query("hdf5_groups", "SELECT r_name AS region, CAST(n_nationkey AS DOUBLE) AS value FROM nation JOIN region ON n_regionkey = r_regionkey")
def _(s, sf):
    g = HDFParser()(s, X.regions_hdf5(s, sf))
    parts = [read.read_elements(r["nations"]).select(F.lit(r["nations"].meta.attributes["region"]).alias("region"), "value") for r in g.groups.values()]
    return functools.reduce(DataFrame.unionByName, parts)


@query("fits_elements", "SELECT CAST((k - 1) // 10 AS BIGINT) AS i0, CAST((k - 1) % 10 AS BIGINT) AS i1, CAST(p_size AS DOUBLE) AS value FROM (SELECT p_size, row_number() OVER (ORDER BY p_partkey) AS k, count(*) OVER () AS n FROM part) WHERE k <= n // 10 * 10")
def _(s, sf):
    return read.read_elements(FITSParser()(s, X.sizes_fits(s, sf))["PRIMARY"])


@query("dmrpp_refs", "SELECT name, doc_id AS i0, 'docs.nc' AS path, doc_id * 100 AS off, n_chars AS len FROM documents, (SELECT unnest(['n', 'g/n']) AS name)")
def _(s, sf):
    g = DMRPPParser()(s, X.documents_dmrpp(s, sf))
    return _named({"n": g["n"], "g/n": g["g"]["n"]}).withColumn("path", F.regexp_extract("path", "([^/]*)$", 1))


@query("default_loadables_opened", "SELECT 'day' AS name UNION ALL SELECT 'total' WHERE false")
def _(s, sf):
    root = X.order_days_netcdf(s, sf)
    first = min(n for n in Folder(s, root).list() if n.endswith(".nc"))
    return s.createDataFrame([(n,) for n in api.open_virtual_dataset(s, f"{root}/{first}", NetCDF3Parser()).loaded], "name string")


# datasets


def _documents(s, sf, where: str = "true", name: str = "v") -> VDataset:
    """Documents in order of id, a chunk each, under their ids as labels."""
    d = M.table(s, sf, "documents").where(where).select("doc_id", "n_chars")
    labels = [r["doc_id"] for r in d.orderBy("doc_id").select("doc_id").toLocalIterator()]
    at = s.createDataFrame(list(enumerate(labels)), "pos bigint, doc_id bigint")
    refs = d.join(at, "doc_id").select(F.array("pos").alias("idx"), F.lit("s3://lake/d.nc").alias("path"), (F.col("doc_id") * 10).alias("offset"), F.col("n_chars").alias("length"), F.lit(None).cast("binary").alias("data"))
    return VDataset({name: VArray(ArrayMeta((len(labels),), (1,), "<f4", fill_value="NaN", dims=("doc",)), refs), "doc": Loaded(("doc",), np.array(labels))}, ["doc"])


_REFS = "'s3://lake/d.nc' AS path, doc_id * 10 AS off, n_chars AS len"


@query("dataset_isel", _WITH + "SELECT i0 - 40 AS i0, path, off, len FROM m1 WHERE i0 >= 40 AND i0 < 1040 AND i1 = 3")
def _(s, sf):
    return flat(_grid(s, sf).isel(order=slice(40, 1040), line=3)["v"])


@query("dataset_sel", f"SELECT CAST(row_number() OVER (ORDER BY doc_id) - 1 AS BIGINT) AS i0, {_REFS} FROM documents WHERE lang = 'en' AND doc_id BETWEEN 20 AND 150")
def _(s, sf):
    return flat(_documents(s, sf, "lang = 'en'").sel(doc=slice(20, 150))["v"])


@query("dataset_sel_nearest", "WITH e AS (SELECT * FROM documents WHERE lang = 'en'), w AS (SELECT unnest([3, 77, 100000]) AS label) SELECT w.label, arg_min(doc_id, abs(doc_id - w.label) * 1000000 + doc_id) * 10 AS off FROM w, e GROUP BY 1")
def _(s, sf):
    ds = _documents(s, sf, "lang = 'en'")
    parts = [ds.sel(method="nearest", doc=x)["v"].refs.select(F.lit(x).alias("label"), F.col("offset").alias("off")) for x in (3, 77, 100_000)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("dataset_concat", _WITH_R + "SELECT * FROM m1 UNION ALL SELECT i0 + (SELECT max(l_orderkey) + 1 FROM lineitem), i1, path, off, len FROM r")
def _(s, sf):
    return flat(D.concat([_grid(s, sf), _grid(s, sf, _R)], "order")["v"])


@query("dataset_merge", f"SELECT 'a' AS name, CAST(dense_rank() OVER (ORDER BY doc_id) - 1 AS BIGINT) AS i0, {_REFS} FROM documents UNION ALL SELECT 'b', CAST(row_number() OVER (ORDER BY doc_id) - 1 AS BIGINT), {_REFS} FROM documents")
def _(s, sf):
    ds = D.merge([_documents(s, sf, name="a"), _documents(s, sf, name="b")])
    return _named({n: ds[n] for n in ("a", "b")})


@query("dataset_combine_nested", _WITH_R + ", n AS (SELECT max(l_orderkey) + 1 AS n0 FROM lineitem) SELECT * FROM m1 UNION ALL SELECT i0, i1 + 7, path, off, len FROM r UNION ALL SELECT i0 + n0, i1, path, off, len FROM r, n UNION ALL SELECT i0 + n0, i1 + 7, path, off, len FROM m1, n")
def _(s, sf):
    a, b = _grid(s, sf), _grid(s, sf, _R)
    return flat(D.combine_nested([[a, b], [b, a]], ["order", "line"])["v"])


@query("dataset_combine_by_coords", f"SELECT CAST(row_number() OVER (ORDER BY doc_id) - 1 AS BIGINT) AS i0, {_REFS} FROM documents")
def _(s, sf):
    n = M.table(s, sf, "documents").count()
    cuts = [0, n // 3, n // 2, n]
    parts = [_documents(s, sf, f"doc_id >= {a} and doc_id < {b}") for a, b in zip(cuts, cuts[1:], strict=False)]
    return flat(D.combine_by_coords([parts[2], parts[0], parts[1]])["v"])


@query("dataset_align", f"WITH t AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i0 FROM documents WHERE lang = 'en' OR n_chars > 1500) SELECT 'a' AS name, CAST(i0 AS BIGINT) AS i0, {_REFS} FROM documents JOIN t USING (doc_id) WHERE lang = 'en' UNION ALL SELECT 'b', CAST(i0 AS BIGINT), {_REFS} FROM documents JOIN t USING (doc_id) WHERE n_chars > 1500")
def _(s, sf):
    a, b = D.align_datasets(_documents(s, sf, "lang = 'en'"), _documents(s, sf, "n_chars > 1500"), join="outer")
    return _named({"a": a["v"], "b": b["v"]})


@query("dataset_reindex", f"SELECT doc_id AS i0, {_REFS} FROM documents WHERE lang = 'en'")
def _(s, sf):
    n = M.table(s, sf, "documents").agg(F.max("doc_id")).first()[0] + 1
    return flat(_documents(s, sf, "lang = 'en'").reindex(doc=np.arange(n))["v"])


@query("dataset_rename_drop", f"SELECT 'w' AS name, 'row' AS dim, CAST(row_number() OVER (ORDER BY doc_id) - 1 AS BIGINT) AS i0, {_REFS} FROM documents")
def _(s, sf):
    ds = _documents(s, sf).assign(gone=Loaded((), np.array(1))).drop_vars("gone").rename_vars({"v": "w"}).rename_dims({"doc": "row"})
    return _named({n: a for n, a in ds.virtual.items()}).withColumn("dim", F.lit(ds["w"].meta.dims[0]))


@query("dataset_expand_dims", _WITH + "SELECT CAST(0 AS BIGINT) AS i0, i0 AS i1, i1 AS i2, path, off, len FROM m1 UNION ALL SELECT 1, i0, i1, path, off, len FROM m1")
def _(s, sf):
    ds = _grid(s, sf).expand_dims("run")
    return flat(D.concat([ds, ds], "run")["v"])


@query("dataset_equals", "SELECT true AS same, false AS other, false AS renamed")
def _(s, sf):
    a = _grid(s, sf)
    return s.createDataFrame([(a.equals(_grid(s, sf)), a.equals(_grid(s, sf, _R)), a.equals(a.rename_vars({"v": "w"})))], "same boolean, other boolean, renamed boolean")


@query("dataset_validate", "SELECT unnest(['v: missing', 'w: dtype', 'w: shape']) AS violation")
def _(s, sf):
    ds = _grid(s, sf).rename_vars({"v": "w"})
    found = ds.validate({"v": {}, "w": {"dims": ("order", "line"), "dtype": "<f4", "shape": (1, 2), "chunks": (1, 1), "virtual": True}})
    return s.createDataFrame([(f if f.endswith("missing") else f.partition(" is")[0],) for f in found], "violation string")


@query("dataset_metrics", _WITH + "SELECT CAST(n0 * 7 AS BIGINT) AS dense, (SELECT count(*) FROM m1) AS there, CAST(n0 * 7 * 32 AS BIGINT) AS nbytes FROM n")
def _(s, sf):
    ds = _grid(s, sf)
    return s.createDataFrame([(ds.n_refs_dense(), ds.n_refs(), ds.nbytes_virtual)], "dense bigint, there bigint, nbytes bigint")


@query("fill_absent", _WITH + "SELECT 'v' AS name, (SELECT count(*) FROM m1) AS n UNION ALL SELECT 'w', 0")
def _(s, sf):
    ds = _grid(s, sf)
    ds = D.fill_absent(ds, {"v": ds["v"].meta, "w": ds["v"].meta}, s)
    return s.createDataFrame([(n, a.n_refs()) for n, a in ds.virtual.items()], "name string, n bigint")


@query("drop_vars", "SELECT DISTINCT source AS name FROM documents WHERE source NOT IN ('src0', 'src1')")
def _(s, sf):
    meta = ArrayMeta((4,), (4,), "<f4", dims=("x",))
    names = [r["source"] for r in M.table(s, sf, "documents").select("source").distinct().toLocalIterator()]
    return s.createDataFrame([(n,) for n in VDataset({n: VArray.empty(s, meta) for n in names}).drop_vars(["src0", "src1"]).variables], "name string")


@query("list_dir", _WITH + "SELECT concat('c.', CAST(i0 AS VARCHAR), '.', CAST(i1 AS VARCHAR)) AS key FROM m1 UNION ALL SELECT 'zarr.json'")
def _(s, sf):
    return VGroup({"v": M.lineitem_grid(s, sf)}).listing("v")


@query("combinable_arrays", "SELECT source AS name, count(DISTINCT lang) = 1 AS ok FROM documents GROUP BY source")
def _(s, sf):
    """The check that combining runs, on the metadata of each source's arrays."""
    out = []
    for r in M.table(s, sf, "documents").groupBy("source").agg(F.collect_set("lang").alias("langs")).toLocalIterator():
        metas = [ArrayMeta((8,), (4,), "<f4", codecs=(codec_from_v2({"id": "zlib", "level": 1 + ["de", "en", "es", "fr"].index(x)}),)) for x in r["langs"]]
        try:
            checks.combinable(metas)
            out.append((r["source"], True))
        except (NotImplementedError, ValueError):
            out.append((r["source"], False))
    return s.createDataFrame(out, "name string, ok boolean")


@query("numpy_concatenate", _WITH_R + "SELECT * FROM m1 UNION ALL SELECT i0 + (SELECT max(l_orderkey) + 1 FROM lineitem), i1, path, off, len FROM r")
def _(s, sf):
    return flat(np.concatenate([M.lineitem_grid(s, sf), M.lineitem_grid(s, sf, _R)], axis=0))


@query("numpy_stack_broadcast", _WITH_R + "SELECT k AS i0, i0 AS i1, i1 AS i2, CAST(0 AS BIGINT) AS i3, path, off, len FROM m1, (SELECT unnest(generate_series(0, 1)) AS k) UNION ALL SELECT k, i0, i1, 1, path, off, len FROM r, (SELECT unnest(generate_series(0, 1)) AS k)")
def _(s, sf):
    a = np.stack([M.lineitem_grid(s, sf), M.lineitem_grid(s, sf, _R)], axis=2)
    return flat(np.broadcast_to(a, (2, *np.shape(a))))


@query("point_lookups", _WITH + "SELECT * FROM (SELECT m1.* FROM m1 WHERE i0 = (SELECT min(i0) FROM m1) OR i0 = (SELECT max(i0) FROM m1))")
def _(s, sf):
    """The first and the last row of the grid, chunk by chunk; missing ones are None."""
    a = M.lineitem_grid(s, sf)
    ends = a.refs.agg(F.min(F.get("idx", F.lit(0))).alias("a"), F.max(F.get("idx", F.lit(0))).alias("b")).first()
    found = [(i, j, e["path"], e["offset"], e["length"]) for i in (ends["a"], ends["b"]) for j in range(7) if (e := a.lookup((i, j))) is not None]
    return s.createDataFrame(found, "i0 bigint, i1 bigint, path string, off bigint, len bigint")


@query("iterate_refs", _DOCS + "SELECT i0, path FROM d")
def _(s, sf):
    return s.createDataFrame([(i[0], e["path"]) for i, e in M.documents_1d(s, sf).iter_refs()], "i0 bigint, path string")


@query("rename_paths_strings", _WITH + "SELECT i0, i1, concat('https://mirror.example/', path) AS path, off, len FROM m1")
def _(s, sf):
    """A function of strings, even where it would do for a Column."""
    return flat(M.lineitem_grid(s, sf).rename_paths(lambda p: "https://mirror.example/" + p))


@query("where_missing", _WITH_R + "SELECT count(*) AS n FROM r")
def _(s, sf):
    a = M.lineitem_grid(s, sf, _R)
    return s.createDataFrame([(align.where(~align.missing_mask(a), a, np.nan).n_refs(),)], "n bigint")


# the store


@query("store_write_open", _WITH + _M1)
def _(s, sf):
    store = Store(s, X.place(s, "store"), _LAKE)
    store.write(_grid(s, sf))
    return flat(store.open_dataset()["v"])


@query("append_offset", _WITH_R + "SELECT * FROM m1 UNION ALL SELECT i0 + (SELECT max(l_orderkey) + 1 FROM lineitem), i1, path, off, len FROM r")
def _(s, sf):
    store = Store(s, X.place(s, "store"), _LAKE)
    store.write(_grid(s, sf))
    store.write(_grid(s, sf, _R), append_dim="order")
    return flat(store.open_dataset()["v"])


@query("region_upsert", _WITH_R + ", k AS (SELECT max(l_orderkey) + 1 AS n0 FROM lineitem) SELECT m1.* FROM m1 UNION ALL SELECT i0 + n0, i1, path, off, len FROM r, k UNION ALL SELECT i0 + 2 * n0, i1, path, off, len FROM m1, k")
def _(s, sf):
    """Three times the grid, then another one written into its middle."""
    store, a = Store(s, X.place(s, "store"), _LAKE), M.lineitem_grid(s, sf)
    store.write(VDataset({"v": combine.concatenate([a, a, a], 0)}))
    store.write(_grid(s, sf, _R), region={"order": slice(a.shape[0], 2 * a.shape[0])})
    return flat(store.open_dataset()["v"])


@query("store_region_auto", f"SELECT doc_id AS i0, 's3://lake/d.nc' AS path, doc_id * 10 AS off, n_chars AS len FROM documents")
def _(s, sf):
    """A region found by the labels of its coordinate."""
    store = Store(s, X.place(s, "store"), _LAKE)
    store.write(_documents(s, sf))
    store.write(_documents(s, sf, "doc_id >= 40 and doc_id < 90"), region="auto")
    return flat(store.open_dataset()["v"])


@query("store_time_travel", _WITH_R + "SELECT 'first' AS what, m1.* FROM m1 UNION ALL SELECT 'tag', m1.* FROM m1 UNION ALL SELECT 'branch', r.* FROM r")
def _(s, sf):
    store = Store(s, X.place(s, "store"), _LAKE)
    first = store.write(_grid(s, sf))
    store.tag("one", first)
    store.write(_grid(s, sf, _R), append_dim="order")
    side = store.create_branch("side", first)
    side.write(_grid(s, sf, _R), mode="w")
    parts = {"first": store.open_dataset(snapshot_id=first), "tag": store.open_dataset(tag="one"), "branch": side.open_dataset()}
    return _named({n: d["v"] for n, d in parts.items()}).withColumnRenamed("name", "what")


@query("store_tree", _NATIONS)
def _(s, sf):
    groups = KerchunkJSONParser(fs_root="s3://b")(s, _nations(s, sf)).groups
    store = Store(s, X.place(s, "store"), ["s3://b/"])
    store.write_tree(VTree({f"/{n}": g.to_dataset() for n, g in groups.items()}))
    return _named({n: a for g in StoreParser()(s, store.path).groups.values() for n, a in g.arrays.items()})


@query("store_containers", "SELECT CAST(2 AS BIGINT) AS refused, CAST(1 AS BIGINT) AS commits")
def _(s, sf):
    refused, path = 0, X.place(s, "store")
    for containers in ([], ["s3://lake/supp-1"], _LAKE):
        try:
            Store(s, path, containers).write(_grid(s, sf))
        except ValueError:
            refused += 1
    return s.createDataFrame([(refused, len(Store(s, path).log()))], "refused bigint, commits bigint")


@query("store_stale", "SELECT CAST(4 * count(DISTINCT vec_id // 50) AS BIGINT) AS stale, CAST(0 AS BIGINT) AS fresh FROM embeddings")
def _(s, sf):
    """Files that are newer than what the store knows of them, and none once they are written again."""
    v, store = ZarrParser()(s, X.embeddings_zarr(s, sf))["v"], Store(s, X.place(s, "store"), ["file:///", "hdfs://", "s3://", "viewfs://"])
    store.write(VDataset({"v": v}), last_updated_at=datetime.datetime(2000, 1, 1))
    stale = store.stale_refs().count()
    store.write(VDataset({"v": v}), mode="w", last_updated_at=datetime.datetime(2100, 1, 1))
    return s.createDataFrame([(stale, store.stale_refs().count())], "stale bigint, fresh bigint")


@query("streaming_ingest", _TOTALS.format(where=""))
def _(s, sf):
    """Files taken up by a stream, appended to a store in order, and read from there."""
    root, at = X.order_days_netcdf(s, sf), X.place(s, "stream")
    store = Store(s, f"{at}/store", ["file:///", "hdfs://", "s3://", "viewfs://"])
    ingest(s, root, "*.nc", lambda u: api.open_virtual_dataset(s, u, NetCDF3Parser(), decode_times=False), store, "day", f"{at}/checkpoint").awaitTermination()
    return _by_label(store.open_dataset())


# reading


def _names(s, sf) -> VArray:
    path, where = X.names_file(s, sf)
    refs = where.select(F.array("n").alias("idx"), F.lit(path).alias("path"), "offset", F.lit(16).cast("bigint").alias("length"), F.lit(None).cast("binary").alias("data"))
    n = where.agg(F.max("n")).first()[0] + 1
    return VArray(ArrayMeta((n, 16), (1, 16), "u1", dims=("part", "char")), refs.withColumn("idx", F.array(F.get("idx", F.lit(0)), F.lit(0).cast("bigint"))))


def _bytes(name: str, args: dict, sql: str):
    @query(f"read_bytes_{name}", f"SELECT p_partkey AS n, {sql} AS text FROM (SELECT p_partkey, rpad(substr(p_name, 1, 16), 16, ' ') AS t FROM part)")
    def _(s, sf):
        return read.read_bytes(_names(s, sf), **args).select(F.get("idx", F.lit(0)).alias("n"), F.decode("bytes", "utf-8").alias("text"))


_bytes("whole", {}, "t")
_bytes("range", {"start": 2, "end": 7}, "substr(t, 3, 5)")
_bytes("offset", {"start": 10}, "substr(t, 11)")
_bytes("suffix", {"suffix": 3}, "substr(t, 14)")


@query("read_missing_as_fill", "SELECT CAST(sum(CASE WHEN k % 3 = 0 THEN -1 ELSE p_size END) AS BIGINT) AS total, CAST(count(*) AS BIGINT) AS n FROM (SELECT p_size, row_number() OVER (ORDER BY p_partkey) - 1 AS k FROM part)")
def _(s, sf):
    """Inlined chunks, every third left out, read as a whole with the fill value in their places."""
    sizes = [r["p_size"] for r in M.table(s, sf, "part").orderBy("p_partkey").select("p_size").toLocalIterator()]
    entries = {str(k): {"path": "", "offset": 0, "length": 4, "data": np.int32(x).tobytes()} for k, x in enumerate(sizes) if k % 3}
    values = read.read_array(VArray.from_dict(s, ArrayMeta((len(sizes),), (1,), "<i4", fill_value=-1), entries))
    return s.createDataFrame([(int(values.sum()), len(values))], "total bigint, n bigint")


@query("cf_decode_values", "SELECT event_id, CASE WHEN CAST(floor(value) AS BIGINT) = 7 THEN NULL ELSE round(CAST(CAST(floor(value) AS BIGINT) AS DOUBLE) * 0.5 + 10.0, 6) END AS value FROM events")
def _(s, sf):
    """The decoding of arrays, batch by batch."""
    attributes = {"scale_factor": 0.5, "add_offset": 10.0, "_FillValue": 7}

    def run(batches):
        import pyarrow as pa

        for b in batches:
            values, _ = read.cf_decode(b.column(1).to_numpy(), attributes)
            values = np.round(values.astype(float), 6)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(values, mask=np.isnan(values))], ["event_id", "value"])

    return M.table(s, sf, "events").select("event_id", F.floor("value").cast("bigint").alias("raw")).mapInArrow(run, "event_id bigint, value double")


@query("calibration_eras", "SELECT lang AS era, string_agg(source, ',' ORDER BY source) AS sources FROM (SELECT DISTINCT lang, source FROM documents) GROUP BY lang")
def _(s, sf):
    pairs = [(r["lang"], r["source"]) for r in M.table(s, sf, "documents").select("lang", "source").distinct().toLocalIterator()]
    made = {f"{lang}/{source}": VDataset({"v": Loaded((), np.array(0), {"era": lang})}) for lang, source in pairs}
    eras = api.calibration_eras(made, "v", ["era"])
    return s.createDataFrame([(k[0], ",".join(sorted(x.partition("/")[2] for x in v))) for k, v in eras.items()], "era string, sources string")
