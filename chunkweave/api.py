"""Opening files as virtual datasets."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterable

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import dataset as D
from .dataset import Loaded, VDataset, VGroup, VTree
from .functions import keys
from .operators.combine import concat_files
from .read import cf_decode, read_array, read_arrays
from .sources.base import FileParser, groups_of
from .varray import VArray


def _wanted(group: VGroup, names, loadable_variables) -> list[str]:
    return [n for n in (D.default_loadable(group) if loadable_variables is None else loadable_variables) if n in names]


def _dataset(group: VGroup, drop_variables, loadable_variables, decode_times: bool, values: dict[str, np.ndarray] | None = None) -> VDataset:
    """The dataset of a group, with variables loaded, from ``values`` where given: by default those named after their only dimension."""
    D.check_collision(drop_variables, loadable_variables)
    if loadable_variables is not None and (isinstance(loadable_variables, str) or not isinstance(loadable_variables, Iterable)):
        raise ValueError("loadable_variables must be a list of names, or None")
    ds = group.to_dataset()
    dropped = {drop_variables} if isinstance(drop_variables, str) else set(drop_variables or ())
    ds = ds.drop_vars(dropped & set(ds.variables))
    wanted = _wanted(group, ds.variables, loadable_variables)
    for n, v in ds.variables.items():
        if isinstance(v, VArray) and any(c > max(1, s) for c, s in zip(v.chunks, v.shape, strict=True)):
            warnings.warn(f"variable {n!r} has chunks {v.chunks} larger than its shape {v.shape}", UserWarning, stacklevel=3)
    out = dict(ds.variables)
    for n in wanted:
        v = ds.variables[n]
        if isinstance(v, VArray):
            raw = values[n] if values is not None and n in values else read_array(v)
            decoded, attrs = cf_decode(raw, v.meta.attributes, decode_times)
            out[n] = Loaded(v.meta.dims or (), decoded, attrs, {k: v.meta.attributes[k] for k in ("units", "calendar") if k in v.meta.attributes and k not in attrs})
    return VDataset(out, ds.coords, ds.attributes)


def open_virtual_dataset(spark: SparkSession, url, parser, drop_variables=None, loadable_variables=None, decode_times: bool = True) -> VDataset:
    """One file, by a parser ``(spark, url) -> VGroup``, as a dataset."""
    D.check_collision(drop_variables, loadable_variables)
    where = keys.uri(url) if isinstance(url, str) else url
    ds = _dataset(parser(spark, where), drop_variables, loadable_variables, decode_times)
    if isinstance(url, str):
        ds.encoding["source"] = where
    return ds


def open_virtual_datatree(spark: SparkSession, url, parser, drop_variables=None, loadable_variables=None, decode_times: bool = True) -> VTree:
    """The whole hierarchy of a file; variables can't be loaded one by one."""
    if loadable_variables:
        raise NotImplementedError("loadable_variables must be None or empty for trees")
    tree = parser(spark, keys.uri(url) if isinstance(url, str) else url).to_tree()
    return VTree({p: d.drop_vars(set(drop_variables or ()) & set(d.variables)) for p, d in tree.nodes.items()})


def _flat(urls) -> list:
    return [x for u in urls for x in _flat(u)] if isinstance(urls, (list, tuple)) else [urls]


def _paths(spark: SparkSession, urls):
    """Lists stay as they are; a pattern becomes its sorted files."""
    if isinstance(urls, str):
        from .hfs import Folder

        folder = Folder(spark, keys.uri(urls))
        fs, p = folder._at("")
        found = fs.globStatus(p)
        return sorted(str(s.getPath().toUri().getPath()) if str(s.getPath()).startswith("file:") else str(s.getPath()) for s in found) if found else []
    return list(urls)


def open_virtual_mfdataset(
    spark: SparkSession, urls, parser, concat_dim=None, compat: str = "no_conflicts", preprocess: Callable[[VDataset], VDataset] | None = None, data_vars: str = "all", coords: str = "different",
    combine: str = "by_coords", join: str = "outer", attrs_file: str | None = None, combine_attrs: str = "override", drop_variables=None, loadable_variables=None, decode_times: bool = True, parallel: bool | str | None = None,
) -> VDataset:
    """Many files as one dataset; for parsers of single files, parsing is one job and loading variables another. ``parallel`` may say so: True, False, None or 'spark' are alike."""
    if parallel not in (None, True, False, "spark"):
        raise ValueError(f"Invalid value for `parallel`: {parallel!r}; files are parsed by Spark tasks")
    urls = _paths(spark, urls)
    flat = _flat(urls)
    if not flat:
        raise OSError("no files to open")
    if combine not in ("nested", "by_coords"):
        raise ValueError(f"combine must be 'nested' or 'by_coords', not {combine!r}")
    if combine == "by_coords" and concat_dim is not None:
        raise ValueError("concat_dim can't be given together with combine='by_coords'")
    opened: dict = {}
    rows = None
    if isinstance(parser, FileParser):
        names = [keys.uri(u) for u in flat]
        rows = parser.rows(spark, names).cache()
        D.check_collision(drop_variables, loadable_variables)
        groups = groups_of(rows, parser.group)
        values = _load(rows, parser.group, groups, drop_variables, loadable_variables)
        for u, name in zip(flat, names, strict=True):
            opened[u] = _dataset(groups.get(name, VGroup()), drop_variables, loadable_variables, decode_times, values.get(name, {}))
            opened[u].encoding["source"] = name
    else:
        for u in flat:
            opened[u] = open_virtual_dataset(spark, u, parser, drop_variables, loadable_variables, decode_times)
    if preprocess is not None:
        opened = {u: preprocess(d) for u, d in opened.items()}
    place = lambda x: [place(y) for y in x] if isinstance(x, (list, tuple)) else opened[x]
    options = {"join": join, "combine_attrs": combine_attrs, "data_vars": data_vars, "coords": coords}
    one = _one_dim([opened[u] for u in flat], concat_dim if combine == "nested" and flat == urls else None, combine) if rows is not None and preprocess is None else None
    if one is not None:
        dim, order = one
        out = _one_pass(rows.where(F.col("grp") == (parser.group or "").strip("/")), [opened[flat[k]] for k in order], dim, options)
    elif combine == "nested":
        out = D.combine_nested(place(urls), concat_dim, compat="override" if compat == "override" else "equals", **options)
    else:
        out = D.combine_by_coords([opened[u] for u in flat], **options)
    if attrs_file is not None:
        out.attributes = dict(opened[attrs_file].attributes)
    return out


def _load(rows, group: str | None, groups: dict[str, VGroup], drop_variables, loadable_variables) -> dict[str, dict[str, np.ndarray]]:
    """Undecoded values of the variables to load, by file and name."""
    dropped = {drop_variables} if isinstance(drop_variables, str) else set(drop_variables or ())
    given = None if isinstance(loadable_variables, str) else loadable_variables
    metas = {(f, n): g.arrays[n].meta for f, g in groups.items() for n in _wanted(g, g.arrays.keys() - dropped, given)}
    out: dict[str, dict[str, np.ndarray]] = {}
    if metas:
        own = (F.col("kind") == "chunk") & (F.col("grp") == (group or "").strip("/")) & F.col("name").isin(sorted({n for _, n in metas}))
        found = read_arrays(rows.where(own).select("file", "name", "idx", "path", "offset", "length", "data"), metas)
        for (f, n), v in found.items():
            out.setdefault(f, {})[n] = v
    return out


def _one_dim(datasets: list[VDataset], concat_dim: str | None, combine: str) -> tuple[str, list[int]] | None:
    """The one existing dimension that the files differ in and their order, if one pass over all references will do: every virtual variable has it, all else is alike."""
    first = datasets[0]
    if any(d.variables.keys() != first.variables.keys() or d.virtual.keys() != first.virtual.keys() for d in datasets) or not first.virtual:
        return None
    differ = [d for d in first.sizes if isinstance(first.variables.get(d), Loaded) and any(not D._same_values(x._index(d), first._index(d)) for x in datasets[1:])]
    dim = concat_dim if combine == "nested" else differ[0] if len(differ) == 1 else None
    if dim not in first.sizes or any(d != dim for d in differ) or any(dim not in (v.meta.dims or ()) for v in first.virtual.values()):
        return None
    if combine == "nested":
        return dim, list(range(len(datasets)))
    labels = [d._index(dim) for d in datasets]
    falls = {bool(i[0] > i[-1]) for i in labels if len(i) > 1} or {False}
    if len(falls) > 1 or any(not len(i) for i in labels):
        return None
    order = sorted(range(len(labels)), key=lambda k: labels[k][0], reverse=falls.pop())
    whole = np.concatenate([labels[k] for k in order])
    if not (np.all(whole[:-1] < whole[1:]) or np.all(whole[:-1] > whole[1:])):
        return None  # the general way names the error
    return dim, order


def _one_pass(rows, datasets: list[VDataset], dim: str, options: dict) -> VDataset:
    """Concatenate files that were parsed into one relation: loaded variables on the driver, each virtual one by one join with the files' shifts."""
    names = list(datasets[0].virtual)
    out = D.concat([d.drop_vars(names) for d in datasets], dim, **options) if len(datasets[0].variables) > len(names) else VDataset({}, (), D.combine_attributes([d.attributes for d in datasets], options["combine_attrs"]))
    files = [d.encoding["source"] for d in datasets]
    made = {n: _joined(rows, n, files, [d[n].meta for d in datasets], dim) for n in names}
    return VDataset({n: made.get(n, out.variables.get(n)) for n in datasets[0].variables}, datasets[0].coords, out.attributes, datasets[0].encoding)


def _joined(rows, name: str, files: list[str], metas: list, dim: str) -> VArray:
    from .operators import checks

    checks.same_ndim(metas)
    checks.combinable(metas)
    axis = metas[0].dims.index(dim)
    checks.same_shape_except(metas, {axis})
    checks.no_partial_chunks(metas, axis)
    order = rows.sparkSession.createDataFrame([(f, k, m.grid[axis]) for k, (f, m) in enumerate(zip(files, metas, strict=True))], "file string, ord bigint, grid_len bigint")
    shape = tuple(sum(m.shape[axis] for m in metas) if i == axis else s for i, s in enumerate(metas[0].shape))
    own = rows.where((F.col("kind") == "chunk") & (F.col("name") == name))
    return VArray(metas[0].replace(shape=shape), concat_files(own, order, axis).select("idx", "path", "offset", "length", "data"))


def concat_parsed(spark: SparkSession, parser: FileParser, urls: list[str], dim: str, order: Callable[[str], object] | None = None) -> VDataset:
    """Files of one layout concatenated along a dimension in one job each variable, whatever their number.

    Metadata of each file (a row each) come to the driver; references don't: each file's shift is a prefix sum
    over the files, joined to its references.
    """
    names = [keys.uri(u) for u in urls]
    names.sort(key=order) if order else None
    rows = parser.rows(spark, names).where(F.col("grp") == (parser.group or "").strip("/"))
    import json

    from .meta import ArrayMeta

    found: dict[str, dict[str, ArrayMeta]] = {}
    for r in rows.where("kind = 'array'").select("file", "name", "meta").toLocalIterator():
        found.setdefault(r["name"], {})[r["file"]] = ArrayMeta.from_row(json.loads(r["meta"]))
    out = {}
    for n, by_file in found.items():
        metas = [by_file[f] for f in names]
        if dim in (metas[0].dims or ()):
            out[n] = _joined(rows, n, names, metas, dim)
        else:
            own = rows.where((F.col("kind") == "chunk") & (F.col("name") == n) & (F.col("file") == names[0]))
            out[n] = VArray(metas[0], own.select("idx", "path", "offset", "length", "data"))
    return VDataset(out)


def calibration_eras(datasets: dict[str, VDataset], variable: str, names: list[str]) -> dict[tuple, list[str]]:
    """Sources by the values of a variable's attributes: files that may not be put in one array."""
    out: dict[tuple, list[str]] = {}
    for source, ds in datasets.items():
        v = ds[variable]
        attrs = v.meta.attributes if isinstance(v, VArray) else v.attributes
        out.setdefault(tuple(attrs.get(n) for n in names), []).append(source)
    return out
