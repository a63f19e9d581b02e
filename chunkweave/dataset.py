"""Datasets and trees of virtual arrays and loaded variables, and how several become one.

A dataset holds virtual arrays, loaded variables (small numpy arrays, such as coordinates) and attributes.
Combining works on metadata and adds unions, shifts and joins to the references.
"""

from __future__ import annotations

import copy
import dataclasses
import functools
from collections.abc import Iterable
from dataclasses import dataclass, field
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import keys
from .meta import ArrayMeta
from .operators import combine
from .varray import VArray


@dataclass
class Loaded:
    """A variable in memory."""

    dims: tuple[str, ...]
    values: np.ndarray
    attributes: dict = field(default_factory=dict)
    encoding: dict = field(default_factory=dict)

    def __post_init__(self):
        self.dims, self.values = tuple(self.dims), np.asarray(self.values)

    shape = property(lambda self: self.values.shape)
    dtype = property(lambda self: self.values.dtype)

    @property
    def nbytes(self) -> int:
        return self.values.nbytes


def _names(names: list[str]) -> DataFrame:
    return SparkSession.active().createDataFrame([(n,) for n in names], "key string")


class VGroup:
    """Named arrays and sub-groups with attributes, as a parser finds them."""

    def __init__(self, arrays: dict[str, VArray] | None = None, groups: dict[str, VGroup] | None = None, attributes: dict | None = None):
        self.arrays, self.groups, self.attributes = dict(arrays or {}), dict(groups or {}), dict(attributes or {})
        if clash := self.arrays.keys() & self.groups.keys():
            raise ValueError(f"arrays and groups share the names {sorted(clash)}")
        for name, a in self.arrays.items():
            if not isinstance(a, (VArray, Loaded)):
                raise TypeError(f"member {name!r} is no array")
        for name, g in self.groups.items():
            if not isinstance(g, VGroup):
                raise TypeError(f"member {name!r} is no group")

    def __getitem__(self, name: str):
        if "/" in name:
            raise ValueError(f"member names are single components, not {name!r}")
        return self.arrays[name] if name in self.arrays else self.groups[name]

    def __iter__(self):
        yield from self.arrays
        yield from self.groups

    def __len__(self) -> int:
        return len(self.arrays) + len(self.groups)

    def deepest(self, key: str) -> tuple[Any, str]:
        """The last group or array on the way of a store key, and what is left of the key."""
        node, parts = self, [p for p in key.split("/") if p]
        while parts and isinstance(node, VGroup) and parts[0] in list(node):
            node = node[parts.pop(0)]
        return node, "/".join(parts)

    def group(self, path: str | None) -> VGroup:
        node = self
        for p in (path or "").strip("/").split("/"):
            if p:
                if p not in node.groups:
                    raise ValueError(f"group {path!r} not found")
                node = node.groups[p]
        return node

    def listing(self, prefix: str) -> DataFrame:
        """key: what :meth:`list_dir` lists, as a relation without order, whose chunk keys never pass the driver."""
        node, rest = self.deepest(prefix)
        if rest or isinstance(node, VGroup):
            return _names([] if rest else ["zarr.json", *node])
        chunk = F.concat(F.lit("c."), keys.format_key(F.col("idx"))) if node.ndim else F.lit("c")
        return node.refs.select(chunk.alias("key")).unionByName(_names(["zarr.json"]))

    def list_dir(self, prefix: str) -> list[str]:
        """Members of a group, or keys of an array's chunks, as a Zarr store lists them, on the driver: for small arrays."""
        node, rest = self.deepest(prefix)
        if rest:
            return []
        if isinstance(node, VGroup):
            return ["zarr.json", *node]
        return ["zarr.json", *("c" if not k else f"c.{k}" for k in node.dict())]

    def nbytes_virtual(self) -> int:
        return sum(a.nbytes_virtual() if isinstance(a, VArray) else a.nbytes for a in self.arrays.values()) + sum(g.nbytes_virtual() for g in self.groups.values())

    def to_dataset(self) -> VDataset:
        attrs = dict(self.attributes)
        named = attrs.pop("coordinates", "")
        return VDataset(dict(self.arrays), named.split() if isinstance(named, str) else list(named), attrs)

    def to_tree(self) -> VTree:
        nodes = {"/": self.to_dataset()}
        for name, g in self.groups.items():
            for path, ds in g.to_tree().nodes.items():
                nodes[f"/{name}{path}".rstrip("/")] = ds
        return VTree(nodes)


class VDataset:
    """Variables by name; ``coords`` are the names of those that are coordinates."""

    def __init__(self, variables: dict[str, VArray | Loaded], coords: Iterable[str] = (), attributes: dict | None = None, encoding: dict | None = None):
        self.variables, self.attributes, self.encoding = dict(variables), dict(attributes or {}), dict(encoding or {})
        sizes: dict[str, int] = {}
        for name, v in self.variables.items():
            dims = _dims(v)
            if dims is None and v.shape:
                raise ValueError(f"variable {name!r} has no dimension names")
            for d, s in zip(dims or (), v.shape, strict=True):
                if sizes.setdefault(d, s) != s:
                    raise ValueError(f"conflicting sizes for dimension {d!r}: {sizes[d]} and {s} ({name!r})")
        self.sizes = sizes
        named = {x for v in self.variables.values() for x in str(_attrs(v).get("coordinates", "")).split()}
        self.coords = {n for n in self.variables if n in set(coords) or n in named or (_dims(self.variables[n]) or ()) == (n,)}

    def __getitem__(self, name: str):
        return self.variables[name]

    def __contains__(self, name: str) -> bool:
        return name in self.variables

    def __repr__(self) -> str:
        return f"VDataset<{dict(self.sizes)}, {[n + ('*' if n in self.coords else '') for n in self.variables]}>"

    def _with(self, variables, **changes) -> VDataset:
        return VDataset(variables, changes.get("coords", self.coords), changes.get("attributes", self.attributes), self.encoding)

    virtual = property(lambda self: {n: v for n, v in self.variables.items() if isinstance(v, VArray)})
    loaded = property(lambda self: {n: v for n, v in self.variables.items() if isinstance(v, Loaded)})

    # projection and renaming

    def drop_vars(self, names: str | Iterable[str], errors: str = "raise") -> VDataset:
        names = {names} if isinstance(names, str) else set(names)
        if errors == "raise" and (lost := names - self.variables.keys()):
            raise ValueError(f"variables not found: {sorted(lost)}")
        return self._with({n: v for n, v in self.variables.items() if n not in names})

    def rename(self, names: dict[str, str]) -> VDataset:
        """Rename variables and dimensions of the given names."""
        return self.rename_vars({k: v for k, v in names.items() if k in self.variables}).rename_dims({k: v for k, v in names.items() if k in self.sizes})

    def rename_vars(self, names: dict[str, str]) -> VDataset:
        if lost := names.keys() - self.variables.keys():
            raise ValueError(f"variables not found: {sorted(lost)}")
        out = {names.get(n, n): v for n, v in self.variables.items()}
        if len(out) < len(self.variables):
            raise ValueError("two variables would have one name")
        return self._with(out, coords={names.get(n, n) for n in self.coords})

    def rename_dims(self, names: dict[str, str]) -> VDataset:
        if lost := names.keys() - self.sizes.keys():
            raise ValueError(f"dimensions not found: {sorted(lost)}")
        return self._with({n: _with_dims(v, tuple(names.get(d, d) for d in _dims(v) or ())) for n, v in self.variables.items()})

    def assign_coords(self, **coords) -> VDataset:
        """Set loaded coordinates; a value may be (dims, values) or 1-D values of a dimension of that name."""
        out = dict(self.variables)
        for n, v in coords.items():
            out[n] = v if isinstance(v, (VArray, Loaded)) else Loaded(*v) if isinstance(v, tuple) else Loaded((n,) if np.ndim(v) else (), v)
        return self._with(out, coords=self.coords | set(coords))

    def assign(self, **variables) -> VDataset:
        return self._with({**self.variables, **variables})

    def drop_encoding(self) -> VDataset:
        out = VDataset({n: dataclasses.replace(v, encoding={}) if isinstance(v, Loaded) else v for n, v in self.variables.items()}, self.coords, self.attributes)
        return out

    def copy(self) -> VDataset:
        return VDataset(copy.copy(self.variables), self.coords, copy.deepcopy(self.attributes), copy.deepcopy(self.encoding))

    def rename_paths(self, new) -> VDataset:
        return self._with({n: v.rename_paths(new) if isinstance(v, VArray) else v for n, v in self.variables.items()})

    # selection

    def isel(self, **indexers) -> VDataset:
        """Select by position along dimensions: slices and integers."""
        if lost := indexers.keys() - self.sizes.keys():
            raise ValueError(f"dimensions not found: {sorted(lost)}")
        out = {}
        for n, v in self.variables.items():
            dims = _dims(v) or ()
            key = tuple(indexers.get(d, slice(None)) for d in dims)
            if not dims or all(isinstance(k, slice) and k == slice(None) for k in key):
                out[n] = v
            elif isinstance(v, VArray):
                out[n] = v[key]
            else:
                out[n] = dataclasses.replace(v, dims=tuple(d for d, k in zip(dims, key, strict=True) if not isinstance(k, (int, np.integer))), values=v.values[key])
        return self._with(out)

    def sel(self, method: str | None = None, **labels) -> VDataset:
        """Select by label along dimensions with a loaded coordinate; ``method='nearest'`` takes the closest."""
        at: dict[str, Any] = {}
        for d, label in labels.items():
            index = self._index(d)
            if isinstance(label, slice):
                a = 0 if label.start is None else int(np.searchsorted(index, np.asarray(label.start, index.dtype), "left"))
                b = len(index) if label.stop is None else int(np.searchsorted(index, np.asarray(label.stop, index.dtype), "right"))
                at[d] = slice(a, b)
            elif method == "nearest":
                at[d] = int(np.argmin(np.abs(index - np.asarray(label, index.dtype))))
            else:
                hit = np.flatnonzero(index == np.asarray(label, index.dtype))
                if not len(hit):
                    raise KeyError(f"label {label!r} not found on {d!r}")
                at[d] = int(hit[0])
        return self.isel(**at)

    def _index(self, dim: str) -> np.ndarray:
        v = self.variables.get(dim)
        if not isinstance(v, Loaded):
            raise ValueError(f"dimension {dim!r} has no loaded coordinate")
        return v.values

    def expand_dims(self, dim: str, axis: int = 0) -> VDataset:
        """A new dimension of length 1 on each data variable; a scalar coordinate of that name becomes its labels."""
        out = {}
        for n, v in self.variables.items():
            if n == dim and v.shape == ():
                out[n] = Loaded((dim,), v.values[None], v.attributes, v.encoding)
            elif n in self.coords:
                out[n] = v
            else:
                dims = list(_dims(v) or ())
                dims.insert(axis, dim)
                out[n] = VArray((e := combine.expand_dims(v, axis)).meta.replace(dims=tuple(dims)), e.refs) if isinstance(v, VArray) else dataclasses.replace(v, dims=tuple(dims), values=np.expand_dims(v.values, axis))
        return self._with(out)

    def reindex(self, **targets) -> VDataset:
        """Every variable at other labels along dimensions, by whole chunks; labels that aren't there are missing."""
        out = self
        for d, labels in targets.items():
            index, labels = out._index(d), np.asarray(labels)
            place = {x: k for k, x in reversed(list(enumerate(index.tolist())))}
            indexer = [place.get(x, -1) for x in labels.tolist()]
            made = {}
            for n, v in out.variables.items():
                dims = _dims(v) or ()
                if n == d:
                    made[n] = dataclasses.replace(v, values=labels)
                elif d not in dims or indexer == list(range(len(index))):
                    made[n] = v
                elif isinstance(v, VArray):
                    made[n] = v[tuple(indexer if x == d else slice(None) for x in dims)]
                else:
                    values = v.values.take(np.maximum(indexer, 0), axis=dims.index(d))
                    if -1 in indexer:
                        values = values.astype(np.result_type(values.dtype, np.float32)) if values.dtype.kind in "iu" else values.copy()
                        at = [slice(None)] * values.ndim
                        at[dims.index(d)] = np.array(indexer) == -1
                        values[tuple(at)] = np.datetime64("NaT") if values.dtype.kind == "M" else np.nan
                    made[n] = dataclasses.replace(v, values=values)
            out = VDataset(made, out.coords, out.attributes, out.encoding)
        return out

    # comparison, metrics, validation

    def equals(self, other: VDataset) -> bool:
        """Same variables, same metadata, same references and values."""
        if self.variables.keys() != other.variables.keys():
            return False
        for n, v in self.variables.items():
            w = other.variables[n]
            if type(v) is not type(w):
                return False
            if isinstance(v, Loaded):
                if v.dims != w.dims or v.shape != w.shape or not _same_values(v.values, w.values):
                    return False
            elif v.meta.comparable() != w.meta.comparable() or not (v == w).all():
                return False
        return True

    @property
    def nbytes_virtual(self) -> int:
        return sum(v.nbytes_virtual() if isinstance(v, VArray) else v.nbytes for v in self.variables.values())

    def n_refs_dense(self) -> int:
        return sum(v.n_refs_dense() for v in self.virtual.values())

    def n_refs(self) -> int:
        return sum(v.n_refs() for v in self.virtual.values())

    def validate(self, schema: dict[str, dict]) -> list[str]:
        """All violations of {variable: {dims, dtype, shape, chunks, attributes, virtual, values}}, any of them left out; values is a predicate."""
        found = []
        for n, want in schema.items():
            v = self.variables.get(n)
            if v is None:
                found.append(f"{n}: missing")
                continue
            have = {"dims": _dims(v), "dtype": np.dtype(v.dtype), "shape": v.shape, "virtual": isinstance(v, VArray), "chunks": v.chunks if isinstance(v, VArray) else None}
            for k, x in want.items():
                if k == "attributes":
                    found += [f"{n}: attribute {a} is {_attrs(v).get(a)!r}, not {y!r}" for a, y in x.items() if _attrs(v).get(a) != y]
                elif k == "values":
                    if not isinstance(v, Loaded) or not x(v.values):
                        found.append(f"{n}: values")
                elif have[k] != (np.dtype(x) if k == "dtype" else tuple(x) if isinstance(x, (list, tuple)) else x):
                    found.append(f"{n}: {k} is {have[k]}, not {x}")
        return found

    # sinks

    def to_kerchunk(self, path: str | None = None, format: str = "dict", **options):
        from .sinks.kerchunk import to_kerchunk

        return to_kerchunk(self, path, format, **options)

    def to_store(self, store, **options) -> str:
        return store.write(self, **options)


class VTree:
    """Datasets by absolute path."""

    def __init__(self, nodes: dict[str, VDataset]):
        self.nodes = dict(nodes)

    def __getitem__(self, path: str) -> VDataset:
        return self.nodes["/" + path.strip("/")]

    def __iter__(self):
        return iter(self.nodes)

    def to_store(self, store, **options) -> str:
        return store.write_tree(self, **options)

    @property
    def nbytes_virtual(self) -> int:
        return sum(d.nbytes_virtual for d in self.nodes.values())


def _dims(v) -> tuple[str, ...] | None:
    return v.meta.dims if isinstance(v, VArray) else v.dims


def _attrs(v) -> dict:
    return v.meta.attributes if isinstance(v, VArray) else v.attributes


def _with_dims(v, dims):
    return VArray(v.meta.replace(dims=dims), v.refs) if isinstance(v, VArray) else dataclasses.replace(v, dims=dims)


def _same_values(a: np.ndarray, b: np.ndarray) -> bool:
    return np.array_equal(a, b, equal_nan=a.dtype.kind in "fcmM" and b.dtype.kind in "fcmM")


# combining


def combine_attributes(all_: list[dict], how: str = "override") -> dict:
    """override: the first's; drop: none; identical: all must agree; no_conflicts: union that agrees; drop_conflicts: union of what agrees."""
    if how == "drop" or not all_:
        return {}
    if how == "override":
        return dict(all_[0])
    if how == "identical":
        if any(a != all_[0] for a in all_[1:]):
            raise ValueError("attributes differ")
        return dict(all_[0])
    if how in ("no_conflicts", "drop_conflicts"):
        out, bad = {}, set()
        for a in all_:
            for k, v in a.items():
                if k in out and out[k] != v:
                    if how == "no_conflicts":
                        raise ValueError(f"conflicting values of attribute {k!r}")
                    bad.add(k)
                out.setdefault(k, v)
        return {k: v for k, v in out.items() if k not in bad}
    raise ValueError(f"unknown combine_attrs {how!r}")


def _join_other_dims(datasets: list[VDataset], dim: str | None, join: str) -> list[VDataset]:
    """Align all dimensions but ``dim``."""
    dims = [d for d in dict.fromkeys(d for ds in datasets for d in ds.sizes) if d != dim]
    for d in dims:
        having = [ds for ds in datasets if d in ds.sizes]
        if not all(isinstance(ds.variables.get(d), Loaded) for ds in having):
            continue
        indexes = [ds._index(d) for ds in having]
        if all(_same_values(i, indexes[0]) for i in indexes):
            continue
        if join == "exact":
            raise ValueError(f"cannot align objects with join='exact' where labels differ on {d!r}")
        if join == "override":
            if any(len(i) != len(indexes[0]) for i in indexes):
                raise ValueError(f"cannot align with join='override': lengths differ on {d!r}")
            datasets = [ds.assign_coords(**{d: dataclasses.replace(ds.variables[d], values=indexes[0])}) if d in ds.sizes else ds for ds in datasets]
            continue
        target = {"outer": lambda: functools.reduce(np.union1d, indexes), "inner": lambda: functools.reduce(np.intersect1d, indexes), "left": lambda: indexes[0], "right": lambda: indexes[-1]}[join]()
        datasets = [ds.reindex(**{d: target}) if d in ds.sizes else ds for ds in datasets]
    return datasets


def align_datasets(*datasets: VDataset, join: str = "outer") -> tuple[VDataset, ...]:
    return tuple(_join_other_dims(list(datasets), None, join))


def concat(datasets: list[VDataset], dim: str, join: str = "outer", combine_attrs: str = "override", data_vars: str = "all", coords: str = "different", compat: str = "equals") -> VDataset:
    """Join along an existing or new dimension.

    Variables with the dimension are concatenated.  Others are stacked along a new dimension, or when
    ``data_vars='minimal'`` (or, for coordinates, unless they differ) taken once after a comparison.
    """
    if not datasets:
        raise ValueError("nothing to concatenate")
    datasets = _join_other_dims(datasets, dim, join)
    first = datasets[0]
    is_new = dim not in first.sizes
    out = {}
    for n, v in first.variables.items():
        if any(n not in ds.variables for ds in datasets):
            raise ValueError(f"variable {n!r} isn't in all datasets")
        own = [ds.variables[n] for ds in datasets]
        dims = _dims(v) or ()
        if dim in dims:
            out[n] = _concat_variables(own, dims.index(dim))
        elif n == dim:
            out[n] = Loaded((dim,), np.stack([o.values for o in own]), v.attributes, v.encoding)
        elif n in first.coords:
            if coords == "all" or coords == "different" and not compat == "override" and not _all_same(own):
                out[n] = _stack_variables(own, dim)
            else:
                out[n] = v
        elif is_new and data_vars == "all":
            out[n] = _stack_variables(own, dim)
        else:
            if compat != "override" and not _all_same(own):
                raise ValueError(f"variable {n!r} lacks dimension {dim!r} and differs between the datasets; virtual values can't be compared")
            out[n] = v
    return VDataset(out, first.coords, combine_attributes([d.attributes for d in datasets], combine_attrs), first.encoding)


def _all_same(variables: list) -> bool:
    first = variables[0]
    for v in variables[1:]:
        if type(v) is not type(first):
            return False
        if isinstance(v, Loaded):
            if v.dims != first.dims or not _same_values(v.values, first.values):
                return False
        elif v.meta.comparable() != first.meta.comparable() or not bool(np.all(v == first)):
            return False
    return True


def _concat_variables(own: list, axis: int):
    if all(isinstance(o, VArray) for o in own):
        return combine.concatenate(own, axis)
    if all(isinstance(o, Loaded) for o in own):
        return dataclasses.replace(own[0], values=np.concatenate([o.values for o in own], axis=axis))
    raise ValueError("a variable is virtual in some datasets and loaded in others")


def _stack_variables(own: list, dim: str):
    if all(isinstance(o, VArray) for o in own):
        s = combine.stack(own, 0)
        return VArray(s.meta.replace(dims=(dim, *(own[0].meta.dims or ()))), s.refs)
    if all(isinstance(o, Loaded) for o in own):
        return dataclasses.replace(own[0], dims=(dim, *own[0].dims), values=np.stack([o.values for o in own]))
    raise ValueError("a variable is virtual in some datasets and loaded in others")


def merge(datasets: list[VDataset], compat: str = "no_conflicts", join: str = "outer", combine_attrs: str = "override") -> VDataset:
    """Variables of all datasets in one; those of one name must be equal, unless ``compat='override'``."""
    datasets = _join_other_dims(datasets, None, join)
    out: dict = {}
    coords: set[str] = set()
    for ds in datasets:
        for n, v in ds.variables.items():
            if n in out and compat != "override" and not _all_same([out[n], v]):
                raise ValueError(f"conflicting values for variable {n!r}")
            out.setdefault(n, v)
        coords |= ds.coords
    return VDataset(out, coords, combine_attributes([d.attributes for d in datasets], combine_attrs))


def combine_nested(datasets, concat_dim, **options) -> VDataset:
    """Nested lists of datasets, concatenated along one dimension for each level, or merged where that is None."""
    dims = [concat_dim] if isinstance(concat_dim, str) or concat_dim is None else list(concat_dim)

    def join(node, rest):
        if isinstance(node, VDataset):
            if rest:
                raise ValueError("fewer levels of lists than dimensions")
            return node
        if not rest:
            raise ValueError("more levels of lists than dimensions")
        own = [join(n, rest[1:]) for n in node]
        if rest[0] is None:
            return merge(own, combine_attrs=options.get("combine_attrs", "override"), compat=options.get("compat", "no_conflicts"))
        return concat(own, rest[0], **options)

    return join(datasets, dims)


def combine_by_coords(datasets: list[VDataset], **options) -> VDataset:
    """Order the datasets by their loaded 1-D coordinates, rising or falling, and concatenate along those that differ; groups with other variables are merged."""
    groups: dict[frozenset, list[VDataset]] = {}
    for ds in datasets:
        groups.setdefault(frozenset(n for n in ds.variables if n not in ds.coords), []).append(ds)
    done = [_by_coords(g, options) for g in groups.values()]
    return done[0] if len(done) == 1 else merge(done, combine_attrs=options.get("combine_attrs", "override"))


def _by_coords(datasets: list[VDataset], options: dict) -> VDataset:
    dims = [d for d in datasets[0].sizes if isinstance(datasets[0].variables.get(d), Loaded) and any(not _same_values(ds._index(d), datasets[0]._index(d)) for ds in datasets[1:])]
    if not dims:
        if len(datasets) == 1:
            return datasets[0]
        raise ValueError("Could not find any dimension coordinates to use to order the datasets for concatenation")
    place: list[tuple] = [() for _ in datasets]
    for d in dims:
        indexes = [ds._index(d) for ds in datasets]
        falls = {bool(len(i) > 1 and i[0] > i[-1]) for i in indexes if len(i) > 1} or {False}
        if len(falls) > 1 or any(len(i) > 1 and not (np.all(i[:-1] <= i[1:]) or np.all(i[:-1] >= i[1:])) for i in indexes):
            raise ValueError(f"Coordinate variable {d} is neither monotonically increasing nor decreasing on all datasets")
        firsts = sorted({i[0] for i in indexes}, reverse=falls.pop())
        rank = {x: k for k, x in enumerate(firsts)}
        place = [p + (rank[i[0]],) for p, i in zip(place, indexes, strict=True)]
    if len(set(place)) < len(place):
        raise ValueError("datasets overlap: two have the same position")
    cells = dict(zip(place, datasets, strict=True))

    def build(prefix: tuple):
        if len(prefix) == len(dims):
            if prefix not in cells:
                raise ValueError("the datasets don't form a complete grid")
            return cells[prefix]
        return [build((*prefix, k)) for k in range(1 + max(p[len(prefix)] for p in place))]

    out = combine_nested(build(()), dims, **options)
    for d in dims:
        i = out._index(d)
        if not (np.all(i[:-1] < i[1:]) or np.all(i[:-1] > i[1:])):
            raise ValueError(f"Resulting object does not have monotonic global indexes along dimension {d}")
    return out


def fill_absent(dataset: VDataset, expected: dict[str, ArrayMeta], spark) -> VDataset:
    """The dataset with a fill-only array for each expected variable that it lacks."""
    return dataset.assign(**{n: VArray.empty(spark, m) for n, m in expected.items() if n not in dataset.variables})


def check_collision(drop_variables, loadable_variables) -> None:
    if both := set(drop_variables or ()) & set(loadable_variables or ()):
        raise ValueError(f"Cannot both drop and load the variables {sorted(both)}")


def default_loadable(group: VGroup) -> list[str]:
    """Variables named after their only dimension."""
    return [n for n, a in group.arrays.items() if _dims(a) == (n,)]

