"""A transactional store of references in a folder.

``data/<snapshot>/<n>`` holds Parquet with columns ``i0.., path, offset, length, data, last_updated_at``; so index
ranges are pruned by row groups.  A snapshot is a JSON document that names, for each array, its metadata and the
segments of references in order; a later segment may replace a box of the grid.  A commit creates the branch's
next numbered file, which fails if someone else was first; until then nothing that was written is visible.
"""

from __future__ import annotations

import datetime
import io
import json
import uuid
import warnings
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..dataset import Loaded, VDataset, VGroup, VTree
from ..functions import keys
from ..hfs import Folder
from ..meta import ArrayMeta
from ..operators import checks
from ..varray import VArray
from .kerchunk import encoded

MODES = ("w", "w-", "a", "r+")


class ConflictError(RuntimeError):
    """Another commit came first; open the store again and repeat."""


class Store:
    """``containers``: URL prefixes that virtual references may point to."""

    def __init__(self, spark: SparkSession, path: str, containers: list[str] | None = None, branch: str = "main", read_only: bool = False):
        self.spark, self.path, self.branch, self.read_only = spark, keys.uri(path).rstrip("/"), branch, read_only
        self.folder = Folder(spark, self.path)
        self.containers = list(containers or ())

    # snapshots

    def log(self, branch: str | None = None) -> list[str]:
        """Snapshot ids of a branch, oldest first."""
        where = f"refs/branch.{branch or self.branch}"
        return [json.loads(self.folder.read(f"{where}/{n}"))["snapshot"] for n in self.folder.list(where) if n.endswith(".json")]

    def snapshot(self, branch: str | None = None, tag: str | None = None, snapshot_id: str | None = None) -> dict:
        if sum(x is not None for x in (branch, tag, snapshot_id)) > 1:
            raise ValueError("give one of branch, tag and snapshot_id at most")
        if tag is not None:
            if not self.folder.exists(f"refs/tag.{tag}.json"):
                raise ValueError(f"tag {tag!r} not found")
            snapshot_id = json.loads(self.folder.read(f"refs/tag.{tag}.json"))["snapshot"]
        if snapshot_id is None:
            log = self.log(branch)
            if not log:
                if branch is not None:
                    raise ValueError(f"branch {branch!r} not found")
                return {"id": None, "nodes": {}, "properties": {}}
            snapshot_id = log[-1]
        if not self.folder.exists(f"snapshots/{snapshot_id}.json"):
            raise ValueError(f"snapshot {snapshot_id!r} not found")
        return json.loads(self.folder.read(f"snapshots/{snapshot_id}.json"))

    def tag(self, name: str, snapshot_id: str | None = None) -> None:
        self.folder.write(f"refs/tag.{name}.json", json.dumps({"snapshot": snapshot_id or self.log()[-1]}).encode())

    def create_branch(self, name: str, snapshot_id: str | None = None) -> Store:
        if self.log(name):
            raise ValueError(f"branch {name!r} exists")
        self.folder.write(f"refs/branch.{name}/{0:012d}.json", json.dumps({"snapshot": snapshot_id or self.log()[-1]}).encode())
        return Store(self.spark, self.path, self.containers, name)

    def commits(self, branch: str | None = None) -> list[dict]:
        """id, parent, committed_at, message and properties of a branch's snapshots."""
        return [{k: s[k] for k in ("id", "parent", "committed_at", "message", "properties")} for s in (self.snapshot(snapshot_id=i) for i in self.log(branch))]

    def _commit(self, parent: dict, nodes: dict, message: str, properties: dict | None) -> str:
        log = self.log()
        if (log[-1] if log else None) != parent["id"]:
            raise ConflictError("the branch has moved on")
        new = {"id": uuid.uuid4().hex, "parent": parent["id"], "committed_at": datetime.datetime.now(datetime.UTC).isoformat(), "message": message, "properties": properties or {}, "nodes": nodes}
        self.folder.write(f"snapshots/{new['id']}.json", json.dumps(new).encode())
        staged = f"refs/.staged-{new['id']}"
        self.folder.write(staged, json.dumps({"snapshot": new["id"]}).encode())
        try:
            done = self.folder.rename(staged, f"refs/branch.{self.branch}/{len(log):012d}.json") if self.folder.exists(f"refs/branch.{self.branch}") else None
            if done is None:
                self.folder.write(f"refs/branch.{self.branch}/{len(log):012d}.json", json.dumps({"snapshot": new["id"]}).encode())
                self.folder.delete(staged)
                done = True
        except Exception as e:
            raise ConflictError("another commit came first") from e
        if not done:
            self.folder.delete(staged)
            raise ConflictError("another commit came first")
        return new["id"]

    # reading

    def open(self, group: str | None = None, branch: str | None = None, tag: str | None = None, snapshot_id: str | None = None, skip_variables=()) -> VGroup:
        nodes = self.snapshot(branch, tag, snapshot_id)["nodes"]
        root = VGroup()
        for path, node in sorted(nodes.items()):
            at = root
            for p in path.strip("/").split("/"):
                if p:
                    at = at.groups.setdefault(p, VGroup())
            at.attributes.update(node["attributes"])
            for name, a in node["arrays"].items():
                if name in skip_variables:
                    continue
                at.arrays[name] = Loaded(tuple(a["dims"]), np.load(io.BytesIO(self.folder.read(a["values"])), allow_pickle=False), a["attributes"], a["encoding"]) if a["kind"] == "loaded" else self._array(a)
        return root.group(group)

    def open_dataset(self, **where) -> VDataset:
        return self.open(**where).to_dataset()

    def _array(self, a: dict) -> VArray:
        meta = ArrayMeta.from_row(a["meta"])
        return VArray(meta, self._segments(a, meta).select("idx", "path", "offset", "length", "data"))

    def _segments(self, a: dict, meta: ArrayMeta) -> DataFrame:
        """References of all segments, without the boxes that later ones replace."""
        axes = [f"i{k}" for k in range(meta.ndim)]
        schema = ", ".join([*[f"{x} bigint" for x in axes], "path string, offset bigint, length bigint, data binary, last_updated_at timestamp"])
        parts = []
        for k, s in enumerate(a["segments"]):
            df = self.spark.read.schema(schema).parquet(f"{self.path}/{s['path']}")
            for later in a["segments"][k + 1 :]:
                if later["box"] is not None:
                    # an array of rank 0 has one place
                    df = df.where(~reduce(lambda x, y: x & y, [(F.col(x) >= lo) & (F.col(x) < hi) for x, (lo, hi) in zip(axes, later["box"], strict=True)], F.lit(True)))
            parts.append(df)
        if not parts:
            parts = [self.spark.createDataFrame([], schema)]
        return reduce(DataFrame.unionByName, parts).withColumn("idx", F.array(*axes) if axes else F.array().cast("array<bigint>"))

    def stale_refs(self, group: str = "", **where) -> DataFrame:
        """path, modified, last_updated_at of files that changed after their references were written."""
        nodes = self.snapshot(**where)["nodes"]
        frames = [self._segments(a, ArrayMeta.from_row(a["meta"])).where("data is null").select("path", "last_updated_at") for a in nodes[group.strip("/")]["arrays"].values() if a["kind"] == "virtual"]
        refs = reduce(DataFrame.unionByName, frames).groupBy("path").agg(F.min("last_updated_at").alias("last_updated_at"))
        names = [r["path"] for r in refs.select("path").toLocalIterator()]
        if not names:
            return refs.select("path", F.lit(None).cast("timestamp").alias("modified"), "last_updated_at")
        now = self.spark.read.format("binaryFile").load(names).select(F.regexp_replace("path", "^file:/+", "file:///").alias("path"), F.col("modificationTime").alias("modified"))
        return refs.join(now, "path").where("modified > last_updated_at").select("path", "modified", "last_updated_at")

    # writing

    def write(self, ds: VDataset, group: str = "", mode: str | None = None, append_dim: str | None = None, region=None, validate_containers: bool = True, last_updated_at: datetime.datetime | None = None, message: str = "", properties: dict | None = None) -> str:
        """Write a dataset into a group and commit; the new snapshot's id.

        mode None is ``w-`` (the group must be new), or ``r+`` with ``append_dim`` or ``region``.
        """
        return self._write({group.strip("/"): ds}, mode, append_dim, region, validate_containers, last_updated_at, message, properties)

    def write_tree(self, tree: VTree, group: str = "", mode: str | None = None, write_inherited_coords: bool = False, validate_containers: bool = True, last_updated_at=None, message: str = "", properties: dict | None = None) -> str:
        """All nodes of a tree in one commit."""
        nodes = {}
        for path, ds in tree.nodes.items():
            if write_inherited_coords:
                up = path.rstrip("/")
                while up:
                    up = up.rpartition("/")[0]
                    parent = tree.nodes.get(up or "/")
                    for n in parent.coords if parent else ():
                        if n not in ds.variables and (dims := _dims(parent.variables[n])) and all(d in ds.sizes for d in dims):
                            ds = ds.assign_coords(**{n: parent.variables[n]})
            nodes["/".join(p for p in (group.strip("/"), path.strip("/")) if p)] = ds
        return self._write(nodes, mode, None, None, validate_containers, last_updated_at, message, properties)

    def _write(self, datasets: dict[str, VDataset], mode, append_dim, region, validate_containers, last_updated_at, message, properties) -> str:
        if self.read_only:
            raise ValueError("supplied store is read-only")
        mode = resolve_mode(mode, append_dim, region)
        for ds in datasets.values():
            if not isinstance(ds, VDataset):
                raise TypeError(f"a dataset is needed, not {type(ds).__name__}")
            if append_dim is not None and append_dim not in ds.sizes:
                raise ValueError(f"append_dim {append_dim!r} does not match any existing dataset dimensions {list(ds.sizes)}")
            if validate_containers:
                self.check_containers(ds)
        if not any(ds.virtual for ds in datasets.values()):
            warnings.warn("the dataset has no virtual variables", UserWarning, stacklevel=3)
        parent = self.snapshot()
        nodes = json.loads(json.dumps(parent["nodes"]))
        stamp = last_updated_at or datetime.datetime.now(datetime.UTC).replace(tzinfo=None) + datetime.timedelta(seconds=1)
        snapshot = uuid.uuid4().hex
        for path, ds in datasets.items():
            if mode == "w-" and path in nodes and nodes[path]["arrays"]:
                raise ValueError(f"group {path!r} exists; use another mode")
            if mode == "r+" and path not in nodes:
                raise ValueError(f"group {path!r} doesn't exist")
            if mode == "w":
                for k in [k for k in nodes if k == path or not path or k.startswith(path + "/")]:
                    if k not in datasets or k == path:
                        nodes.pop(k)
            up = path
            while up:
                up = up.rpartition("/")[0]
                nodes.setdefault(up, {"attributes": {}, "arrays": {}})
            node = nodes.setdefault(path, {"attributes": {}, "arrays": {}})
            self._into(node, ds, f"data/{snapshot}/{path or 'root'}", append_dim, region, stamp)
            attrs = dict(ds.attributes)
            if named := sorted(n for n in ds.coords if n not in ds.sizes):
                attrs["coordinates"] = " ".join(named)
            node["attributes"] |= json.loads(json.dumps(attrs, default=str))
        return self._commit(parent, nodes, message, properties)

    def _into(self, node: dict, ds: VDataset, where: str, append_dim, region, stamp) -> None:
        region = self._region(node, ds, region)
        for n, v in ds.loaded.items():
            values, dims = v.values, v.dims
            old = node["arrays"].get(n)
            if old is not None and old["kind"] == "loaded" and (append_dim in dims or region):
                before = np.load(io.BytesIO(self.folder.read(old["values"])), allow_pickle=False)
                if append_dim in dims:
                    values = np.concatenate([before, values], axis=dims.index(append_dim))
                elif region and any(d in region for d in dims):
                    before = before.copy()
                    before[tuple(slice(*region[d]) if d in region else slice(None) for d in dims)] = values
                    values = before
            if values.dtype == np.dtype(object):
                values = values.astype(str)
            raw = io.BytesIO()
            np.save(raw, values, allow_pickle=False)
            self.folder.write(f"{where}/{n}.npy", raw.getvalue())
            node["arrays"][n] = {"kind": "loaded", "dims": list(dims), "values": f"{where}/{n}.npy", "attributes": json.loads(json.dumps(encoded(v)[1] if values.dtype.kind != "M" else v.attributes, default=str)), "encoding": json.loads(json.dumps(v.encoding, default=str))}
        for n, v in ds.virtual.items():
            old, dims = node["arrays"].get(n), v.meta.dims or ()
            if append_dim is not None and append_dim in dims and old is not None:
                self._append(old, v, dims.index(append_dim), f"{where}/{n}", stamp)
            elif region and any(d in region for d in dims) and old is not None:
                self._replace(old, v, {dims.index(d): b for d, b in region.items() if d in dims}, f"{where}/{n}", stamp)
            else:
                self._segment(v, [0] * v.ndim, f"{where}/{n}", stamp)
                node["arrays"][n] = {"kind": "virtual", "meta": v.meta.to_row(), "segments": [{"path": f"{where}/{n}", "box": None}]}

    def _segment(self, v: VArray, shift: list[int], path: str, stamp) -> None:
        axes = [(F.get("idx", F.lit(k)) + shift[k]).alias(f"i{k}") for k in range(v.ndim)]
        v.refs.select(*axes, "path", "offset", "length", "data", F.lit(stamp).cast("timestamp").alias("last_updated_at")).write.parquet(f"{self.path}/{path}")

    def _append(self, old: dict, v: VArray, axis: int, path: str, stamp) -> None:
        meta = ArrayMeta.from_row(old["meta"])
        checks.appendable(meta, v.meta, {axis})
        checks.same_encoding({"fill_value": meta.fill_value, **_encoding(meta)}, {"fill_value": v.meta.fill_value, **_encoding(v.meta)})
        checks.no_partial_chunks([meta], axis)
        self._segment(v, [meta.grid[axis] if k == axis else 0 for k in range(v.ndim)], path, stamp)
        shape = tuple(s + v.shape[k] if k == axis else s for k, s in enumerate(meta.shape))
        old["meta"] = meta.replace(shape=shape).to_row()
        old["segments"].append({"path": path, "box": None})

    def _region(self, node: dict, ds: VDataset, region) -> dict[str, tuple[int, int]]:
        """(start, stop) by dimension of a region: 'auto', or slices, or 'auto' by dimension."""
        if region is None:
            return {}
        if region == "auto":
            region = {d: "auto" for d in ds.sizes if isinstance(ds.variables.get(d), Loaded) and d in node["arrays"]}
        out = {}
        for d, r in region.items():
            if d not in ds.sizes:
                raise ValueError(f"region {d!r} does not match any existing dataset dimensions")
            if r == "auto":
                have = node["arrays"].get(d)
                if have is None or have["kind"] != "loaded" or not isinstance(ds.variables.get(d), Loaded):
                    raise ValueError(f"region='auto' needs a loaded coordinate {d!r} on both sides")
                index = np.load(io.BytesIO(self.folder.read(have["values"])), allow_pickle=False)
                at = np.flatnonzero(index == ds.variables[d].values.astype(index.dtype)[0])
                if not len(at) or not np.array_equal(index[at[0] : at[0] + ds.sizes[d]], ds.variables[d].values.astype(index.dtype)):
                    raise ValueError(f"the labels of {d!r} aren't a stretch of the existing ones")
                r = slice(int(at[0]), int(at[0]) + ds.sizes[d])
            if r.step not in (None, 1):
                raise ValueError(f"region {d!r} has a step")
            start = r.start or 0
            stop = start + ds.sizes[d] if r.stop is None else r.stop
            if stop - start != ds.sizes[d]:
                raise ValueError(f"region {d!r} has length {stop - start}, the dataset {ds.sizes[d]}")
            out[d] = (start, stop)
        return out

    def _replace(self, old: dict, v: VArray, region: dict[int, tuple[int, int]], path: str, stamp) -> None:
        meta = ArrayMeta.from_row(old["meta"])
        checks.combinable([meta, v.meta])
        checks.same_ndim([meta, v.meta])
        checks.same_shape_except([meta, v.meta], set(region))
        box, shift = [(0, n) for n in meta.grid], [0] * v.ndim
        for axis, (start, stop) in region.items():
            c = meta.chunks[axis]
            if start % c or stop % c and stop != meta.shape[axis] or stop > meta.shape[axis]:
                raise ValueError(f"region {start}:{stop} of axis {axis} is not aligned to whole chunks of length {c}")
            box[axis], shift[axis] = (start // c, -(-stop // c)), start // c
        self._segment(v, shift, path, stamp)
        old["segments"].append({"path": path, "box": box})

    def check_containers(self, ds: VDataset) -> None:
        """Every virtual reference lies below an allowed prefix."""
        for n, v in ds.virtual.items():
            refs = v.virtual_refs()
            if not self.containers:
                if not refs.isEmpty():
                    raise ValueError(f"No Virtual Chunk Containers set, but variable {n!r} has virtual references")
                continue
            bad = refs.where(~reduce(lambda x, y: x | y, [F.startswith("path", F.lit(p)) for p in self.containers])).select("path").limit(1).collect()
            if bad:
                raise ValueError(f"No Virtual Chunk Container set which supports prefix of {bad[0]['path']!r} (variable {n!r}); containers: {self.containers}")


def _encoding(meta: ArrayMeta) -> dict:
    return {k: meta.attributes[k] for k in ("scale_factor", "add_offset", "units", "calendar", "_FillValue") if k in meta.attributes}


def _dims(v) -> tuple[str, ...]:
    return (v.meta.dims if isinstance(v, VArray) else v.dims) or ()


def resolve_mode(mode: str | None, append_dim: str | None, region) -> str:
    changes = append_dim is not None or region is not None
    if mode is None:
        return "r+" if changes else "w-"
    if not isinstance(mode, str):
        raise TypeError("mode must be a string")
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}, not {mode!r}")
    if changes and mode in ("w", "w-"):
        raise ValueError(f"mode {mode!r} cannot be used together with append_dim or region")
    return mode
