"""Kerchunk reference documents: JSON, dicts and the Parquet layout."""

from __future__ import annotations

import base64
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..dataset import VGroup
from ..functions import keys
from ..hfs import Folder
from ..meta import ArrayMeta
from ..varray import VArray

METADATA = (".zarray", ".zattrs", ".zgroup", ".zmetadata", "zarr.json")
_BASE64 = "base64:"


def refs_frame(spark: SparkSession, document: dict | str) -> DataFrame:
    """key, value of a document: a dict, or the path of a JSON file. Values that aren't strings stay JSON text; ``text`` tells which were strings."""
    if isinstance(document, dict):
        refs = document.get("refs", document)
        rows = [(k, v if isinstance(v, str) else json.dumps(v), isinstance(v, str)) for k, v in refs.items() if k != "version"]
        return spark.createDataFrame(rows, "key string, value string, text boolean")
    # the bare NaN of [NaN] isn't JSON
    whole = spark.read.text(keys.uri(document), wholetext=True).select(F.regexp_replace("value", r"(:\s*\[\s*)NaN(\s*\])", "$1null$2").alias("value"))
    # values as JSON text each, by way of a variant: a string that looks like a list stays a string
    return whole.select(F.expr("parse_json(value)").alias("v")).select(F.expr("coalesce(try_variant_get(v, '$.refs', 'map<string, variant>'), cast(v as map<string, variant>))").alias("m")).select(F.explode("m").alias("key", "v")).select("key", F.when(F.schema_of_variant("v") == "STRING", F.expr("cast(v as string)")).otherwise(F.to_json("v")).alias("value"), (F.schema_of_variant("v") == "STRING").alias("text"))


def extract_group(refs: DataFrame, group: str | None) -> DataFrame:
    """Keys below a group, its prefix cut off; ValueError for a group that isn't there."""
    group = (group or "").strip("/")
    if not group:
        return refs
    found = refs.where(F.startswith("key", F.lit(group + "/")))
    if found.isEmpty():
        raise ValueError(f"Group {group!r} not found in the references")
    # as it stands in JSON text, taken literally
    quoted = r"\Q" + json.dumps(group, ensure_ascii=False)[1:-1].replace(r"\E", r"\E\\E\Q") + r"\E"
    return found.withColumn("key", F.substring("key", len(group) + 2, 1 << 30)).withColumn("value", F.when(F.endswith("key", F.lit(".zattrs")), F.regexp_replace("value", rf'(?<=")(?:/)?{quoted}/', "")).otherwise(F.col("value")))


def chunk_rows(refs: DataFrame, fs_root: str | None = None) -> DataFrame:
    """name, key, path, offset, length, data, n of the chunk keys. Forms of value: base64 text, raw text, [path], [NaN], [path, offset, length]."""
    name = F.regexp_extract("key", r"^(.*)/[^/]*$", 1)
    last = F.regexp_extract("key", r"([^/]*)$", 1)
    parts = F.when(~F.col("text"), F.from_json(F.regexp_replace("value", r"\bNaN\b", "null"), "array<string>"))
    rows = refs.where(~last.isin(*METADATA) & (name != "")).select(name.alias("name"), last.alias("key"), "text", "value", parts.alias("p"))
    bad = rows.where("not text and (p is null or size(p) not in (1, 3))")
    if not bad.isEmpty():
        raise TypeError(f"chunk references must be strings, [path] or [path, offset, length]: {bad.first()['value']!r}")
    data = F.when(F.col("text") & F.startswith("value", F.lit(_BASE64)), F.unbase64(F.substring("value", len(_BASE64) + 1, 1 << 30))).when(F.col("text"), F.encode("value", "utf-8"))
    rows = rows.where("text or p[0] is not null").select("name", "key", data.alias("data"), F.get("p", F.lit(0)).alias("path"), F.get("p", F.lit(1)).cast("bigint").alias("offset"), F.get("p", F.lit(2)).cast("bigint").alias("length"), F.coalesce(F.size("p"), F.lit(0)).alias("n"))
    rows = rows.withColumn("path", F.when(F.col("data").isNull(), keys.normalise_uri(F.col("path"), fs_root)))
    if not rows.where("data is null and path is null").isEmpty():
        raise ValueError("paths must be absolute posix paths or URIs; give fs_root for relative ones")
    return rows


def with_whole_files(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """[path] references get their file's length, from a listing that reads no content."""
    whole = rows.where("n = 1 and data is null")
    if whole.isEmpty():
        return rows
    names = [r["path"] for r in whole.select("path").distinct().toLocalIterator()]
    sizes = spark.read.format("binaryFile").load(names).select(F.regexp_replace("path", "^file:/+", "file:///").alias("path"), F.col("length").alias("size"))
    return rows.join(sizes, "path", "left").withColumns({"offset": F.when(F.col("n") == 1, F.lit(0).cast("bigint")).otherwise(F.col("offset")), "length": F.when(F.col("n") == 1, F.col("size")).otherwise(F.col("length"))}).drop("size")


def arrays_of(spark: SparkSession, refs: DataFrame, fs_root: str | None = None, skip_variables=()) -> VGroup:
    """Group of the arrays in refs (key, value, text)."""
    docs: dict[str, dict[str, str]] = {}
    for r in refs.where(F.regexp_extract("key", r"([^/]*)$", 1).isin(".zarray", ".zattrs", ".zgroup")).collect():
        where, _, what = r["key"].rpartition("/")
        docs.setdefault(where, {})[what] = json.loads(r["value"])
    chunks = with_whole_files(spark, chunk_rows(refs, fs_root))
    root = VGroup(attributes=docs.get("", {}).get(".zattrs", {}))
    root.attributes.pop("_ARRAY_DIMENSIONS", None)

    def at(path: str) -> VGroup:
        node = root
        for p in path.split("/"):
            if p:
                node = node.groups.setdefault(p, VGroup())
        return node

    for where, d in sorted(docs.items()):
        parent, _, name = where.rpartition("/")
        if ".zarray" in d:
            if name in skip_variables:
                continue
            meta = ArrayMeta.from_v2(d[".zarray"], d.get(".zattrs"))
            own = chunks.where(F.col("name") == where)
            idx = keys.parse_key(F.col("key"), meta.separator) if meta.ndim else F.array().cast("array<bigint>")
            own = own.select(idx.alias("idx"), "path", F.when(F.col("data").isNotNull(), F.lit(0)).otherwise(F.col("offset")).cast("bigint").alias("offset"), F.when(F.col("data").isNotNull(), F.octet_length("data")).otherwise(F.col("length")).cast("bigint").alias("length"), "data")
            at(parent).arrays[name] = VArray(meta, own)
        elif where:
            at(where).attributes.update(d.get(".zattrs", {}))
    return root


class KerchunkJSONParser:
    """``parser(spark, url)`` of a JSON document, or of a dict in its place."""

    def __init__(self, group: str | None = None, fs_root: str | None = None, skip_variables=()):
        self.group, self.fs_root, self.skip_variables = group, fs_root, tuple(skip_variables or ())

    def __call__(self, spark: SparkSession, url: str | dict) -> VGroup:
        return arrays_of(spark, extract_group(refs_frame(spark, url), self.group), self.fs_root, self.skip_variables)


class KerchunkParquetParser:
    """``parser(spark, url)`` of a folder with ``.zmetadata`` and ``<variable>/refs.<n>.parq``."""

    def __init__(self, group: str | None = None, fs_root: str | None = None, skip_variables=(), reader_options: dict | None = None):
        self.group, self.fs_root, self.skip_variables, self.reader_options = group, fs_root, tuple(skip_variables or ()), dict(reader_options or {})

    def __call__(self, spark: SparkSession, url: str) -> VGroup:
        folder = Folder(spark, keys.uri(url))
        doc = json.loads(folder.read(".zmetadata"))
        record, metadata = int(doc.get("record_size", 10_000)), doc["metadata"]
        root = VGroup(attributes=metadata.get(".zattrs", {}))
        for key, zarray in sorted(metadata.items()):
            where, _, what = key.rpartition("/")
            name = where.rpartition("/")[2]
            if what != ".zarray" or name in self.skip_variables:
                if what == ".zattrs" and where and f"{where}/.zarray" not in metadata:
                    self._at(root, where).attributes.update(zarray)
                continue
            meta = ArrayMeta.from_v2(zarray, metadata.get(f"{where}/.zattrs"))
            self._at(root, where.rpartition("/")[0]).arrays[name] = VArray(meta, self._refs(spark, folder, where, meta, record))
        return root.group(self.group)

    @staticmethod
    def _at(root: VGroup, path: str) -> VGroup:
        node = root
        for p in path.split("/"):
            if p:
                node = node.groups.setdefault(p, VGroup())
        return node

    def _refs(self, spark, folder: Folder, where: str, meta: ArrayMeta, record: int) -> DataFrame:
        if not any(n.startswith("refs.") for n in folder.list(where)):
            return VArray.empty(spark, meta).refs
        rows = spark.read.options(**self.reader_options).schema("path string, offset bigint, size bigint, raw binary").parquet(f"{folder.path}/{where}/refs.*.parq")
        linear = F.regexp_extract(F.col("_metadata.file_name"), r"refs\.(\d+)\.parq", 1).cast("bigint") * record + F.col("_metadata.row_index")
        rows = rows.select(linear.alias("at"), "path", "offset", "size", "raw").where("path is not null or raw is not null").where(F.col("at") < meta.n_chunks)
        idx, stride = [], 1
        for n in reversed(meta.grid):
            idx.insert(0, F.expr(f"(at div {stride}) % {n}"))
            stride *= n
        return rows.select(
            (F.array(*idx) if idx else F.array().cast("array<bigint>")).alias("idx"), keys.normalise_uri(F.col("path"), self.fs_root).alias("path"),
            F.when(F.col("raw").isNull(), F.col("offset")).otherwise(0).cast("bigint").alias("offset"), F.when(F.col("raw").isNull(), F.col("size")).otherwise(F.octet_length("raw")).cast("bigint").alias("length"), F.col("raw").alias("data"),
        )


def inline(data: bytes) -> str:
    return _BASE64 + base64.b64encode(data).decode()
