"""Driver-facing query catalogue: array operators over the shared tables, each with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys
from ..operators import align, checks, combine, compare, metrics
from ..read import cf_column
from ..sinks.kerchunk import ref_rows
from ..varray import VArray
from . import manifests as M

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The tables' arrays in SQL.
_M1 = """SELECT CAST(l_orderkey AS BIGINT) AS i0, CAST(l_linenumber - 1 AS BIGINT) AS i1, concat('s3://lake/supp-', CAST(min(l_suppkey) AS VARCHAR), '.nc') AS path,
  CAST(min(l_partkey) * 100 AS BIGINT) AS off, CAST(sum(l_quantity) AS BIGINT) AS len FROM lineitem {where} GROUP BY 1, 2"""
_WITH = f"WITH m1 AS ({_M1.format(where='')}), n AS (SELECT max(l_orderkey) + 1 AS n0 FROM lineitem) "
_WITH_R = f"WITH m1 AS ({_M1.format(where='')}), r AS ({_M1.format(where="WHERE l_returnflag = 'R'")}) "
_DOCS = """WITH d AS (SELECT doc_id AS i0, CASE WHEN n_chars >= 64 THEN concat('file:///corpus/', source, '.txt') END AS path, n_chars AS len, text,
  CAST(coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS off, source, lang FROM documents),
  n AS (SELECT count(*) AS n0 FROM documents) """


def query(name: str, sql: str):
    def add(f):
        QUERIES[name] = f
        ORACLES[name] = sql
        return f

    return add


def flat(arr: VArray) -> DataFrame:
    """i0, i1, ..., path, off, len."""
    return arr.refs.select(*[F.get("idx", F.lit(a)).alias(f"i{a}") for a in range(arr.ndim)], "path", F.col("offset").alias("off"), F.col("length").alias("len"))


# selection


@query("slice_refs_per_file", _WITH + "SELECT path, count(*) AS n_refs, CAST(sum(len) AS BIGINT) AS n_bytes, min(off) AS first_off FROM m1 WHERE i0 >= 40 AND i0 < 1040 GROUP BY path")
def _(s, sf):
    return metrics.refs_per_file(M.lineitem_grid(s, sf)[40:1040, :].refs)


@query("slice_aligned", _WITH + "SELECT i0 - 40 AS i0, i1 - 2 AS i1, path, off, len FROM m1 WHERE i0 >= 40 AND i0 < 1040 AND i1 >= 2 AND i1 < 5")
def _(s, sf):
    return flat(M.lineitem_grid(s, sf)[40:1040, 2:5])


@query("slice_partial_end", _WITH + "SELECT i0 - (SELECT n0 - 100 FROM n) AS i0, i1, path, off, len FROM m1 WHERE i0 >= (SELECT n0 - 100 FROM n)")
def _(s, sf):
    return flat(M.lineitem_grid(s, sf)[-100:, ...])


@query("slice_empty", _WITH + "SELECT i0, i1, path, off, len FROM m1 WHERE false")
def _(s, sf):
    return flat(M.lineitem_grid(s, sf)[2:2, :])


@query("int_index", _WITH + "SELECT i0, path, off, len FROM m1 WHERE i1 = 3")
def _(s, sf):
    return flat(M.lineitem_grid(s, sf)[:, 3])


@query("int_index_negative", _WITH + "SELECT i0, path, off, len FROM m1 WHERE i1 = 6")
def _(s, sf):
    return flat(M.lineitem_grid(s, sf)[:, -1])


@query("newaxis", _WITH + "SELECT CAST(0 AS BIGINT) AS i0, i0 AS i1, CAST(0 AS BIGINT) AS i2, i1 AS i3, path, off, len FROM m1")
def _(s, sf):
    return flat(M.lineitem_grid(s, sf)[None, :, None, :])


@query("sub_chunk_shift", _WITH + "SELECT i0 - 10 AS i0, i1, path, off + 1 * 8 AS off, CAST(2 * 8 AS BIGINT) AS len FROM m1 WHERE i0 = 10")
def _(s, sf):
    return flat(M.lineitem_grid(s, sf, chunks=(4, 1))[41:43, :])


# union-like


@query("concat_axis0", _WITH + "SELECT * FROM m1 UNION ALL SELECT i0 + (SELECT n0 FROM n), i1, path, off, len FROM m1")
def _(s, sf):
    a = M.lineitem_grid(s, sf)
    return flat(combine.concatenate([a, a], 0))


@query("concat_axis1", _WITH_R + "SELECT * FROM m1 UNION ALL SELECT i0, i1 + 7, path, off, len FROM r UNION ALL SELECT i0, i1 + 14, path, off, len FROM m1")
def _(s, sf):
    a, b = M.lineitem_grid(s, sf), M.lineitem_grid(s, sf, "l_returnflag = 'R'")
    return flat(combine.concatenate([a, b, a], -1))


@query("stack_axis0", _WITH_R + "SELECT CAST(0 AS BIGINT) AS i0, i0 AS i1, i1 AS i2, path, off, len FROM m1 UNION ALL SELECT 1, i0, i1, path, off, len FROM r")
def _(s, sf):
    return flat(combine.stack([M.lineitem_grid(s, sf), M.lineitem_grid(s, sf, "l_returnflag = 'R'")], 0))


@query("stack_axis1", _WITH_R + "SELECT i0, CAST(0 AS BIGINT) AS i1, i1 AS i2, path, off, len FROM m1 UNION ALL SELECT i0, 1, i1, path, off, len FROM r")
def _(s, sf):
    return flat(combine.stack([M.lineitem_grid(s, sf), M.lineitem_grid(s, sf, "l_returnflag = 'R'")], 1))


@query("stack_then_index", _WITH_R + "SELECT i0, i1, path, off, len FROM r")
def _(s, sf):
    return flat(combine.stack([M.lineitem_grid(s, sf), M.lineitem_grid(s, sf, "l_returnflag = 'R'")], -1)[:, :, 1])


@query("expand_dims", _WITH + "SELECT i0, i1, CAST(0 AS BIGINT) AS i2, path, off, len FROM m1")
def _(s, sf):
    return flat(combine.expand_dims(M.lineitem_grid(s, sf), 2))


@query("broadcast_prepend", _WITH + "SELECT k AS i0, i0 AS i1, i1 AS i2, path, off, len FROM m1, (SELECT unnest(generate_series(0, 2)) AS k)")
def _(s, sf):
    a = M.lineitem_grid(s, sf)
    return flat(combine.broadcast_to(a, (3, *a.meta.shape)))


@query("broadcast_expand", _WITH + "SELECT i0, k AS i1, path, off, len FROM (SELECT * FROM m1 WHERE i1 = 2), (SELECT unnest(generate_series(0, 5)) AS k)")
def _(s, sf):
    a = M.lineitem_grid(s, sf)[:, 2:3]
    return flat(combine.broadcast_to(a, (a.meta.shape[0], 6)))


@query("fill_only_concat", _WITH + "SELECT i0 + (SELECT n0 FROM n) AS i0, i1, path, off, len FROM m1")
def _(s, sf):
    a = M.lineitem_grid(s, sf)
    return flat(combine.concatenate([a.with_fill_value_only("NaN"), a], 0))


@query("concat_many_files", """WITH t AS (SELECT DISTINCT event_type AS file, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS label FROM events),
  f AS (SELECT file, count(*) AS g FROM t GROUP BY file), s AS (SELECT file, coalesce(sum(g) OVER (ORDER BY file ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS st FROM f)
  SELECT t.file, CAST(row_number() OVER (PARTITION BY t.file ORDER BY label) - 1 + st AS BIGINT) AS i0, CAST(label AS BIGINT) AS label FROM t JOIN s USING (file)""")
def _(s, sf):
    from pyspark.sql import Window

    t = M.event_days(s, sf)
    refs = t.select("file", "label", F.array((F.row_number().over(Window.partitionBy("file").orderBy("label")) - 1).cast("bigint")).alias("idx"))
    files = t.groupBy("file").agg(F.count("*").alias("grid_len")).withColumn("ord", F.col("file"))
    return combine.concat_files(refs, files, 0).select("file", F.get("idx", F.lit(0)).alias("i0"), "label")


# alignment


def _indexed(name: str, build, sql: str):
    @query(name, _DOCS + sql)
    def _(s, sf):
        a = M.documents_1d(s, sf, 2)
        n = a.grid[0]
        return flat(a[(build(n),)])


_indexed("reindex_append_null", lambda n: [*range(2 * n), *[-1] * 8], "SELECT i0, path, off, len FROM d")
_indexed("reindex_insert_gap", lambda n: [*range(100), *[-1] * 6, *range(100, 2 * n)], "SELECT CASE WHEN i0 < 50 THEN i0 ELSE i0 + 3 END AS i0, path, off, len FROM d")
_indexed("reindex_reorder", lambda n: [*range(2 * (n // 2), 2 * n), *range(2 * (n // 2))], "SELECT CASE WHEN i0 >= n0 // 2 THEN i0 - n0 // 2 ELSE i0 + n0 - n0 // 2 END AS i0, path, off, len FROM d, n")
_indexed("reindex_repeat", lambda n: [*range(2 * n), *range(2 * n)], "SELECT i0 + k AS i0, path, off, len FROM d, n, (SELECT unnest([0, 1]) AS t), LATERAL (SELECT t * n0 AS k)")


@query("reindex_reject_count", "SELECT count(*) AS n FROM (SELECT pos // 5 AS dst, min(pos + 1) AS low FROM (SELECT unnest(generate_series(0, 994)) AS pos) GROUP BY 1) WHERE low % 5 <> 0")
def _(s, sf):
    shifted = s.range(995).select(F.col("id").alias("pos"), (F.col("id") + 1).alias("src"))
    return align.chunk_map(shifted, 5, 1000).where("not ok").agg(F.count("*").alias("n"))


_DAYS = """WITH o AS (SELECT DISTINCT date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS label FROM orders WHERE o_orderstatus = 'O'),
  f AS (SELECT DISTINCT date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS label FROM orders WHERE o_orderstatus = 'F'),
  po AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS pos FROM o), pf AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS pos FROM f), """


def _aligned(how: str, labels: str):
    @query(f"align_{how}", _DAYS + f"""t AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS pos FROM ({labels}))
      SELECT CAST(t.pos AS BIGINT) AS pos, CAST(t.label AS BIGINT) AS label, CAST(coalesce(po.pos, -1) AS BIGINT) AS src_o, CAST(coalesce(pf.pos, -1) AS BIGINT) AS src_f FROM t LEFT JOIN po USING (label) LEFT JOIN pf USING (label)""")
    def _(s, sf):
        o, f = M.order_days(s, sf, "O"), M.order_days(s, sf, "F")
        t = align.join_labels([o, f], how)
        return t.join(align.positions(t, o).withColumnRenamed("src", "src_o"), "pos").join(align.positions(t, f).withColumnRenamed("src", "src_f"), "pos")


_aligned("outer", "SELECT label FROM o UNION SELECT label FROM f")
_aligned("inner", "SELECT label FROM o INTERSECT SELECT label FROM f")
_aligned("left", "SELECT label FROM o")
_aligned("right", "SELECT label FROM f")


@query("chunk_map_by_labels", """WITH t AS (SELECT pos, CASE WHEN pos < 40 THEN pos WHEN pos < 60 THEN -1 ELSE pos - 20 END AS src FROM (SELECT unnest(generate_series(0, 119)) AS pos))
  SELECT pos // 10 AS dst, min(src) // 10 AS src, true AS ok FROM t GROUP BY 1 HAVING max(src) >= 0""")
def _(s, sf):
    m = s.range(120).select(F.col("id").alias("pos"), F.expr("case when id < 40 then id when id < 60 then -1 else id - 20 end").alias("src"))
    return align.chunk_map(m, 10, 100)


@query("combine_by_coords", """WITH t AS (SELECT event_type AS file, min(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE))) AS a, max(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE))) AS b FROM events GROUP BY 1)
  SELECT file, CAST(a AS BIGINT) AS first, CAST(b AS BIGINT) AS last, CAST(dense_rank() OVER (ORDER BY a) - 1 AS BIGINT) AS ord, coalesce(lead(a) OVER (ORDER BY a, file) <= b, false) AS overlaps FROM t""")
def _(s, sf):
    return align.file_order(M.event_days(s, sf))


@query("sel_nearest", """WITH c AS (SELECT doc_id AS pos, doc_id * 10 AS label FROM documents), w AS (SELECT DISTINCT o_custkey * 7 + 3 AS label FROM orders)
  SELECT w.label, arg_min(c.pos, abs(c.label - w.label) * 1000000 + c.pos) AS pos FROM w, c WHERE abs(c.label - w.label) <= 10 GROUP BY w.label
  UNION ALL SELECT w.label, (SELECT max(pos) FROM c) FROM w WHERE w.label > (SELECT max(label) + 10 FROM c)""")
def _(s, sf):
    c = M.table(s, sf, "documents").select(F.col("doc_id").alias("pos"), (F.col("doc_id") * 10).alias("label"))
    w = M.table(s, sf, "orders").select((F.col("o_custkey") * 7 + 3).alias("label")).distinct()
    return align.nearest(c, w)


@query("missing_chunks", _WITH + "SELECT a AS i0, b AS i1 FROM (SELECT unnest(generate_series(0, (SELECT n0 - 1 FROM n))) AS a), (SELECT unnest(generate_series(0, 6)) AS b) WHERE NOT EXISTS (SELECT 1 FROM m1 WHERE i0 = a AND i1 = b)")
def _(s, sf):
    return align.missing_chunks(M.lineitem_grid(s, sf)).select(F.get("idx", F.lit(0)).alias("i0"), F.get("idx", F.lit(1)).alias("i1"))


# comparison and metrics


@query("elementwise_eq", _WITH_R + "SELECT coalesce(m1.i0, r.i0) AS i0, coalesce(m1.i1, r.i1) AS i1, m1.path IS NOT DISTINCT FROM r.path AND m1.off IS NOT DISTINCT FROM r.off AND m1.len IS NOT DISTINCT FROM r.len AS equal FROM m1 FULL JOIN r ON m1.i0 = r.i0 AND m1.i1 = r.i1")
def _(s, sf):
    e = compare.elementwise_eq(M.lineitem_grid(s, sf), M.lineitem_grid(s, sf, "l_returnflag = 'R'"))
    return e.select(F.get("idx", F.lit(0)).alias("i0"), F.get("idx", F.lit(1)).alias("i1"), "equal")


@query("manifest_equal", "SELECT true AS same, false AS other")
def _(s, sf):
    a, b = M.lineitem_grid(s, sf), M.lineitem_grid(s, sf, "l_returnflag = 'R'")
    return s.createDataFrame([(compare.refs_equal(a, a.rename_paths(lambda p: p)), compare.refs_equal(a, b))], "same boolean, other boolean")


@query("grid_shape_from_keys", _WITH + "SELECT max(i0) + 1 AS g0, max(i1) + 1 AS g1 FROM m1")
def _(s, sf):
    return s.createDataFrame([metrics.grid_from_keys(M.lineitem_grid(s, sf).refs, 2)], "g0 bigint, g1 bigint")


@query("grid_ceildiv", "SELECT doc_id AS file, (n_chars + c - 1) // c AS g FROM (SELECT doc_id, n_chars, CASE WHEN lang = 'en' THEN 512 ELSE 1024 END AS c FROM documents)")
def _(s, sf):
    return M.document_arrays(s, sf).select("file", metrics.dense_count(metrics.grid_column(F.col("shape"), F.col("chunks"))).alias("g"))


@query("ref_counts", _WITH + "SELECT CAST((SELECT n0 FROM n) * 7 AS BIGINT) AS dense, (SELECT count(*) FROM m1) AS there, CAST((SELECT n0 FROM n) * 7 * 32 AS BIGINT) AS nbytes_virtual, CAST((SELECT n0 FROM n) * 7 * 8 AS BIGINT) AS nbytes, (SELECT count(DISTINCT path) FROM m1) AS files")
def _(s, sf):
    a = M.lineitem_grid(s, sf)
    return s.createDataFrame([(a.n_refs_dense(), a.n_refs(), a.nbytes_virtual(), a.nbytes, metrics.distinct_files(a.refs))], "dense bigint, there bigint, nbytes_virtual bigint, nbytes bigint, files bigint")


@query("nbytes_inlined", _DOCS + "SELECT CAST(n0 * 32 + (SELECT sum(octet_length(encode(text))) FROM d WHERE path IS NULL) AS BIGINT) AS nbytes_virtual FROM n")
def _(s, sf):
    return s.createDataFrame([(M.documents_1d(s, sf).nbytes_virtual(),)], "nbytes_virtual bigint")


@query("refs_per_file", _WITH + "SELECT path, count(*) AS n_refs, CAST(sum(len) AS BIGINT) AS n_bytes, min(off) AS first_off FROM m1 GROUP BY path")
def _(s, sf):
    return metrics.refs_per_file(M.lineitem_grid(s, sf).refs)


# keys, paths, ranges


@query("rename_paths_literal", _DOCS + "SELECT i0, CASE WHEN path IS NOT NULL THEN 'file:///moved.nc' END AS path, off, len FROM d")
def _(s, sf):
    return flat(M.documents_1d(s, sf).rename_paths("/moved.nc"))


@query("rename_paths_expr", _WITH + "SELECT i0, i1, replace(path, 's3://lake/', 'https://mirror.example/') AS path, off, len FROM m1")
def _(s, sf):
    return flat(M.lineitem_grid(s, sf).rename_paths(F.replace("path", F.lit("s3://lake/"), F.lit("https://mirror.example/"))))


@query("key_format", _WITH + "SELECT concat(CAST(i0 AS VARCHAR), '.', CAST(i1 AS VARCHAR)) AS chunk_key, path, off, len FROM m1")
def _(s, sf):
    return M.lineitem_grid(s, sf).keyed().select("chunk_key", "path", F.col("offset").alias("off"), F.col("length").alias("len"))


@query("key_parse", "SELECT DISTINCT conv_id AS i0, turn AS i1 FROM conversations")
def _(s, sf):
    k = M.table(s, sf, "conversations").select(F.concat(F.lit("grp/var/c/"), F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string")).alias("k")).distinct()
    idx = keys.store_key_index(F.col("k"), "/")
    return k.select(F.get(idx, F.lit(0)).alias("i0"), F.get(idx, F.lit(1)).alias("i1"))


@query("key_validate", "SELECT k AS chunk_key FROM (SELECT DISTINCT concat(CAST(conv_id AS VARCHAR), CASE WHEN turn % 3 = 0 THEN '.' ELSE '' END, '.', CAST(turn AS VARCHAR)) AS k FROM conversations) WHERE contains(k, '..')")
def _(s, sf):
    k = M.table(s, sf, "conversations").select(F.concat(F.col("conv_id").cast("string"), F.when(F.col("turn") % 3 == 0, ".").otherwise(""), F.lit("."), F.col("turn").cast("string")).alias("chunk_key")).distinct()
    return keys.bad_keys(k)


@query("uri_normalise", """SELECT page_id, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN concat('file:///data/p', CAST(page_id AS VARCHAR), '.nc') WHEN 2 THEN concat('file:///srv/q', CAST(page_id AS VARCHAR), '.nc') ELSE concat('file:///srv/data/x/', CAST(page_id AS VARCHAR)) END AS uri,
  CASE page_id % 4 WHEN 0 THEN regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/]*)', 1) ELSE 'file://' END AS prefix FROM pages""")
def _(s, sf):
    n = F.col("page_id").cast("string")
    p = F.when(F.col("page_id") % 4 == 0, F.col("url")).when(F.col("page_id") % 4 == 1, F.concat(F.lit("/data/p"), n, F.lit(".nc"))).when(F.col("page_id") % 4 == 2, F.concat(F.lit("../q"), n, F.lit(".nc"))).otherwise(F.concat(F.lit("./x//"), n))
    return M.table(s, sf, "pages").select("page_id", keys.normalise_uri(p, "file:///srv/data/").alias("uri")).withColumn("prefix", keys.prefix_of(F.col("uri")))


def _range(name: str, args: dict, sql: str):
    @query(f"byte_range_{name}", _DOCS + f"SELECT i0, {sql} FROM d")
    def _(s, sf):
        off, n = keys.resolve_range(F.col("offset"), F.col("length"), **args)
        return M.documents_1d(s, sf).refs.select(F.get("idx", F.lit(0)).alias("i0"), off.alias("off"), n.alias("len"))


_range("range", {"start": 100, "end": 300}, "off + least(100, len) AS off, greatest(least(300, len) - least(100, len), 0) AS len")
_range("offset", {"start": 500}, "off + least(500, len) AS off, len - least(500, len) AS len")
_range("suffix", {"suffix": 250}, "off + len - least(250, len) AS off, least(250, len) AS len")


# checks


@query("container_violations", _WITH + "SELECT path, count(*) AS n FROM m1 WHERE NOT (starts_with(path, 's3://lake/supp-1') OR starts_with(path, 's3://lake/supp-2')) GROUP BY path")
def _(s, sf):
    return checks.container_violations(M.lineitem_grid(s, sf).refs, ["s3://lake/supp-1", "s3://lake/supp-2"]).groupBy("path").agg(F.count("*").alias("n"))


@query("compat_check", "SELECT source AS name, count(DISTINCT CASE WHEN lang = 'fr' THEN 1 ELSE 2 END) AS n_dtypes, count(DISTINCT lang) AS n_codecs, count(DISTINCT lang = 'en') AS n_chunk_shapes, CAST(1 AS BIGINT) AS n_ranks FROM documents GROUP BY source HAVING count(DISTINCT lang) > 1")
def _(s, sf):
    return checks.incompatible(M.document_arrays(s, sf))


@query("partial_chunk_check", "SELECT doc_id AS file FROM documents WHERE n_chars % CASE WHEN lang = 'en' THEN 512 ELSE 1024 END > 0")
def _(s, sf):
    return checks.partial_arrays(M.document_arrays(s, sf), 0).select("file")


@query("oversize_chunks", "SELECT doc_id AS file FROM documents WHERE n_chars < CASE WHEN lang = 'en' THEN 512 ELSE 1024 END")
def _(s, sf):
    return checks.oversize_arrays(M.document_arrays(s, sf)).select("file")


@query("merge_conflicts", "SELECT source AS name, count(DISTINCT lang) AS n FROM documents GROUP BY source HAVING count(DISTINCT lang) > 1")
def _(s, sf):
    return checks.name_conflicts(M.document_arrays(s, sf))


@query("default_loadables", "SELECT doc_id AS file, source AS name FROM documents WHERE lang = 'de'")
def _(s, sf):
    return checks.default_loadable(M.document_arrays(s, sf)).select("file", "name")


@query("absent_variables", "SELECT DISTINCT l.lang AS file, s.source AS name FROM (SELECT DISTINCT lang FROM documents) l, (SELECT DISTINCT source FROM documents) s WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.lang = l.lang AND d.source = s.source AND d.n_chars > 2000)")
def _(s, sf):
    d = M.table(s, sf, "documents")
    files, names = d.select(F.col("lang").alias("file")).distinct(), d.select(F.col("source").alias("name")).distinct()
    expected = files.join(F.broadcast(names.agg(F.collect_set("name").alias("names"))), how="cross").select("file", F.explode("names").alias("name"))  # names of variables: one row
    return checks.absent(expected, d.where("n_chars > 2000").select(F.col("lang").alias("file"), F.col("source").alias("name")).distinct())


# documents of references


@query("kerchunk_refs_rows", _WITH + """SELECT concat('v/', CAST(i0 AS VARCHAR), '.', CAST(i1 AS VARCHAR)) AS key, concat('["', path, '",', CAST(off AS VARCHAR), ',', CAST(len AS VARCHAR), ']') AS value FROM m1""")
def _(s, sf):
    return ref_rows(M.lineitem_grid(s, sf), "v")


@query("kerchunk_inline_base64", _DOCS + """SELECT concat('doc/', CAST(i0 AS VARCHAR)) AS key, CASE WHEN path IS NULL THEN concat('"base64:', base64(encode(text)), '"') ELSE concat('["', substr(path, 8), '",', CAST(off AS VARCHAR), ',', CAST(len AS VARCHAR), ']') END AS value FROM d""")
def _(s, sf):
    return ref_rows(M.documents_1d(s, sf), "doc")


@query("zip_contiguity", _DOCS + "SELECT i0, off, len FROM (SELECT *, lead(off) OVER (PARTITION BY path ORDER BY off, i0) AS nxt FROM d WHERE path IS NOT NULL) WHERE nxt IS NOT NULL AND off + len <> nxt")
def _(s, sf):
    return metrics.not_contiguous(M.documents_1d(s, sf).virtual_refs()).select(F.get("idx", F.lit(0)).alias("i0"), F.col("offset").alias("off"), F.col("length").alias("len"))


# values


@query("cf_decode", "SELECT event_id, CASE WHEN CAST(floor(value) AS BIGINT) = 7 THEN NULL ELSE round(CAST(CAST(floor(value) AS BIGINT) AS DOUBLE) * 0.5 + 10.0, 6) END AS value FROM events")
def _(s, sf):
    raw = F.floor("value").cast("bigint")
    return M.table(s, sf, "events").select("event_id", F.round(cf_column(raw, {"scale_factor": 0.5, "add_offset": 10.0, "_FillValue": 7}), 6).alias("value"))


from . import files  # noqa: E402,F401  adds its queries
