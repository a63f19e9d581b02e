"""Alignment: label joins, and reindexing by whole chunks.

Labels are relations (dim, pos, label), joined by equality.  A reindex turns positions into a map of chunks by
one aggregation, and the map joins the references.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.keys import at_axis
from ..meta import ceil_div
from ..varray import VArray
from . import ranges


def positions(target: DataFrame, source: DataFrame) -> DataFrame:
    """pos, src: for each row of ``target`` (pos, label) the position of its label in ``source``, or -1."""
    s = source.select(F.col("pos").alias("src"), F.col("label").alias("src_label"))
    return target.join(s, F.col("label") == F.col("src_label"), "left").select("pos", F.coalesce("src", F.lit(-1)).cast("bigint").alias("src"))


def join_labels(coords: list[DataFrame], how: str = "outer") -> DataFrame:
    """pos, label of the aligned axis of several ``coords`` (pos, label).

    outer and inner sort the labels; left and right take the first's or last's as they are; exact demands equality;
    override takes the first's and demands equal lengths.
    """
    if how in ("left", "right"):
        return (coords[0] if how == "left" else coords[-1]).select("pos", "label")
    if how in ("exact", "override"):
        for c in coords[1:]:
            if how == "override" and c.count() != coords[0].count():
                raise ValueError("cannot align with join='override': lengths differ")
            if how == "exact" and not coords[0].select("pos", "label").exceptAll(c.select("pos", "label")).unionAll(c.select("pos", "label").exceptAll(coords[0].select("pos", "label"))).isEmpty():
                raise ValueError("cannot align objects with join='exact' where labels differ")
        return coords[0].select("pos", "label")
    if how not in ("outer", "inner"):
        raise ValueError(f"unknown join {how!r}")
    tagged = [c.select("label").distinct() for c in coords]
    all_ = tagged[0]
    for t in tagged[1:]:
        all_ = all_.unionAll(t)
    grouped = all_.groupBy("label").agg(F.count("*").alias("n"))
    if how == "inner":
        grouped = grouped.where(F.col("n") == len(coords))
    return ranges.row_numbers(grouped.select("label"), "label", "pos").select("pos", "label")


def chunk_map(map_: DataFrame, chunk: int, source_len: int) -> DataFrame:
    """dst, src of each target chunk whose source is a whole chunk; a row with ok = false for a target that isn't chunk by chunk.

    map_: pos, src (-1 for none).  A target chunk of nothing but -1 gives no row.
    """
    g = map_.groupBy(F.expr(f"pos div {chunk}").alias("dst")).agg(
        F.min("src").alias("low"), F.max("src").alias("high"), F.count("*").alias("n"), F.sum((F.col("src") == -1).cast("int")).alias("none"),
        F.countDistinct(F.expr(f"src - pos % {chunk}")).alias("shifts"),
    )
    whole = (F.col("low") % chunk == 0) & (F.col("shifts") == 1) & (F.col("n") == F.least(F.lit(chunk), source_len - F.col("low"))) & (F.col("none") == 0)
    return g.where("none < n").select("dst", F.expr(f"low div {chunk}").alias("src"), whole.alias("ok"))


def chunk_map_of(indexer: list[int], chunk: int, source_len: int) -> list[int | None]:
    """The same for a list on the driver: source chunk of each target chunk, None for none."""
    out: list[int | None] = []
    for a in range(0, len(indexer), chunk):
        part = indexer[a : a + chunk]
        if all(p == -1 for p in part):
            out.append(None)
            continue
        first = part[0]
        n = min(chunk, source_len - first)
        if first < 0 or first % chunk or len(part) != n or part != list(range(first, first + n)):
            raise NotImplementedError(f"target positions {a}:{a + len(part)} don't follow chunk boundaries of the source")
        out.append(first // chunk)
    # a short chunk in the middle of the target would end there
    for k, src in enumerate(out[:-1]):
        if src is not None and min(chunk, source_len - src * chunk) < chunk:
            raise NotImplementedError(f"target chunk {k} takes a partial chunk, which doesn't follow chunk boundaries")
    return out


def moved(refs: DataFrame, axis: int, map_: DataFrame) -> DataFrame:
    """References whose chunk on ``axis`` goes from src to dst; one source may go to many targets."""
    m = map_.select(F.col("src").cast("bigint").alias("_src"), F.col("dst").cast("bigint").alias("_dst"))
    return refs.join(m, F.get("idx", F.lit(axis)) == F.col("_src")).withColumn("idx", at_axis(F.col("idx"), axis, lambda _: F.col("_dst"))).drop("_src", "_dst")


def reindex_axis(arr: VArray, axis: int, indexer: list[int]) -> VArray:
    """The array with the source positions ``indexer`` (-1: missing) along an axis, by whole chunks."""
    map_ = [(d, s) for d, s in enumerate(chunk_map_of(list(indexer), arr.chunks[axis], arr.shape[axis])) if s is not None]
    m = arr.spark.createDataFrame(map_, "dst bigint, src bigint")
    shape = tuple(len(indexer) if i == axis else s for i, s in enumerate(arr.shape))
    return arr.with_refs(moved(arr.refs, axis, m), shape=shape)


def reindex_to(arr: VArray, axis: int, source: DataFrame, target: DataFrame) -> VArray:
    """Reindex by relations of labels (pos, label), without a list on the driver."""
    m = chunk_map(positions(target, source), arr.chunks[axis], arr.shape[axis])
    if not m.where("not ok").isEmpty():
        raise NotImplementedError(f"Cannot align/reindex this virtual array along axis {axis}: labels don't follow chunk boundaries")
    n = target.count()
    partial = arr.shape[axis] % arr.chunks[axis]
    if partial and not m.where((F.col("src") == arr.grid[axis] - 1) & (F.col("dst") < ceil_div(n, arr.chunks[axis]) - 1)).isEmpty():
        raise NotImplementedError(f"Cannot align/reindex this virtual array along axis {axis}: a partial chunk would leave chunk boundaries")
    return arr.with_refs(moved(arr.refs, axis, m), shape=tuple(n if i == axis else s for i, s in enumerate(arr.shape)))


def missing_chunks(arr: VArray) -> DataFrame:
    """idx of the grid positions without a chunk."""
    if 0 in arr.grid:
        return arr.spark.createDataFrame([], "idx array<bigint>")
    # positions are numbered, so that making them is spread over the tasks
    idx, stride = [], 1
    for n in reversed(arr.grid):
        idx.insert(0, F.expr(f"(id div {stride}) % {n}"))
        stride *= n
    full = arr.spark.range(stride).select((F.array(*idx) if idx else F.array().cast("array<bigint>")).alias("idx"))
    return full.join(arr.refs.select("idx"), "idx", "left_anti")


def missing_mask(arr: VArray) -> np.ndarray:
    """Elements of missing chunks as a boolean array, for small arrays."""
    mask = np.zeros(arr.shape, bool)
    for r in missing_chunks(arr).toLocalIterator():
        mask[tuple(slice(i * c, (i + 1) * c) for i, c in zip(r["idx"], arr.chunks, strict=True))] = True
    return mask


def where(cond: np.ndarray, arr: VArray, fill) -> VArray:
    """``arr`` itself where ``~cond`` is exactly what is missing: it reads as fill there anyway."""
    if np.array_equal(~np.broadcast_to(np.asarray(cond, bool), arr.shape), missing_mask(arr)):
        return arr
    raise NotImplementedError("where() on a virtual array works only on the elements of missing chunks; it can't mask parts of chunks")


def coords_frame(spark: SparkSession, labels) -> DataFrame:
    """pos, label of a sequence of labels."""
    import pandas as pd

    values = np.asarray(labels)
    return spark.createDataFrame(pd.DataFrame({"pos": np.arange(len(values), dtype=np.int64), "label": values}))


def file_order(labels: DataFrame) -> DataFrame:
    """file, first, last, ord, overlaps of files by their coordinate: labels is (file, label)."""
    spans = ranges.in_buckets(labels.groupBy("file").agg(F.min("label").alias("first"), F.max("label").alias("last")), "first")
    rank = F.dense_rank().over(Window.partitionBy(ranges.BUCKET).orderBy("first")) - 1
    following = F.lead("first").over(Window.partitionBy(ranges.BUCKET).orderBy("first", "file"))
    # a row a bucket: distinct starts before it, and the first start after it
    every = spans.groupBy(ranges.BUCKET).agg(F.min("first").alias("_low"), F.countDistinct("first").alias("_n"))
    order = Window.orderBy(ranges.BUCKET)
    every = every.select(ranges.BUCKET, F.coalesce(F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.lead("_low").over(order).alias("_next"))
    found = spans.withColumns({"_rank": rank, "_following": following}).join(F.broadcast(every), ranges.BUCKET)
    overlaps = F.coalesce(F.coalesce("_following", "_next") <= F.col("last"), F.lit(False))
    return found.select("file", "first", "last", (F.col("_rank") + F.col("_before")).cast("bigint").alias("ord"), overlaps.alias("overlaps"))


def nearest(coords: DataFrame, wanted: DataFrame) -> DataFrame:
    """label, pos of the closest coordinate (pos, label) of each wanted label; of two as close, the lower.

    An ordered pass over both inside buckets of labels, without pairs; repeated wanted labels take part once.  A null
    wanted label gets the first coordinate's place, any gets null where there are no coordinates.
    """
    once = wanted.groupBy("label").agg(F.count("*").alias("n"))
    both = coords.select("label", F.col("pos").cast("bigint").alias("p"), F.lit(0).cast("bigint").alias("n")).where("label IS NOT NULL").unionByName(once.select("label", F.lit(None).cast("bigint").alias("p"), "n"))
    both = both.withColumn(ranges.BUCKET, ranges.bucket("label", ranges.bounds(both, "label"), both))
    mine = F.when(F.col("p").isNotNull(), F.struct("label", "p"))
    # a row a bucket: the closest coordinates outside of it
    order = Window.orderBy(ranges.BUCKET)
    edges = both.groupBy(ranges.BUCKET).agg(F.min(mine).alias("_low"), F.max(mine).alias("_high")).select(
        ranges.BUCKET,
        F.last("_high", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("_below"),
        F.first("_low", ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing)).alias("_above"),
    )
    inside = Window.partitionBy(ranges.BUCKET).orderBy("label", F.col("p").isNull(), "p")
    before = F.last(mine, ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(mine, ignorenulls=True).over(inside.rowsBetween(0, Window.unboundedFollowing))
    found = both.withColumns({"_before": before, "_after": after}).where("n > 0").join(F.broadcast(edges), ranges.BUCKET)
    found = found.select("label", "n", F.coalesce("_before", "_below").alias("before"), F.coalesce("_after", "_above").alias("after"))
    use_after = F.col("before").isNull() | (F.col("after").isNotNull() & (F.col("after.label") - F.col("label") < F.col("label") - F.col("before.label")))
    place = F.when(use_after, F.col("after.p")).otherwise(F.col("before.p"))
    return found.select("label", place.alias("pos"), "n").select("label", "pos", F.explode(F.sequence(F.lit(1).cast("bigint"), "n"))).select("label", "pos")
