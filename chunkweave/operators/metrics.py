"""Small reductions over references."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def grid_from_keys(refs: DataFrame, ndim: int) -> tuple[int, ...]:
    """Grid shape from the indexes that are there: the largest on each axis plus one."""
    row = refs.agg(*[F.max(F.get("idx", F.lit(a))).alias(f"m{a}") for a in range(ndim)]).first() if ndim else ()
    return tuple((m if m is not None else -1) + 1 for m in row)


def refs_per_file(refs: DataFrame) -> DataFrame:
    """path, n_refs, n_bytes, first_off of each file."""
    return refs.where("data is null").groupBy("path").agg(F.count("*").alias("n_refs"), F.sum("length").cast("bigint").alias("n_bytes"), F.min("offset").alias("first_off"))


def missing_ratio(refs: DataFrame, n_chunks: int) -> float:
    return 1 - refs.count() / n_chunks if n_chunks else 0.0


def distinct_files(refs: DataFrame, exact: bool = True) -> int:
    f = F.countDistinct("path") if exact else F.approx_count_distinct("path")
    return refs.where("data is null").agg(f.alias("n")).first()["n"]


def grid_column(shape, chunks):
    """Chunks along each axis, as a Column of an array."""
    return F.zip_with(shape, chunks, lambda s, c: F.floor((s + c - 1) / c).cast("bigint"))


def dense_count(grid):
    """Grid positions, as a Column of a grid array."""
    return F.aggregate(grid, F.lit(1).cast("bigint"), lambda a, x: a * x)


def not_contiguous(refs: DataFrame, end: str = "length") -> DataFrame:
    """path, idx of references that don't begin where the file's previous one ends: lead over each file's references."""
    from pyspark.sql import Window

    order = Window.partitionBy("path").orderBy("offset", "idx")
    return refs.withColumn("next_", F.lead("offset").over(order)).where(F.col("next_").isNotNull() & (F.col("offset") + F.col(end) != F.col("next_")))
