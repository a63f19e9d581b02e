"""Order over a whole relation without a task that holds all of it.

Rows are put into buckets between bounds, which are values on the driver, so that every evaluation of a plan agrees on
them.  Windows run inside the buckets; what passes from one bucket to the next is a row a bucket, at most as many as
there are shuffle partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Values looked at for each bound.
PER_BOUND = 20

BUCKET = "_bucket"


def bounds(df: DataFrame, column: str) -> list:
    """Ascending values that cut ``column`` into about equal parts, from the values of lowest hash; fewer where there are few values."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    some = df.select(F.col(column).alias("v")).where("v IS NOT NULL").distinct().orderBy(F.xxhash64("v"), "v").limit(parts * PER_BOUND)
    values = [r["v"] for r in some.orderBy("v").collect()]
    step = max(PER_BOUND, -(-len(values) // parts))
    return values[step::step]


def bucket(column: str, cuts: list, df: DataFrame) -> Column:
    """How many bounds a value reaches; 0 for null."""
    if not cuts:
        return F.lit(0)
    kind = df.schema[column].dataType
    return F.size(F.filter(F.array(*[F.lit(c).cast(kind) for c in cuts]), lambda c: c <= F.col(column)))


def in_buckets(df: DataFrame, column: str) -> DataFrame:
    """``df`` with :data:`BUCKET`: rows of a lower bucket come before those of a higher one in the order of ``column``."""
    return df.withColumn(BUCKET, bucket(column, bounds(df, column), df))


def totals_before(df: DataFrame, total: Column, name: str) -> DataFrame:
    """BUCKET and the sum of the aggregate ``total`` over all lower buckets, as ``name``; a row a bucket."""
    earlier = Window.orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    return df.groupBy(BUCKET).agg(total.alias("_t")).select(BUCKET, F.coalesce(F.sum("_t").over(earlier), F.lit(0)).cast("bigint").alias(name))


def row_numbers(df: DataFrame, column: str, name: str) -> DataFrame:
    """``df`` with the place of each row, from 0, in the order of ``column``, whose values are distinct."""
    cut = in_buckets(df, column)
    before = totals_before(cut, F.count("*"), "_before")
    inside = F.row_number().over(Window.partitionBy(BUCKET).orderBy(column)) - 1
    return cut.withColumn("_inside", inside).join(F.broadcast(before), BUCKET).withColumn(name, (F.col("_inside") + F.col("_before")).cast("bigint")).drop("_inside", "_before", BUCKET)


def sums_before(df: DataFrame, column: str, value: str, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows that come before in the order of ``column``, whose values are distinct."""
    cut = in_buckets(df, column)
    before = totals_before(cut, F.sum(value), "_before")
    own = Window.partitionBy(BUCKET).orderBy(column).rowsBetween(Window.unboundedPreceding, -1)
    return cut.withColumn("_inside", F.coalesce(F.sum(value).over(own), F.lit(0))).join(F.broadcast(before), BUCKET).withColumn(name, (F.col("_inside") + F.col("_before")).cast("bigint")).drop("_inside", "_before", BUCKET)
