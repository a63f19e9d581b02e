"""Virtual arrays made from the shared tables, so that array operators can be checked against SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..meta import ArrayMeta
from ..varray import VArray


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _none():
    return F.lit(None).cast("binary").alias("data")


def lineitem_grid(spark: SparkSession, sf: str, where: str | None = None, chunks=(1, 1)) -> VArray:
    """Sparse grid of orders by line numbers; a supplier is a file."""
    li = table(spark, sf, "lineitem")
    n = li.agg(F.max("l_orderkey").alias("m")).first()["m"] + 1
    if where:
        li = li.where(where)
    refs = li.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_suppkey").alias("s"), (F.min("l_partkey") * 100).alias("offset"), F.sum("l_quantity").cast("bigint").alias("length")).select(
        F.array(F.col("l_orderkey").cast("bigint"), (F.col("l_linenumber") - 1).cast("bigint")).alias("idx"), F.concat(F.lit("s3://lake/supp-"), F.col("s").cast("string"), F.lit(".nc")).alias("path"), "offset", "length", _none()
    )
    return VArray(ArrayMeta((n * chunks[0], 7 * chunks[1]), chunks, "<f8", dims=("order", "line")), refs)


def documents_1d(spark: SparkSession, sf: str, chunk: int = 1) -> VArray:
    """Dense 1-D array of documents; a source is a file, offsets are prefix sums; short texts are inlined."""
    from pyspark.sql import Window

    d = table(spark, sf, "documents")
    n = d.count()
    before = F.coalesce(F.sum("n_chars").over(Window.partitionBy("source").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inline = F.col("n_chars") < 64
    refs = d.select(
        F.array(F.col("doc_id").cast("bigint")).alias("idx"), F.when(~inline, F.concat(F.lit("file:///corpus/"), "source", F.lit(".txt"))).alias("path"), before.cast("bigint").alias("offset"),
        F.col("n_chars").alias("length"), F.when(inline, F.encode("text", "utf-8")).alias("data"),
    )
    return VArray(ArrayMeta((n * chunk,), (chunk,), "<f4", fill_value="NaN", dims=("doc",)), refs)


def event_days(spark: SparkSession, sf: str) -> DataFrame:
    """file, label: the days of each type of event."""
    return table(spark, sf, "events").select(F.col("event_type").alias("file"), F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).cast("bigint").alias("label")).distinct()


def order_days(spark: SparkSession, sf: str, status: str) -> DataFrame:
    """pos, label: the days of the orders of one status, in order."""
    from pyspark.sql import Window

    o = table(spark, sf, "orders").where(F.col("o_orderstatus") == status).select(F.datediff(F.col("o_orderdate").cast("date"), F.lit("1990-01-01").cast("date")).cast("bigint").alias("label")).distinct()
    return o.select((F.row_number().over(Window.orderBy("label")) - 1).cast("bigint").alias("pos"), "label")


def document_arrays(spark: SparkSession, sf: str) -> DataFrame:
    """An array each document: name, shape, chunks, dtype, codec_fp, dims, fp."""
    d = table(spark, sf, "documents")
    return d.select(
        F.col("source").alias("name"), F.col("doc_id").alias("file"), F.array("n_chars").alias("shape"), F.array(F.when(F.col("lang") == "en", F.lit(512)).otherwise(F.lit(1024)).cast("bigint")).alias("chunks"),
        F.when(F.col("lang") == "fr", "<f4").otherwise("<f8").alias("dtype"), F.md5(F.col("lang").cast("binary")).alias("codec_fp"), F.array(F.when(F.col("lang") == "de", F.col("source")).otherwise(F.lit("x"))).alias("dims"),
        F.concat_ws("/", "source", "lang").alias("fp"),
    )
