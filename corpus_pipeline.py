"""Corpus pipeline: language, quality, near duplicates, benchmark passages, then tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``docs`` and only choose among its rows.  Between stages rows are written as Parquet and read again.

Cases: rows whose text is null or has no letter are of no language and go, and so do all rows where there is
nothing to learn languages from; without usable labels no row is of bad quality; of a component of near-equal texts
the row with the smallest id stays (rows without an id come last, then the smaller hash of the text decides), once,
though it stand there many times; rows without words have no near duplicates; the token stage encodes a null text as an empty one
and keeps null and repeated ids; empty tables pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkweave.llm import base, bpe_codec, decontaminate, lang_id, ngram_join, quality

#: Languages that stay, and the least score of the prediction.
LANGUAGES, LEAST_SCORE = ("en",), 0.5
#: Words of a shingle, and similarity in per cent from which texts are near duplicates; op2 has its own.
NEAR_SIZE, NEAR_PER_CENT = 5, 80


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text is predicted to be in one of ``LANGUAGES``."""
    found = lang_id.predict(F.col("text"), lang_id.train(docs.where(~base.held_out(3, 1))), spark)
    return docs.withColumn("__found", found).where(F.col("__found.lang_pred").isin(*LANGUAGES) & (F.col("__found.score") >= LEAST_SCORE)).select(docs.columns)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality classifier, learnt from the labelled ones, calls good."""
    model = quality.train(docs, base.table(spark, sf_dir, "labels").where(~base.held_out(4, 2)))
    return docs.where(quality.predict(F.col("text"), model, spark) >= quality.GOOD) if model["tables"] else docs


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near-equal texts."""

    def decided() -> DataFrame:
        """doc_id and text_hash of what goes, or stands there several times: whether it is its component's first."""
        found = ngram_join.classes(docs, size=NEAR_SIZE, per_cent=NEAR_PER_CENT).where("root is not null")
        rows = found.groupBy("root", "doc_id", "text_hash").agg(F.count("*").alias("times"))
        order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("text_hash"))
        best = rows.groupBy("root").agg(F.min(order).alias("best"))
        return rows.join(best, "root").select("doc_id", "text_hash", "times", (order == F.col("best")).alias("first")).where("not first or times > 1")

    known = base.settled(decided, "near-duplicates")
    keyed = docs.withColumn("__hash", F.xxhash64("text"))
    same = keyed["doc_id"].cast("long").eqNullSafe(known["doc_id"]) & (keyed["__hash"] == known["text_hash"])
    kept = keyed.join(known, same, "left_anti").select(docs.columns)
    again = known.where("first")
    if again.isEmpty():
        return kept
    # of rows alike in id and text the one with the smallest hash of all columns
    one = keyed.join(again, same, "left_semi").groupBy("doc_id", "__hash").agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("__row"))
    return kept.unionByName(one.select("__row.*"))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a passage of the benchmark."""
    items = base.table(spark, sf_dir, "benchmark")
    hit = base.settled(lambda: decontaminate.matches(docs, items).where("size(spans) > 0").select("doc_id").distinct(), "contaminated")
    return docs.alias("d").join(hit.alias("h"), F.expr("d.doc_id <=> h.doc_id"), "left_anti")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token ids and digests of each row."""
    path = bpe_codec.default_path()
    full = docs.select("doc_id", bpe_codec.token_ids(F.col("text"), path).alias("t"))
    return full.select("doc_id", F.size("t.ids").cast("long").alias("n_tokens"), F.col("t.ids").alias("token_ids"), "t.decoded_sha256")


STAGES = [
    ("language", language),
    ("good_quality", good_quality),
    ("without_near_duplicates", without_near_duplicates),
    ("without_benchmark", without_benchmark),
    ("tokens", tokens),
]

#: SQL can express neither the language model nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = base.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = base.stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
