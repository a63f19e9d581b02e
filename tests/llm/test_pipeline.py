"""The pipeline's stages against their operators, and the registry."""

from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from chunkweave.llm import bpe_codec, quality
from chunkweave.llm.registry import ORACLES, QUERIES

from .test_table_operators import brute_components, brute_hits
from .test_text_operators import brute_language


def test_registry():
    numbers = [int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op")]
    assert sorted(numbers) == list(range(1, 11)) and "pipeline" in QUERIES and set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracles(spark, sf, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = c.sql(ORACLES[name]).df()
    got = QUERIES[name](spark, sf).toPandas()
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)
    text = lambda df: sorted(tuple("null" if x is None or str(x) in ("nan", "<NA>") else str(x) for x in r) for r in df[columns].astype(object).values.tolist())
    assert text(got) == text(want)


def one_of_each(given, size=5, per_cent=80):
    """Brute force of the near-duplicate stage for distinct ids: the smallest of each component."""
    return {i for i, _, c in brute_components(given, size, per_cent) if i == c}


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        given = [(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()]
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        kept = {r["doc_id"] for r in out.collect()}
        if k == 0:
            found = brute_language(given, sorted({x for _, _, x in given if x}))
            want = {g[0] for g, (lang, score) in zip(given, found, strict=True) if lang == "en" and score >= 0.5}
        elif k == 1:
            want = {r["doc_id"] for r in quality.classify(docs, spark.read.parquet(f"{sf}/labels.parquet")).where("predicted = 1").collect()}
        elif k == 2:
            want = one_of_each([g[:2] for g in given])
        else:
            items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            want = {r[0] for r in brute_hits([g[:2] for g in given], items)[0] if not r[-1]}
        assert kept == want and len(kept) < len(given)
        docs = spark.createDataFrame(out.collect(), docs.schema)
    got = corpus_pipeline.run(spark, sf)
    assert {r["doc_id"] for r in got.collect()} == {r["doc_id"] for r in docs.collect()}
    both = got.join(bpe_codec.encode_documents(docs).withColumnRenamed("n_tokens", "want"), "doc_id")
    assert both.where("want <> n_tokens or size(token_ids) <> want").count() == 0


def test_no_language(spark, edge_docs, sf):
    """With nothing to learn from all rows go; null and letterless texts go in any case."""
    assert not corpus_pipeline.language(spark, edge_docs.withColumn("lang", F.lit(None).cast("string")), sf).collect()
    stay = corpus_pipeline.language(spark, edge_docs.withColumn("lang", F.lit("en")), sf).collect()
    assert stay and all(any(c.isalpha() for c in r["text"] or "") for r in stay)
    assert not corpus_pipeline.language(spark, edge_docs.withColumn("lang", F.lit("fr")), sf).collect()


def test_repeated_ids(spark, sf):
    """One id on several texts, rows without an id, and rows that differ in other columns alone: each row is judged by its own text."""
    a, b, c = ("one two three four five six seven eight nine ten", "other words of another text that nobody else has at all", "third kind of text with its own words and nothing more here")
    docs = [(1, a, "x"), (5, a, "x"), (5, b, "x"), (5, b, "y"), (None, b, "x"), (None, c, "x"), (None, c, "z"), (2, "", "x"), (2, "", "x"), (5, a + " eleven", "q")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    for given in (df, df.orderBy(F.desc("source"), "text")):
        out = [tuple(r) for r in corpus_pipeline.without_near_duplicates(spark, given, sf).collect()]
        assert sorted(out, key=str)[:2] == [(1, a, "x"), (2, "", "x")] and sorted(map(str, (r[0] for r in out))) == ["1", "2", "2", "5", "None"]
        assert {r[1] for r in out if r[0] in (5, None)} == {b, c}
        first = first if given is not df else out
    assert Counter(first) == Counter(out)


def test_near_duplicates_of_five_words(spark, sf):
    """The stage alone, over all documents: shingles of five words, similarity 0.8 or more."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    given = [(r["doc_id"], r["text"]) for r in docs.collect()]
    kept = {r["doc_id"] for r in corpus_pipeline.without_near_duplicates(spark, docs, sf).collect()}
    want, narrow = one_of_each(given), one_of_each(given, 3, 90)
    assert kept == want and want < narrow


def test_edges(spark, edge_docs, no_docs, tmp_path):
    for t, schema in (("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{t}.parquet")
    for docs in (edge_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns
            out.collect()
        corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    one = corpus_pipeline.without_near_duplicates(spark, edge_docs, str(tmp_path)).collect()
    ids = [r["doc_id"] for r in one]
    assert ids.count(11) == 1 and 6 in ids and 12 not in ids and 13 not in ids and 2 in ids and 1 in ids and ids.count(None) == 2
