"""Queries of this subpackage, by name, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from . import bpe_codec, decontaminate, lang_id, lattice_lm, media, ngram_join, oracles, quality, sharding, token_counts, url_filter
from .base import documents, table

QUERIES: dict = {}
ORACLES: dict = {}


def _query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


@_query("op3_media_columns")
def op3(spark, sf_dir):
    """PNG round trip and cosine-transform hash of every document."""
    return media.media_features(documents(spark, sf_dir))


@_query("op8_bpe_encoding")
def op8(spark, sf_dir):
    """Token ids and decoded text of every document, as digests."""
    return bpe_codec.encode_documents(documents(spark, sf_dir))


@_query("op5_quality_classifier")
def op5(spark, sf_dir):
    """Quality score of every document."""
    return quality.classify(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


@_query("op9_language_id")
def op9(spark, sf_dir):
    """Language of every document."""
    return lang_id.identify(documents(spark, sf_dir))


@_query("op6_sharding", oracles.shards())
def op6(spark, sf_dir):
    """Shard and slot of every document, law of near-equal bytes."""
    return sharding.shard(documents(spark, sf_dir))


@_query("op10_url_filters", oracles.urls())
def op10(spark, sf_dir):
    """Verdict on the url of every page."""
    return url_filter.judge(table(spark, sf_dir, "pages")).drop("trust", "distrust")


_OP1 = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), t AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), tw AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[i : i + 9], ' ') AS win
  FROM (SELECT item_id, ws, unnest(generate_series(1, greatest(1, len(ws) - 9))) AS i FROM t WHERE len(ws) > 0)
), sizes AS (SELECT DISTINCT n FROM tw), dw AS (
  SELECT doc_id, i, n, array_to_string(ws[i : i + n - 1], ' ') AS win
  FROM (SELECT doc_id, ws, n, unnest(generate_series(1, len(ws) - n + 1)) AS i FROM w, sizes WHERE len(ws) >= n)
), hits AS (
  SELECT doc_id, i, dw.n AS n, item_id FROM dw JOIN tw USING (win, n)
), cover AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM hits) GROUP BY doc_id
), its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY doc_id
)
SELECT w.doc_id, CAST(coalesce(len(ws), 0) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN cover USING (doc_id) LEFT JOIN its USING (doc_id)
"""


@_query("op1_decontamination", _OP1)
def op1(spark, sf_dir):
    """Benchmark phrases in every document."""
    return decontaminate.report(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


_OP2 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(ws[i : i + 2], ' ') AS g FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(1, len(ws) - 2))) AS i FROM w WHERE len(ws) > 0)
), n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS MATERIALIZED (
  SELECT a.doc_id AS x, b.doc_id AS y FROM s a JOIN s b USING (g) JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id WHERE a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 90 * (any_value(na.n) + any_value(nb.n) - count(*))
), r AS (
  SELECT doc_id, doc_id AS c FROM n UNION SELECT p.x, r.c FROM r JOIN p ON p.y = r.doc_id
)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(k.c, w.doc_id) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) k USING (doc_id)
"""


@_query("op2_ngram_jaccard_join", _OP2)
def op2(spark, sf_dir):
    """Components of near-equal documents."""
    return ngram_join.join(documents(spark, sf_dir))


@_query("op4_token_counts")
def op4(spark, sf_dir):
    """Token counts of every document before and after redaction."""
    return token_counts.redacted_counts(documents(spark, sf_dir))


@_query("op7_lattice_lm")
def op7(spark, sf_dir):
    """Subword-lattice probability of every document."""
    return lattice_lm.score(documents(spark, sf_dir))


@_query("pipeline")
def pipeline(spark, sf_dir):
    """All stages of the corpus pipeline."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
