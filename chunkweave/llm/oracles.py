"""DuckDB SQL of the queries whose SQL is made from a rule."""

from __future__ import annotations

from . import sharding, url_filter

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def shards(n: int = sharding.SHARDS) -> str:
    """Shards by running sums over the order of keys; crc32 by its bitwise rule, a byte at a time."""
    bit = "xor({x} >> 1, 3988292384 * ({x} & 1))"
    step = "k"
    for _ in range(8):
        step = bit.format(x=step)
    return f"""
WITH crc AS (SELECT list({step} ORDER BY k) AS t FROM (SELECT unnest(generate_series(0, 255))::UBIGINT AS k)
), d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents
), u AS (SELECT DISTINCT text FROM d
), c AS (SELECT text, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(generate_series(0, octet_length(encode(text)) - 1), lambda i: ('0x' || substr(hex(encode(text)), 2 * i + 1, 2))::UBIGINT)),
    lambda a, b: xor(a >> 8, t[CAST(xor(a, b) & 255 AS BIGINT) + 1])), 4294967295::UBIGINT) AS text_crc32 FROM u, crc
), k AS (SELECT doc_id, octet_length(encode(text)) + 1 AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, ('0x' || substr(md5(text), 1, 15))::BIGINT AS key FROM d JOIN c USING (text)
), b AS (SELECT *, sum(size) OVER (ORDER BY key, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING) - size AS before, sum(size) OVER () AS total FROM k
), s AS (SELECT *, CAST(before * {n} // total AS INT) AS shard FROM b)
SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'bytes' AS law, shard, CAST(row_number() OVER (PARTITION BY shard ORDER BY key, doc_id NULLS FIRST) - 1 AS BIGINT) AS slot, CAST(NULL AS INT) AS grown_shard FROM s
"""


def urls(rules=url_filter.RULES, rounds: int = 400, damping: float = url_filter.DAMPING, threshold: float = url_filter.THRESHOLD) -> str:
    """Rules as a CASE; walks from the seeds, summed over so many rounds or until there are none."""

    def case(value: int) -> str:
        when = [f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{(h + p, v)[value]}'" for h, p, v in url_filter._longest_first(rules)]
        return f"CASE {' '.join(when)} END"

    host = lambda url: _LOWER.format(f"regexp_extract(substr({url}, instr({url}, '://') + 3), '^([^/?#]*)', 1)")
    return f"""
WITH RECURSIVE u AS (SELECT page_id, html, CASE WHEN instr(url, '://') > 0 THEN url ELSE '://' END AS url FROM pages
), p AS (SELECT page_id, html, {host("url")} AS host, regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) AS path FROM u
), r AS (SELECT *, {case(0)} AS rule, {case(1)} AS by_rule FROM p
), l AS (SELECT host AS src, unnest(regexp_extract_all(html, '(?i)\\shref\\s*=\\s*["'']?([^"''\\s>]+)', 1)) AS link FROM r
), a AS (SELECT src, CASE WHEN starts_with(link, '//') THEN 'x:' || link ELSE link END AS link FROM l WHERE regexp_matches(link, '^([A-Za-z][A-Za-z0-9+.-]*:)?//')
), edges AS MATERIALIZED (SELECT src, dst, count(*) AS n FROM (SELECT src, {host("link")} AS dst FROM a) WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY src, dst
), w AS MATERIALIZED (SELECT 'good' AS kind, src, dst, n / sum(n) OVER (PARTITION BY src) AS w FROM edges UNION ALL SELECT 'bad', dst, src, n / sum(n) OVER (PARTITION BY dst) FROM edges
), seeds AS (SELECT host, avg(CASE WHEN by_rule = 'allow' THEN 1.0 ELSE 0.0 END) AS good, avg(CASE WHEN by_rule = 'block' THEN 1.0 ELSE 0.0 END) AS bad FROM r WHERE host <> '' GROUP BY host
  UNION ALL SELECT host, CASE WHEN by_rule = 'allow' THEN 1.0 ELSE 0.0 END, CASE WHEN by_rule = 'block' THEN 1.0 ELSE 0.0 END FROM (SELECT host, {case(1)} AS by_rule FROM (SELECT DISTINCT dst AS host, '/' AS path FROM edges))
), hosts AS (SELECT host, CAST(max(good) AS DOUBLE) AS good, CAST(max(bad) AS DOUBLE) AS bad FROM seeds GROUP BY host
), walks AS (SELECT 0 AS k, 'good' AS kind, host, good / sum(good) OVER () AS x FROM hosts WHERE good > 0 UNION ALL SELECT 0, 'bad', host, bad / sum(bad) OVER () FROM hosts WHERE bad > 0
  UNION ALL SELECT any_value(walks.k) + 1, walks.kind, w.dst, {damping} * sum(w.w * walks.x) FROM walks JOIN w ON w.src = walks.host AND w.kind = walks.kind WHERE walks.k < {rounds} GROUP BY walks.kind, w.dst
), ranks AS (SELECT kind, host, sum(x) / sum(sum(x)) OVER (PARTITION BY kind) AS rank FROM walks GROUP BY kind, host
), v AS (SELECT host, coalesce(sum(rank) FILTER (kind = 'bad'), 0.0) > {threshold} * coalesce(sum(rank) FILTER (kind = 'good'), 0.0) AS bad FROM ranks GROUP BY host
)
SELECT page_id, r.host, path, rule, coalesce(by_rule, CASE WHEN v.bad THEN 'block' ELSE 'allow' END) AS verdict FROM r LEFT JOIN v USING (host)
"""
