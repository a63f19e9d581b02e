"""Operators over whole tables, against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter as Count

import numpy as np
import pytest

from chunkweave.llm import decontaminate, ngram_join, sharding, url_filter

from .conftest import prose


def rows(df):
    return [r.asDict() for r in df.collect()]


# 1


def brute_hits(docs, items, window=10):
    rule = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")
    words = lambda t: rule.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
    windows = Count()
    held: dict = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            held.setdefault(tuple(w[k : k + window]), set()).add(i)
    sizes = {len(w) for w in held}
    out = Count()
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in held:
                    hit |= set(range(k, k + n))
                    found |= held[x]
        ids = sorted(str(x) for x in found if x is not None)
        out[i, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)] += 1
    return out, windows


@pytest.mark.parametrize("block_words", [500_000, 12])
def test_decontamination(spark, edge_docs, edge_rows, block_words):
    long = edge_rows[6][1].split()
    items = [(1, None), (2, ""), (3, "two WORDS"), (4, " ".join(long[100:130])), (5, " ".join(long[110:150])), (5, "the of"), (None, "straße"), (20, "two words"), (3, edge_rows[5][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = rows(decontaminate.report(edge_docs, bench, block_words=block_words))
    assert Count((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in got) == brute_hits(edge_rows, items)[0]


def test_no_benchmark(spark, edge_docs, edge_rows, no_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    got = rows(decontaminate.report(edge_docs, none))
    assert len(got) == len(edge_rows) and not any(r["contaminated"] for r in got)
    assert not rows(decontaminate.report(no_docs, spark.createDataFrame([(1, "a b")], "item_id long, text string")))


def test_segments_cut_anywhere(spark, edge_docs, edge_rows):
    """One index serves any benchmark, however it is cut."""
    for block in ([("a", [b"the", b"of"]), ("b", [b"and"])], [("c", ["straße".encode()]), (None, [b"nowhere"])]):
        whole = None
        for size in (1, 50_000, 10**9):
            got = sorted((str(r["doc_id"]), r["n_words"], len(r["spans"]), tuple(r["item_ids"])) for r in rows(decontaminate.search(decontaminate.index(edge_docs, segment_words=size), decontaminate.Phrases(block))))
            assert whole in (None, got)
            whole = got
        assert any(r[2] for r in whole)


def test_index_holds_all_terms(spark, edge_docs, edge_rows):
    seg = rows(decontaminate.index(edge_docs, segment_words=20_000))
    assert len(seg) > 1 and sum(int(np.frombuffer(r["counts"], np.uint32).sum()) for r in seg) == sum(len(decontaminate.words((t or "").encode())) for _, t in edge_rows)


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha x beta y gamma"), (2, "alpha beta gamma"), (3, "alpha x x x beta gamma"), (4, "gamma beta alpha")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "alpha beta gamma")], "item_id long, text string")
    near = lambda slop: {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in rows(decontaminate.matches(docs, items, slop=slop)) if r["spans"]}
    assert near(None) == {2: [(0, 3)]} == near(0)
    assert near(2) == {1: [(0, 5)], 2: [(0, 3)]} and set(near(3)) == {1, 2, 3}


def test_rarest_term_first():
    lists = {0: np.array([1, 5, 9, 20]), 1: np.array([6, 21]), 2: np.array([7, 22])}
    assert decontaminate.intersect(lists.get, (0, 1, 2), [1, 2, 0]).tolist() == [5, 20]


# 2


def brute_components(docs, size=3, per_cent=90):
    sets = []
    for _, t in docs:
        w = (t or "").translate({c: c + 32 for c in range(65, 91)})
        w = re.findall("[^\\x20\\x09-\\x0D]+", w)
        sets.append({tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set())
    root = list(range(len(docs)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            i = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * i >= per_cent * (len(sets[a]) + len(sets[b]) - i):
                root[max(top(a), top(b))] = min(top(a), top(b))
    out = Count()
    for k, (i, _) in enumerate(docs):
        ids = [docs[j][0] for j in range(len(docs)) if top(j) == top(k) and docs[j][0] is not None]
        out[i, len(sets[k]), (min(ids) if ids else None) if sets[k] else i] += 1
    return out


def components(df):
    return Count((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows(df))


def test_join_edges(edge_docs, edge_rows, no_docs):
    assert components(ngram_join.join(edge_docs)) == brute_components(edge_rows)
    assert not rows(ngram_join.join(no_docs))


@pytest.mark.parametrize("block,per_cent,most", [(2048, 90, 10**6), (4, 90, 10**6), (8, 80, 600)])
def test_join_families(spark, block, per_cent, most):
    """Families of edited copies, chains of them, a passage in most documents, and exact copies."""
    rnd = random.Random(block)
    vocabulary = [f"w{k}" for k in range(400)]
    passage = prose(rnd, 30, vocabulary)
    docs = []
    for _ in range(12):
        base = prose(rnd, rnd.choice([4, 30, 120, 400]), vocabulary).split()
        for _ in range(rnd.choice([1, 2, 9, 20])):
            w = list(base)
            for _ in range(rnd.choice([0, 0, 1, 2, 4])):
                w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
            docs.append(" ".join(w) + (" " + passage if rnd.random() < 0.5 else ""))
            if rnd.random() < 0.5:
                base = w  # a chain
    docs += [docs[0]] * 15
    rnd.shuffle(docs)
    given = list(enumerate(docs))
    assert components(ngram_join.join(spark.createDataFrame(given, "doc_id long, text string"), block=block, per_cent=per_cent, most=most)) == brute_components(given, per_cent=per_cent)


def test_bitmaps_lose_nothing():
    rnd = np.random.default_rng(1)
    for n in (1, 5, 40, 1400, 1600, 2900, 3100, 9000):
        a = np.unique(rnd.integers(0, 2**63, n, dtype=np.uint64))
        for edits in {0, n // 60, n // 25}:
            b = np.unique(np.concatenate([a[edits:], rnd.integers(0, 2**63, edits, dtype=np.uint64)]))
            i = len(np.intersect1d(a, b))
            linked = 100 * i >= 90 * (len(a) + len(b) - i)
            near = ngram_join.near_signs([ngram_join.sign(a), ngram_join.sign(b)], np.array([len(a), len(b)]), np.array([False, False]), True, 90)
            assert not linked or near.all()
    far = [np.unique(rnd.integers(0, 2**63, 3000, dtype=np.uint64)) for _ in range(2)]
    assert not ngram_join.near_signs([ngram_join.sign(x) for x in far], np.array([3000, 3000]), np.array([False, True]), False, 90).any()


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101), (5, 5)], "a long, b long")
    got = {r["node"]: r["root"] for r in rows(ngram_join.components(edges))}
    assert got == {k: 0 for k in range(1, 61)} | {101: 100}


# 6


def check_law(docs, got, shards=16):
    key = lambda t: int(hashlib.md5((t or "").encode()).hexdigest()[:15], 16)
    order = sorted(docs, key=lambda d: (key(d[1]), d[0] is not None, d[0] or 0))
    size = [len((t or "").encode()) + 1 for _, t in order]
    total, before, want, slots = sum(size), 0, Count(), Count()
    for (i, t), n in zip(order, size, strict=True):
        s = before * shards // total
        want[i, n, zlib.crc32((t or "").encode()), s] += 1
        before += n
        slots[s] += 1
    assert Count((r["doc_id"], r["size"], r["text_crc32"], r["shard"]) for r in got) == want
    assert all(sorted(r["slot"] for r in got if r["shard"] == s) == list(range(n)) for s, n in slots.items())
    assert all(r["law"] == "bytes" and r["grown_shard"] is None for r in got)


def test_sharding_edges(edge_docs, edge_rows, no_docs):
    check_law(edge_rows, rows(sharding.shard(edge_docs)))
    assert not rows(sharding.shard(no_docs))


@pytest.mark.parametrize("copies,range_rows", [(0, 1_000_000), (0, 40), (900, 1_000_000), (900, 25)])
def test_sharding_hot_text(spark, copies, range_rows):
    """A text that many rows share, a row that stands there many times, and fine ranges of few rows."""
    rnd = random.Random(2)
    docs = [(k, "the same text") for k in range(-400, 400)] + [(7, "the same row")] * copies + [(1000 + k, prose(rnd, rnd.choice([1, 5, 50]))) for k in range(900 - copies // 2)]
    rnd.shuffle(docs)
    got = rows(sharding.shard(spark.createDataFrame(docs, "doc_id long, text string"), range_rows=range_rows))
    check_law(docs, got)
    by = Count()
    for r in got:
        by[r["shard"]] += r["size"]
    assert max(by.values()) - min(by.values()) < 2 * max(r["size"] for r in got)


def test_key_edges():
    last = (1 << 64) - 1
    inside = sharding._Interval((5, last), 63, (1 << 63) - 1, 1, 1, 0, 0)
    assert inside.edge() == (5, last, (1 << 63) - 1) and inside.edge(beyond=True) == (6, 0, 0)
    assert sharding._Interval((), 12, 3, 1, 1, 0, 0).edge(beyond=True) == (4 << 48, 0, 0)
    keys = [(0, 0, 0), (0, 256, 0), (1, 0, 1), (1, 0, 256), (1 << 59, last, 5)]
    packed = sharding._packed(list(np.array(keys, dtype=np.uint64).T))
    assert (np.searchsorted(packed, packed, side="right") == np.arange(1, 6)).all()


# 10


def brute_rule(host, path):
    best = None
    for h, p, v in url_filter.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, v)
    return best


URLS = [None, "", "no scheme", "http://A.Example.NET/en/x?y#z", "https://example.net/EN/", "x://Example.com/de/1", "http://notexample.com/de/1", "http://org/fr/", "http://a.org?q=/fr/", "http://a.org#://b", "//a.net/", "http://net", "ftp://net/", "http://É.net/ü?", "a://b://c.net/d", "http://"]


def test_url_rules(spark):
    pages = spark.createDataFrame([(k, u, None, "x", "y", "z") for k, u in enumerate(URLS * 2)], "page_id long, url string, html string, host string, rule string, rank string")
    got = rows(url_filter.judge(pages))
    assert len(got) == 2 * len(URLS)
    for r in got:
        u = URLS[r["page_id"] % len(URLS)] or ""
        rest = u.split("://", 1)[1] if "://" in u else ""
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host) :])[0]
        host = host.translate({c: c + 32 for c in range(65, 91)})
        assert (r["host"], r["path"]) == (host, path)
        rule = brute_rule(host, path)
        assert r["rule"] == (rule[0] if rule else None)
        if rule:
            assert r["verdict"] == rule[1]
    assert not rows(url_filter.judge(pages.limit(0)))


def test_link_graph(spark):
    link = lambda *hosts: " ".join(f'<a href="https://{h}/x">x</a>' for h in hosts)
    pages = [(1, "http://good.org/fr/1", link("kept.dev") + '<a href="/own">'), (2, "http://kept.dev/1", ""), (3, "http://bad.net/1", ""), (4, "http://farm.dev/1", link("bad.net", "bad.net")), (5, "http://alone.dev/1", None), (6, "http://far.dev/1", link("farm.dev"))]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    assert {(r["src"], r["dst"], r["n"]) for r in rows(url_filter.host_edges(df))} == {("good.org", "kept.dev", 1), ("farm.dev", "bad.net", 2), ("far.dev", "farm.dev", 1)}
    got = {r["page_id"]: r["verdict"] for r in rows(url_filter.judge(df))}
    assert got == {1: "allow", 2: "allow", 3: "block", 4: "block", 5: "allow", 6: "block"}


def test_ranks_settle(spark):
    """Ranks of both kinds against the linear system; hosts without links, and hosts out of reach."""
    rnd = np.random.default_rng(6)
    n = 30
    w = np.where(rnd.random((n, n)) < 0.08, rnd.integers(1, 5, (n, n)), 0)
    np.fill_diagonal(w, 0)
    edges = spark.createDataFrame([(f"h{a}", f"h{b}", int(w[a, b])) for a in range(n) for b in range(n) if w[a, b]], "src string, dst string, n long")
    seeds = spark.createDataFrame([("good", "h1", 1.0), ("good", "h4", 0.5), ("bad", "h2", 1.0), ("bad", "h5", 0.0)], "kind string, host string, start double")
    got = {(r["kind"], r["host"]): r["rank"] for r in rows(url_filter.ranks(edges, seeds))}
    for kind, m, start in (("good", w, {1: 2 / 3, 4: 1 / 3}), ("bad", w.T, {2: 1.0})):
        out = m.sum(1, keepdims=True)
        x = np.linalg.solve(np.eye(n) - 0.85 * np.divide(m, out, where=out > 0, out=np.zeros(m.shape)).T, [start.get(k, 0.0) for k in range(n)])
        assert np.allclose([got.get((kind, f"h{k}"), 0.0) for k in range(n)], x / x.sum(), rtol=1e-8, atol=0)
    with pytest.raises(RuntimeError):
        url_filter.ranks(edges, seeds, most=8)
    assert not rows(url_filter.ranks(edges, seeds.limit(0)))


def test_link_graph_sql(spark):
    """Chains, a ring, a farm and a tie against the SQL twin; the hosts at the end of a long chain are judged by it."""
    duckdb = pytest.importorskip("duckdb")
    from chunkweave.llm import oracles

    link = lambda *hosts: " ".join(f'<a href="https://{h}/x">x</a>' for h in hosts)
    pages = [(f"http://h{k}.dev/1", link(f"h{k + 1}.dev")) for k in range(14)] + [("http://h14.dev/1", link("bad.net")), ("http://bad.net/1", ""), ("http://alone.dev/1", "")]
    pages += [("http://r1.dev/", link("r2.dev")), ("http://r2.dev/", link("r3.dev", "good.org")), ("http://r3.dev/", link("r1.dev", "bad.net", "bad.net"))]
    pages += [("http://good.org/fr/1", link("r1.dev", "t.dev")), ("http://t.dev/", link("bad.net")), (None, link("bad.net")), ("http://f.dev/", None)]
    df = spark.createDataFrame([(k, u, h) for k, (u, h) in enumerate(pages)], "page_id long, url string, html string")
    c = duckdb.connect()
    c.register("pages", df.toPandas())
    want = {r[0]: tuple(r[1:]) for r in c.sql(oracles.urls()).fetchall()}
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in rows(url_filter.judge(df))}
    assert got == want and all(got[k][3] == "block" for k in range(15)) and got[16][3] == "allow"


def test_native_plan(spark, sf):
    plan = url_filter.judge(spark.read.parquet(f"{sf}/pages.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
