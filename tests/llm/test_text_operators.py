"""Operators that work row by row, against the libraries and against brute force."""

import hashlib
import random
import zlib
from collections import Counter as Count

import numpy as np
import pytest
from pyspark.sql import functions as F

from chunkweave.llm import bpe_codec, lang_id, lattice_lm, media, quality, token_counts
from chunkweave.llm.registry import QUERIES


def rows(df):
    return [r.asDict() for r in df.collect()]


def by_text(df, edge_rows):
    """Result rows with the text they stem from: rows keep their number and ids."""
    out = rows(df)
    assert Count(r["doc_id"] for r in out) == Count(i for i, _ in edge_rows)
    return out


# 8


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe_codec.default_path())


def test_bpe_edges(edge_docs, edge_rows, library):
    got = by_text(bpe_codec.encode_documents(edge_docs), edge_rows)
    want = Count()
    for i, t in edge_rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert Count((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got) == want


def test_bpe_tree_is_exact():
    c, rnd = bpe_codec.Codec(bpe_codec.default_path()), random.Random(1)
    for _ in range(60):
        word = c._mapped("".join(rnd.choice(rnd.choice(["abc", "thein", "!#-", "eéo"])) for _ in range(rnd.randint(1, 1500))))
        assert c.encode_word(word, rnd.choice([3, 7, 20, 100])) == [t.value for t in c.tokenizer.model.tokenize(word)]


def test_bpe_text_tree(library):
    """Texts cut anywhere, joined again: the library's ids, whatever stands at a cut."""
    c, rnd = bpe_codec.Codec(bpe_codec.default_path()), random.Random(2)
    bits = ["a", "b", "'s", "'", "re", "'re", " ", "  ", "\n", "1", "é", "漢", "é", "İ", "!", "<|", "|>", "ll", "<|endoftext|>", "x" * 40, "ß", "Σ", "ς", "\x85", "😀", "²"]
    for k in range(600):
        text = "".join(rnd.choice([b for b in bits if k % 2 or not c.unsafe.search(b)]) for _ in range(rnd.randint(0, 150)))
        want = np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        for leaf in (1, 3, 17, 64):
            assert b"".join(c.packed[w] for w in c.text_words(text, leaf)) == want
    assert c.joins > 1000


def test_bpe_query_joins(spark, sf):
    """The leaf of the query is smaller than most texts: their ids come through joins."""
    texts = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    c = bpe_codec.Codec(bpe_codec.default_path())
    for t in texts:
        c.encode(t)
    assert c.joins >= sum(len(t) > bpe_codec.LEAF for t in texts) > len(texts) / 3


def test_bpe_full_output(edge_docs, library):
    out = rows(edge_docs.where("doc_id = 6").select(bpe_codec.encode(F.col("text"), bpe_codec.default_path()).alias("e"), "text"))
    assert out[0]["e"]["ids"] == library.encode(out[0]["text"], add_special_tokens=False).ids


def test_empty_tables(no_docs, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert not rows(bpe_codec.encode_documents(no_docs)) and not rows(media.media_features(no_docs)) and not rows(token_counts.redacted_counts(no_docs))
    assert not rows(lang_id.identify(no_docs)) and not rows(quality.classify(no_docs, labels)) and not rows(lattice_lm.score(no_docs))


# 3


def test_media_edges(edge_docs, edge_rows):
    texts = {}
    for r in by_text(media.media_features(edge_docs), edge_rows):
        for i, t in edge_rows:
            if i == r["doc_id"] and i is not None:
                b = (t or "").encode()
                p = b + b"\xff" * (max(1, -(-len(b) // 576)) * 576 - len(b))
                assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
                assert texts.setdefault(t or "", (r["media_sha256"], r["feature"], r["media_bytes"])) == (r["media_sha256"], r["feature"], r["media_bytes"])


def _filtered(samples, kinds, step):
    """Rows filtered as the format says, a byte at a time."""
    out = []
    for y, kind in enumerate(kinds):
        line = [kind]
        for x in range(samples.shape[1]):
            a = int(samples[y, x - step]) if x >= step else 0
            b = int(samples[y - 1, x]) if y else 0
            c = int(samples[y - 1, x - step]) if y and x >= step else 0
            p = a + b - c
            paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            line.append((int(samples[y, x]) - [0, a, b, (a + b) // 2, paeth][kind]) & 255)
        out.append(line)
    return np.array(out, np.uint8)


@pytest.mark.parametrize("step,colour", [(1, 0), (3, 2), (2, 4), (4, 6)])
def test_png_filters(step, colour):
    rnd = np.random.default_rng(step)
    samples = rnd.integers(0, 256, (12, 9 * step), dtype=np.uint8)
    lines = _filtered(samples, [k % 5 for k in range(12)], step)
    import struct

    png = media.MAGIC + media._chunk(b"IHDR", struct.pack(">IIBBBBB", 9, 12, 8, colour, 0, 0, 0)) + media._chunk(b"IDAT", zlib.compress(lines.tobytes())[:20]) + media._chunk(b"IDAT", zlib.compress(lines.tobytes())[20:]) + media._chunk(b"IEND", b"")
    assert (media.read_png(png) == samples).all()
    assert (media.read_png(media.write_png(samples, colour)) == samples).all()
    with pytest.raises(media.MediaError):
        media.unfiltered(np.array([[5, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12]], np.uint8), [1], step)


def _decoded(png):
    """Another reader of grey PNGs: chunks by struct, filters a byte at a time."""
    import struct

    at, body, size, kinds = 8, b"", None, []
    while at < len(png):
        n, kind = struct.unpack_from(">I4s", png, at)
        if kind == b"IHDR":
            size = struct.unpack_from(">II", png, at + 8)
        if kind == b"IDAT":
            body += png[at + 8 : at + 8 + n]
        at += 12 + n
    raw, out = zlib.decompress(body), []
    for y in range(size[1]):
        kind, *line = raw[y * (size[0] + 1) : (y + 1) * (size[0] + 1)]
        kinds.append(kind)
        own = []
        for x, v in enumerate(line):
            a, b, c = own[-1] if x else 0, out[-1][x] if y else 0, out[-1][x - 1] if y and x else 0
            p = a + b - c
            own.append((v + (0, a, b, (a + b) // 2, min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2])[kind]) % 256)
        out.append(own)
    return out, kinds


def _hashed(samples):
    """The hash by its definition: means of 32 x 32 fields, the transform as sums of cosines."""
    import math

    n, small = 32, np.array(samples, float)
    for axis in (0, 1):
        if small.shape[axis] < n:
            small = small.repeat(-(-n // small.shape[axis]), axis=axis)
        cut = [k * small.shape[axis] // n for k in range(n)] + [small.shape[axis]]
        small = np.stack([small.take(range(a, b), axis=axis).mean(axis=axis) for a, b in zip(cut, cut[1:], strict=False)], axis=axis)
    low = np.zeros((8, 8))
    for u in range(8):
        for v in range(8):
            wave = np.outer([math.cos(math.pi * u * (2 * k + 1) / 64) for k in range(n)], [math.cos(math.pi * v * (2 * k + 1) / 64) for k in range(n)])
            low[u, v] = (wave * small).sum() * (1 / 32) * (1 if u else 0.5**0.5) * (1 if v else 0.5**0.5) * 2
    return low


def test_media_by_another_reader(spark, edge_docs, edge_rows):
    """Stored bytes and features of texts of all kinds; several filters are in use, so unfiltering carries the result."""
    texts = ["", "a", "漢字 " * 300, "the same line of words\n" * 150, *[t for _, t in edge_rows[4:7] if t]]
    got = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    described = {r["doc_id"]: r for r in rows(media.media_features(got))}
    used = set()
    for k, png in enumerate(media.stores([t.encode() for t in texts])):
        samples, kinds = _decoded(png)
        used |= set(kinds)
        assert bytes(x for row in samples for x in row) == media.payload(texts[k].encode())
        assert described[k]["media_sha256"] == hashlib.sha256(png).hexdigest() and described[k]["media_bytes"] == len(png)
        low = _hashed(samples)
        bits = np.unpackbits(np.frombuffer(bytes.fromhex(described[k]["feature"]), np.uint8))
        median = np.median(low.ravel()[1:])
        clear = np.abs(low.ravel() - median) > 1e-4
        clear[0] = False
        assert ((low.ravel() > median) == bits)[clear].all() and not bits[0]
        # the filter of each row is one of the least sum
        s = np.array(samples)
        for y, kind in enumerate(kinds):
            cost = [np.abs(_filtered(s[max(0, y - 1) : y + 1], [0] * min(y, 1) + [f], 1)[-1, 1:].astype(np.int8).astype(int)).sum() for f in range(5)]
            assert kind == int(np.argmin(cost))
    assert len(used) >= 3


def test_png_damage():
    png = bytearray(media.store(b"hello"))
    for at in (0, 20, 50, len(png) - 5):
        bad = bytearray(png)
        bad[at] ^= 1
        with pytest.raises(media.MediaError):
            media.read_png(bytes(bad))
    with pytest.raises(media.MediaError):
        media.read_png(bytes(png[:-8]))


def test_hash_is_perceptual(spark):
    rnd = np.random.default_rng(7)
    coarse = rnd.integers(0, 256, (8, 8)).repeat(12, axis=0).repeat(12, axis=1).astype(float)
    a = np.clip(coarse, 6, 249).astype(np.uint8)
    b = np.clip(a.astype(int) + np.random.default_rng(0).integers(-6, 7, a.shape), 0, 255).astype(np.uint8)
    distance = lambda p, q: (np.unpackbits(np.frombuffer(p, np.uint8)) != np.unpackbits(np.frombuffer(q, np.uint8))).sum()
    assert distance(media.cosine_hash(a), media.cosine_hash(b)) <= 12 < distance(media.cosine_hash(a), media.cosine_hash(a.T[::-1].copy()))
    df = spark.createDataFrame([(bytearray(media.write_png(a)),), (None,)], "png binary").select(media.hash_column(F.col("png")).alias("h"))
    assert {None if r["h"] is None else bytes(r["h"]) for r in df.collect()} == {None, media.cosine_hash(a)}


# 4


@pytest.fixture(scope="module")
def counter():
    return token_counts.Counter(token_counts.default_path())


def test_tree_equals_recount(counter):
    rnd = random.Random(3)
    pieces = ["a", "b", " ", "  ", "\n", "'", "'s", "re", "1", "2", "!", "é", "\t", "'re ", "I'll"]
    make = lambda n: "".join(rnd.choice(pieces) for _ in range(n))
    for _ in range(300):
        s = make(rnd.choice([0, 1, 5, 30, 300, 1500]))
        t = token_counts.Tree(counter, s)
        for _ in range(6):
            a = rnd.randint(0, len(s))
            b, new = min(len(s), a + rnd.choice([0, 0, 1, 3, 40, 200])), make(rnd.choice([0, 1, 2, 10, 100]))
            t.edit(a, b, new)
            s = s[:a] + new + s[b:]
            assert t.pieces() == counter.pattern.findall(s) and t.n_pretokens == len(t.pieces())
            assert t.n_tokens == len(counter.encoding.encode_ordinary(s)) == t.tokens[1] and len(t) == len(s)


def test_edits_touch_little(counter):
    """A kept tree: a few pre-tokens are encoded again and a few leaves are read for each edit, whatever the length."""
    text = "word " * 50_000
    kept = token_counts.Tree(counter, text).kept()
    t = token_counts.Tree(counter, text, kept)
    for n, at in enumerate((100_000, 3, 249_990, 100_002), 1):
        t.edit(at, at + 4, "other")
        text = text[:at] + "other" + text[at + 4 :]
        assert t.reencoded < 10 * n and t.read <= 2 * n
    assert t.text() == text and t.n_tokens == len(counter.encoding.encode_ordinary(text))
    # many insertions cut a leaf in several without reading others
    read = t.read
    for _ in range(60):
        t.edit(500, 500, "new words here and ")
    assert t.read <= read + 2 and len(t.leaves) > 782
    again = token_counts.Tree(counter, t.text(), t.kept())
    assert (again.n_tokens, again.n_pretokens, again.pieces()) == (t.n_tokens, t.n_pretokens, counter.pattern.findall(t.text()))


def test_redacted_counts(edge_docs, edge_rows, counter):
    for r in by_text(token_counts.redacted_counts(edge_docs), edge_rows):
        found = [t or "" for i, t in edge_rows if i == r["doc_id"]]
        if len(set(found)) == 1:
            after = token_counts.REDACT.sub(token_counts.REPLACEMENT, found[0])
            assert (r["n_tokens"], r["n_tokens_after"]) == (len(counter.encoding.encode_ordinary(found[0])), len(counter.encoding.encode_ordinary(after)))


def test_apply_edits(spark, counter):
    docs = spark.createDataFrame([(1, "hello world"), (1, "hello world"), (2, None), (3, "abc")], "doc_id long, text string")
    edits = spark.createDataFrame([(1, 2, 5, 99, "!"), (1, 1, 0, 5, "HELLO there"), (2, 1, 0, 0, "new"), (9, 1, 0, 1, "x"), (None, 1, 0, 1, "x"), (3, 1, None, 1, None)], "doc_id long, seq int, start int, end int, replacement string")
    kept = token_counts.trees(docs)
    n = lambda s: len(counter.encoding.encode_ordinary(s))
    for most in (token_counts.EDITS, 1):  # all at once, or one a round
        once = token_counts.apply_edits(kept, edits, most=most)
        got = sorted((r["doc_id"], r["text"], r["n_edits"], r["n_tokens"]) for r in rows(once))
        assert got == [(1, "HELLO!", 2, n("HELLO!"))] * 2 + [(2, "new", 1, n("new")), (3, "bc", 1, n("bc"))]
    # a tree that was kept goes on where it was
    again = rows(token_counts.apply_edits(once, spark.createDataFrame([(2, 1, 3, 3, "er words")], edits.schema)))
    assert [(r["text"], r["n_tokens"], r["n_tokens_before"]) for r in again if r["doc_id"] == 2] == [("newer words", n("newer words"), n("new"))]
    assert all(sum(r["counts"]) == r["n_tokens"] and sum(r["lengths"]) == len(r["text"]) for r in again)
    assert len(rows(token_counts.apply_edits(kept, edits.limit(0)))) == 4
    with pytest.raises(ValueError):
        token_counts.Tree(counter, "abc", tuple(np.array(x) for x in ([1], [1], [1], [1, 1], [1, 1])))


# 5


def test_quality_held_out(spark, sf):
    got = QUERIES["op5_quality_classifier"](spark, "/root/testdata/sf0.01")
    both = got.join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert len(both) > 50 and ((both.predicted == both.quality).mean()) > 0.95


def test_quality_edges(edge_docs, edge_rows, spark):
    labels = spark.createDataFrame([(6, 1), (6, 0), (None, 1), (4, None), (5, 0), (12, 1), (99, 1)], "doc_id long, quality int")
    for r in by_text(quality.classify(edge_docs, labels), edge_rows):
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) and r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
    none = quality.classify(edge_docs, labels.limit(0))
    assert {r["score"] for r in rows(none)} == {0.5}


def brute_features(text):
    """The features by their names, character by character where they are about characters."""
    import math

    b = (text or "").encode()
    words = b.split()
    n, size = max(1, len(words)), max(1, len(b))
    share = lambda of: sum(c in of for c in b)
    upper, lower, wide = sum(65 <= c <= 90 for c in b), sum(97 <= c <= 122 for c in b), sum(c > 127 for c in b)
    lines = [x for x in b.split(b"\n") if x.strip()]
    counts = Count(words)
    marks = b"#$%&*+/<=>@[\\]^_`{|}~"
    return [
        math.log(1 + len(words)), len(b) / n, upper / max(1, upper + lower + wide), share(marks) / size, b.count(b"|") / n, b.count(b"!") / n, share(b".,;:?") / n,
        share(b"0123456789") / size, len(counts) / n, 1 - len(set(lines)) / max(1, len(lines)), math.log(1 + len(b) / max(1, len(lines))),
        sum(x.rstrip()[-1:] in (b".", b"?", b"!", b":") for x in lines) / max(1, len(lines)), wide / size, max(counts.values(), default=0) / n,
        sum(w[-1:] in [bytes([m]) for m in marks] + [b"!"] for w in words) / n, math.log(1 + max(map(len, words), default=0)),
    ]


def test_quality_by_brute_force(spark, edge_docs, edge_rows):
    """Features of all kinds of texts; then the query's model and scores, from features and labels gathered by hand."""
    got = rows(edge_docs.select("text", quality.feature_column(F.col("text")).alias("x")))
    for r in got:
        assert np.allclose(r["x"], brute_features(r["text"]))
    sf = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    learned = [i for i in labels if i in docs and zlib.crc32(str(i).encode()) % 4 != 2]
    assert len(learned) < quality.SAMPLE
    model = quality.fit(np.array([brute_features(docs[i]) for i in learned]), np.array([float(labels[i] == 1) for i in learned]))
    want = dict(zip(docs, quality.score(model, np.array([brute_features(t) for t in docs.values()])), strict=True))
    off = [abs(r["score"] - want[r["doc_id"]]) for r in rows(QUERIES["op5_quality_classifier"](spark, sf))]
    assert np.mean(np.array(off) < 1e-6) > 0.99 and max(off) < 0.05  # order of sums may move a cut between equal gains


def test_gam_learns_a_pair():
    rnd = np.random.default_rng(0)
    x = rnd.random((4000, len(quality.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 3] > 0.5)).astype(float)
    m = quality.fit(x[:3000], y[:3000])
    assert ((quality.score(m, x[3000:]) > 0.5) == y[3000:]).mean() > 0.9
    # a score is a sum of table cells
    bins = [np.searchsorted(e, x[0, k], side="left") for k, e in enumerate(m["edges"])]
    total = np.log(m["prior"] / (1 - m["prior"])) + sum(t[b] for t, b in zip(m["tables"], bins, strict=True)) + sum(t[bins[a], bins[b]] for a, b, t in m["pairs"])
    assert np.isclose(quality.score(m, x[:1])[0], 1 / (1 + np.exp(-total)))


# 9


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = lang_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.97 and got.score.between(0, 1).all()


def test_language_edges(edge_docs, edge_rows):
    for r in by_text(lang_id.identify(edge_docs), edge_rows):
        texts = [t for i, t in edge_rows if i == r["doc_id"]]
        if all(not any(c.isalpha() for c in t or "") for t in texts):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        assert r["lang_pred"] in ("en", "fr", "und") and 0 <= r["score"] <= 1


def test_backoff():
    def table(name, *shares):
        """One entry that all languages have."""
        return [name], np.array([0, 2]), np.array([0, 1], np.int32), np.log(np.array(shares) / 0.01).astype(np.float32), np.log(np.full(2, 0.01))

    model = {"id": "t", "langs": ["aa", "bb"], "grams": {0: table("known", 0.9, 0.1), 2: table("zz", 0.2, 0.8), 1: table("q", 0.7, 0.3)}}
    s = lang_id.Scorer(model)
    assert s.predict("known")[0] == "aa" and s.predict("qzz")[0] == "bb" and s.predict("q")[0] == "aa"
    assert s.predict("ww") == ("aa", 0.5)  # no evidence: a tie, the first
    assert s.predict("known 12")[1] == pytest.approx(0.9, abs=1e-6)
    assert lang_id._words("ab ² ǅx 12 ²b") == lang_id._words("² ab ǅx ²b") == ["ab", "ǆx", "²b"]


def brute_language(docs, langs):
    """(lang_pred, score) of each text, by dictionaries: docs are (doc_id, text, lang)."""
    import math
    import re

    words = lambda t: [w for w in re.findall(r"[^\W\d_]+", (t or "").lower()) if any(map(str.isalpha, w))]
    grams = lambda w, n: [f"^{w}$"[i : i + n] for i in range(len(w) + 3 - n)]
    counts = Count()
    for i, t, lang in docs:
        if lang is not None and t is not None and i is not None and zlib.crc32(str(i).encode()) % 3 != 1:
            for w in words(t):
                counts[0, w, lang] += 1
                for n in range(1, 6):
                    for g in grams(w, n):
                        counts[n, g, lang] += 1
    counts = {k: c for k, c in counts.items() if c > 1 or k[0] < 3}
    known = {n: {g for m, g, _ in counts if m == n} for n in range(6)}
    total = {(n, lang): sum(c for (m, _, x), c in counts.items() if m == n and x == lang) + 0.5 * len(known[n]) + 1 for n in range(6) for lang in langs}
    logp = lambda n, g, lang: math.log((counts.get((n, g, lang), 0) + 0.5) / total[n, lang])
    out = []
    for _, t, _ in docs:
        own, sums = words(t), dict.fromkeys(langs, 0.0)
        for w in own:
            hits = [(0, w)] if w in known[0] else next((h for n in range(5, 0, -1) if (h := [(n, g) for g in grams(w, n) if g in known[n]])), [])
            for lang in langs:
                sums[lang] += sum(logp(n, g, lang) for n, g in hits) / max(1, len(hits)) * min(1, 20 / len(own))
        best = max(langs, key=lambda x: (sums[x], [-ord(c) for c in x]))
        out.append((best, 1 / sum(math.exp(v - sums[best]) for v in sums.values())) if own else ("und", 0.0))
    return out


def test_language_by_brute_force(spark):
    rnd = random.Random(9)
    kinds = {"aa": ["lorem", "ipsum", "dolor", "ßet"], "bb": ["tempor", "dolor", "élan"], "cc": ["ipse"]}
    docs = [(k, " ".join(rnd.choice(kinds[lang]) + rnd.choice(["", "x", "et"]) for _ in range(rnd.choice([1, 4, 30]))), lang) for k in range(60) for lang in [rnd.choice(list(kinds))]]
    docs += [(100, None, "aa"), (101, "12 34", "bb"), (102, "ipsumdolor temporet", None), (None, "lorem lorem", "bb"), (103, "dolor", "aa")]
    got = {(r["doc_id"], i): r for i, r in enumerate(rows(lang_id.identify(spark.createDataFrame(docs, "doc_id long, text string, lang string"))))}
    by_id = {k[0]: r for k, r in got.items()}
    for (i, _, _), (lang, score) in zip(docs, brute_language(docs, sorted(kinds)), strict=True):
        assert by_id[i]["lang_pred"] == lang and by_id[i]["score"] == pytest.approx(score, rel=1e-4)


def test_many_languages(spark):
    """No language is lost, and a rare one keeps its words beside frequent ones."""
    name = lambda k: "".join(chr(97 + k // 26**i % 26) for i in range(4))
    docs = [(k, f"{name(k * 7919)}q {name(k * 104729)}z", f"l{k:04}") for k in range(1500)] + [(5000 + k, f"frequent {name(k)}f", "l0000") for k in range(3000)]
    model = lang_id.train(spark.createDataFrame(docs, "doc_id long, text string, lang string"), entries=1000, least=10)
    assert len(model["langs"]) == 1500
    s = lang_id.Scorer(model)
    assert all(s.predict(t)[0] == lang for _, t, lang in docs[1:1500:50]) and s.predict("frequent")[0] == "l0000"


# 7


def test_lattice_against_paths():
    import math

    v = lattice_lm.Vocabulary(lattice_lm.default_path())
    ids, special = {p: k for k, p in enumerate(v.pieces)}, {*v.byte.tolist(), v.end}

    def paths(s):
        """All segmentations' probabilities, one by one."""
        if not s:
            return [1.0]
        out = []
        for n in range(1, min(16, len(s)) + 1):
            k = ids.get(s[:n])
            if k is not None and k not in special:
                p = math.exp(v.first[k])
            elif n == 1:
                p = math.exp(sum(v.first[v.byte[b]] for b in s[0].encode()))
            else:
                continue
            out += [p * q for q in paths(s[n:])]
        return out

    words = ["the", "hello", "è漢", "a", "ththtion", "😛q", "ꙮ"]
    got = lattice_lm.log_marginals(v, v.first, [w.encode() for w in words])
    assert np.allclose(got, [math.log10(sum(paths("▁" + w))) for w in words])
    lattice = lattice_lm.Lattice(v, ["theation"])
    assert lattice.arcs(0, lattice.length)[0].shape[2] == min(lattice.length, v.longest)
    e = lattice.expected(v.first, np.array([2.0]))
    k = int(e.argmax())
    moved = v.first.copy()
    moved[k] += 1e-5
    slope = (lattice_lm.log_marginals(v, moved, [b"theation"]) - lattice_lm.log_marginals(v, v.first, [b"theation"]))[0] * math.log(10) / 1e-5
    assert e[k] == pytest.approx(2 * slope, rel=1e-3)


def test_long_words_in_stripes():
    v, rnd = lattice_lm.Vocabulary(lattice_lm.default_path()), random.Random(5)
    word = "".join(rnd.choice("thequickbrownfox漢😛") for _ in range(700))
    whole, cut = lattice_lm.Lattice(v, [word, word[::-1]]), lattice_lm.Lattice(v, [word, word[::-1]], most=50)
    assert len(whole.stripes) == 1 and len(cut.stripes) > 20
    assert np.allclose(whole.marginal(v.first), cut.marginal(v.first), rtol=1e-12)
    assert np.allclose(whole.expected(v.first, np.array([1.0, 3.0])), cut.expected(v.first, np.array([1.0, 3.0])), rtol=1e-9)


def test_score_by_brute_force(spark):
    """Two rounds of re-estimation and the texts' probabilities, by enumeration of all segmentations."""
    import math

    v = lattice_lm.Vocabulary(lattice_lm.default_path())
    ids, special = {p: k for k, p in enumerate(v.pieces)}, {*v.byte.tolist(), v.end}

    def paths(s):
        if not s:
            return [()]
        out = []
        for n in range(1, min(v.longest, len(s)) + 1):
            k = ids.get(s[:n])
            head = (k,) if k is not None and k not in special else tuple(v.byte[b] for b in s[0].encode()) if n == 1 else None
            out += [head + rest for rest in paths(s[n:])] if head is not None else []
        return out

    docs = [(1, "the cat Ꙩ"), (2, "The hat"), (3, None), (4, "that cat cat"), (5, "hatted"), (6, "a the"), (None, "null")]
    fold = lambda i: zlib.crc32(str(i).encode()) % 7
    split = lambda t: [w.decode() for w in lattice_lm.tokens((t or "").encode())]
    counts = Count(w for i, t in docs if i is not None and fold(i) != 2 for w in split(t))
    every = {w: paths("▁" + w) if w else [(v.end,)] for _, t in docs for w in split(t)}
    logp = v.first
    for _ in range(lattice_lm.ROUNDS):
        mass = lattice_lm.PRIOR * np.exp(v.first)
        for w, c in counts.items():
            p = [math.exp(sum(logp[k] for k in path)) for path in every[w]]
            for path, x in zip(every[w], p, strict=True):
                for k in path:
                    mass[k] += c * x / sum(p)
        logp = np.log(mass / mass.sum())
    want = {i: sum(math.log10(sum(math.exp(sum(logp[k] for k in path)) for path in every[w])) for w in split(t)) for i, t in docs}
    got = {r["doc_id"]: r["score"] for r in rows(lattice_lm.score(spark.createDataFrame(docs, "doc_id long, text string")))}
    assert got == pytest.approx(want, rel=1e-6)


def test_scores(edge_docs, edge_rows, spark):
    for head in (3, lattice_lm.HEAD):  # a small head sends words through the join
        got = rows(lattice_lm.score(edge_docs, head=head))
        fold = lambda i: zlib.crc32(str(i).encode()) % 7
        counts = Count()
        for i, t in edge_rows:
            if i is not None and fold(i) != 2:
                counts.update(lattice_lm.tokens((t or "").encode()))
        n, v = sum(counts.values()), len(counts)
        want = Count()
        for i, t in edge_rows:
            own = lattice_lm.tokens((t or "").encode())
            want[i, i is not None and fold(i) == 2, len(own), sum(counts[w] > 0 for w in own), n, round(sum(np.log10((counts[w] + 1) / (n + v + 1)) for w in own), 5)] += 1
        assert Count((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in got) == want
        assert all(r["score"] < 0 for r in got)
        if head == 3:
            first = sorted((str(r["doc_id"]), round(r["score"], 6)) for r in got)
        else:
            assert first == sorted((str(r["doc_id"]), round(r["score"], 6)) for r in got)
