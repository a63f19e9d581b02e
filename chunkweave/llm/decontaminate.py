"""Benchmark decontamination over a distributed positional inverted index.

The index is a table of segments, as search engines keep it: a segment holds the postings of all words of
some documents, one list of positions a term, in one row.  Terms are 64-bit hashes of words, sorted in each
segment, so the index knows nothing of what will be looked for and serves any number of benchmarks.
Segments are cut by their number of words, so neither a hot source nor many documents make a large one;
nothing is shuffled.  Positions run through a segment, with a gap between documents which no phrase can bridge.

A search first adds up the counts of the benchmark's terms over all segments, orders each phrase's terms from
the rarest over the whole corpus, and then in every segment takes the phrases all of whose terms occur there
and intersects the lists, each moved back by its term's place in the phrase, beginning with the rarest,
and stops at the first empty intersection.  With ``slop`` the terms must follow each other in order within the
phrase's length plus ``slop`` words.

The benchmark is worked off in blocks of at most ``BLOCK_WORDS`` words, which bounds what is broadcast;
all blocks search the same index.

Two different words of a corpus share a term with probability 2**-64 a pair.

Cases: null or wordless texts have no words and no hits, null or wordless items no windows; repeated rows
each get their own row; a null item_id is left out of the ids but its windows still hit; equal items all
count; an empty benchmark hits nothing.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base

WINDOW = 10
#: Words of items in a block; words of documents in a segment, but for a longer document's.
BLOCK_WORDS, SEGMENT_WORDS = 500_000, 1_000_000
GAP = 1 << 10
_TABLE = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
INDEX = "doc_ids array<long>, starts array<long>, lengths array<long>, digests array<string>, terms binary, counts binary, postings binary"
#: Hashes of words that a worker keeps.
KEPT_WORDS = 300_000
FOUND = "doc_id long, n_words long, spans array<struct<start:long,end:long>>, item_ids array<string>, digest string"


def words(text: bytes | None) -> list[bytes]:
    """Lower-cased ASCII letters, digits and all bytes of other characters, cut everywhere else."""
    return text.translate(_TABLE).split() if text else []


def blocks(items: DataFrame, most: int = BLOCK_WORDS):
    """Lists of (item_id, words), a bounded number of words each."""
    block, size = [], 0
    for r in items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("binary").alias("text")).where("text is not null").toLocalIterator():
        if w := words(bytes(r["text"])):
            if block and size + len(w) > most:
                yield block
                block, size = [], 0
            block.append((r["item_id"], w))
            size += len(w)
    if block:
        yield block


class _Terms(dict):
    """64-bit hashes of words, kept while there is room."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > KEPT_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def terms(own: list[bytes]) -> np.ndarray:
    return np.fromiter(map(base.built(("terms",), _Terms).__getitem__, own), np.uint64, len(own))


class Phrases:
    """Windows of a block of items. terms: their distinct terms, sorted; windows: numbers of terms, -1 behind shorter ones; ids: items of each window."""

    def __init__(self, block: list, window: int = WINDOW):
        found: dict[tuple, set] = {}
        for item, own in block:
            t = tuple(terms(own).tolist())
            for i in range(max(1, len(t) - window + 1)):
                found.setdefault(t[i : i + window], set()).add(item)
        self.terms = np.array(sorted({t for w in found for t in w}), np.uint64)
        flat = np.searchsorted(self.terms, np.array([t for w in found for t in w], np.uint64))
        lengths = np.array([len(w) for w in found], np.int64)
        self.windows = np.full((len(found), lengths.max(initial=1)), -1, np.int32)
        self.windows[np.repeat(np.arange(len(found)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
        self.ids = [sorted(x for x in items if x is not None) for items in found.values()]
        self.order = None

    def rank(self, counts: np.ndarray) -> None:
        """Terms of each window from the rarest; counts: occurrences of each term in the corpus."""
        key = np.where(self.windows >= 0, counts[self.windows], np.iinfo(np.int64).max)
        self.order = np.argsort(key, axis=1, kind="stable").astype(np.int16)


def _segment(docs: list) -> pa.RecordBatch:
    """One row of :data:`INDEX`. docs: (doc_id, digest, term of each word)."""
    lengths = np.array([len(x) for _, _, x in docs], np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths + GAP)[:-1]]).astype(np.int64)
    words_ = np.concatenate([x for _, _, x in docs]) if docs else np.zeros(0, np.uint64)
    places = np.repeat(starts - np.cumsum(lengths) + lengths, lengths) + np.arange(len(words_))
    order = np.argsort(words_, kind="stable")
    words_, places = words_[order], places[order]
    heads = np.flatnonzero(np.concatenate([[True], words_[1:] != words_[:-1]])) if len(words_) else np.zeros(0, np.int64)
    # postings as gaps within each list
    gaps = np.diff(places, prepend=0)
    gaps[heads] = places[heads]
    kind = np.uint32 if not len(gaps) or gaps.max() < 1 << 32 else np.uint64
    body = bytes([np.dtype(kind).itemsize]) + gaps.astype(kind).tobytes()
    counts = np.diff(np.append(heads, len(words_))).astype(np.uint32)
    column = lambda x, t: pa.array([x], pa.list_(t))
    return pa.RecordBatch.from_arrays(
        [column([d for d, _, _ in docs], pa.int64()), column(starts, pa.int64()), column(lengths, pa.int64()), column([g for _, g, _ in docs], pa.string()), pa.array([words_[heads].tobytes()], pa.binary()), pa.array([counts.tobytes()], pa.binary()), pa.array([body], pa.binary())],
        ["doc_ids", "starts", "lengths", "digests", "terms", "counts", "postings"],
    )


def index(docs: DataFrame, digests: bool = False, segment_words: int = SEGMENT_WORDS) -> DataFrame:
    """Segments of the postings of all words of ``docs`` (doc_id, text), stored."""

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), base.texts(batch.column(1)), strict=True):
                own = terms(words(text))
                held.append((doc_id, hashlib.md5(text or b"").hexdigest() if digests else None, own))
                size += len(own) + GAP
                if size >= segment_words:
                    yield _segment(held)
                    held, size = [], 0
        if held:
            yield _segment(held)

    return base.stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, INDEX), "postings")


def corpus_counts(segments: DataFrame, phrases: Phrases) -> np.ndarray:
    """Occurrences of each of the phrases' terms in all segments."""
    sent = segments.sparkSession.sparkContext.broadcast(phrases.terms)

    def run(batches):
        wanted = sent.value
        total = np.zeros(len(wanted), np.int64)
        for batch in batches:
            for own, counts in zip(batch.column(0), batch.column(1), strict=True):
                own, counts = np.frombuffer(own.as_buffer(), np.uint64), np.frombuffer(counts.as_buffer(), np.uint32)
                at, there = _looked_up(own, wanted)
                total[there] += counts[at[there]]
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used], pa.int64())], ["term", "n"])

    rows = segments.select("terms", "counts").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(phrases.terms), np.int64)
    out[rows.column("term").to_numpy()] = rows.column("n").to_numpy()
    return out


def _looked_up(own: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the wanted terms among a segment's, and which are there."""
    at = np.minimum(np.searchsorted(own, wanted), max(0, len(own) - 1))
    return at, own[at] == wanted if len(own) else np.zeros(len(wanted), bool)


def intersect(lists, phrase: list[int], order: list[int]) -> np.ndarray:
    """Positions where the phrase begins. lists: positions of a term; order: places in the phrase, rarest term first."""
    left = lists(phrase[order[0]]) - order[0]
    for k in order[1:]:
        if not len(left):
            break
        other = lists(phrase[k])
        if not len(other):
            return other
        at = np.searchsorted(other, left + k)
        left = left[other[np.minimum(at, len(other) - 1)] == left + k]
    return left


def near(lists, phrase: list[int], order: list[int], slop: int) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends (last word) of matches in order, shortest for each begin, with at most ``slop`` other words between."""
    reach = len(phrase) + slop
    rare = lists(phrase[order[0]])
    begin = lists(phrase[0])
    if not len(rare) or not len(begin):
        return begin[:0], begin[:0]
    # only begins with the rarest term within reach
    at = np.searchsorted(rare, begin)
    begin = begin[(at < len(rare)) & (rare[np.minimum(at, len(rare) - 1)] < begin + reach)]
    end = begin
    for term in phrase[1:]:
        other = lists(term)
        at = np.searchsorted(other, end, side="right")
        ok = at < len(other)
        begin, end = begin[ok], other[at[ok]]
        ok = end - begin < reach
        begin, end = begin[ok], end[ok]
    return begin, end


def search(segments: DataFrame, phrases: Phrases, slop: int | None = None) -> DataFrame:
    """A row of :data:`FOUND` for each indexed document: words hit as disjoint spans, and items with matches.

    ``slop`` None asks for exact phrases.
    """
    phrases.rank(corpus_counts(segments, phrases))
    sent = segments.sparkSession.sparkContext.broadcast(phrases)

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                yield from _searched(row, sent.value, slop)

    return segments.mapInArrow(run, FOUND)


def _searched(row: dict, phrases: Phrases, slop: int | None):
    kind = np.uint32 if row["postings"][0] == 4 else np.uint64
    gaps = np.frombuffer(row["postings"], kind, offset=1)
    ends = np.cumsum(np.frombuffer(row["counts"], np.uint32), dtype=np.int64)
    at, there = _looked_up(np.frombuffer(row["terms"], np.uint64), phrases.terms)
    kept: dict[int, np.ndarray] = {}

    def lists(term: int) -> np.ndarray:
        if term not in kept:
            k = at[term]
            kept[term] = np.cumsum(gaps[ends[k - 1] if k else 0 : ends[k]].astype(np.int64))
        return kept[term]

    begins, ends_, phrase_of = [], [], []
    # phrases all of whose terms occur in the segment
    open_ = np.flatnonzero((there[phrases.windows] | (phrases.windows < 0)).all(axis=1)) if len(phrases.terms) else ()
    for k in open_:
        phrase = [int(t) for t in phrases.windows[k] if t >= 0]
        order = phrases.order[k][: len(phrase)].tolist()
        if slop is None:
            b = intersect(lists, phrase, order)
            e = b + len(phrase) - 1
        else:
            b, e = near(lists, phrase, order, slop)
        if len(b):
            begins.append(b)
            ends_.append(e)
            phrase_of.append(np.full(len(b), k))
    starts = np.array(row["starts"], np.int64)
    n = len(starts)
    spans: list[list] = [[] for _ in range(n)]
    items: list[set] = [set() for _ in range(n)]
    if begins:
        b, e, p = map(np.concatenate, (begins, ends_, phrase_of))
        order = np.argsort(b, kind="stable")
        b, e, p = b[order], e[order], p[order]
        doc = np.searchsorted(starts, b, side="right") - 1
        for d, x, y, k in zip(doc.tolist(), (b - starts[doc]).tolist(), (e - starts[doc] + 1).tolist(), p.tolist(), strict=True):
            own = spans[d]
            if own and x <= own[-1]["end"]:
                own[-1]["end"] = max(own[-1]["end"], y)
            else:
                own.append({"start": x, "end": y})
            items[d].update(phrases.ids[k])
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for i in range(0, n, 10_000):
        j = slice(i, i + 10_000)
        yield pa.RecordBatch.from_arrays(
            [pa.array(row["doc_ids"][j], pa.int64()), pa.array(row["lengths"][j], pa.int64()), pa.array(spans[j], span), pa.array([sorted(x) for x in items[j]], pa.list_(pa.string())), pa.array(row["digests"][j], pa.string())],
            ["doc_id", "n_words", "spans", "item_ids", "digest"],
        )


def _merged(batches):
    """Spans of several blocks as disjoint ones."""
    for batch in batches:
        out = []
        for lists in batch.column("spans").to_pylist():
            own: list = []
            for x in sorted((s for part in lists for s in part), key=lambda s: (s["start"], s["end"])):
                if own and x["start"] <= own[-1]["end"]:
                    own[-1]["end"] = max(own[-1]["end"], x["end"])
                else:
                    own.append(dict(x))
            out.append(own)
        at = batch.schema.get_field_index("spans")
        yield batch.set_column(at, "spans", pa.array(out, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))))


def matches(docs: DataFrame, items: DataFrame, window: int = WINDOW, slop: int | None = None, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, spans and item_ids of each row of ``docs`` (doc_id, text)."""
    base.small_batches()
    all_blocks = blocks(items, block_words)
    block = next(all_blocks, None)
    following = next(all_blocks, None)
    alone = following is None
    segments = index(docs, digests=not alone)
    parts = [search(segments, Phrases(block or [], window), slop)]
    while following is not None:
        parts[-1] = base.stored(parts[-1], "matches")
        block, following = following, next(all_blocks, None)
        parts.append(search(segments, Phrases(block, window), slop))
    if alone:
        return parts[0].drop("digest")
    # rows alike in id and text have the same matches: they meet here and part again by their number
    out = parts[0].groupBy("doc_id", "n_words", "digest").agg(F.count("*").alias("times"))
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    hits = whole.where("size(spans) > 0").distinct().groupBy("doc_id", "digest").agg(F.collect_list("spans").alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"))  # one row a block at most
    hits = hits.mapInArrow(_merged, "doc_id long, digest string, spans array<struct<start:long,end:long>>, item_ids array<string>")
    o, h = out.alias("o"), hits.alias("h")
    joined = o.join(h, F.expr("o.doc_id <=> h.doc_id and o.digest = h.digest"), "left")
    return joined.select("o.doc_id", "o.n_words", F.coalesce("h.spans", F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)")).alias("spans"), F.coalesce("h.item_ids", F.expr("cast(array() as array<string>)")).alias("item_ids"), F.explode(F.sequence(F.lit(1), F.col("o.times"))).alias("_")).drop("_")


def report(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of each row of ``docs``."""
    m = matches(docs, items, window, None, block_words)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return m.select("doc_id", "n_words", hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))
