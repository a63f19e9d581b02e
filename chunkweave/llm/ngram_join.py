"""N-gram Jaccard join over a token-group matrix.

Documents are sets of word shingles, kept as sorted 64-bit hashes.  Equal sets are one node.  A pair with
similarity t or more shares one of each set's first ``n - ceil(t n) + 1`` shingles in any common order.
The order here puts last what a sketch of fixed size, counting all shingles, shows to be frequent, such as
passages of many documents; before those, shingles go by their words, rarest first, from a like sketch of all words, so
that leading shingles are hardly ever shared by chance.

* Groups: nodes with a shared leading shingle, gathered under the most frequent of those, so that similar
  documents meet.  A group of more than ``BLOCK`` nodes or ``SHINGLES`` shingles is cut; the smallest node of all visits each part.
* First, groups are compared inside.  Most of a large cluster of near copies is one component then.
* Token-group matrix: the union of each group's leading shingles, as rows (token, group).
* Candidate groups of a node: those whose union has one of its leading shingles, and sizes that can match.
  Of two groups the smaller one's nodes visit the larger.  Shingles all of whose nodes are in one component, and
  groups all of whose nodes are in the visitor's, have no link to add and are left out, so that a huge cluster isn't compared
  part by part with itself.
* Signs: every set has a bitmap of ``SIGN_BITS`` bits, doubled with the size of the set beyond ``SIGN_SIZE``,
  each the parity of the shingles that fall on it.  Two bitmaps, the longer one folded, differ in no more bits
  than the sets in shingles, so only nodes with a partner whose bitmap is near enough stay; none that has a
  link is lost.  Whole sets are moved for those nodes alone.
* Bound: a visitor's overlap with the union of all of the group's shingles.  Only visitors that reach t
  times their own size open the group.
* Opened groups are compared by a product of membership matrices, so no pair becomes a row: out come edges
  from each node to the smallest node that it reaches inside the group.

Components of those edges are found by alternating large and small stars, every round stored.

Nodes are named by a 64-bit hash of their set: two different sets collide with probability 2**-64 a pair.

Cases: a null, empty or wordless text has no shingles and is its own component; a text with fewer words
than a shingle is one shingle; repeated rows share a component; a null doc_id takes part, and a component
without any other id is null.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base

SIZE, PER_CENT = 3, 90
#: Most members, and most visitors, that are compared at once, and most shingles of either, but for a single set's.
BLOCK, SHINGLES = 512, 2_000_000
SIGN_BITS, SIGN_SIZE = 1024, 1500
#: Counters of the sketch, as a power of two; bits of the filter of sets that are needed again.
SKETCH_BITS, WORD_BITS, FILTER_BITS = 22, 20, 23
SLICE = 1 << 14
KEPT_WORDS = 200_000
HEADS = "doc_id long, text_hash long, n long, node long, head array<long>, sign binary"
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
_ODD = [np.uint64(x | 1) for x in (0x8CB92BA72F3D8DD6, 0xC2B2AE3D27D4EB4F, 0x27D4EB2F165667C4, 0x165667B19E3779F8, 0xD6E8FEB86659FD92)]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX[1]
    h = (h ^ (h >> np.uint64(27))) * _MIX[2]
    return h ^ (h >> np.uint64(31))


class _Words(dict):
    """64-bit hashes of words, kept while there is room."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > KEPT_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h



def word_hashes(text: bytes | None) -> np.ndarray:
    words = text.lower().split() if text else []
    return np.fromiter(map(base.built(("words",), _Words).__getitem__, words), np.uint64, len(words))


def _windows(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each shingle, in order of the text; of the whole sequence where it is shorter."""
    n = len(words)
    width = min(n, size)
    total = np.full(n - width + 1, width, np.uint64) * _MIX[0]
    for k in range(width):
        total += _mixed(words[k : n - width + 1 + k] * _ODD[k % len(_ODD)] + np.uint64(k))
    return _mixed(total)


def shingles(text: bytes | None, size: int = SIZE) -> np.ndarray:
    """Sorted distinct hashes of the shingles of ``size`` words."""
    words = word_hashes(text)
    return np.unique(_windows(words, size)) if len(words) else words


def ranked(text: bytes | None, size: int, frequent: np.ndarray, word_class: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same, and each one's place in the common order."""
    words = word_hashes(text)
    if not len(words):
        return words, words
    u, first = np.unique(_windows(words, size), return_index=True)
    shift = lambda table: np.uint64(65 - len(table).bit_length())
    steps = np.concatenate([[0], np.cumsum(word_class[(words >> shift(word_class)).astype(np.int64)], dtype=np.int64)])
    width = min(len(words), size)
    score = np.minimum(steps[first + width] - steps[first], 4095).astype(np.uint64)
    place = frequent[(u >> shift(frequent)).astype(np.int64)].astype(np.uint64)
    return u, place << np.uint64(56) | score << np.uint64(44) | u >> np.uint64(20)


def needed(n: int, per_cent: int) -> int:
    return -(-n * per_cent // 100)


def _node(u: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(u.tobytes(), digest_size=8).digest(), "little", signed=True)


def sign_class(n: int) -> int:
    """How often the bitmap of a set of n shingles is doubled."""
    return max(0, (-(-n // SIGN_SIZE) - 1).bit_length())


def sign(u: np.ndarray) -> bytes:
    """Bitmap of a set: for each place whether an odd number of shingles fall on it."""
    bits = SIGN_BITS << sign_class(len(u))
    places = (u * _MIX[2] >> np.uint64(20)) & np.uint64(bits - 1)
    return np.packbits((np.bincount(places.astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def folded(signs: np.ndarray, times: int) -> np.ndarray:
    """Rows of bitmaps, halved so many times."""
    for _ in range(times):
        half = signs.shape[1] // 2
        signs = signs[:, :half] ^ signs[:, half:]
    return signs


def _vectors(df: DataFrame, of, length: int, join, kind) -> np.ndarray:
    """``join`` of the vectors that ``of`` makes from each partition's batches; moved and merged in slices of fixed size."""
    size = min(SLICE, length)

    def cut(batches):
        whole = of(batches)
        for a in range(0, length, 32 * size):
            k = range(a, min(length, a + 32 * size), size)
            yield pa.RecordBatch.from_arrays([pa.array([i // size for i in k], pa.int32()), pa.array([whole[i : i + size].tobytes() for i in k], pa.binary())], ["slice", "part"])

    def merge(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.frombuffer(part, kind)
                held[k] = join(held[k], own) if k in held else own
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([v.tobytes() for v in held.values()], pa.binary())], ["slice", "part"])

    schema = "slice int, part binary"
    rows = df.mapInArrow(cut, schema).repartition(min(length // size, max(16, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))), "slice").mapInArrow(merge, schema).toArrow()
    out = np.zeros(length, kind)
    for k, part in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
        out[k * size : (k + 1) * size] = join(out[k * size : (k + 1) * size], np.frombuffer(part, kind))
    return out


def frequency_classes(docs: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For each counter of shingles 0, or the more the further it stands out; for each counter of words how frequent they are."""
    cuts = [0, 1 << SKETCH_BITS, (1 << SKETCH_BITS) + (1 << WORD_BITS)]

    def of(batches):
        counts = np.zeros(cuts[2], np.uint32)
        held, n = [], 0

        def add():
            nonlocal held, n
            for k, part in enumerate(zip(*held, strict=True)):
                bits = (SKETCH_BITS, WORD_BITS)[k]
                np.add.at(counts[cuts[k] : cuts[k + 1]], (np.concatenate(part) >> np.uint64(64 - bits)).astype(np.int64), np.uint32(1))
            held, n = [], 0

        for batch in batches:
            for text in base.texts(batch.column(0)):
                words = word_hashes(text)
                if len(words):
                    held.append((np.unique(_windows(words, size)), words))
                    n += len(words)
                    if n > 1 << 18:
                        add()
        add()
        return counts

    total = _vectors(docs.select("text"), of, cuts[2], lambda a, b: a + np.minimum(b, np.uint32(0xFFFFFFFF) - a), np.uint32).astype(np.float64)
    of_shingles, of_words = total[: cuts[1]], total[cuts[1] :]
    usual = of_shingles.mean()
    # a shingle that is taken for frequent by chance only comes later in the order
    frequent = np.where(of_shingles > usual + 2 * np.sqrt(usual) + 1, 4 * np.log2(1 + of_shingles), 0).astype(np.uint8)
    return frequent, (7 * np.log2(1 + of_words)).astype(np.uint8)


def heads(docs: DataFrame, size: int, per_cent: int) -> DataFrame:
    """Per row: its set's size, node and leading shingles; stored."""
    classes = docs.sparkSession.sparkContext.broadcast(frequency_classes(docs, size))

    def run(batches):
        for batch in batches:
            rows = []
            for doc_id, text_hash, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), base.texts(batch.column(2)), strict=True):
                u, place = ranked(text, size, *classes.value)
                if len(u):
                    first = len(u) - needed(len(u), per_cent) + 1
                    rows.append((doc_id, text_hash, len(u), _node(u), (u[np.argpartition(place, first - 1)[:first]] if first < len(u) else u).view(np.int64), sign(u)))
                else:
                    rows.append((doc_id, text_hash, 0, None, [], None))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [x.split()[0] for x in HEADS.split(", ")])

    return base.stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, HEADS), "heads")


def _places(keys: np.ndarray, bits: int) -> np.ndarray:
    h = _mixed(keys.astype(np.int64).view(np.uint64) + _MIX[0])
    return np.concatenate([(h >> np.uint64(64 - bits)).astype(np.int64), (h & np.uint64((1 << bits) - 1)).astype(np.int64)])


def _needed_sets(docs: DataFrame, reps: DataFrame, size: int, bits: int = FILTER_BITS) -> DataFrame:
    """node, n and shingles of the nodes ``reps`` (node, rep); a filter of fixed size keeps other texts' sets out of the shuffle."""

    def of(batches):
        own = np.zeros(1 << bits, bool)
        for batch in batches:
            own[_places(batch.column(0).to_numpy(zero_copy_only=False), bits)] = True
        return np.packbits(own)

    packed = docs.sparkSession.sparkContext.broadcast(_vectors(reps.select(F.coalesce("rep", "node")), of, 1 << (bits - 3), np.bitwise_or, np.uint8))

    def run(batches):
        wanted = np.unpackbits(packed.value).astype(bool)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), base.texts(batch.column(1)), strict=True):
                if doc_id is None or wanted[_places(np.array([doc_id], np.int64), bits)].all():
                    u = shingles(text, size)
                    if len(u):
                        node = _node(u)
                        rows.append((doc_id if doc_id is not None else node, node, u.tobytes()))
            if rows:
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary())], ["rep", "node", "tokens"])

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "rep long, node long, tokens binary")
    own = reps.select("node", F.coalesce("rep", "node").alias("rep"))
    return found.join(own, ["node", "rep"]).dropDuplicates(["node"]).select("node", "tokens")


#: Rows of a matrix of links that are worked on at once, and tokens of a matrix of membership.
_ROWS, _WIDTH = 256, 2048


def _lowest(link: np.ndarray, rows: np.ndarray, cols: np.ndarray, n: int) -> np.ndarray:
    """The smallest index that each of n items reaches by links between rows and cols (their indexes)."""
    label = np.arange(n, dtype=np.int32)
    while True:
        before = label.copy()
        for i in range(0, len(rows), _ROWS):
            r, own = rows[i : i + _ROWS], link[i : i + _ROWS]
            np.minimum.at(label, r, np.where(own, label[cols][None, :], np.int32(n)).min(axis=1))
            np.minimum.at(label, cols, np.where(own, label[r][:, None], np.int32(n)).min(axis=0))
        label = label[label]
        if (label == before).all():
            return label


def compare(nodes: np.ndarray, sets: list[np.ndarray], visits: np.ndarray, inner: bool, per_cent: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of one opened group. visits: which nodes are visitors; inner: compare members with each other too."""
    order = np.argsort(nodes, kind="stable")  # the smallest index is the smallest node
    nodes, visits, sets = nodes[order], visits[order], [sets[i] for i in order]
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    in_group = np.bincount(column[~visits[owner]], minlength=len(count)) > 0
    overlap = np.bincount(owner[in_group[column]], minlength=len(sets))
    opens = visits & (100 * overlap >= per_cent * sizes)
    rows = np.flatnonzero(opens | (~visits if inner else False))
    cols = np.flatnonzero(~visits)
    if not len(rows) or not len(cols):
        return nodes[:0], nodes[:0]
    # tokens of one row alone are in no intersection
    used = np.zeros(len(sets), bool)
    used[rows] = used[cols] = True
    kept = (count[column] > 1) & used[owner]
    owner, column = owner[kept], column[kept]
    by_column = np.argsort(column, kind="stable")
    owner, column = owner[by_column], column[by_column]
    _, column = np.unique(column, return_inverse=True)
    kind = np.float32 if sizes.max() < 1 << 24 else np.float64  # sums of ones stay exact
    inter = np.zeros((len(rows), len(cols)), kind)
    at_row, at_col = np.full(len(sets), -1), np.full(len(sets), -1)
    at_row[rows], at_col[cols] = np.arange(len(rows)), np.arange(len(cols))
    last = int(column[-1]) + 1 if len(column) else 0
    for a in range(0, last, _WIDTH):
        i, j = np.searchsorted(column, (a, a + _WIDTH))
        o, c = owner[i:j], column[i:j] - a
        x, y = np.zeros((len(rows), min(_WIDTH, last - a)), kind), np.zeros((len(cols), min(_WIDTH, last - a)), kind)
        ok = at_row[o] >= 0
        x[at_row[o[ok]], c[ok]] = 1
        ok = at_col[o] >= 0
        y[at_col[o[ok]], c[ok]] = 1
        inter += x @ y.T
    link = np.empty(inter.shape, bool)
    for i in range(0, len(rows), _ROWS):
        own = inter[i : i + _ROWS].astype(np.int64)
        link[i : i + _ROWS] = (100 + per_cent) * own >= per_cent * (sizes[rows[i : i + _ROWS]][:, None] + sizes[cols][None, :])
    del inter
    label = _lowest(link, rows, cols, len(sets))
    moved = label != np.arange(len(sets))
    return nodes[moved], nodes[label[moved]]


def near_signs(signs: list[bytes], sizes: np.ndarray, visits: np.ndarray, inner: bool, per_cent: int) -> np.ndarray:
    """Which rows have a partner that may be linked, by the number of bits in which their bitmaps differ."""
    out = np.zeros(len(sizes), bool)
    kinds = np.array([sign_class(int(n)) for n in sizes])
    words = {k: np.frombuffer(b"".join(signs[i] for i in np.flatnonzero(kinds == k)), np.uint64).reshape((kinds == k).sum(), -1) for k in np.unique(kinds)}
    place = np.zeros(len(sizes), np.int64)
    for k in words:
        place[kinds == k] = np.arange((kinds == k).sum())
    for x, of_x in words.items():
        rows = np.flatnonzero((kinds == x) if inner else (kinds == x) & visits)
        for y, of_y in words.items():
            cols = np.flatnonzero((kinds == y) & ~visits)
            if not len(rows) or not len(cols) or 100 * sizes[rows].max() < per_cent * sizes[cols].min() or 100 * sizes[cols].max() < per_cent * sizes[rows].min():
                continue
            least = min(x, y)
            right = folded(of_y[place[cols]], y - least)
            step = max(1, (1 << 20) // (right.shape[1] * len(cols)))
            for i in range(0, len(rows), step):
                r = rows[i : i + step]
                left = folded(of_x[place[r]], x - least)
                apart = np.bitwise_count(left[:, None, :] ^ right[None, :, :]).sum(axis=2, dtype=np.int64)
                near = (100 + per_cent) * apart <= (100 - per_cent) * (sizes[r][:, None] + sizes[cols][None, :])
                near &= r[:, None] != cols[None, :]
                out[r] |= near.any(axis=1)
                out[cols] |= near.any(axis=0)
    return out


def _units(batches, columns: tuple[str, ...], finish):
    """``finish(grp, chunk, rows)`` of each unit in a stream of rows sorted by (grp, chunk)."""
    key, rows = None, []
    for batch in batches:
        for g, c, *row in zip(*(batch.column(k).to_pylist() for k in ("grp", "chunk", *columns)), strict=True):
            if (g, c) != key:
                if len(rows) > 1:
                    yield from finish(*key, rows)
                key, rows = (g, c), []
            rows.append(row)
    if len(rows) > 1:
        yield from finish(*key, rows)


def _survivors(per_cent: int, inner: bool):
    """grp, chunk, node, visit of the nodes that may have a link in a unit."""

    def finish(g, c, rows):
        near = near_signs([r[3] for r in rows], np.array([r[2] for r in rows], np.int64), np.array([r[1] for r in rows], bool), inner, per_cent)
        if near.any():
            own = [rows[i] for i in np.flatnonzero(near)]
            yield pa.RecordBatch.from_arrays([pa.array([g] * len(own), pa.int64()), pa.array([c] * len(own), pa.int32()), pa.array([r[0] for r in own], pa.int64()), pa.array([r[1] for r in own], pa.bool_())], ["grp", "chunk", "node", "visit"])

    return lambda batches: _units(batches, ("node", "visit", "n", "sign"), finish)


def _opened(per_cent: int, inner: bool):
    """Edges (a, b) of the units."""

    def finish(g, c, rows):
        a, b = compare(np.array([r[0] for r in rows], np.int64), [np.frombuffer(r[2], np.uint64) for r in rows], np.array([r[1] for r in rows], bool), inner, per_cent)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return lambda batches: _units(batches, ("node", "visit", "tokens"), finish)


def components(edges: DataFrame) -> DataFrame:
    """node, root: every node of ``edges`` (a, b) but the roots, with the smallest node of its component."""
    mark = lambda e: e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
    now = base.stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "stars")
    seen = mark(now)
    while seen["n"]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        new = base.stored(small.distinct(), "stars")
        base.dropped(now)
        now, before, seen = new, seen, mark(new)
        if (seen["n"], seen["h"]) == (before["n"], before["h"]):
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _compared(docs: DataFrame, units: DataFrame, own: DataFrame, members: DataFrame, size: int, per_cent: int, inner: bool) -> DataFrame:
    """Edges (a, b) in units (grp, chunk, node, visit): between visitors and the others and, where ``inner``, between the others."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = lambda rows: rows.repartition(parts, "grp", "chunk").sortWithinPartitions("grp", "chunk")
    near = base.stored(dealt(units.join(own, "node")).mapInArrow(_survivors(per_cent, inner), "grp long, chunk int, node long, visit boolean"), "near")
    sets = _needed_sets(docs, near.select("node").distinct().join(members.select("node", "rep"), "node"), size)
    return dealt(near.join(sets, "node")).mapInArrow(_opened(per_cent, inner), "a long, b long")


def links(docs: DataFrame, lead: DataFrame, size: int, per_cent: int, block: int = BLOCK, most: int = SHINGLES) -> DataFrame:
    """Edges (a, b) between linked nodes: enough of them to connect what is linked."""
    full = lead.where("n > 0")
    nodes = full.groupBy("node").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"))
    tokens = full.select("node", F.explode("head").alias("token"))
    shared = tokens.groupBy("token").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("token")
    cells = base.stored(tokens.join(shared, "token", "left_semi").distinct(), "cells")
    spark = docs.sparkSession
    if cells.isEmpty():
        return spark.createDataFrame([], "a long, b long")
    in_parts = F.ceil(F.greatest(F.count("*") / block, F.sum("n") / most)).cast("int")
    # groups: each node under the most frequent of its shared leading shingles
    often = cells.groupBy("token").agg(F.count("*").alias("df"))
    home = cells.join(often, "token").groupBy("node").agg(F.max(F.struct("df", "token")).alias("h")).select("node", F.col("h.token").alias("home")).join(nodes, "node")
    # the few that are cut, so that a hot one need not meet its rows in a shuffle
    crowd = base.stored(home.groupBy("home").agg(in_parts.alias("parts"), F.min("node").alias("anchor")).where("parts > 1"), "crowd")
    grp = lambda node: F.xxhash64("home", F.pmod(F.xxhash64(node), F.coalesce("parts", F.lit(1))))
    members = base.stored(home.join(crowd, "home", "left").select("node", "rep", "n", "home", grp("node").alias("grp")), "members")
    own = full.select("node", F.col("doc_id").alias("rep"), "n", "sign").alias("f").join(members.select("node", "rep").alias("m"), F.expr("f.node = m.node and f.rep <=> m.rep")).select("f.node", "n", "sign").dropDuplicates(["node"])
    # inside the groups; of a group in parts the smallest node visits all but its own
    visit = lambda v: (F.lit(0).alias("chunk"), "node", F.lit(v).alias("visit"))
    cut = crowd.select("home", F.col("anchor").alias("node"), grp("anchor").alias("at"))
    anchors = members.select("home", "grp").distinct().join(cut, "home").where("grp <> at").select("grp", *visit(True))
    inside = base.stored(_compared(docs, members.select("grp", *visit(False)).unionByName(anchors), own, members, size, per_cent, True), "inside")
    # what is connected already
    roots = components(inside)
    placed = base.stored(members.join(roots, "node", "left").select("node", "n", "grp", F.coalesce("root", "node").alias("comp")), "placed")
    known = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
    cells = cells.join(placed, "node")
    mixed = cells.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("token")
    cells = base.stored(cells.join(mixed, "token", "left_semi"), "cells")
    sizes = placed.groupBy("grp").agg(F.count("*").alias("m"), F.min("n").alias("low"), F.max("n").alias("high"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    matrix = cells.select("token", "grp").distinct().join(sizes, "grp").select("token", F.col("grp").alias("to"), F.col("m").alias("to_m"), "low", "high", "lo", "hi")
    # of two groups the smaller one's nodes visit, those that share a token with the other and can match in size
    rule = f"(m < to_m or (m = to_m and grp < to)) and 100 * n >= {per_cent} * low and 100 * high >= {per_cent} * n and not (comp = lo and comp = hi)"
    guests = base.stored(cells.join(sizes.select("grp", "m"), "grp").join(matrix, "token").where(rule).select("node", "n", F.col("to").alias("grp")).distinct(), "guests")
    if guests.isEmpty():
        return known
    calls = guests.groupBy("grp").agg(in_parts.alias("chunks"))
    visitors = guests.join(calls, "grp").select("grp", F.pmod(F.xxhash64("node", "grp"), "chunks").cast("int").alias("chunk"), "node", F.lit(True).alias("visit"))
    hosts = members.join(calls, "grp").select("grp", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "node", F.lit(False).alias("visit"))
    return known.unionByName(_compared(docs, visitors.unionByName(hosts), own, members, size, per_cent, False))


def classes(docs: DataFrame, size: int = SIZE, per_cent: int = PER_CENT, block: int = BLOCK, most: int = SHINGLES) -> DataFrame:
    """doc_id, n_shingles, component_id, text_hash and root (the component's smallest node, null without shingles) of each row of ``docs`` (doc_id, text)."""
    base.small_batches()
    docs = docs.select("doc_id", "text")
    lead = heads(docs, size, per_cent)
    stars = base.settled(lambda: components(links(docs, lead, size, per_cent, block, most)), "components")
    nodes = lead.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("rep"))
    rooted = nodes.join(stars, "node", "left").select("node", "rep", F.coalesce("root", "node").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("rep").alias("component"))
    named = rooted.join(lowest, "root").select("node", "component", "root")
    return lead.select("doc_id", "n", "node", "text_hash").join(named, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component")).alias("component_id"), "text_hash", "root")


def join(docs: DataFrame, size: int = SIZE, per_cent: int = PER_CENT, block: int = BLOCK, most: int = SHINGLES) -> DataFrame:
    """doc_id, n_shingles and component_id of each row of ``docs`` (doc_id, text)."""
    return classes(docs, size, per_cent, block, most).select("doc_id", "n_shingles", "component_id")
