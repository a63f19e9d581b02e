"""Sharding by histogram sort: near-equal bytes in each shard, rows exchanged once.

Rows are ordered by (md5 of the text as a 60-bit number, doc_id, serial number), so equal texts are neighbours.  A row
belongs to shard ``k`` when the bytes before it, in that order, are at least ``k`` sixteenths of all
bytes and less than ``k + 1``.  The splitters are found without a sort: each round counts the exact bytes
and rows below candidate boundaries across all partitions and refines only the intervals that still hold a
splitter, until an interval's rows all share one key.  Besides the splitters of shards, splitters at a row
count cut every shard into fine ranges; those take an interval's edge once it is close enough.  Rows then
move once, to their fine range, and are numbered there.

A fine range never grows with one text: a text that many rows share is cut by doc_id, a row that stands there
many times by serial numbers, given when the keys were stored.  What reaches the driver is about 16 numbers a
fine range in the first round, which settles all of those but the ones in hot texts, and 256 for each splitter
that is still open in the others.

Cases: a null text has size 1, its crc32 is that of the empty text, and it sorts as the empty text does; a
null doc_id sorts before all others; rows alike in text and doc_id are shared out as any others; an empty
table gives no rows.
"""

from __future__ import annotations

import bisect
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from . import base

SHARDS = 16
#: Intervals that a refined interval is cut into, and all rows at first at least, as powers of two.
FANOUT_BITS, FIRST_BITS = 8, 12
#: Parts of a row's key, in order, and their bits.
KEYS = (("key", 60), ("uid", 64), ("serial", 63))
#: A fine range's edge may be off by this share of a range's rows.
SLACK = 0.25
#: Rows in a fine range, about.
RANGE_ROWS = 1_000_000


def _keys(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id",
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long").alias("key"),
        # the order of ids as an unsigned number: sign turned, null first
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).bitwiseXOR(F.lit(-(1 << 63))).alias("uid"),
        F.monotonically_increasing_id().alias("serial"),
    )


class _Interval:
    """Rows whose keys begin with the same bits: whole parts of the key, then a prefix of the next; what lies before them and what they hold."""

    def __init__(self, whole: tuple[int, ...], bits: int, prefix: int, rows: int, size: int, before_rows: int, before_size: int):
        self.whole, self.bits, self.prefix = whole, bits, prefix
        self.rows, self.size, self.before_rows, self.before_size = rows, size, before_rows, before_size

    def edge(self, beyond: bool = False) -> tuple[int, ...]:
        """The smallest key of the interval, or the first one past it."""
        part = len(self.whole)
        out = [*self.whole, (self.prefix + beyond) << (KEYS[part][1] - self.bits)] + [0] * (len(KEYS) - part - 1)
        for k in range(part, 0, -1):  # what is past the last number of a part begins the next of the part before
            if out[k] >> KEYS[k][1]:
                out[k] = 0
                out[k - 1] += 1
        return tuple(out)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _shifted(part: str, bits: int, taken: int) -> Column:
    """The first ``taken`` bits of a part of the key."""
    return F.shiftrightunsigned(part, bits - taken) if taken else F.lit(0).cast("long")


def _counted(rows: DataFrame, part: int, taken: int, width: int, parents: list[_Interval] | None) -> list[list[_Interval]]:
    """Exact rows and bytes of each piece of the parents, in order: pieces by the ``width`` bits that follow ``taken`` bits of a part of the key."""
    name, bits = KEYS[part]
    picked = rows.withColumn("parent", F.lit(0))
    if parents is not None:
        # the rows of the parents alone: at most one parent for each splitter
        names = [f"at{k}" for k in range(part + 1)]
        at = [F.col(KEYS[k][0]) for k in range(part)] + [_shifted(name, bits, taken)]
        known = [(*map(_signed, p.whole), *((_signed(p.prefix),) if len(p.whole) == part else (_signed(p.prefix), 0)), i) for i, p in enumerate(parents)]
        known = rows.sparkSession.createDataFrame(known, ", ".join(f"{n} long" for n in names) + ", parent int")
        picked = rows.withColumns(dict(zip(names, at, strict=True))).join(F.broadcast(known), names)
    piece = F.shiftrightunsigned(name, bits - taken - width).bitwiseAND(F.lit((1 << width) - 1))
    found = picked.groupBy("parent", piece.alias("piece")).agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).orderBy("parent", "piece").collect()
    out: list[list[_Interval]] = [[] for _ in parents or [None]]
    for x in found:
        own, parent = out[x["parent"]], parents[x["parent"]] if parents else None
        if own:
            r, b = own[-1].before_rows + own[-1].rows, own[-1].before_size + own[-1].size
        else:
            r, b = (parent.before_rows, parent.before_size) if parent else (0, 0)
        deeper = parent is None or len(parent.whole) < part
        whole = () if parent is None else (*parent.whole, parent.prefix) if deeper else parent.whole
        own.append(_Interval(whole, taken + width, x["piece"] if deeper else parent.prefix << width | x["piece"], x["n"], x["bytes"], r, b))
    return out


def splitters(rows: DataFrame, shards: int, ranges: int) -> tuple[list[tuple[int, ...]], list[tuple[int, ...]]]:
    """Smallest key of each shard but the first, and of each fine range but the first."""
    part, taken, width = 0, 0, max(FIRST_BITS, ranges.bit_length() + 3)
    pieces = _counted(rows, part, taken, width, None)[0]
    if not pieces:
        return [], []
    total_rows, total_size = pieces[-1].before_rows + pieces[-1].rows, pieces[-1].before_size + pieces[-1].size
    # a target: (exact?, place in bytes or rows)
    wanted = [(True, -(-k * total_size // shards)) for k in range(1, shards)] + [(False, k * total_rows // ranges) for k in range(1, ranges)]
    close = SLACK * total_rows / ranges
    edges: dict[tuple[bool, int], tuple[int, ...]] = {}
    groups = [(pieces, dict.fromkeys(wanted))]
    while groups:
        last = part + 1 == len(KEYS) and taken + width == KEYS[part][1]
        opened: dict[int, tuple[_Interval, dict]] = {}
        for own, targets in groups:
            begins = {True: [p.before_size for p in own], False: [p.before_rows for p in own]}
            for t in targets:
                exact, place = t
                held = (lambda p: p.size) if exact else (lambda p: p.rows)
                # the first piece that begins at the place or beyond it is the shard's first, unless the one before it is cut
                k = bisect.bisect_left(begins[exact], place)
                inside = own[k - 1] if k and place < begins[exact][k - 1] + held(own[k - 1]) else None
                if inside is None:
                    edges[t] = own[k].edge() if k < len(own) else own[-1].edge(beyond=True)
                    continue
                low = place - begins[exact][k - 1]
                if not exact and min(low, held(inside) - low) <= close:
                    edges[t] = inside.edge(beyond=2 * low > held(inside))
                elif inside.rows == 1 or last:
                    # the row that the place lies in starts before it: the next one is the first of the shard
                    edges[t] = inside.edge(beyond=True)
                else:
                    opened.setdefault(id(inside), (inside, {}))[1][t] = None
        taken += width
        if taken == KEYS[part][1]:
            part, taken = part + 1, 0
        if opened:
            width = min(FANOUT_BITS, KEYS[part][1] - taken)
            groups = list(zip(_counted(rows, part, taken, width, [p for p, _ in opened.values()]), [t for _, t in opened.values()], strict=True))
        else:
            groups = []
    return [edges[t] for t in wanted if t[0]], [edges[t] for t in wanted if not t[0]]


def _packed(columns) -> np.ndarray:
    """Keys as strings of bytes whose order is that of the keys."""
    return np.ascontiguousarray(np.stack(columns, axis=1).astype(">u8")).view(f"S{8 * len(KEYS)}").ravel()


def _position(outer: list[tuple[int, ...]], fine: list[tuple[int, ...]], spark) -> Column:
    """Struct of shard and range of a row: how many of the sorted edges of each are at or before it."""
    packed = [_packed(list(np.array(e, dtype=np.uint64).reshape(-1, len(KEYS)).T)) for e in (sorted(outer), sorted(fine))]
    sent = spark.sparkContext.broadcast(packed)

    @arrow_udf("shard int, range int")
    def run(key: pa.Array, uid: pa.Array, serial: pa.Array) -> pa.Array:
        own = _packed([c.to_numpy(zero_copy_only=False).view(np.uint64) for c in (key, uid, serial)])
        return pa.StructArray.from_arrays([pa.array(np.searchsorted(e, own, side="right"), pa.int32()) for e in sent.value], ["shard", "range"])

    return run(*[F.col(k) for k, _ in KEYS])


def shard(docs: DataFrame, shards: int = SHARDS, range_rows: int = RANGE_ROWS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of each row of ``docs``."""
    rows = base.stored(_keys(docs), "shard-keys")
    total, spark = rows.count(), docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(shards, parts, math.ceil(total / range_rows))
    outer, fine = splitters(rows, shards, ranges)
    placed = rows.withColumn("at", _position(outer, sorted(set(outer) | set(fine)), spark)).select("*", "at.*").drop("at")
    # rows of each fine range, a bounded number: where its slots begin
    counts = sorted((r["range"], r["shard"], r["n"]) for r in placed.groupBy("range", "shard").agg(F.count("*").alias("n")).collect())
    starts, filled = [], {}
    for r, s, n in counts:
        starts.append((r, filled.get(s, 0)))
        filled[s] = filled.get(s, 0) + n
    begin = spark.createDataFrame(starts, "range int, start long")
    order = Window.partitionBy("range").orderBy("key", F.col("uid").bitwiseXOR(F.lit(-(1 << 63))), "serial")
    return (
        placed.repartition(max(parts, len(starts)), "range")
        .withColumn("slot", F.row_number().over(order) - 1)
        .join(F.broadcast(begin), "range")
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("slot") + F.col("start")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )
