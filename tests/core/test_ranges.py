"""Order over relations in buckets, against plain Python."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chunkweave.operators import align, combine, ranges


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.mark.parametrize("n", [0, 1, 7, 500])
def test_row_numbers_and_sums(spark, n):
    rng = np.random.default_rng(n)
    labels = sorted(rng.choice(10_000, n, replace=False).tolist())
    weights = rng.integers(1, 9, n).tolist()
    df = frame(spark, [(a, w) for a, w in zip(labels, weights, strict=True)], "label bigint, w bigint")
    if n == 500:
        assert ranges.in_buckets(df, "label").select(ranges.BUCKET).distinct().count() > 2
    got = {r["label"]: r["pos"] for r in ranges.row_numbers(df, "label", "pos").collect()}
    assert got == {a: k for k, a in enumerate(labels)}
    got = {r["label"]: r["s"] for r in ranges.sums_before(df, "label", "w", "s").collect()}
    assert got == {a: sum(weights[:k]) for k, a in enumerate(labels)}


@pytest.mark.parametrize("kind", ["string", "date", "timestamp", "double"])
def test_other_types(spark, kind):
    df = spark.range(300).select(F.expr({"string": "concat('a', id)", "date": "date_add(date'2000-01-01', int(id))", "timestamp": "timestamp_seconds(id * 7200)", "double": "id / 7.0"}[kind]).cast(kind).alias("label"))
    got = [r["pos"] for r in ranges.row_numbers(df, "label", "pos").orderBy("label").collect()]
    assert got == list(range(300))


def test_join_labels(spark):
    a = frame(spark, [(k, 3 * k) for k in range(200)], "pos bigint, label bigint")
    b = frame(spark, [(k, 2 * k) for k in range(200)], "pos bigint, label bigint")
    for how, want in (("outer", {3 * k for k in range(200)} | {2 * k for k in range(200)}), ("inner", {3 * k for k in range(200)} & {2 * k for k in range(200)})):
        got = [(r["pos"], r["label"]) for r in align.join_labels([a, b], how).orderBy("pos").collect()]
        assert got == list(enumerate(sorted(want)))


def brute_order(spans):
    first = sorted({a for _, a, _ in spans})
    ordered = sorted(spans, key=lambda s: (s[1], s[0]))
    return {f: (a, b, first.index(a), k + 1 < len(ordered) and ordered[k + 1][1] <= b) for k, (f, a, b) in enumerate(ordered)}


@pytest.mark.parametrize("n", [0, 1, 3, 300])
def test_file_order(spark, n):
    rng = np.random.default_rng(n)
    spans = [(f"f{k}", int(a), int(a + rng.integers(0, 4))) for k, a in enumerate(rng.integers(0, 600, n))]
    labels = frame(spark, [(f, x) for f, a, b in spans for x in (a, b)], "file string, label bigint")
    got = {r["file"]: (r["first"], r["last"], r["ord"], r["overlaps"]) for r in align.file_order(labels).collect()}
    assert got == brute_order(spans)


def test_concat_files(spark):
    files = frame(spark, [(f"f{k}", k, k % 3 + 1) for k in range(200)], "file string, ord bigint, grid_len bigint")
    refs = frame(spark, [(f"f{k}", [j]) for k in range(200) for j in range(k % 3 + 1)], "file string, idx array<bigint>")
    got = sorted(r["idx"][0] for r in combine.concat_files(refs, files, 0).collect())
    assert got == list(range(len(got))) and len(got) == sum(k % 3 + 1 for k in range(200))


def closest(coords, x):
    if not coords:
        return None
    if x is None:
        return min(coords)[1]
    below, above = [c for c in coords if c[0] <= x], [c for c in coords if c[0] >= x]
    if not below:
        return min(above)[1]
    return max(below)[1] if not above or not min(above)[0] - x < x - max(below)[0] else min(above)[1]


@pytest.mark.parametrize(("n", "m"), [(0, 5), (1, 5), (400, 400), (5, 400), (400, 3)])
def test_nearest(spark, n, m):
    rng = np.random.default_rng(n + m)
    coords = [(int(x), k) for k, x in enumerate(rng.choice(2000, n, replace=False))]
    wanted = [int(x) for x in rng.integers(-50, 2100, m)] + [77] * 50 + [None]
    got = align.nearest(frame(spark, [(p, x) for x, p in coords], "pos bigint, label bigint"), frame(spark, [(x,) for x in wanted], "label bigint"))
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(((r["label"], r["pos"]) for r in got.collect()), key=key) == sorted(((x, closest(coords, x)) for x in wanted), key=key)
