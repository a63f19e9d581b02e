"""Language identification: known words by per-language log frequency, unseen words by ever shorter character n-grams.

The model is fitted on a bounded sample of the rows that may be learned from: about ``PER_LANG`` rows a
language, picked by a hash of the id, every language by its own share.  Its table is sparse, and each language
brings its own most frequent words and n-grams of each length, ``ENTRIES`` over all languages and at least
``LEAST`` a language: a frequent language takes nothing from a rare one.  So the table that is broadcast grows
with the number of languages alone.  Prediction reads every word of every text.

Cases: a null text, or one without a letter, is ``und`` with score 0, and so is every text when there
is nothing to learn from; equal evidence goes to the language that sorts first; rows with a null lang or
text are not learned from, null ids neither.  Rows are independent, so skew and repeats do no harm.
"""

from __future__ import annotations

import itertools
import re
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from . import base

#: Rows of each language that the model is fitted on, about; longest n-gram.
PER_LANG, LONGEST = 2500, 5
#: Size of the model: words and n-grams of all languages; the least that a language brings of each length.
ENTRIES, LEAST = 300_000, 500
#: Number of n-gram rows that count in full; rarer n-grams of three or more letters say little and are left out.
SEEN = 2
#: Slices in which a language's most frequent entries are looked for.
SLICES = 16
#: Words that count in full towards the score; more words than these add no more certainty.
EVIDENCE = 20
#: Cells (words times languages) of evidence that a worker keeps; words and n-grams that it counts before it passes them on.
KEPT_CELLS, FLUSH = 1_500_000, 100_000
WORD = re.compile(r"[^\W\d_]+")
RESULT = "lang_pred string, score double"
GRAMS = "place int, size int, gram string, n long"


def _words(text: str) -> list[str]:
    """Lower-cased runs of word characters that have a letter; numerals such as superscripts alone are no words."""
    words = WORD.findall(text.lower())
    return words if text.isascii() else [w for w in words if any(map(str.isalpha, w))]


def _count(batches):
    """Words (size 0) and n-grams of the batches' texts, counted before the shuffle; at most about ``FLUSH`` are held."""
    base.built(("grams",), dict)
    found: Counter = Counter()

    def out():
        cols = list(zip(*found, strict=True)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string()), pa.array(list(found.values()), pa.int64())], ["place", "size", "gram", "n"])

    for batch in batches:
        for lang, text in zip(batch.column("place").to_pylist(), batch.column("text"), strict=True):
            for word, n in Counter(_words(text.as_py())).items():
                found[lang, 0, word] += n
                whole = f"^{word}$"
                for size in range(1, LONGEST + 1):
                    for i in range(len(whole) - size + 1):
                        found[lang, size, whole[i : i + size]] += n
            if len(found) > FLUSH:
                yield out()
                found.clear()
    yield out()


def train(docs: DataFrame, per_lang: int = PER_LANG, entries: int = ENTRIES, least: int = LEAST) -> dict:
    """Model of ``docs`` (doc_id, text, lang), to be passed to :func:`predict`. Leave held-out rows out beforehand."""
    base.small_batches()
    known = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), "text").where("lang is not null and text is not null and doc_id is not null")
    # a number a language
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().toLocalIterator()}
    langs = sorted(sizes)
    if not langs:
        return {"id": uuid.uuid4().hex, "langs": [], "grams": {}}
    shares = docs.sparkSession.createDataFrame([(k, lang, min(1.0, per_lang / sizes[lang])) for k, lang in enumerate(langs)], "place int, lang string, share double")
    sample = known.join(F.broadcast(shares), "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.col("share") * (1 << 30))
    counted = sample.select("place", "text").mapInArrow(_count, GRAMS).groupBy("size", "gram", "place").agg(F.sum("n").alias("n")).where(f"n >= {SEEN} or size < 3")
    counted = base.stored(counted, "grams")
    most = max(least, entries // (len(langs) * (LONGEST + 1)))
    # the most frequent of each language and length, first within slices of them, so that no task holds a whole language
    by = lambda *more: F.row_number().over(Window.partitionBy("place", "size", *more).orderBy(F.desc("n"), "gram"))
    heads = counted.withColumn("first", by(F.pmod(F.xxhash64("gram"), F.lit(SLICES)))).where(F.col("first") <= most)
    wanted = heads.withColumn("first", by()).where(F.col("first") <= most).select("size", "gram").distinct()
    # what one language brings is counted in all
    rows = counted.join(wanted, ["size", "gram"]).toArrow().sort_by([("size", "ascending"), ("gram", "ascending"), ("place", "ascending")])
    base.dropped(counted)
    out = {}
    for size in range(LONGEST + 1):
        own = rows.filter(pc.equal(rows.column("size"), size))
        if not own.num_rows:
            continue
        names, place, n = own.column("gram").to_pylist(), own.column("place").to_numpy(), own.column("n").to_numpy().astype(float)
        heads = np.flatnonzero(np.array([True] + [x != y for x, y in itertools.pairwise(names)]))
        total = np.bincount(place, n, len(langs)) + 0.5 * len(heads) + 1
        out[size] = ([names[k] for k in heads], np.append(heads, len(names)), place.astype(np.int32), np.log((n + 0.5) / 0.5).astype(np.float32), np.log(0.5 / total))
    return {"id": uuid.uuid4().hex, "langs": langs, "grams": out}


class Scorer:
    """Keeps the evidence of words: one row of log frequencies a word.

    model["grams"][size]: the names; where each one's cells begin, and the last ones end; languages and gains of the
    cells; log frequency of what a language has not.
    """

    def __init__(self, model: dict):
        self.langs = model["langs"]
        self.index: dict[int, dict[str, int]] = {}
        begins, langs, gains, floors, at, cells = [], [], [], [], 0, 0
        for size, (names, heads, place, gain, floor) in sorted(model["grams"].items()):
            self.index[size] = {g: at + k for k, g in enumerate(names)}
            begins.append(heads[:-1] + cells)
            langs.append(place)
            gains.append(gain)
            floors.append((at, floor))
            at += len(names)
            cells += len(place)
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        self.begins, self.lang, self.gain = np.append(join(begins, np.int64), cells), join(langs, np.int32), join(gains, np.float32)
        self.floor_at, self.floors = np.array([a for a, _ in floors]), np.array([f for _, f in floors])
        self.most = max(1, KEPT_CELLS // max(1, len(self.langs)))
        self._forget()

    def _forget(self):
        self.row_of: dict[str, int] = {}
        self.rows = np.zeros((0, max(1, len(self.langs))), np.float32)

    def hits(self, word: str) -> list[int]:
        """The word itself; else back off to the longest n-grams of which the model knows one; a word unlike all is no evidence."""
        if (own := self.index.get(0, {}).get(word)) is not None:
            return [own]
        whole = f"^{word}$"
        for n in range(LONGEST, 0, -1):
            get = self.index.get(n, {}).get
            if found := [x for i in range(len(whole) - n + 1) if (x := get(whole[i : i + n])) is not None]:
                return found
        return []

    def _learn(self, words: list[str]) -> None:
        found = [self.hits(w) for w in words]
        size = np.array([len(f) for f in found])
        flat = np.array([x for f in found for x in f], np.int64)
        new = np.zeros((len(words), self.rows.shape[1]))
        if len(flat):
            owner = np.repeat(np.arange(len(words)), size)
            np.add.at(new, owner, self.floors[np.searchsorted(self.floor_at, flat, side="right") - 1])
            many = self.begins[flat + 1] - self.begins[flat]
            cell = np.repeat(self.begins[flat] - np.cumsum(many) + many, many) + np.arange(many.sum())
            np.add.at(new, (np.repeat(owner, many), self.lang[cell]), self.gain[cell])
            new /= np.maximum(size, 1)[:, None]
        used = len(self.row_of)
        if used + len(words) > len(self.rows):
            self.rows = np.concatenate([self.rows[:used], np.zeros((max(len(words), used), self.rows.shape[1]), np.float32)])
        self.rows[used : used + len(words)] = new
        self.row_of.update(zip(words, range(used, used + len(words)), strict=True))

    def predict(self, text: str | None) -> tuple[str, float]:
        words = _words(text or "")
        if not words or not self.langs:
            return "und", 0.0
        total = np.zeros(self.rows.shape[1])
        for i in range(0, len(words), self.most):  # so many words at once as are kept
            own = words[i : i + self.most]
            if len(self.row_of) + len(own) > 2 * self.most:
                self._forget()
            if missing := {w for w in own if w not in self.row_of}:
                self._learn(sorted(missing))
            total += self.rows[list(map(self.row_of.__getitem__, own))].sum(axis=0, dtype=np.float64)
        total *= min(1.0, EVIDENCE / len(words))
        best = int(total.argmax())
        return self.langs[best], float(1 / np.exp(total - total[best]).sum())


def predict(text: Column, model: dict, spark) -> Column:
    """A struct of :data:`RESULT` for each text."""
    base.small_batches()
    sent = spark.sparkContext.broadcast(model)
    key = ("lang", model["id"])

    @arrow_udf(RESULT)
    def run(column: pa.Array) -> pa.Array:
        scorer = base.built(key, lambda: Scorer(sent.value))
        found = [scorer.predict(t.as_py()) for t in column]
        return pa.StructArray.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["lang_pred", "score"])

    return run(text)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each row, learning from rows whose fold (mod 3) is not 1."""
    out = base.held_out(3, 1)
    model = train(docs.where(~out))
    return docs.select("doc_id", (base.fold(3) == 1).alias("held_out"), predict(F.col("text"), model, docs.sparkSession).alias("r")).select("doc_id", "held_out", "r.*")
