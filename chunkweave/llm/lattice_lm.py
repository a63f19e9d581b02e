"""Language-model scoring by subword lattices.

A word is every path through its lattice of vocabulary pieces; its probability is the sum over all
segmentations, by a forward recursion in log space.  Pieces don't cross words, so a text's marginal
probability is the product of its words' marginals and that of the end.  The pieces and their first
weights are those of an existing vocabulary (its scores are ranks, read as a Zipf law); expected counts
over all words that may be learned from re-estimate the weights, with the first weights as a prior.
Characters without a piece take the path of their bytes.

Counts of words grow with the corpus and stay distributed: each partition counts its words, one shuffle
adds them up, and the marginal of each distinct word is computed once.  The ``HEAD`` most frequent words
are broadcast; a document's other words, few by choice of the head, join the table of words.  What reaches
the driver is bounded by the vocabulary and the head.

Cases: a null, empty or wordless text has one token, its end; words unseen in training have c = 0 and a
score like any other; without training rows the weights are the vocabulary's own; repeated rows are scored
alike, each counts in training; null ids are not learned from.  A very long word is worked through in
stripes: beside its characters two numbers a character are held.
"""

from __future__ import annotations

import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import base

#: Words in the broadcast head; rounds of re-estimation; weight of the vocabulary's own scores, in pieces.
HEAD, ROUNDS, PRIOR = 200_000, 2, 1000.0
#: Characters whose arcs are held at once.
ARCS = 100_000
#: Distinct words that a partition counts before it passes them on.
FLUSH = 300_000
START = "▁"
PASSED = "key long, doc_id long, held_out boolean, n_tokens long, known long, base double, score double, words array<binary>, times array<long>"
_P = np.uint64(0x9E3779B97F4A7C15)
_SLOTS = 22


class Vocabulary:
    """Pieces of a sentencepiece model and log weights."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ranks, self.pieces, self.byte, self.end = [], [], np.zeros(256, np.int64), 0
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte[int(piece[3:5], 16)] = len(self.pieces)
                ranks.append(model.get_piece_size())
            elif i == model.eos_id():
                self.end = len(self.pieces)
                ranks.append(100)
            elif model.is_control(i) or model.is_unknown(i) or set(piece) == {START} and len(piece) > 1:
                continue
            else:
                ranks.append(max(0.0, -model.get_score(i)) if model.get_score(i) > -1e8 else model.get_piece_size())
            self.pieces.append(piece)
        zipf = 1 / (np.array(ranks) + 2.7)
        self.first = np.log(zipf / zipf.sum())
        self.longest = max(len(p) for k, p in enumerate(self.pieces) if k not in set(self.byte) and k != self.end)
        special = {*self.byte.tolist(), self.end}
        plain = [k for k in range(len(self.pieces)) if k not in special]
        self.hashes = np.zeros(len(self.pieces), np.uint64)
        for k in plain:
            h = np.uint64(0)
            with np.errstate(over="ignore"):
                for c in self.pieces[k]:
                    h = (h + np.uint64(ord(c) + 1)) * _P
                    h ^= h >> np.uint64(29)
            self.hashes[k] = h
        self.slots = np.full(1 << _SLOTS, -1, np.int32)
        self.crowded = np.zeros(1 << _SLOTS, bool)
        self.others: dict[int, int] = {}
        for k in plain:
            s = int(self.hashes[k] >> np.uint64(64 - _SLOTS))
            if self.slots[s] < 0:
                self.slots[s] = k
            else:
                self.crowded[s] = True
                self.others[int(self.hashes[k])] = k

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece of each hash, -1 for none."""
        slot = (h >> np.uint64(64 - _SLOTS)).astype(np.int64)
        k = self.slots[slot].astype(np.int64)
        ok = (k >= 0) & (self.hashes[k] == h)
        out = np.where(ok, k, -1)
        for at in zip(*np.nonzero(~ok & self.crowded[slot]), strict=True):
            out[at] = self.others.get(int(h[at]), -1)
        return out


class Lattice:
    """Words of one length and their paths. Arcs are worked out for so many beginnings at once that a stripe of them has about ``ARCS`` characters, however long a word is."""

    def __init__(self, vocabulary: Vocabulary, words: list[str], most: int | None = None):
        self.v, self.n, self.length = vocabulary, len(words), len(words[0]) + 1
        self.codes = np.frombuffer("".join(START + w for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(self.n, self.length)
        self.reach = min(self.length, vocabulary.longest)
        step = max(1, (most or ARCS) // self.n)
        self.stripes = [(a, min(self.length, a + step)) for a in range(0, self.length, step)]

    def arcs(self, a: int, b: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """Pieces of the windows of 1, 2, ... characters that begin at ``a`` to ``b``, as [word, beginning, length]; -1 for none, numbers past the pieces for unknown characters, whose byte pieces follow."""
        out = np.full((self.n, b - a, self.reach), -1, np.int32)
        h, unknown = np.zeros((self.n, b - a), np.uint64), []
        for k in range(self.reach):
            fits = min(b, self.length - k) - a  # further windows reach past the end
            if fits <= 0:
                break
            h = (h[:, :fits] + (self.codes[:, a + k : a + k + fits] + np.uint32(1)).astype(np.uint64)) * _P
            h ^= h >> np.uint64(29)
            found = self.v.find(h)
            if k == 0 and (found < 0).any():
                lost = found < 0
                chars, at = np.unique(self.codes[:, a:b][lost], return_inverse=True)
                found[lost] = len(self.v.pieces) + at
                unknown = [self.v.byte[list(chr(c).encode("utf-8", "surrogatepass"))] for c in chars]
            out[:, :fits, k] = found
        return out, unknown

    @staticmethod
    def weights(arcs: np.ndarray, unknown: list[np.ndarray], logp: np.ndarray) -> np.ndarray:
        return np.concatenate([logp, [logp[x].sum() for x in unknown], [-np.inf]])[arcs]

    def forward(self, logp: np.ndarray) -> np.ndarray:
        """Log of the sum over the segmentations of each beginning; columns past the length stay empty."""
        alpha = np.full((self.n, self.length + 1 + self.reach), -np.inf)
        alpha[:, 0] = 0
        for a, b in self.stripes:
            w = self.weights(*self.arcs(a, b), logp)
            for i in range(a, b):
                ahead = alpha[:, i + 1 : i + 1 + self.reach]
                np.logaddexp(ahead, alpha[:, i : i + 1] + w[:, i - a], out=ahead)
        return alpha

    def marginal(self, logp: np.ndarray) -> np.ndarray:
        return self.forward(logp)[:, self.length]

    def expected(self, logp: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Expected uses of each piece, the words counted so many times."""
        alpha = self.forward(logp)
        beta = np.full((self.n, self.length + 1 + self.reach), -np.inf)
        beta[:, self.length] = 0
        total = np.zeros(len(logp))
        for a, b in reversed(self.stripes):
            arcs, unknown = self.arcs(a, b)
            w = self.weights(arcs, unknown, logp)
            for i in range(b - 1, a - 1, -1):
                x = w[:, i - a] + beta[:, i + 1 : i + 1 + self.reach]
                top = x.max(axis=1, keepdims=True)
                beta[:, i] = top[:, 0] + np.log(np.exp(x - top).sum(axis=1))
            behind = np.lib.stride_tricks.sliding_window_view(beta[:, a + 1 : b + self.reach], self.reach, axis=1)
            w += alpha[:, a:b, None] + behind - alpha[:, self.length, None, None]
            ok = arcs >= 0
            own = np.bincount(arcs[ok], (np.exp(w) * times[:, None, None])[ok], len(logp) + len(unknown))
            for k, x in enumerate(unknown):
                np.add.at(total, x, own[len(logp) + k])
            total += own[: len(logp)]
        return total


def _by_length(words: list[bytes], most: int | None = None):
    """Indexes of words of one length, and the words, so many characters at once, or one longer word."""
    text = [w.decode("utf-8", "surrogateescape").encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace") for w in words]
    lengths = np.array([len(t) for t in text])
    order = np.argsort(lengths, kind="stable")
    for length in np.unique(lengths):
        at = order[np.searchsorted(lengths[order], length) : np.searchsorted(lengths[order], length, side="right")]
        step = max(1, (most or ARCS) // (int(length) + 1))
        for i in range(0, len(at), step):
            yield at[i : i + step], [text[j] for j in at[i : i + step]]


def log_marginals(vocabulary: Vocabulary, logp: np.ndarray, words: list[bytes]) -> np.ndarray:
    """log10 of each word's marginal; of the end for the empty word."""
    out = np.zeros(len(words))
    for at, own in _by_length(words):
        out[at] = Lattice(vocabulary, own).marginal(logp) if own[0] else logp[vocabulary.end]
    return out / np.log(10)


def _vocabulary(path: str) -> Vocabulary:
    return base.built(("vocabulary", path), lambda: Vocabulary(path))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def tokens(text: bytes | None) -> list[bytes]:
    """Words of the lowered text; then the end, written as the empty word."""
    return [*(text.lower().split() if text else ()), b""]


def word_counts(docs: DataFrame, learn: Column) -> DataFrame:
    """word and c, its count in the rows where ``learn`` holds, for each distinct token of all rows; stored."""

    def run(batches):
        def out(found):
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["word", "c"])

        base.built(("counts",), dict)
        found: Counter = Counter()
        for batch in batches:
            for text, learned in zip(base.texts(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                own = tokens(text)
                if learned:
                    found.update(own)
                else:
                    found.update(dict.fromkeys(own, 0))
                if len(found) > FLUSH:
                    yield out(found)
                    found = Counter()
        yield out(found)

    return base.stored(docs.select("text", learn.alias("learn")).mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c")), "words")


def weights(words: DataFrame, path: str, rounds: int = ROUNDS) -> np.ndarray:
    """Log weights of the pieces after re-estimation on ``words`` (word, c)."""
    vocabulary = _vocabulary(path)
    logp, spark = vocabulary.first, words.sparkSession
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(logp)

        def run(batches, sent=sent):
            v = _vocabulary(path)
            total = np.zeros(len(v.pieces))
            for batch in batches:
                own, c = batch.column(0).to_pylist(), batch.column(1).to_numpy().astype(float)
                for at, chars in _by_length(own):
                    if not chars[0]:
                        total[v.end] += c[at].sum()
                    else:
                        total += Lattice(v, chars).expected(sent.value, c[at])
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.float64())], ["piece", "e"])

        rows = words.where("c > 0").select("word", "c").mapInArrow(run, "piece long, e double").groupBy("piece").agg(F.sum("e").alias("e")).toArrow()
        e = np.zeros(len(logp))
        e[rows.column("piece").to_numpy()] = rows.column("e").to_numpy()
        mass = e + PRIOR * np.exp(vocabulary.first)
        logp = np.log(mass / mass.sum())
    return logp


def scored_words(words: DataFrame, logp: np.ndarray, path: str) -> DataFrame:
    """word, c and lp, the log10 marginal of each word; stored."""
    sent = words.sparkSession.sparkContext.broadcast(logp)

    def run(batches):
        for batch in batches:
            own = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(log_marginals(_vocabulary(path), sent.value, own), pa.float64())], ["word", "c", "lp"])

    return base.stored(words.select("word", "c").mapInArrow(run, "word binary, c long, lp double"), "scored-words")


def score(docs: DataFrame, path: str | None = None, modulus: int = 7, remainder: int = 2, head: int = HEAD) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row of ``docs``."""
    base.small_batches()
    path = path or default_path()
    counted = word_counts(docs, ~base.held_out(modulus, remainder))
    total = counted.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.coalesce(F.sum((F.col("c") > 0).cast("long")), F.lit(0)).alias("v")).first()
    words = scored_words(counted, weights(counted, path), path)
    base.dropped(counted)
    top = words.orderBy(F.desc("c"), "word").limit(head).toArrow()
    sent = docs.sparkSession.sparkContext.broadcast((top.column("word").to_pylist(), top.column("c").to_numpy(), top.column("lp").to_numpy()))
    key = ("head", uuid.uuid4().hex)

    def run(batches):
        from pyspark import TaskContext

        own, c, lp = sent.value
        get = base.built(key, lambda: {w: k for k, w in enumerate(own)}).get
        plus, known, n = np.append(np.log10(c + 1.0), 0.0), np.append(c > 0, False), TaskContext.get().partitionId() << 40
        lp = np.append(lp, 0.0)
        for batch in batches:
            cols: list[list] = [[] for _ in range(7)]
            for text in base.texts(batch.column(1)):
                found = tokens(text)
                at = np.fromiter((get(w, -1) for w in found), np.int64, len(found))
                rest = Counter(found[i] for i in np.flatnonzero(at < 0))
                for col, x in zip(cols, (n, len(found), int(known[at].sum()), float(plus[at].sum()), float(lp[at].sum()), list(rest), list(rest.values())), strict=True):
                    col.append(x)
                n += 1
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int64()))
            made = [pa.array(x, t) for x, t in zip(cols, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([made[0], batch.column(0), batch.column(2), *made[1:]], [x.split()[0] for x in PASSED.split(", ")])

    passed = base.stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (base.fold(modulus) == remainder).alias("held_out")).mapInArrow(run, PASSED), "passed")
    rest = passed.select("key", F.explode(F.arrays_zip("words", "times")).alias("x")).select("key", F.col("x.words").alias("word"), F.col("x.times").alias("times"))
    rest = rest.join(words, "word").groupBy("key").agg(F.sum(F.when(F.col("c") > 0, F.col("times"))).alias("known_"), F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("base_"), F.sum(F.col("times") * F.col("lp")).alias("score_"))
    n, v = total["n"], total["v"]
    zero = lambda c: F.coalesce(c, F.lit(0))
    return passed.drop("words", "times").join(rest, "key", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + zero("known_")).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + zero("base_") - F.col("n_tokens") * float(np.log10(n + v + 1))).alias("base_score"), (F.col("score") + zero("score_")).alias("score"),
    )
