"""Edit-aware token counts: a segment tree of pre-tokens for each document, kept as a table.

Leaves are blocks of pre-tokens with their token counts; inner nodes hold sums of characters and tokens.
A kept tree is a row: the text, lengths and counts of its pre-tokens, how many each leaf has, and the sums of
all nodes.  Nothing is split or encoded to take it up again, and a leaf is read only when an edit touches it.
An edit finds its place by descending the sums, splits anew only the pre-tokens that it touches or whose
match looked into it, stops as soon as a boundary of the new split meets an old one behind the edit, and
corrects the sums on the way from the touched leaves to the root.  A leaf that has grown to four times its size
is cut in several, for which the sums are added up anew.

The pre-token pattern is matched from left to right; a match looks at most two characters past its end
(a run of spaces before a word leaves its last one), or three past its start, which is the context that is
split again.

Cases: a null text is an empty one; an empty text has no tokens; edits beyond the end are clipped to it; an
edit may be empty, or leave the text as it is; edits of one document are applied in order of (seq, start,
end, replacement), each on the text that the one before left, ``EDITS`` of them at once and any number one after the
other; edits of unknown or null documents have no effect; rows alike in id each get all edits of that id; a
kept tree that doesn't fit its text is refused.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from . import base

#: Pre-tokens in a leaf when a tree is built; a leaf of four times as many is a reason to build anew.
LEAF = 64
KEPT_WORDS = 400_000
#: Edits of one document that meet in one row.
EDITS = 50_000
#: What the query redacts: addresses, and numbers of seven digits or more with their separators.
REDACT = regex.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+|\+?\(?\d(?:[ ().-]{0,2}\d){6,}")
REPLACEMENT = "[redacted]"


class Counter:
    """Pre-tokens of texts, and the tokens in each."""

    def __init__(self, path: str):
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.kept: dict[str, int] = {}

    def counts(self, pieces: list[str]) -> list[int]:
        kept = self.kept
        if len(kept) > KEPT_WORDS:
            kept.clear()
        for p in {p for p in pieces if p not in kept}:
            kept[p] = len(self.encoding.encode_ordinary(p))
        return list(map(kept.__getitem__, pieces))


class Tree:
    """The pre-tokens of one text. chars and tokens: sums, node k over nodes 2k and 2k + 1; leaves are the last ``width`` of them."""

    def __init__(self, counter: Counter, text: str, kept: tuple | None = None):
        """``kept``: what :meth:`kept` gave for this text; then nothing is split or encoded."""
        self.counter, self.reencoded, self.read = counter, 0, 0
        #: a leaf is its pre-tokens and counts, or its number in the kept tree while it hasn't been read
        self.leaves: list = []
        if kept is None:
            pieces = counter.pattern.findall(text)
            counts = counter.counts(pieces)
            self.n_pretokens = len(pieces)
            for i in range(0, max(1, len(pieces)), LEAF):
                self.leaves.append((pieces[i : i + LEAF], counts[i : i + LEAF]))
            self._sum([sum(map(len, p)) for p, _ in self.leaves], [sum(c) for _, c in self.leaves])
            return
        self._text, (self._lengths, self._counts, sizes, chars, tokens) = text, kept
        self.chars, self.tokens = np.asarray(chars).tolist(), np.asarray(tokens).tolist()
        self.width, self.leaves, self.n_pretokens = len(self.chars) // 2, list(range(len(sizes))), len(self._lengths)
        self._first = np.concatenate([[0], np.cumsum(sizes)]).tolist()
        self._begin = np.concatenate([[0], np.cumsum(self.chars[self.width : self.width + len(sizes)])]).tolist()
        if self._begin[-1] != len(text) or not self._first[-1] == len(self._lengths) == len(self._counts) or self.chars[1] != len(text):
            raise ValueError("the kept tree belongs to another text")

    def _leaf(self, i: int) -> tuple[list[str], list[int]]:
        """Pre-tokens and counts of a leaf."""
        k = self.leaves[i]
        if isinstance(k, int):
            self.read += 1
            a, b, at = self._first[k], self._first[k + 1], self._begin[k]
            pieces = []
            for n in self._lengths[a:b].tolist():
                pieces.append(self._text[at : at + n])
                at += n
            self.leaves[i] = k = (pieces, self._counts[a:b].tolist())
        return k

    def pieces(self) -> list[str]:
        return [p for i in range(len(self.leaves)) for p in self._leaf(i)[0]]

    def kept(self) -> tuple[np.ndarray, ...]:
        """Lengths and counts of the pre-tokens, the leaves' sizes, and the sums, from which the tree comes back."""
        lengths, counts, sizes = [], [], []
        for k in self.leaves:
            if isinstance(k, int):
                a, b = self._first[k], self._first[k + 1]
                lengths.append(self._lengths[a:b])
                counts.append(self._counts[a:b])
                sizes.append(b - a)
            else:
                lengths.append(np.fromiter(map(len, k[0]), np.int32, len(k[0])))
                counts.append(np.array(k[1], np.int32))
                sizes.append(len(k[0]))
        return np.concatenate(lengths), np.concatenate(counts), np.array(sizes, np.int32), np.array(self.chars, np.int64), np.array(self.tokens, np.int64)

    def _sum(self, chars: list[int], tokens: list[int]) -> None:
        """All sums from those of the leaves."""
        self.width = 1 << (len(chars) - 1).bit_length()
        empty = [0] * (self.width - len(chars))
        self.chars, self.tokens = [0] * self.width + chars + empty, [0] * self.width + tokens + empty
        for k in range(self.width - 1, 0, -1):
            self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]
            self.tokens[k] = self.tokens[2 * k] + self.tokens[2 * k + 1]

    def __len__(self) -> int:
        return self.chars[1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    def text(self) -> str:
        return "".join(self._text[self._begin[k] : self._begin[k + 1]] if isinstance(k, int) else "".join(k[0]) for k in self.leaves)

    def _block(self, at: int) -> tuple[int, int]:
        """The block that holds character ``at``, and where it begins."""
        k, begin = 1, 0
        while k < self.width:
            k *= 2
            if at >= begin + self.chars[k]:
                begin += self.chars[k]
                k += 1
        return min(k - self.width, len(self.leaves) - 1), begin

    def _put(self, i: int, pieces: list[str], counts: list[int]) -> None:
        """Another content of a leaf; the sums above it follow."""
        self.n_pretokens += len(pieces) - len(self._leaf(i)[0])
        self.leaves[i] = (pieces, counts)
        k = self.width + i
        chars, tokens = sum(map(len, pieces)) - self.chars[k], sum(counts) - self.tokens[k]
        while k:
            self.chars[k] += chars
            self.tokens[k] += tokens
            k //= 2

    def _cut(self, i: int) -> None:
        """A leaf in several."""
        pieces, counts = self._leaf(i)
        parts = [(pieces[k : k + LEAF], counts[k : k + LEAF]) for k in range(0, len(pieces), LEAF)]
        n = len(self.leaves)
        chars, tokens = self.chars[self.width : self.width + n], self.tokens[self.width : self.width + n]
        self.leaves[i : i + 1] = parts
        self._sum(chars[:i] + [sum(map(len, p)) for p, _ in parts] + chars[i + 1 :], tokens[:i] + [sum(c) for _, c in parts] + tokens[i + 1 :])

    def edit(self, start: int, end: int, replacement: str) -> None:
        """Put ``replacement`` in the place of characters ``start`` to ``end``."""
        start = min(max(0, start), len(self))
        end = min(max(start, end), len(self))
        # the first pre-token whose match looked at or past the edit
        first, begin = self._block(max(0, start - 3))
        while first and (begin > start - 3 or not self.chars[self.width + first]):
            first -= 1
            begin -= self.chars[self.width + first]
        keep, at = 0, begin
        for p in self._leaf(first)[0]:
            if max(at + len(p) + 2, at + 3) > start:
                break
            at += len(p)
            keep += 1
        # old pre-tokens from there on, taken up block by block
        block, old, left = first, self._leaf(first)[0][keep:], at
        taken = [len(old)]
        shift = len(replacement) - (end - start)
        while True:
            reach = left + sum(map(len, old))
            last = block + 1 >= len(self.leaves)
            if reach >= end + 4 or last:
                text = "".join(old)
                fresh = text[: start - left] + replacement + text[end - left :]
                bounds, edge = {}, left
                for i, p in enumerate(old):
                    if edge >= end:
                        bounds[edge + shift] = i
                    edge += len(p)
                new, edge, met = [], left, None
                for m in self.counter.pattern.finditer(fresh):
                    if edge >= start + len(replacement) and edge in bounds:
                        met = bounds[edge]
                        break
                    # a match that looked at the end of what was taken up isn't sure yet
                    if not last and max(m.end() + 2, m.start() + 3) > len(fresh):
                        break
                    new.append(m.group())
                    edge += len(m.group())
                else:
                    if last:
                        met = len(old)
                    elif edge in bounds:
                        met = bounds[edge]
                if met is not None:
                    break
            block += 1
            old = old + self._leaf(block)[0]
            taken.append(len(self._leaf(block)[0]))
        counts = self.counter.counts(new)
        self.reencoded += len(new)
        # the new pre-tokens stand in the first block; those met again stay where they are
        gone = met
        for i, n in enumerate(taken):
            b = first + i
            head = keep if i == 0 else 0
            cut = min(gone, n)
            gone -= cut
            more = (new, counts) if i == 0 else ([], [])
            if cut or more[0]:
                pieces, own = self._leaf(b)
                self._put(b, pieces[:head] + more[0] + pieces[head + cut :], own[:head] + more[1] + own[head + cut :])
        if len(self._leaf(first)[0]) > 4 * LEAF:
            self._cut(first)


def _counter(path: str) -> Counter:
    return base.built(("counter", path), lambda: Counter(path))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def redactions(text: str) -> list[tuple[int, int, str]]:
    """Edits that redact a text, from its end to its beginning, so that places stay right."""
    return [(m.start(), m.end(), REPLACEMENT) for m in REDACT.finditer(text)][::-1]


TREE = "n_tokens long, lengths array<int>, counts array<int>, sizes array<int>, chars array<long>, tokens array<long>"
KEPT = ("lengths", "counts", "sizes", "chars", "tokens")
EDITED = f"text string, {TREE}, n_pretokens_before long, n_tokens_before long, n_edits long, n_reencoded long, n_leaves_read long"
EDIT = "array<struct<start:long,end:long,replacement:string>>"


def _arrays(rows: list[tuple], schema: str) -> pa.Array:
    kinds = {"string": pa.string(), "long": pa.int64(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64())}
    fields = [f.split() for f in schema.split(", ")]
    cols = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.StructArray.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(cols, fields, strict=True)], [n for n, _ in fields])


def trees(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text and the kept tree of each row of ``docs``. Store it, and give it to :func:`apply_edits`."""
    path = path or default_path()
    base.small_batches()

    def run(column: pa.Array) -> pa.Array:
        counter, rows = _counter(path), []
        for t in column:
            tree = Tree(counter, t.as_py() or "")
            rows.append((tree.n_tokens, *tree.kept()))
        return _arrays(rows, TREE)

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), arrow_udf(run, TREE)(F.col("text")).alias("r")).select("doc_id", "text", "r.*")


def edited(kept: list[Column], edits: Column, path: str) -> Column:
    """Struct of :data:`EDITED` of kept trees (text, then the columns of :data:`KEPT`) after an array of :data:`EDIT` each."""

    def run(text: pa.Array, lengths: pa.Array, counts: pa.Array, sizes: pa.Array, chars: pa.Array, tokens: pa.Array, given: pa.Array) -> pa.Array:
        counter, rows = _counter(path), []
        for t, *own, changes in zip(text, lengths, counts, sizes, chars, tokens, given, strict=True):
            tree = Tree(counter, t.as_py(), tuple(x.values.to_numpy() for x in own))
            before, changes = (tree.n_pretokens, tree.n_tokens), changes.as_py() or []
            for x in changes:
                tree.edit(x["start"], x["end"], x["replacement"])
            rows.append((tree.text(), tree.n_tokens, *tree.kept(), *before, len(changes), tree.reencoded, tree.read))
        return _arrays(rows, EDITED)

    return arrow_udf(run, EDITED)(*kept, edits)


_SUMS = ("n_edits", "n_reencoded", "n_leaves_read")


def apply_edits(kept: DataFrame, edits: DataFrame, path: str | None = None, most: int = EDITS) -> DataFrame:
    """The trees of :func:`trees` after ``edits`` (doc_id, seq, start, end, replacement), in the same columns and n_pretokens_before, n_tokens_before, n_edits, n_reencoded and n_leaves_read.

    Only what an edit touches is read, split and encoded.  At most ``most`` edits of a document meet in its row, as each
    builds on the one before; further ones follow in rounds, the trees stored between.  Documents without edits pass by.
    """
    path = path or default_path()
    base.small_batches()
    columns = [F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c) for c in ("seq", "start", "end")]
    e = edits.where("doc_id is not null").select("doc_id", *columns, F.coalesce("replacement", F.lit("")).alias("replacement"))
    e = base.stored(e.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy("seq", "start", "end", "replacement")) - 1), "edits")
    rounds = -(-((e.agg(F.max("place")).first()[0] or 0) + 1) // most)
    now = kept.select("doc_id", "text", "n_tokens", *KEPT).withColumns({"n_pretokens_before": F.size("lengths").cast("long"), "n_tokens_before": F.col("n_tokens")} | {c: F.lit(0).cast("long") for c in _SUMS})
    for k in range(rounds):
        own = e.where(f"place div {most} = {k}").groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "start", "end", "replacement"))), lambda x: F.struct(x["start"], x["end"], x["replacement"])).alias("edits"))
        r = now.join(own, "doc_id").withColumn("r", edited([F.col("text"), *[F.col(c) for c in KEPT]], F.col("edits"), path))
        changed = r.select("doc_id", *[F.col(f"r.{c}").alias(c) for c in ("text", "n_tokens", *KEPT)], "n_pretokens_before", "n_tokens_before", *[(F.col(c) + F.col(f"r.{c}")).alias(c) for c in _SUMS])
        now = changed.unionByName(now.join(own, "doc_id", "left_anti"))
        if k + 1 < rounds:
            now = base.stored(now, "trees")
    return now


def redacted_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Token counts of each row of ``docs`` before and after redaction: trees are kept first, then edited."""
    path = path or default_path()
    base.small_batches()

    @arrow_udf(EDIT)
    def edits(column: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("replacement", pa.string())]))
        return pa.array([[dict(zip(("start", "end", "replacement"), x, strict=True)) for x in redactions(t.as_py())] for t in column], kind)

    kept = base.stored(trees(docs, path), "trees")
    done = kept.select("doc_id", edited([F.col("text"), *[F.col(c) for c in KEPT]], edits(F.col("text")), path).alias("r"))
    return done.select("doc_id", F.col("r.n_pretokens_before").alias("n_pretokens"), F.col("r.n_tokens_before").alias("n_tokens"), "r.n_edits", "r.n_reencoded", "r.n_leaves_read", F.size("r.lengths").cast("long").alias("n_pretokens_after"), F.col("r.n_tokens").alias("n_tokens_after"))
