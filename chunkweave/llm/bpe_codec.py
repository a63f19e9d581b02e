"""BPE encoding and decoding by tree concatenation.

A text is cut into leaves of ``LEAF`` characters, wherever that falls.  The leaves are encoded side by side,
then joined pairwise up a tree: around each join a window is encoded again, growing until it agrees with both
sides.  On the left a window begins where one of the left side's words does, so far before the join that no
match up to there looked past it.  On the right it ends with the first word that begins at the same place in
the window and in the right side, so far before the window's end that no match up to there looked past that.
From such places on both splits are the same, so the joined words are those of the whole.  The tree works on
texts as the library's normaliser leaves them; marked tokens part a text beforehand.

Words of more than ``WORD_LEAF`` symbols are cut in their turn, and joined by windows of tokens that grow
until their first and last tokens are the ones that stood there before: every neighbouring pair of tokens
comes from a genuine encoding, which for BPE makes the whole sequence the genuine one.

Cases: a null text is an empty one; an empty text has no tokens and decodes to ''.  Texts that hold
characters whose case, class or composition depends on the Unicode version are normalised and split
by the library itself; the rest by one compiled pattern.  Rows are independent, so repeated rows,
skew and very long texts need no care beyond the tree.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
import unicodedata

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from . import base

#: Characters in a leaf of a text's tree; symbols (bytes of UTF-8) in a leaf of a long word's.
LEAF, WORD_LEAF = 1024, 512
#: Characters on each side of a join that its first window takes; how far a match of the pattern looks past its beginning or its end at most.
WINDOW, LOOK = 24, 4
#: Words kept per worker; the store is emptied when it is full.
KEPT_WORDS = 120_000
RESULT = "n_tokens long, ids_sha256 string, decoded_sha256 string"
FULL, IDS = "ids array<int>, decoded string", "ids array<int>, decoded_sha256 string"


class Codec:
    """Encodes as ``Tokenizer.from_file(path).encode(text, add_special_tokens=False)``; decodes as its ``decode``."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self._path, self._inner = path, None
        self.ids = self.tokenizer.get_vocab(with_added_tokens=True)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        splits = [p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        # for safe texts the classes are spelt out, which the plain engine matches faster
        of = lambda kind: "".join(re.escape(chr(k)) for k in range(0x250) if unicodedata.category(chr(k))[0] == kind)
        self.words = re.compile(splits[0].replace(r"\p{L}", of("L")).replace(r"\p{N}", of("N")))
        # ASCII and Latin letters up to U+024F: stable classes, no composition, simple case
        self.unsafe = regex.compile("[^\t-\r -~¡-įı-ɏ]")
        self.joins = 0
        self.map = {}
        spare = 256
        for b in range(256):
            shown = 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255
            self.map[b] = chr(b) if shown else chr(spare)
            spare += not shown
        #: 1 for symbols that begin a character, 0 for its further bytes
        self.begins = {shown: b & 0xC0 != 0x80 for b, shown in self.map.items()}
        self._forget()

    @property
    def inner(self):
        """The model without word ends, for leaves and windows that stop inside a word; built when a long word comes."""
        if self._inner is None:
            from tokenizers import Tokenizer, models

            with open(self._path, encoding="utf-8") as f:
                model = json.load(f)["model"]
            merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
            self._inner = Tokenizer(models.BPE(vocab=model["vocab"], merges=merges))
        return self._inner

    def _ended(self, word: str) -> list[str]:
        """Tokens of a whole word, by the library's model."""
        return [t.value for t in self.tokenizer.model.tokenize(word)]

    def _forget(self):
        self.packed: dict[str, bytes] = {}
        self.shown: dict[str, bytes] = {}

    def _keep(self, word: str, tokens: list[str]) -> None:
        self.packed[word] = b"".join(self.ids[t].to_bytes(4, "little") for t in tokens)
        self.shown[word] = " ".join(tokens).encode()

    def encode_word(self, word: str, leaf: int = WORD_LEAF) -> list[str]:
        """Tokens of one word in the byte alphabet, ended by the suffix."""
        if len(word) <= leaf:
            return self._ended(word) if word else []
        leaves = [word[i : i + leaf] for i in range(0, len(word), leaf)]
        parts = [e.tokens for e in self.inner.encode_batch(leaves[:-1])] + [self._ended(leaves[-1])]
        while len(parts) > 1:
            parts = [self.join(parts[i], parts[i + 1], i + 2 >= len(parts)) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return parts[0]

    def join(self, left: list[str], right: list[str], last: bool) -> list[str]:
        """Tokens of two adjacent stretches of a word as one; ``last``: the right one ends the word."""
        size = 4
        while True:
            a, b = max(0, len(left) - size), min(len(right), size)
            ends = last and b == len(right)
            text = "".join(left[a:]) + "".join(right[:b])
            window = self._ended(text.removesuffix(self.suffix)) if ends else self.inner.encode(text).tokens
            if (a == 0 or window[:2] == left[a : a + 2]) and (b == len(right) or window[-2:] == right[b - 2 : b]):
                return left[:a] + window + right[b:]
            size *= 2

    def _mapped(self, word: str) -> str:
        return "".join(map(self.map.__getitem__, word.encode()))

    def _own(self, text: str) -> list[str]:
        """Words of a stretch of a plain text, by the compiled pattern; those not yet kept are encoded."""
        found = self.words.findall(text)
        for w in {w for w in found if w not in self.packed}:
            self._keep(w, self.encode_word(self._mapped(w)))
        return found

    def _library(self, text: str) -> list[str]:
        """The same for any text, by the library's own splitting: keys are words in the byte alphabet."""
        found = ["\0" + w for w, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]
        for key in {k for k in found if k not in self.packed}:
            self._keep(key, self.encode_word(key[1:]))
        return found

    def _width(self, key: str) -> int:
        """Characters of a word."""
        return sum(self.begins[c] for c in key[1:]) if key[:1] == "\0" else len(key)

    def _starts(self, text: str, at: int, words: list[str], end: int):
        """Where each of the words begins that were found from ``at`` on, up to ``end``."""
        for w in words:
            at += text[at] == " "  # the normaliser leaves single spaces between words
            if at > end:
                return
            yield at
            at += self._width(w)

    def tree(self, text: str, split, leaf: int = LEAF) -> list[str]:
        """Words of a normalised text: of its leaves, joined pairwise until one list is left."""
        cuts = [*range(0, len(text), leaf), len(text)]
        parts = [(a, b, split(text[a:b])) for a, b in itertools.pairwise(cuts)]
        while len(parts) > 1:
            joined = [(a, c, self.concatenated(text, a, b, c, left, right, split)) for (a, b, left), (_, c, right) in zip(parts[::2], parts[1::2], strict=False)]
            parts = joined + parts[2 * len(joined) :]
        return parts[0][2] if parts else []

    def concatenated(self, text: str, a: int, b: int, c: int, left: list[str], right: list[str], split) -> list[str]:
        """Words of text[a:c] from those of text[a:b] and text[b:c]."""
        self.joins += 1
        size = WINDOW
        while True:
            # back over the left side's words, to one that begins at least ``size`` before the join
            kept, begin = len(left), b
            while kept and begin > b - size:
                kept -= 1
                begin -= text[begin - 1] == " "
                begin -= self._width(left[kept])
            if not kept:
                begin = a
            end = min(c, b + size)
            window = split(text[begin:end])
            sure = end if end == c else end - LOOK
            old = {at: k for k, at in enumerate(self._starts(text, b, right, sure))}
            for k, at in enumerate(self._starts(text, begin, window, sure)):
                if at >= b and at in old:
                    return left[:kept] + window[:k] + right[old[at] :]
            if end == c:
                return left[:kept] + window
            size *= 2

    def text_words(self, text: str, leaf: int = LEAF) -> list[str]:
        """Keys of the kept words, in order; encodes those not yet kept."""
        found: list[str] = []
        for part in self.cut.split(text) if self.cut and "<|" in text else [text]:
            if part in self.special:
                if part not in self.packed:
                    self._keep(part, [part])
                found.append(part)
            elif self.unsafe.search(part):
                found += self.tree(self.tokenizer.normalizer.normalize_str(part), self._library, leaf)
            else:
                found += self.tree(" ".join(part.lower().split()), self._own, leaf)
        return found

    def encode(self, text: str) -> tuple[bytes, bytes]:
        """The ids as little-endian unsigned 32-bit integers, and the decoded text in UTF-8."""
        if len(self.packed) > KEPT_WORDS:
            self._forget()
        words = self.text_words(text)
        return b"".join(map(self.packed.__getitem__, words)), b" ".join(map(self.shown.__getitem__, words))


def _codec(path: str) -> Codec:
    return base.built(("codec", path), lambda: Codec(path))


def digest(text: Column, path: str) -> Column:
    """A struct of :data:`RESULT` for each text."""

    base.small_batches()

    @arrow_udf(RESULT)
    def run(column: pa.Array) -> pa.Array:
        codec, n, ids, decoded = _codec(path), [], [], []
        for t in column:
            packed, shown = codec.encode(t.as_py() or "")
            n.append(len(packed) // 4)
            ids.append(hashlib.sha256(packed).hexdigest())
            decoded.append(hashlib.sha256(shown).hexdigest())
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["n_tokens", "ids_sha256", "decoded_sha256"])

    return run(text)


def token_ids(text: Column, path: str) -> Column:
    """A struct of :data:`IDS` for each text: token ids, and the digest of the decoded text."""
    import numpy as np

    base.small_batches()

    @arrow_udf(IDS)
    def run(column: pa.Array) -> pa.Array:
        codec, ids, decoded = _codec(path), [], []
        for t in column:
            packed, shown = codec.encode(t.as_py() or "")
            ids.append(np.frombuffer(packed, "<u4").astype(np.int32))
            decoded.append(hashlib.sha256(shown).hexdigest())
        return pa.StructArray.from_arrays([pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())], ["ids", "decoded_sha256"])

    return run(text)


def encode(text: Column, path: str) -> Column:
    """A struct of :data:`FULL` for each text: token ids and the decoded text."""
    import numpy as np

    base.small_batches()

    @arrow_udf(FULL)
    def run(column: pa.Array) -> pa.Array:
        codec, ids, decoded = _codec(path), [], []
        for t in column:
            packed, shown = codec.encode(t.as_py() or "")
            ids.append(np.frombuffer(packed, "<u4").astype(np.int32))
            decoded.append(shown.decode())
        return pa.StructArray.from_arrays([pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())], ["ids", "decoded"])

    return run(text)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row of ``docs``."""
    return docs.select("doc_id", digest(F.col("text"), path or default_path()).alias("r")).select("doc_id", "r.*")
