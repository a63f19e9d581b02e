"""Media columns: PNG bytes in a binary column, read back with checksum tests, and cosine-transform hashes.

Written are 8-bit greyscale images, each row by that of the five row filters whose bytes, taken as signed, have the
least absolute sum (the first of equals); read are 8-bit grey, grey-alpha, RGB and RGBA, not interlaced.  Every
chunk's CRC and the zlib stream's Adler checksum are tested on reading.

Filters are undone in numpy over all images of a batch at once: a sample needs the ones on its left, above and
at that corner, so all samples with the same sum of row and column can be worked out together.

Cases: a null text is an empty payload; every payload is padded with bytes 255 to a positive multiple
of ``BLOCK``, so that no image is empty.  Equal payloads give equal bytes, checksums and features.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from . import base

#: Bytes that a payload is padded to a multiple of; one image row.
BLOCK = 576
MAGIC = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}  # fixed values of the format: colour type -> samples per pixel
LEVEL = 3
#: Side of the square that a picture is averaged to, and of its low-frequency corner.
SIDE, CORNER = 32, 8
#: Rows that filters are chosen for at once.
STRIP = 8192


class MediaError(ValueError):
    """A stored medium that is damaged or of a kind that isn't read."""


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


def _paeth(a, b, c):
    """Of left, above and corner (signed integers) the one nearest to left + above - corner; of equals the first."""
    to_a, to_b, to_c = np.abs(b - c), np.abs(a - c), np.abs(a + b - 2 * c)
    return np.where((to_a <= to_b) & (to_a <= to_c), a, np.where(to_b <= to_c, b, c))


def filtered(rows: np.ndarray, first: np.ndarray, step: int = 1) -> np.ndarray:
    """Rows of samples (uint8) with their filter in front. first: which rows begin an image; step: bytes per pixel."""
    out = np.empty((len(rows), rows.shape[1] + 1), np.uint8)
    for i in range(0, len(rows), STRIP):
        own = rows[i : i + STRIP].astype(np.int16)
        above = np.zeros_like(own)
        above[1:] = own[:-1]
        if i:
            above[0] = rows[i - 1]
        above[first[i : i + STRIP]] = 0
        left, corner = np.zeros_like(own), np.zeros_like(own)
        left[:, step:], corner[:, step:] = own[:, :-step], above[:, :-step]
        part, least = out[i : i + STRIP], None
        for kind, guess in enumerate((0, left, above, (left + above) >> 1, _paeth(left, above, corner))):
            line = (own - guess).astype(np.uint8)
            cost = np.abs(line.view(np.int8).astype(np.int16)).sum(axis=1, dtype=np.int64)
            better = np.ones(len(own), bool) if least is None else cost < least
            least = cost if least is None else np.minimum(cost, least)
            part[better, 0] = kind
            part[better, 1:] = line[better]
    return out


def _png(lines: np.ndarray, width: int, colour: int) -> bytes:
    return MAGIC + _chunk(b"IHDR", struct.pack(">IIBBBBB", width, len(lines), 8, colour, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def write_png(samples: np.ndarray, colour: int = 0) -> bytes:
    """PNG of uint8 samples of shape (height, width * channels)."""
    first = np.zeros(len(samples), bool)
    first[:1] = True
    return _png(filtered(samples, first, CHANNELS[colour]), samples.shape[1] // CHANNELS[colour], colour)


def chunks(png: bytes):
    """(kind, body) of each chunk, CRC tested."""
    if png[:8] != MAGIC:
        raise MediaError("no PNG signature")
    at = 8
    while at < len(png):
        if at + 12 > len(png):
            raise MediaError("cut short")
        size, kind = struct.unpack_from(">I4s", png, at)
        body = png[at + 8 : at + 8 + size]
        if len(body) != size or at + 12 + size > len(png):
            raise MediaError("cut short")
        if zlib.crc32(body, zlib.crc32(kind)) != struct.unpack_from(">I", png, at + 8 + size)[0]:
            raise MediaError(f"wrong checksum in {kind!r}")
        yield kind, body
        at += 12 + size
        if kind == b"IEND":
            return
    raise MediaError("no IEND")


def unfiltered(lines: np.ndarray, heights: list[int], step: int) -> np.ndarray:
    """Samples of images of one width. lines: uint8, a row's filter in column 0, one image's rows below the other's; step: bytes per pixel."""
    kinds = lines[:, 0]
    if len(kinds) and kinds.max() > 4:
        raise MediaError(f"row filter {kinds.max()}")
    n, width = len(lines), (lines.shape[1] - 1) // step
    raw = lines[:, 1:].reshape(n * width, step)
    # a row and a column of zeros before each image
    stride = width + 1
    image = np.repeat(np.arange(len(heights)), heights)
    y = np.arange(n) - np.repeat(np.cumsum(heights) - heights, heights)
    at = (np.arange(n) + image + 1) * stride + 1
    out = np.zeros(((n + len(heights)) * stride, step), np.int16)
    order = np.argsort(y, kind="stable")
    depth = np.cumsum(np.bincount(y, minlength=1)) if n else np.zeros(1, np.int64)
    at, y, kinds, rows = at[order], y[order], kinds[order].astype(np.intp)[:, None], order * width
    for t in range(len(depth) + width - 1 if n else 0):
        a, b = depth[t - width] if t >= width else 0, depth[min(t, len(depth) - 1)]
        x = t - y[a:b]
        here = at[a:b] + x
        left, above, corner = out[here - 1], out[here - stride], out[here - stride - 1]
        guess = np.choose(kinds[a:b], (np.int16(0), left, above, (left + above) >> 1, _paeth(left, above, corner)))
        out[here] = (raw[rows[a:b] + x] + guess) & 255
    kept = np.ones(len(out), bool)
    kept[:: stride] = False
    for k, h in enumerate(np.cumsum([0, *heights[:-1]])) if n else ():
        kept[(h + k) * stride : (h + k + 1) * stride] = False
    return out[kept].astype(np.uint8).reshape(n, width * step)


def _parsed(png: bytes) -> tuple[np.ndarray, int]:
    """Filtered rows, and bytes per pixel."""
    head, body = None, []
    for kind, part in chunks(png):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"IDAT":
            body.append(part)
    if head is None:
        raise MediaError("no IHDR")
    width, height, depth, colour, packing, filters, interlace = head
    if depth != 8 or colour not in CHANNELS or packing or filters or interlace:
        raise MediaError("a PNG of a kind that isn't read")
    step = CHANNELS[colour]
    try:
        raw = zlib.decompress(b"".join(body))
    except zlib.error as e:
        raise MediaError(f"damaged pixels: {e}") from e
    if len(raw) != height * (width * step + 1):
        raise MediaError("wrong number of samples")
    return np.frombuffer(raw, np.uint8).reshape(height, width * step + 1), step


def read_pngs(pngs: list[bytes]) -> list[np.ndarray]:
    """The samples of each as uint8 of shape (height, width * channels); those of one layout are unfiltered together."""
    parsed = [_parsed(p) for p in pngs]
    alike: dict[tuple[int, int], list[int]] = {}
    for k, (lines, step) in enumerate(parsed):
        alike.setdefault((lines.shape[1], step), []).append(k)
    out: list = [None] * len(pngs)
    for (_, step), own in alike.items():
        heights = [len(parsed[k][0]) for k in own]
        samples = unfiltered(np.concatenate([parsed[k][0] for k in own]), heights, step)
        for k, end, h in zip(own, np.cumsum(heights), heights, strict=True):
            out[k] = samples[end - h : end]
    return out


def read_png(png: bytes) -> np.ndarray:
    return read_pngs([png])[0]


def _cosine(side: int) -> np.ndarray:
    k = np.arange(CORNER)[:, None]
    return np.cos(np.pi * k * (2 * np.arange(side) + 1) / (2 * side)) * np.where(k, np.sqrt(2 / side), np.sqrt(1 / side))


_BASIS = _cosine(SIDE)


def cosine_hash(samples: np.ndarray) -> bytes:
    """64 bits: which of the 8 x 8 lowest frequencies of the averaged picture lie above their median (the mean level apart)."""
    small = samples
    for axis in (0, 1):
        size = small.shape[axis]
        if size < SIDE:
            small = np.repeat(small, -(-SIDE // size), axis=axis)
            size = small.shape[axis]
        edges = np.arange(SIDE) * size // SIDE
        counts = np.diff(np.append(edges, size))
        small = np.add.reduceat(small, edges, axis=axis, dtype=np.float64) / (counts[:, None] if axis == 0 else counts[None, :])
    low = (_BASIS @ small @ _BASIS.T).round(6).ravel()
    bits = low > np.median(low[1:])
    bits[0] = False
    return np.packbits(bits).tobytes()


def payload(text: bytes | None) -> bytes:
    text = text or b""
    return text + b"\xff" * (max(1, -(-len(text) // BLOCK)) * BLOCK - len(text))


def stores(texts: list[bytes | None]) -> list[bytes]:
    """Each text's payload as PNG bytes, one block a row."""
    if not texts:
        return []
    rows = [np.frombuffer(payload(t), np.uint8).reshape(-1, BLOCK) for t in texts]
    ends = np.cumsum([len(r) for r in rows])
    first = np.zeros(ends[-1], bool)
    first[[0, *ends[:-1]]] = True
    lines = filtered(np.concatenate(rows), first)
    return [_png(lines[e - len(r) : e], BLOCK, 0) for r, e in zip(rows, ends, strict=True)]


def store(text: bytes | None) -> bytes:
    return stores([text])[0]


def _array(rows: list[tuple], names: list[str], kinds: list) -> pa.Array:
    cols = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)


def png_column(text: Column) -> Column:
    """Binary column of PNGs."""
    return arrow_udf(lambda c: pa.array(stores(list(base.texts(c))), pa.binary()), "binary")(text)


def _hashes(pngs: list) -> list:
    there = [k for k, p in enumerate(pngs) if p is not None]
    out: list = [None] * len(pngs)
    for k, samples in zip(there, read_pngs([pngs[k] for k in there]), strict=True):
        out[k] = cosine_hash(samples)
    return out


def hash_column(png: Column) -> Column:
    """Binary column of 8-byte hashes of PNGs; null stays null."""
    return arrow_udf(lambda c: pa.array(_hashes(c.to_pylist()), pa.binary()), "binary")(png)


READ = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, hash binary"


def describe(png: Column) -> Column:
    """Struct of :data:`READ` read back from each PNG; its hash is that of :func:`hash_column`."""

    def run(column: pa.Array) -> pa.Array:
        rows, pngs = [], column.to_pylist()
        for p, samples in zip(pngs, read_pngs(pngs), strict=True):
            data = samples.tobytes()
            rows.append((len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]), len(p), hashlib.sha256(p).hexdigest(), cosine_hash(samples)))
        return _array(rows, [x.split()[0] for x in READ.split(", ")], [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()])

    return arrow_udf(run, READ)(png)


def media_features(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: its text stored as PNG, read back, and described; the hash as hexadecimal digits."""
    base.small_batches()
    kept = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), png_column(F.col("text")).alias("png"))
    return kept.select("doc_id", "n_bytes", describe(F.col("png")).alias("r")).select("doc_id", "n_bytes", "r.*").withColumn("hash", F.lower(F.hex("hash"))).withColumnRenamed("hash", "feature")
