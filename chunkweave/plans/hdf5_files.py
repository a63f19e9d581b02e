"""HDF5 files for queries and tests: old and new headers, and every chunk index. Checksums of metadata are left zero."""

from __future__ import annotations

import itertools
import math
import struct
import zlib
from dataclasses import dataclass, field
from typing import Any

import numpy as np

NONE = b"\xff" * 8
_u8 = lambda n: struct.pack("<Q", n)


@dataclass
class Array:
    """storage: contiguous, compact, or the chunk index: tree (old), single, implicit, fixed, extensible, tree2."""

    name: str
    values: np.ndarray
    storage: str = "contiguous"
    chunks: tuple[int, ...] | None = None
    #: limits of the axes, None for an endless one
    limits: tuple[int | None, ...] | None = None
    deflate: bool = False
    attributes: dict[str, Any] = field(default_factory=dict)
    #: names of the scales of the axes; a scale itself has none
    scales: tuple[str, ...] = ()
    is_scale: bool = False
    fill: Any = None
    #: grid indexes of chunks that are never written
    absent: frozenset = frozenset()


class Writer:
    """``new``: superblock 2, headers 2 and links as messages; else superblock 0, headers 1 and symbol tables.

    ``dense``: links and attributes of new groups lie in fractal heaps.  ``page_bits``, ``leaf``: sizes of pages of
    fixed arrays and of nodes of trees.  ``front``: bytes before the superblock, 0 or 512 times a power of two.
    """

    def __init__(self, new: bool = True, dense: bool = False, page_bits: int = 10, leaf: int = 512, front: int = 0):
        self.new, self.dense, self.page_bits, self.leaf, self.front = new, dense, page_bits, leaf, front
        self.out = bytearray(48 if new else 96)
        self.headers: dict[str, int] = {}

    def put(self, data: bytes) -> int:
        self.out += b"\0" * (-len(self.out) % 8)
        at = len(self.out)
        self.out += data
        return at

    def file(self, arrays: list[Array], groups: dict[str, list[Array]] | None = None, attributes: dict | None = None, soft: dict[str, str] | None = None) -> bytes:
        members = {g: self.group({a.name: self.array(a) for a in own}, {}) for g, own in (groups or {}).items()}
        members |= {a.name: self.array(a) for a in sorted(arrays, key=lambda a: not a.is_scale)}
        root = self.group(members, attributes or {}, soft or {})
        if self.new:
            head = b"\x89HDF\r\n\x1a\n" + bytes([2, 8, 8, 0]) + _u8(self.front) + NONE + _u8(len(self.out)) + _u8(root) + bytes(4)
        else:
            head = b"\x89HDF\r\n\x1a\n" + bytes([0, 0, 0, 0, 0, 8, 8, 0]) + struct.pack("<HHI", 4, 16, 0)
            head += _u8(self.front) + NONE + _u8(len(self.out)) + NONE + _u8(0) + _u8(root) + bytes(24)
        self.out[: len(head)] = head
        return bytes(self.front) + bytes(self.out)

    def header(self, messages: list[tuple[int, bytes]]) -> int:
        """The messages after the second lie in a continuation."""
        if self.new:
            pack = lambda ms: b"".join(struct.pack("<BHB", k, len(d), 0) + d for k, d in ms)
            if len(messages) > 3:
                rest = b"OCHK" + pack(messages[2:]) + bytes(4)
                messages = [*messages[:2], (0x10, _u8(self.put(rest)) + _u8(len(rest)))]
            body = pack(messages)
            return self.put(b"OHDR" + bytes([2, 2]) + struct.pack("<I", len(body)) + body + bytes(4))
        padded = [(k, d + b"\0" * (-len(d) % 8)) for k, d in messages]
        pack = lambda ms: b"".join(struct.pack("<HHB3x", k, len(d), 0) + d for k, d in ms)
        n = len(padded)
        if n > 3:
            rest = pack(padded[2:])
            padded, n = [*padded[:2], (0x10, _u8(self.put(rest)) + _u8(len(rest)))], n + 1
        body = pack(padded)
        return self.put(struct.pack("<BxHII4x", 1, n, 1, len(body)) + body)

    # groups

    def group(self, members: dict[str, int], attributes: dict, soft: dict[str, str] | None = None) -> int:
        own = [(0x0C, self.attribute(k, v)) for k, v in attributes.items()]
        if not self.new:
            return self.header([(0x11, self.symbols(members, soft or {})), *own])
        link = lambda name, flags, kind, info: bytes([1, flags]) + kind + bytes([len(name.encode())]) + name.encode() + info
        links = [link(n, 0, b"", _u8(a)) for n, a in members.items()]
        links += [link(n, 8, b"\1", struct.pack("<H", len(t)) + t.encode()) for n, t in (soft or {}).items()]
        if not self.dense:
            return self.header([(0x02, bytes(2) + NONE + NONE), *[(0x06, d) for d in links], *own])
        heap, ids = self.heap(links, 7)
        tree = self.tree2(5, [bytes(4) + i for i in ids])
        found = [(0x02, bytes(2) + _u8(heap) + _u8(tree))]
        if own:
            heap, ids = self.heap([d for _, d in own], 8)
            found.append((0x15, bytes(2) + _u8(heap) + _u8(self.tree2(8, [i + bytes(9) for i in ids]))))
        return self.header(found)

    def symbols(self, members: dict[str, int], soft: dict[str, str]) -> bytes:
        names, places = bytearray(8), {}
        for n in sorted({*members, *soft, *soft.values()}):
            places[n] = len(names)
            names += n.encode() + b"\0" * (8 - len(n.encode()) % 8)
        heap = self.put(b"HEAP" + bytes(4) + _u8(len(names)) + _u8(1) + _u8(self.put(bytes(names))))
        entries = []
        for n in sorted({*members, *soft}):
            if n in members:
                entries.append(_u8(places[n]) + _u8(members[n]) + bytes(24))
            else:
                entries.append(_u8(places[n]) + NONE + struct.pack("<II", 2, 0) + struct.pack("<I12x", places[soft[n]]))
        nodes = [self.put(b"SNOD\1\0" + struct.pack("<H", len(e)) + b"".join(e)) for k in range(0, len(entries), 8) if (e := entries[k : k + 8])]
        leaf = b"TREE\0\0" + struct.pack("<H", len(nodes)) + NONE + NONE + _u8(0) + b"".join(_u8(n) + _u8(0) for n in nodes)
        top = b"TREE\0\1" + struct.pack("<H", 1) + NONE + NONE + _u8(0) + _u8(self.put(leaf)) + _u8(0)
        return _u8(self.put(top)) + _u8(heap)

    def heap(self, objects: list[bytes], width: int) -> tuple[int, list[bytes]]:
        """Heap of blocks of 512 bytes in a table of four columns, with large objects apart; and the ids."""
        start, columns, bits = 512, 4, 32
        head = 5 + 8 + 4
        blocks, sizes, ids, used, first = [], [], [], head, 0
        size_of = lambda k: start << max(0, k // columns - 1)
        current = bytearray(head)
        for data in objects:
            while used + len(data) > size_of(len(blocks)):
                blocks.append(bytes(current))
                first += size_of(len(blocks) - 1)
                current, used = bytearray(head), head
            ids.append(bytes([0]) + struct.pack("<I", first + used) + struct.pack("<H", len(data)) + bytes(width - 7))
            current += data
            used += len(data)
        blocks.append(bytes(current))
        places = []
        for k, block in enumerate(blocks):
            sizes.append(size_of(k))
            raw = b"FHDB\0" + bytes(8) + struct.pack("<I", sum(sizes[:k])) + block[head:]
            places.append(self.put(raw.ljust(sizes[k], b"\0")))
        rows = 0 if len(blocks) == 1 else -(-len(blocks) // columns)
        root = places[0]
        if rows:
            table = [_u8(p) for p in places] + [NONE] * (rows * columns - len(places))
            root = self.put(b"FHIB\0" + bytes(8) + bytes(4) + b"".join(table) + bytes(4))
        out = b"FRHP\0" + struct.pack("<HHBI", width, 0, 0, 4096) + bytes(8) + NONE + bytes(8) + NONE + bytes(64)
        out += struct.pack("<HQQHH", columns, start, 65536, bits, 1) + _u8(root) + struct.pack("<H", rows) + bytes(4)
        return self.put(out), ids

    def tree2(self, kind: int, records: list[bytes]) -> int:
        """Of one level of leaves, or two where one node can't hold the records."""
        width = len(records[0])
        most = (self.leaf - 10) // width
        node = lambda name, body: self.put((name + bytes([0, kind]) + body).ljust(self.leaf, b"\0"))
        if len(records) <= most:
            depth, n, root = 0, len(records), node(b"BTLF", b"".join(records))
        else:
            count = (most.bit_length() - 1) // 8 + 1
            parts, above = [], []
            for k in range(0, len(records), most + 1):
                parts.append(records[k : k + most])
                above += records[k + most : k + most + 1]
            if len(above) == len(parts):
                parts.append([])
            pointers = b"".join(_u8(node(b"BTLF", b"".join(p))) + len(p).to_bytes(count, "little") for p in parts)
            depth, n, root = 1, len(above), node(b"BTIN", b"".join(above) + pointers)
        return self.put(b"BTHD\0" + bytes([kind]) + struct.pack("<IHHBB", self.leaf, width, depth, 98, 40) + _u8(root) + struct.pack("<H", n) + _u8(len(records)) + bytes(4))

    # types, attributes

    @staticmethod
    def type(dtype: np.dtype) -> bytes:
        big = dtype.byteorder == ">"
        if dtype.kind in "iu":
            return bytes([0x10, big | (8 if dtype.kind == "i" else 0), 0, 0]) + struct.pack("<IHH", dtype.itemsize, 0, 8 * dtype.itemsize)
        if dtype.kind == "f":
            mantissa, bias = {2: (10, 15), 4: (23, 127), 8: (52, 1023)}[dtype.itemsize]
            bits = 8 * dtype.itemsize
            return bytes([0x11, 0x20 | big, bits - 1, 0]) + struct.pack("<IHHBBBBI", dtype.itemsize, 0, bits, mantissa, bits - 1 - mantissa, 0, mantissa, bias)
        if dtype.kind == "b":
            return bytes([0x18, 2, 0, 0]) + struct.pack("<I", 1) + Writer.type(np.dtype("i1")) + b"FALSE\0\0\0" + b"TRUE\0\0\0\0" + b"\0\1"
        if dtype.kind == "S":
            return bytes([0x13, 0, 0, 0]) + struct.pack("<I", dtype.itemsize)
        if dtype.names:
            parts = b"".join(n.encode() + b"\0" + bytes([dtype.fields[n][1]]) + Writer.type(dtype.fields[n][0]) for n in dtype.names)
            return bytes([0x36, len(dtype.names), 0, 0]) + struct.pack("<I", dtype.itemsize) + parts
        raise NotImplementedError(str(dtype))

    @staticmethod
    def space(shape: tuple[int, ...], limits: tuple[int | None, ...] | None = None) -> bytes:
        out = bytes([1, len(shape), 0 if limits is None else 1]) + bytes(5) + b"".join(map(_u8, shape))
        return out + b"".join(NONE if n is None else _u8(n) for n in limits or ())

    def attribute(self, name: str, value: Any) -> bytes:
        """Numbers and arrays as they are, bytes as fixed text, str as text of variable length; ("refs", lists) for scales."""
        if isinstance(value, tuple) and value[0] == "refs":
            raw = [b"".join(_u8(self.headers[n]) for n in own) for own in value[1]]
            kind = bytes([0x19, 0, 0, 0]) + struct.pack("<I", 16) + bytes([0x17, 0, 0, 0]) + struct.pack("<I", 8)
            shape, data = (len(raw),), self.collected(raw, 8)
        elif isinstance(value, str):
            kind = bytes([0x19, 1, 1, 0]) + struct.pack("<I", 16) + self.type(np.dtype("S1"))
            shape, data = (), self.collected([value.encode()], 1)
        else:
            held = np.asarray(value)
            kind, shape, data = self.type(held.dtype), held.shape, held.tobytes()
        n, space = name.encode() + b"\0", self.space(shape)
        sizes = struct.pack("<HHH", len(n), len(kind), len(space))
        if self.new:
            return bytes([3, 0]) + sizes + b"\0" + n + kind + space + data
        return bytes([1, 0]) + sizes + b"".join(x + b"\0" * (-len(x) % 8) for x in (n, kind, space)) + data

    def collected(self, values: list[bytes], unit: int) -> bytes:
        """A global heap of the values, and the elements that point into it."""
        body = b"".join(struct.pack("<HH4xQ", k + 1, 1, len(v)) + v + b"\0" * (-len(v) % 8) for k, v in enumerate(values))
        size = 16 + len(body) + 16
        at = self.put(b"GCOL\1\0\0\0" + _u8(size) + body + struct.pack("<HH4xQ", 0, 0, 16))
        return b"".join(struct.pack("<IQI", len(v) // unit, at, k + 1) for k, v in enumerate(values))

    # datasets

    def array(self, a: Array) -> int:
        shape, dtype = a.values.shape, a.values.dtype
        fill = b"" if a.fill is None else np.asarray(a.fill, dtype).tobytes()
        space = self.space(shape, a.limits if a.limits is not None else shape if a.storage not in ("contiguous", "compact") else None)
        found = [(0x01, space), (0x03, self.type(dtype)), (0x05, bytes([2, 2, 0, bool(fill)]) + (struct.pack("<I", len(fill)) + fill if fill else b""))]
        if a.deflate:
            if self.new:
                found.append((0x0B, bytes([2, 2]) + struct.pack("<HHHI", 2, 0, 1, dtype.itemsize) + struct.pack("<HHHI", 1, 0, 1, 4)))
            else:
                found.append((0x0B, bytes([1, 2]) + bytes(6) + b"".join(struct.pack("<HHHH", f, 8, 0, 1) + n.ljust(8, b"\0") + struct.pack("<I4x", v) for f, n, v in ((2, b"shuffle", dtype.itemsize), (1, b"deflate", 4)))))
        found.append((0x08, self.layout(a)))
        named = dict(a.attributes)
        if a.is_scale:
            named |= {"CLASS": np.bytes_(b"DIMENSION_SCALE"), "NAME": np.bytes_(a.name.encode())}
        if a.scales:
            named["DIMENSION_LIST"] = ("refs", [[n] if n else [] for n in a.scales])
        found += [(0x0C, self.attribute(k, v)) for k, v in named.items()]
        self.headers[a.name] = self.header(found)
        return self.headers[a.name]

    def layout(self, a: Array) -> bytes:
        raw, rank = a.values.tobytes(), a.values.ndim
        if a.storage == "compact":
            return bytes([3, 0]) + struct.pack("<H", len(raw)) + raw
        if a.storage == "contiguous":
            return bytes([3, 1]) + (_u8(self.put(raw)) if raw else NONE) + _u8(len(raw))
        chunks = a.chunks or a.values.shape
        sizes = (*chunks, a.values.itemsize)
        whole = math.prod(sizes)
        limits = a.limits or a.values.shape
        extent = [-(-(s if n is None else n) // c) for s, n, c in zip(a.values.shape, limits, chunks, strict=True)]
        stored: dict[tuple, tuple[int, int]] = {}
        grid = [range(-(-s // c)) for s, c in zip(a.values.shape, chunks, strict=True)]
        if a.storage == "implicit":
            self.put(b"")
        for idx in itertools.product(*grid):
            if idx not in a.absent:
                data = self.encoded(a, idx, chunks)
                stored[idx] = (self.put(data) if a.storage != "implicit" else self.append(data), len(data))
        if a.storage == "tree":
            key = lambda idx, n: struct.pack("<II", n, 0) + b"".join(_u8(i * c) for i, c in zip(idx, chunks, strict=True)) + _u8(0)
            items = list(stored.items())
            leaves = [b"TREE\1\0" + struct.pack("<H", len(p)) + NONE + NONE + b"".join(key(i, n) + _u8(at) for i, (at, n) in p) + key(grid_end(grid), 0) for k in range(0, len(items), 16) if (p := items[k : k + 16])]
            top = b"TREE\1\1" + struct.pack("<H", len(leaves)) + NONE + NONE
            for k, leaf in enumerate(leaves):
                top += key(items[k * 16][0], items[k * 16][1][1]) + _u8(self.put(leaf))
            at = _u8(self.put(top + key(grid_end(grid), 0))) if items else NONE
            return bytes([3, 2, rank + 1]) + at + b"".join(struct.pack("<I", s) for s in sizes)
        entry = lambda at, n: _u8(at) + (n.to_bytes(4, "little") + bytes(4) if a.deflate else b"")
        empty = NONE + (bytes(8) if a.deflate else b"")
        head = lambda flags, kind, info: bytes([4, 2, flags, rank + 1, 4]) + b"".join(struct.pack("<I", s) for s in sizes) + bytes([kind]) + info
        if a.storage == "single":
            at, n = next(iter(stored.values()))
            return head(2 if a.deflate else 0, 1, _u8(n) + bytes(4) if a.deflate else b"") + _u8(at)
        if a.storage == "implicit":
            return head(0, 2, b"") + _u8(next(iter(stored.values()))[0])
        if a.storage == "tree2":
            records = [entry(at, n) + b"".join(map(_u8, idx)) for idx, (at, n) in sorted(stored.items())]
            return head(0, 5, struct.pack("<IBB", self.leaf, 98, 40)) + (_u8(self.tree2(11 if a.deflate else 10, records)) if records else NONE)
        axes = sorted(range(rank), key=lambda k: (limits[k] is not None, k))
        number = lambda idx: sum(idx[k] * math.prod(extent[j] for j in axes[p + 1 :]) for p, k in enumerate(axes))
        of = {number(idx): entry(*v) for idx, v in stored.items()}
        if a.storage == "fixed":
            return head(0, 3, bytes([self.page_bits])) + _u8(self.fixed([of.get(k, empty) for k in range(math.prod(extent))], a.deflate))
        if a.storage == "extensible":
            return head(0, 4, bytes([32, 4, 4, 16, self.page_bits])) + _u8(self.extensible(of, empty, a.deflate))
        raise ValueError(f"unknown storage {a.storage!r} ({whole} bytes a chunk)")

    def append(self, data: bytes) -> int:
        self.out += data
        return len(self.out) - len(data)

    @staticmethod
    def encoded(a: Array, idx: tuple, chunks: tuple) -> bytes:
        block = np.full(chunks, 0 if a.fill is None else a.fill, a.values.dtype)
        part = a.values[tuple(slice(i * c, (i + 1) * c) for i, c in zip(idx, chunks, strict=True))]
        block[tuple(slice(0, n) for n in part.shape)] = part
        raw = block.tobytes()
        if a.deflate:
            raw = zlib.compress(np.frombuffer(raw, np.uint8).reshape(-1, a.values.itemsize).T.tobytes(), 4)
        return raw

    def fixed(self, entries: list[bytes], filtered: bool) -> int:
        page = 1 << self.page_bits
        if len(entries) <= page:
            body = b"".join(entries) + bytes(4)
        else:
            parts = [entries[k : k + page] for k in range(0, len(entries), page)]
            made = bytearray(-(-len(parts) // 8))
            for p, own in enumerate(parts):
                if any(e[:8] != NONE for e in own):
                    made[p // 8] |= 0x80 >> p % 8
            body = bytes(made) + bytes(4) + b"".join(b"".join(own) + bytes(4) for own in parts)
        head = self.put(b"FAHD\0" + bytes([filtered, len(entries[0]), self.page_bits]) + _u8(len(entries)) + bytes(8) + bytes(4))
        block = self.put(b"FADB\0" + bytes([filtered]) + _u8(head) + body)
        self.out[head + 16 : head + 24] = _u8(block)
        return head

    def extensible(self, of: dict[int, bytes], empty: bytes, filtered: bool) -> int:
        """Index block of 4 elements, data blocks of 16 and more, 4 super blocks in the index block."""
        inside, smallest, pointers, bits = 4, 16, 4, 32
        page = 1 << self.page_bits
        head = self.put(b"EAHD\0" + bytes([filtered, len(empty), bits, inside, smallest, pointers, self.page_bits]) + bytes(48) + bytes(8) + bytes(4))
        get = lambda first, n: [of.get(first + k, empty) for k in range(n)]
        last, first, near, far = max(of, default=-1), inside, [], []
        for u in range(1 + bits - 4):
            blocks, length = 1 << u // 2, (1 << (u + 1) // 2) * smallest
            if u >= 4 and first > last:
                far.append(NONE)
                first += blocks * length
                continue
            places, made = [], b""
            for _ in range(blocks):
                own = get(first, length)
                paged = u >= 4 and length > page
                if any(e != empty for e in own):
                    prefix = b"EADB\0" + bytes([filtered]) + _u8(head) + (first - inside).to_bytes(4, "little")
                    if paged:
                        parts = [own[k : k + page] for k in range(0, length, page)]
                        own_made = bytearray(-(-len(parts) // 8))
                        for p, some in enumerate(parts):
                            if any(e != empty for e in some):
                                own_made[p // 8] |= 0x80 >> p % 8
                        made += bytes(own_made)
                        body = bytes(4) + b"".join(b"".join(some) + bytes(4) for some in parts)
                    else:
                        body = b"".join(own) + bytes(4)
                    places.append(_u8(self.put(prefix + body)))
                else:
                    places.append(NONE)
                    made += bytes(-(-(length // page) // 8)) if paged else b""
                first += length
            if u < 4:
                near += places
            else:
                far.append(_u8(self.put(b"EASB\0" + bytes([filtered]) + _u8(head) + bytes(4) + made + b"".join(places) + bytes(4))))
        index = self.put(b"EAIB\0" + bytes([filtered]) + _u8(head) + b"".join(get(0, inside)) + b"".join(near) + b"".join(far) + bytes(4))
        self.out[head + 60 : head + 68] = _u8(index)
        return head


def grid_end(grid: list[range]) -> tuple[int, ...]:
    return tuple(len(r) for r in grid)
