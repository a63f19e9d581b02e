"""HDF5 files by their public format: superblock, object headers, groups, attributes and every kind of chunk index.

Only metadata are read, through a small cache of blocks; of the datasets themselves, where their chunks lie.
Not read, and refused by name: filtered heaps, shared message tables, virtual datasets, external files.
"""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import numpy as np

SIGNATURE = b"\x89HDF\r\n\x1a\n"

#: Message types of object headers. Fixed values.
SPACE, LINK_INFO, TYPE, OLD_FILL, FILL, LINK = 0x01, 0x02, 0x03, 0x04, 0x05, 0x06
EXTERNAL, LAYOUT, FILTERS, ATTRIBUTE, CONTINUED, TABLE, ATTRIBUTE_INFO = 0x07, 0x08, 0x0B, 0x0C, 0x10, 0x11, 0x15


class FormatError(ValueError):
    """The bytes don't follow the format."""


def _width(limit: int) -> int:
    """Bytes that hold numbers up to ``limit``."""
    return (max(1, limit).bit_length() - 1) // 8 + 1


class _Bytes:
    """Little-endian fields, one after another."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def take(self, n: int) -> bytes:
        out = self.data[self.at : self.at + n]
        if len(out) < n:
            raise FormatError("a structure is cut short")
        self.at += n
        return out

    def number(self, n: int) -> int:
        return int.from_bytes(self.take(n), "little")

    def expect(self, signature: bytes) -> None:
        if (found := self.take(len(signature))) != signature:
            raise FormatError(f"{signature!r} expected, {found!r} found")

    def text(self, padded: bool) -> str:
        """Up to a zero byte; ``padded``: to a multiple of eight bytes from where it began."""
        start = self.at
        end = self.data.index(b"\0", start)
        self.at = start + -(-(end + 1 - start) // 8) * 8 if padded else end + 1
        return self.data[start:end].decode("utf-8", "replace")


@dataclass(frozen=True)
class Type:
    """A stored type. kind: plain (numpy has it), text (of variable length), sequence (likewise), reference."""

    size: int
    dtype: Any
    kind: str = "plain"
    base: Type | None = None


@dataclass
class Dataset:
    address: int
    type: Type
    shape: tuple[int, ...] | None  # None: a null space
    limits: tuple[int | None, ...]
    fill: Any
    filters: list[tuple[int, tuple[int, ...]]]
    attributes: dict
    chunks: tuple[int, ...] | None = None
    #: contiguous: (address, size); compact: its bytes
    offset: int | None = None
    size: int = 0
    data: bytes | None = None
    index: tuple | None = None


@dataclass
class Group:
    address: int
    attributes: dict
    #: name: address of the object's header
    children: dict[str, int] = field(default_factory=dict)


class File:
    """``source`` has read_at(n, offset) and size()."""

    BLOCK, KEPT = 1 << 16, 256

    def __init__(self, source):
        self.source, self.end, self.base = source, source.size(), 0
        self._blocks: OrderedDict[int, bytes] = OrderedDict()
        at = 0
        while self.read(at, 8, short=True) != SIGNATURE:
            at = at * 2 or 512
            if at >= self.end:
                raise FormatError("no HDF5 file")
        self._superblock(at)

    def read(self, address: int, n: int, short: bool = False) -> bytes:
        address += self.base
        if n > 4 * self.BLOCK:
            out = self.source.read_at(n, address)
        else:
            first = address // self.BLOCK
            parts = [self._block(k) for k in range(first, (address + n - 1) // self.BLOCK + 1)]
            start = address - first * self.BLOCK
            out = b"".join(parts)[start : start + n]
        if len(out) < n and not short:
            raise FormatError("the file is cut short")
        return out

    def _block(self, k: int) -> bytes:
        if k in self._blocks:
            self._blocks.move_to_end(k)
            return self._blocks[k]
        start = k * self.BLOCK
        self._blocks[k] = self.source.read_at(min(self.BLOCK, self.end - start), start) if start < self.end else b""
        if len(self._blocks) > self.KEPT:
            self._blocks.popitem(last=False)
        return self._blocks[k]

    def _superblock(self, at: int) -> None:
        b = _Bytes(self.read(at, 128, short=True), at=8)
        version = b.number(1)
        if version <= 1:
            b.take(4)
            self.O, self.L = b.number(1), b.number(1)
            b.take(1 + 4 + 4 + (4 if version else 0))
            base = b.number(self.O)
            b.take(3 * self.O + self.O)  # free space, end, driver, name of the root's entry
            self.root = b.number(self.O)
        elif version <= 3:
            self.O, self.L = b.number(1), b.number(1)
            b.take(1)
            base = b.number(self.O)
            b.take(2 * self.O)
            self.root = b.number(self.O)
        else:
            raise NotImplementedError(f"HDF5 superblock of version {version}")
        self.none = (1 << 8 * self.O) - 1
        self.base = base

    def _address(self, b: _Bytes) -> int | None:
        found = b.number(self.O)
        return None if found == self.none else found

    # object headers

    def messages(self, address: int) -> list[tuple[int, bytes]]:
        """(type, data) of an object's header; shared messages are followed."""
        out = []
        for kind, flags, data in self._raw_messages(address):
            out.append((kind, self._shared(kind, data) if flags & 2 else data))
        return out

    def _shared(self, kind: int, data: bytes) -> bytes:
        b = _Bytes(data)
        version, how = b.number(1), b.number(1)
        if version == 3 and how == 1:
            raise NotImplementedError("HDF5 messages in a shared table")
        if version == 1:
            b.take(6)
        address = b.number(self.O)
        return next(d for k, _, d in self._raw_messages(address) if k == kind)

    def _raw_messages(self, address: int) -> Iterator[tuple[int, int, bytes]]:
        head = self.read(address, 32, short=True)
        if head[:4] == b"OHDR":
            flags = head[5]
            at = 6 + (16 if flags & 0x20 else 0) + (4 if flags & 0x10 else 0)
            width = 1 << (flags & 3)
            b = _Bytes(self.read(address, at + width), at)
            blocks, new = [(address + at + width, b.number(width))], True
            extra = 2 if flags & 4 else 0
        elif head[:1] == b"\1":
            blocks, new, extra = [(address + 16, int.from_bytes(head[8:12], "little"))], False, 0
        else:
            raise FormatError(f"no object header at {address}")
        while blocks:
            start, n = blocks.pop(0)
            b = _Bytes(self.read(start, n))
            fixed = 4 + extra if new else 8
            while len(b.data) - b.at >= fixed:
                kind, size = (b.number(1), b.number(2)) if new else (b.number(2), b.number(2))
                flags = b.number(1)
                b.take(extra if new else 3)
                data = b.take(size)
                if kind == CONTINUED:
                    c = _Bytes(data)
                    place, length = c.number(self.O), c.number(self.L)
                    blocks.append((place + 4, length - 8) if new else (place, length))
                else:
                    yield kind, flags, data

    def object(self, address: int) -> Group | Dataset | None:
        """None for what is neither: a named type."""
        found = self.messages(address)
        kinds = {k for k, _ in found}
        if LAYOUT in kinds:
            return self._dataset(address, found)
        if kinds & {TABLE, LINK, LINK_INFO}:
            return Group(address, self._attributes(found), self._children(found))
        return None

    def walk(self) -> Iterator[tuple[str, Group | Dataset]]:
        """(path, object) from the root, whose path is '', by name; a link back to a group above ends there."""
        stack = [("", self.root, ())]
        while stack:
            path, address, above = stack.pop()
            found = self.object(address)
            if found is None:
                continue
            yield path, found
            if isinstance(found, Group):
                inside = (*above, address)
                for name in sorted(found.children, reverse=True):
                    if found.children[name] not in inside:
                        stack.append((f"{path}/{name}".lstrip("/"), found.children[name], inside))

    # groups

    def _children(self, found: list, follow: bool = True) -> dict[str, int]:
        """Names and headers of a group's members; soft links where they lead to one by hard links."""
        hard, soft = {}, {}
        for kind, data in found:
            if kind == TABLE:
                b = _Bytes(data)
                tree, heap = b.number(self.O), b.number(self.O)
                names = self._local_heap(heap)
                for node in self._leaves(tree):
                    self._symbols(node, names, hard, soft)
            elif kind == LINK:
                self._link(data, hard, soft)
            elif kind == LINK_INFO:
                b = _Bytes(data, 1)
                if b.number(1) & 1:
                    b.take(8)
                heap, tree = self._address(b), self._address(b)
                if heap is not None and tree is not None:
                    held = _Heap(self, heap)
                    for record in self._records(tree):
                        self._link(held.get(record[4:]), hard, soft)
        led = {name: self._followed(target, hard) for name, target in soft.items()} if follow else {}
        return hard | {name: address for name, address in led.items() if address is not None}

    def _followed(self, target: str, here: dict[str, int]) -> int | None:
        """Address that a soft link leads to, through hard links; None where there is none."""
        parts = [p for p in target.split("/") if p and p != "."]
        at = self.root if target.startswith("/") else None
        for p in parts:
            children = here
            if at is not None:
                found = self.messages(at)
                if any(k == LAYOUT for k, _ in found):
                    return None
                children = self._children(found, follow=False)
            if p not in children:
                return None
            at = children[p]
        return at

    def _link(self, data: bytes, hard: dict, soft: dict) -> None:
        b = _Bytes(data, 1)
        flags = b.number(1)
        kind = b.number(1) if flags & 8 else 0
        b.take((8 if flags & 4 else 0) + (1 if flags & 0x10 else 0))
        name = b.take(b.number(1 << (flags & 3))).decode("utf-8", "replace")
        if kind == 0:
            hard[name] = b.number(self.O)
        elif kind == 1:
            soft[name] = b.take(b.number(2)).decode("utf-8", "replace")

    def _local_heap(self, address: int) -> bytes:
        b = _Bytes(self.read(address, 8 + 2 * self.L + self.O))
        b.expect(b"HEAP")
        b.take(4)
        n = b.number(self.L)
        b.take(self.L)
        return self.read(b.number(self.O), n)

    def _leaves(self, address: int) -> Iterator[int]:
        b = _Bytes(self.read(address, 8 + 2 * self.O))
        b.expect(b"TREE")
        _, level, used = b.number(1), b.number(1), b.number(2)
        body = _Bytes(self.read(address + 8 + 2 * self.O, used * (self.L + self.O)))
        for _ in range(used):
            body.take(self.L)
            child = body.number(self.O)
            if level:
                yield from self._leaves(child)
            else:
                yield child

    def _symbols(self, address: int, names: bytes, hard: dict, soft: dict) -> None:
        b = _Bytes(self.read(address, 8))
        b.expect(b"SNOD")
        b.take(2)
        n = b.number(2)
        b = _Bytes(self.read(address + 8, n * (2 * self.O + 24)))
        for _ in range(n):
            name = _Bytes(names, b.number(self.O)).text(False)
            header, cached = b.number(self.O), b.number(4)
            b.take(4)
            scratch = b.take(16)
            if cached == 2:
                soft[name] = _Bytes(names, int.from_bytes(scratch[:4], "little")).text(False)
            else:
                hard[name] = header

    # types and spaces

    def _space(self, data: bytes) -> tuple[tuple[int, ...] | None, tuple[int | None, ...]]:
        b = _Bytes(data)
        version, rank, flags = b.number(1), b.number(1), b.number(1)
        kind = b.number(1) if version >= 2 else b.take(5) and 1
        if kind == 2:
            return None, ()
        shape = tuple(b.number(self.L) for _ in range(rank))
        if not flags & 1:
            return shape, shape
        endless = (1 << 8 * self.L) - 1
        limits = (b.number(self.L) for _ in range(rank))
        return shape, tuple(None if n == endless else n for n in limits)

    def _type(self, b: _Bytes) -> Type:
        head, bits, size = b.number(1), b.number(3), b.number(4)
        version, kind = head >> 4, head & 15
        order = ">" if bits & 1 else "<"
        if kind in (0, 4):
            b.take(4)
            signed = kind == 0 and bits & 8
            return Type(size, np.dtype(f"{order}{'i' if signed else 'u'}{size}"))
        if kind == 1:
            b.take(12)
            if bits & 0x40 or size not in (2, 4, 8):
                raise NotImplementedError(f"floating-point numbers of {size} bytes in an order of their own")
            return Type(size, np.dtype(f"{order}f{size}"))
        if kind == 3:
            return Type(size, np.dtype(f"S{size}"))
        if kind == 5:
            b.take(bits & 255)
            return Type(size, np.dtype(f"V{size}"))
        if kind == 6:
            return self._compound(b, version, bits & 0xFFFF, size)
        if kind == 7:
            return Type(size, None, "reference")
        if kind == 8:
            base, n = self._type(b), bits & 0xFFFF
            names = [b.text(version < 3) for _ in range(n)]
            values = np.frombuffer(b.take(n * base.size), base.dtype).tolist()
            if dict(zip(names, values, strict=True)) == {"FALSE": 0, "TRUE": 1} and base.size == 1:
                return Type(1, np.dtype(bool))
            return base
        if kind == 9:
            return Type(size, None, "text" if bits & 15 == 1 else "sequence", self._type(b))
        if kind == 10:
            rank = b.number(1)
            if version < 3:
                b.take(3)
            shape = tuple(b.number(4) for _ in range(rank))
            if version < 3:
                b.take(4 * rank)
            base = self._type(b)
            return Type(size, None if base.dtype is None else np.dtype((base.dtype, shape)), base.kind, base)
        raise NotImplementedError(f"HDF5 type of class {kind}")

    def _compound(self, b: _Bytes, version: int, n: int, size: int) -> Type:
        names, kinds, offsets = [], [], []
        for _ in range(n):
            names.append(b.text(version < 3))
            offsets.append(b.number(4 if version < 3 else _width(size)))
            shape = ()
            if version == 1:
                rank = b.number(1)
                b.take(11)
                shape = tuple(b.number(4) for _ in range(4))[:rank]
            own = self._type(b)
            dtype = np.dtype(f"V{own.size}") if own.dtype is None else own.dtype
            kinds.append(np.dtype((dtype, shape)) if shape else dtype)
        if names == ["r", "i"] and kinds[0] == kinds[1] and kinds[0].kind == "f" and size == 2 * kinds[0].itemsize:
            return Type(size, np.dtype(f"{kinds[0].byteorder.replace('=', '<')}c{size}"))
        return Type(size, np.dtype({"names": names, "formats": kinds, "offsets": offsets, "itemsize": size}))

    def _values(self, t: Type, shape: tuple[int, ...] | None, data: bytes) -> Any:
        """A scalar, or an array or list; "" for a null space."""
        if shape is None:
            return ""
        n = math.prod(shape)
        if t.kind == "plain":
            out = np.frombuffer(data, t.dtype, n).reshape((*shape, *t.dtype.shape))
            return out if out.shape else out[()]
        found = [self._value(t, data[k * t.size : (k + 1) * t.size]) for k in range(n)]
        return found if shape else found[0]

    def _value(self, t: Type, data: bytes) -> Any:
        b = _Bytes(data)
        if t.kind == "reference":
            return b.number(self.O)
        n, address, number = b.number(4), b.number(self.O), b.number(4)
        raw = b"" if not n or not address or address == self.none else self._global(address, number)
        if t.kind == "text":
            return raw[:n].decode("utf-8", "replace").rstrip("\0")
        return self._values(t.base, (n,), raw) if raw else []

    def _global(self, address: int, number: int) -> bytes:
        b = _Bytes(self.read(address, 8 + self.L))
        b.expect(b"GCOL")
        b.take(4)
        size = b.number(self.L)
        b = _Bytes(self.read(address, size), 8 + self.L)
        while size - b.at >= 8 + self.L:
            own = b.number(2)
            b.take(6)
            n = b.number(self.L)
            if own == number:
                return b.take(n)
            if own == 0:
                break
            b.take(-(-n // 8) * 8)
        raise FormatError(f"no object {number} in the heap at {address}")

    # attributes

    def _attributes(self, found: list) -> dict:
        out = {}
        for kind, data in found:
            if kind == ATTRIBUTE:
                self._attribute(data, out)
            elif kind == ATTRIBUTE_INFO:
                b = _Bytes(data, 1)
                if b.number(1) & 1:
                    b.take(2)
                heap, tree = self._address(b), self._address(b)
                if heap is not None and tree is not None:
                    held = _Heap(self, heap)
                    for record in self._records(tree):
                        self._attribute(held.get(record[:8]), out)
        return out

    def _attribute(self, data: bytes, out: dict) -> None:
        b = _Bytes(data)
        version, flags = b.number(1), b.number(1)
        sizes = [b.number(2) for _ in range(3)]
        if version >= 3:
            b.take(1)
        parts = [b.take(-(-n // 8) * 8 if version == 1 else n) for n in sizes]
        shared = flags if version >= 2 else 0
        raw_type = self._shared(TYPE, parts[1]) if shared & 1 else parts[1]
        raw_space = self._shared(SPACE, parts[2]) if shared & 2 else parts[2]
        t, (shape, _) = self._type(_Bytes(raw_type)), self._space(raw_space)
        n = 0 if shape is None else math.prod(shape) * t.size
        out[parts[0].rstrip(b"\0").decode("utf-8", "replace")] = self._values(t, shape, b.take(n))

    # datasets

    def _dataset(self, address: int, found: list) -> Dataset:
        of = dict(found)
        shape, limits = self._space(of[SPACE])
        t = self._type(_Bytes(of[TYPE]))
        out = Dataset(address, t, shape, limits, self._fill(of, t), self._filters(of.get(FILTERS)), self._attributes(found))
        if EXTERNAL in of:
            raise NotImplementedError("an HDF5 dataset in external files")
        self._layout(of[LAYOUT], out)
        return out

    def _fill(self, of: dict, t: Type) -> Any:
        raw = b""
        if FILL in of:
            b = _Bytes(of[FILL])
            version = b.number(1)
            if version < 3:
                b.take(2)
                given = b.number(1) or version == 1
            else:
                given = b.number(1) & 0x20
            raw = b.take(b.number(4)) if given and len(b.data) - b.at >= 4 else b""
        if not raw and OLD_FILL in of:
            b = _Bytes(of[OLD_FILL])
            raw = b.take(b.number(4))
        return np.frombuffer(raw, t.dtype, 1)[0] if t.kind == "plain" and len(raw) == t.size and t.size else None

    def _filters(self, data: bytes | None) -> list[tuple[int, tuple[int, ...]]]:
        if data is None:
            return []
        b = _Bytes(data)
        version, n = b.number(1), b.number(1)
        if version == 1:
            b.take(6)
        out = []
        for _ in range(n):
            number = b.number(2)
            name = b.number(2) if version == 1 or number >= 256 else 0
            b.take(2)
            values = b.number(2)
            b.take(-(-name // 8) * 8 if version == 1 else name)
            out.append((number, tuple(b.number(4) for _ in range(values))))
            if version == 1 and values % 2:
                b.take(4)
        return out

    def _layout(self, data: bytes, d: Dataset) -> None:
        b = _Bytes(data)
        version = b.number(1)
        if version < 3:
            rank, kind = b.number(1), b.number(1)
            b.take(5)
            address = self._address(b) if kind else None
            sizes = tuple(b.number(4) for _ in range(rank))
            if kind == 0:
                d.data = b.take(b.number(4))
            elif kind == 1:
                d.offset, d.size = address, math.prod(d.shape or ()) * d.type.size
            else:
                d.chunks, d.index = sizes[:-1], ("tree", address)
            return
        kind = b.number(1)
        if kind == 0:
            d.data = b.take(b.number(2))
        elif kind == 1:
            d.offset, d.size = self._address(b), b.number(self.L)
        elif kind == 2 and version == 3:
            rank = b.number(1)
            address = self._address(b)
            d.chunks, d.index = tuple(b.number(4) for _ in range(rank))[:-1], ("tree", address)
        elif kind == 2:
            self._indexed(b, d)
        else:
            raise NotImplementedError("an HDF5 virtual dataset")

    def _indexed(self, b: _Bytes, d: Dataset) -> None:
        flags, rank, width = b.number(1), b.number(1), b.number(1)
        d.chunks = tuple(b.number(width) for _ in range(rank))[:-1]
        if flags & 1 and d.filters and any(s % c for s, c in zip(d.shape or (), d.chunks, strict=True)):
            raise NotImplementedError("an HDF5 dataset whose edge chunks alone aren't filtered")
        kind, size, mask = b.number(1), None, 0
        if kind == 1 and flags & 2:
            size, mask = b.number(self.L), b.number(4)
        elif kind > 1:
            b.take({2: 0, 3: 1, 4: 5, 5: 6}[kind])
        names = {1: "single", 2: "implicit", 3: "fixed", 4: "extensible", 5: "tree2"}
        d.index = (names[kind], self._address(b), size, mask)

    # chunks

    def chunks(self, d: Dataset) -> Iterator[tuple[tuple[int, ...], int, int]]:
        """(grid index, offset in the file, bytes) of each stored chunk of a chunked dataset."""
        if d.index is None or d.index[1] is None or d.shape is None:
            return
        grid = tuple(-(-s // c) for s, c in zip(d.shape, d.chunks, strict=True))
        whole = math.prod(d.chunks) * d.type.size
        for idx, address, size, mask in getattr(self, f"_by_{d.index[0]}")(d, d.index[1], whole):
            if any(i >= n for i, n in zip(idx, grid, strict=True)):
                continue
            if mask:
                raise NotImplementedError(f"chunk {idx} skips filters (mask {mask:#x})")
            yield idx, address + self.base, size

    def _by_tree(self, d: Dataset, address: int, whole: int):
        rank = len(d.chunks)
        b = _Bytes(self.read(address, 8 + 2 * self.O))
        b.expect(b"TREE")
        _, level, used = b.number(1), b.number(1), b.number(2)
        key = 8 + 8 * (rank + 1)
        body = _Bytes(self.read(address + 8 + 2 * self.O, used * (key + self.O)))
        for _ in range(used):
            size, mask = body.number(4), body.number(4)
            at = [body.number(8) for _ in range(rank + 1)]
            child = body.number(self.O)
            if level:
                yield from self._by_tree(d, child, whole)
            else:
                yield tuple(a // c for a, c in zip(at, d.chunks, strict=False)), child, size, mask

    def _by_single(self, d: Dataset, address: int, whole: int):
        yield (0,) * len(d.chunks), address, d.index[2] or whole, d.index[3]

    def _by_implicit(self, d: Dataset, address: int, whole: int):
        for number in range(math.prod(self._extent(d))):
            yield self._place(d, number), address + number * whole, whole, 0

    def _by_tree2(self, d: Dataset, address: int, whole: int):
        rank = len(d.chunks)
        for record in self._records(address):
            b = _Bytes(record)
            place = b.number(self.O)
            size, mask = whole, 0
            if d.filters:
                size, mask = b.number(len(record) - self.O - 4 - 8 * rank), b.number(4)
            yield tuple(b.number(8) for _ in range(rank)), place, size, mask

    def _by_fixed(self, d: Dataset, address: int, whole: int):
        for number, entry in self._fixed(address):
            yield from self._entry(d, number, entry, whole)

    def _by_extensible(self, d: Dataset, address: int, whole: int):
        for number, entry in self._extensible(address):
            yield from self._entry(d, number, entry, whole)

    def _entry(self, d: Dataset, number: int, entry: bytes, whole: int):
        b = _Bytes(entry)
        place, size, mask = self._address(b), whole, 0
        if place is None:
            return
        if d.filters:
            size, mask = b.number(len(entry) - self.O - 4), b.number(4)
        yield self._place(d, number), place, size, mask

    def _extent(self, d: Dataset) -> list[int]:
        """Chunks on each axis that the index has numbers for; as of now on an endless one."""
        return [-(-(s if n is None else n) // c) for s, n, c in zip(d.shape, d.limits, d.chunks, strict=True)]

    def _place(self, d: Dataset, number: int) -> tuple[int, ...]:
        """Grid index of a chunk's number: the endless axis varies slowest, then the first."""
        axes = sorted(range(len(d.chunks)), key=lambda a: (d.limits[a] is not None, a))
        extent, idx = self._extent(d), [0] * len(axes)
        for a in reversed(axes[1:]):
            number, idx[a] = divmod(number, extent[a])
        idx[axes[0]] = number
        return tuple(idx)

    def _fixed(self, address: int) -> Iterator[tuple[int, bytes]]:
        b = _Bytes(self.read(address, 8 + self.L + self.O))
        b.expect(b"FAHD")
        b.take(2)
        width, bits, n = b.number(1), b.number(1), b.number(self.L)
        block = self._address(b)
        if block is None:
            return
        self._check(block, b"FADB")
        at, page = block + 6 + self.O, 1 << bits
        if n <= page:
            yield from self._cut(self.read(at, n * width), width, 0)
            return
        pages = -(-n // page)
        made = self.read(at, -(-pages // 8))
        at += len(made) + 4
        for p in range(pages):
            if made[p // 8] & (0x80 >> p % 8):
                count = min(page, n - p * page)
                yield from self._cut(self.read(at + p * (page * width + 4), count * width), width, p * page)

    def _check(self, address: int, signature: bytes) -> None:
        _Bytes(self.read(address, 4)).expect(signature)

    @staticmethod
    def _cut(data: bytes, width: int, first: int) -> Iterator[tuple[int, bytes]]:
        for k in range(len(data) // width):
            yield first + k, data[k * width : (k + 1) * width]

    def _extensible(self, address: int) -> Iterator[tuple[int, bytes]]:
        b = _Bytes(self.read(address, 12 + 6 * self.L + self.O))
        b.expect(b"EAHD")
        b.take(2)
        width, bits, inside, smallest, pointers, page_bits = (b.number(1) for _ in range(6))
        b.take(6 * self.L)
        block = self._address(b)
        if block is None:
            return
        self._check(block, b"EAIB")
        # sizes of the super blocks: how many data blocks, of how many elements
        levels = [(1 << u // 2, (1 << (u + 1) // 2) * smallest) for u in range(1 + bits - (smallest.bit_length() - 1))]
        direct = 2 * (pointers.bit_length() - 1)
        near = sum(n for n, _ in levels[:direct])
        offset = -(-bits // 8)
        b = _Bytes(self.read(block, 6 + self.O + inside * width + (near + len(levels) - direct) * self.O), 6 + self.O)
        yield from self._cut(b.take(inside * width), width, 0)
        first, page = inside, 1 << page_bits
        for u, (blocks, length) in enumerate(levels):
            # data blocks below the index block itself have no pages
            made, pages = b"", length // page if length > page and u >= direct else 0
            if u < direct:
                places = [self._address(b) for _ in range(blocks)]
            elif (above := self._address(b)) is None:
                first += blocks * length
                continue
            else:
                self._check(above, b"EASB")
                bitmap = -(-pages // 8)
                s = _Bytes(self.read(above, 6 + self.O + offset + blocks * (bitmap + self.O)), 6 + self.O + offset)
                made = s.take(blocks * bitmap)
                places = [self._address(s) for _ in range(blocks)]
            for k, place in enumerate(places):
                if place is not None:
                    self._check(place, b"EADB")
                    at = place + 6 + self.O + offset
                    if not pages:
                        yield from self._cut(self.read(at, length * width), width, first)
                    own = made[k * -(-pages // 8) : (k + 1) * -(-pages // 8)]
                    for p in range(pages):
                        if own[p // 8] & (0x80 >> p % 8):
                            data = self.read(at + 4 + p * (page * width + 4), page * width)
                            yield from self._cut(data, width, first + p * page)
                first += length

    def _records(self, address: int) -> Iterator[bytes]:
        """Records of a version 2 B-tree, in order."""
        b = _Bytes(self.read(address, 16 + self.O + 2 + self.L))
        b.expect(b"BTHD")
        b.take(2)
        node, width, depth = b.number(4), b.number(2), b.number(2)
        b.take(2)
        root, n = self._address(b), b.number(2)
        if root is None:
            return
        most = (node - 10) // width
        count, below, total = _width(most), [0], most
        for _ in range(depth):
            own = (node - 10 - (self.O + count + below[-1])) // (width + self.O + count + below[-1])
            total = (own + 1) * total + own
            below.append(_width(total))

        def visit(at: int, n: int, level: int) -> Iterator[bytes]:
            pointer = self.O + count + (below[level - 1] if level > 1 else 0)
            size = 6 + n * width + ((n + 1) * pointer if level else 0)
            b = _Bytes(self.read(at, size))
            b.expect(b"BTIN" if level else b"BTLF")
            b.take(2)
            own = [b.take(width) for _ in range(n)]
            for k in range(n + 1 if level else 0):
                child, inside = b.number(self.O), b.number(count)
                b.take(pointer - self.O - count)
                yield from visit(child, inside, level - 1)
                yield from own[k : k + 1]
            if not level:
                yield from own

        yield from visit(root, n, depth)


class _Heap:
    """A fractal heap: objects by their ids."""

    def __init__(self, f: File, address: int):
        self.f = f
        b = _Bytes(f.read(address, 22 + 12 * f.L + 3 * f.O))
        b.expect(b"FRHP")
        b.take(1)
        self.width, filters = b.number(2), b.number(2)
        if filters:
            raise NotImplementedError("a filtered HDF5 heap")
        b.take(1)
        largest = b.number(4)
        b.take(f.L)
        self.huge = f._address(b)
        b.take(f.L + f.O + 8 * f.L)
        self.columns, self.start, self.direct, bits = b.number(2), b.number(f.L), b.number(f.L), b.number(2)
        b.take(2)
        self.root, self.rows = f._address(b), b.number(2)
        self.offset = -(-bits // 8)
        self.length = min((self.direct.bit_length() + 6) // 8, _width(largest))

    def get(self, id_: bytes) -> bytes:
        kind = id_[0] >> 4 & 3
        b = _Bytes(id_, 1)
        if kind == 2:
            if self.width > 17:
                n = ((id_[0] & 15) << 8 | b.number(1)) + 1
            else:
                n = (id_[0] & 15) + 1
            return b.take(n)
        if kind == 1:
            if self.width - 1 >= self.f.O + self.f.L:
                return self.f.read(b.number(self.f.O), b.number(self.f.L))
            wanted = b.number(min(self.width - 1, self.f.L))
            for record in self.f._records(self.huge):
                r = _Bytes(record)
                place, n, own = r.number(self.f.O), r.number(self.f.L), r.number(self.f.L)
                if own == wanted:
                    return self.f.read(place, n)
            raise FormatError(f"no large object {wanted}")
        at, n = b.number(self.offset), b.number(self.length)
        block, first = self._block(self.root, self.rows, 0, at)
        return self.f.read(block + at - first, n)

    def _block(self, address: int, rows: int, first: int, at: int) -> tuple[int, int]:
        """Address and first offset of the direct block that holds offset ``at``; rows: 0 for a direct block."""
        while rows:
            self.f._check(address, b"FHIB")
            table, place = address + 5 + self.f.O + self.offset, first
            most = self.direct.bit_length() - self.start.bit_length() + 2
            for r in range(rows):
                size = self.start << max(0, r - 1)
                if at < place + size * self.columns:
                    break
                place += size * self.columns
            else:
                raise FormatError("an offset beyond the heap")
            column = (at - place) // size
            first = place + column * size
            child = self.f._address(_Bytes(self.f.read(table + (r * self.columns + column) * self.f.O, self.f.O)))
            if child is None:
                raise FormatError("an offset in a block that isn't there")
            address = child
            rows = 0 if r < most else size.bit_length() - (self.start * self.columns).bit_length() + 1
        return address, first
