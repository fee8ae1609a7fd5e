"""Classic TIFF and BigTIFF directories, either byte order, read by byte range.

Out-of-line values stay unread until they are asked for.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np

from tesserae.errors import SlideFormatError
from tesserae.sources.bytesource import exactly

#: numpy kind of each field type, and values per count.
TYPES = {1: ("u1", 1), 2: ("u1", 1), 3: ("u2", 1), 4: ("u4", 1), 5: ("u4", 2), 6: ("i1", 1), 7: ("u1", 1), 8: ("i2", 1), 9: ("i4", 1), 10: ("i4", 2), 11: ("f4", 1), 12: ("f8", 1), 13: ("u4", 1), 16: ("u8", 1), 17: ("i8", 1), 18: ("u8", 1)}
INTEGERS = {1, 3, 4, 6, 8, 9, 13, 16, 17, 18}
MAX_IFDS = 1000
MAX_VALUE = 256 << 20


def type_size(kind: int) -> int:
    if kind not in TYPES:
        raise SlideFormatError(f"unknown field type {kind}")
    code, per = TYPES[kind]
    return int(code[1]) * per


@dataclass(frozen=True)
class Header:
    order: str  # '<' or '>'
    big: bool
    first_ifd: int


@dataclass(frozen=True)
class Tag:
    id: int
    kind: int
    count: int
    raw: bytes  # the value field: the value, or its offset


@dataclass
class Ifd:
    index: int
    offset: int
    header: Header
    source: object = field(repr=False)
    tags: dict[int, Tag] = field(default_factory=dict)
    next: int = 0

    def value_bytes(self, tag: Tag) -> bytes:
        n = type_size(tag.kind) * tag.count
        if n <= len(tag.raw):
            return tag.raw[:n]
        if n > MAX_VALUE:
            raise SlideFormatError(f"tag {tag.id} has {n} bytes")
        at = int.from_bytes(tag.raw, "little" if self.header.order == "<" else "big")
        return exactly(self.source, at, n)

    def _array(self, tag: Tag) -> np.ndarray:
        return np.frombuffer(self.value_bytes(tag), self.header.order + TYPES[tag.kind][0])

    def value(self, tag_id: int):
        """Integers, floats and rationals as lists, text as str, undefined as bytes; None if absent."""
        tag = self.tags.get(tag_id)
        if tag is None:
            return None
        type_size(tag.kind)
        if tag.kind == 2:
            return self.value_bytes(tag).rstrip(b"\0").decode("utf-8", "replace")
        if tag.kind == 7:
            return self.value_bytes(tag)
        if tag.kind in (5, 10):
            return [tuple(x) for x in self._array(tag).reshape(-1, 2).tolist()]
        return self._array(tag).tolist()

    def ints(self, tag_id: int) -> list[int]:
        tag = self.tags.get(tag_id)
        if tag is None:
            raise SlideFormatError(f"tag {tag_id} is missing")
        if tag.kind not in INTEGERS:
            raise SlideFormatError(f"tag {tag_id} is not an integer")
        return self._array(tag).tolist()

    def int_at(self, tag_id: int, i: int) -> int:
        """One of a tag's integers, without reading the others where they lie elsewhere."""
        tag = self.tags.get(tag_id)
        if tag is None or tag.kind not in INTEGERS or not 0 <= i < tag.count:
            raise SlideFormatError(f"tag {tag_id} has no integer {i}")
        size = type_size(tag.kind)
        if size * tag.count <= len(tag.raw):
            return self._array(tag).tolist()[i]
        at = int.from_bytes(tag.raw, "little" if self.header.order == "<" else "big")
        return np.frombuffer(exactly(self.source, at + i * size, size), self.header.order + TYPES[tag.kind][0]).tolist()[0]

    def int(self, tag_id: int, default: int | None = None) -> int:
        if tag_id not in self.tags and default is not None:
            return default
        values = self.ints(tag_id)
        if not values:
            raise SlideFormatError(f"tag {tag_id} is empty")
        return values[0]

    def text(self, tag_id: int) -> str | None:
        tag = self.tags.get(tag_id)
        if tag is not None and tag.kind != 2:
            raise SlideFormatError(f"tag {tag_id} is not text")
        return self.value(tag_id)

    def raw(self, tag_id: int) -> bytes | None:
        tag = self.tags.get(tag_id)
        return None if tag is None else self.value_bytes(tag)

    @property
    def tiled(self) -> bool:
        return 322 in self.tags and 323 in self.tags


def read_header(source) -> Header:
    head = exactly(source, 0, 8)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    if order is None:
        raise SlideFormatError("no byte-order mark")
    magic = struct.unpack(order + "H", head[2:4])[0]
    if magic == 42:
        return Header(order, False, struct.unpack(order + "I", head[4:8])[0])
    if magic != 43:
        raise SlideFormatError(f"magic number {magic}")
    if struct.unpack(order + "HH", head[4:8]) != (8, 0):
        raise SlideFormatError("BigTIFF offsets must have 8 bytes")
    return Header(order, True, struct.unpack(order + "Q", exactly(source, 8, 8))[0])


def read_ifd(source, header: Header, offset: int, index: int) -> Ifd:
    """One directory; the last of repeated tags wins."""
    o, big = header.order, header.big
    count = struct.unpack(o + ("Q" if big else "H"), exactly(source, offset, 8 if big else 2))[0]
    if count > 65535:
        raise SlideFormatError(f"a directory of {count} entries")
    entry, wide = (20, 8) if big else (12, 4)
    body = exactly(source, offset + (8 if big else 2), count * entry + wide)
    ifd = Ifd(index, offset, header, source)
    for i in range(count):
        e = body[i * entry : (i + 1) * entry]
        tag, kind = struct.unpack(o + "HH", e[:4])
        n = struct.unpack(o + ("Q" if big else "I"), e[4 : 4 + wide])[0]
        ifd.tags[tag] = Tag(tag, kind, n, e[4 + wide :])
    ifd.next = struct.unpack(o + ("Q" if big else "I"), body[count * entry :])[0]
    return ifd


def read_ifds(source) -> list[Ifd]:
    """The chain of directories; a cycle or more than MAX_IFDS is an error."""
    header = read_header(source)
    out, seen, at = [], set(), header.first_ifd
    while at:
        if at in seen:
            raise SlideFormatError("the directories form a cycle")
        if len(out) == MAX_IFDS:
            raise SlideFormatError("too many directories")
        seen.add(at)
        out.append(read_ifd(source, header, at, len(out)))
        at = out[-1].next
    return out
