"""BigTIFF pyramids: the layout, and assembly in file order.

Spark knows every tile's size before the file is assembled, so offsets come from running sums and
nothing is patched afterwards. The file is little endian: header, then each directory followed by
its out-of-line values, then tiles and strips at even places.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable
from dataclasses import dataclass, field
from typing import BinaryIO

import numpy as np

from tesserae.sources.tiff import TYPES

ASCII, SHORT, LONG, LONG8 = 2, 3, 4, 16


@dataclass
class LevelSpec:
    width: int
    height: int
    tile_w: int
    tile_h: int
    compression: int
    description: str | None = None

    @property
    def n_tiles(self) -> int:
        return -(-self.width // self.tile_w) * -(-self.height // self.tile_h)


@dataclass
class ImageSpec:
    """An associated image with its strips, written as they are."""

    width: int
    height: int
    compression: int
    photometric: int  # -1: not written
    samples: int
    bits: list[int]
    rows_per_strip: int
    strips: list[bytes]
    predictor: int = 1
    description: str | None = None


@dataclass
class Entry:
    tag: int
    kind: int
    data: bytes = field(repr=False)
    count: int = 0


def entry(tag: int, kind: int, values: Iterable[int]) -> Entry:
    a = np.array(list(values), "<" + TYPES[kind][0])
    return Entry(tag, kind, a.tobytes(), len(a))


def text_entry(tag: int, text: str) -> Entry:
    raw = text.encode() + b"\0"
    return Entry(tag, ASCII, raw, len(raw))


def level_entries(s: LevelSpec, offsets: Iterable[int], counts: Iterable[int]) -> list[Entry]:
    return [
        entry(256, LONG, [s.width]),
        entry(257, LONG, [s.height]),
        entry(258, SHORT, [8, 8, 8]),
        entry(259, SHORT, [s.compression]),
        entry(262, SHORT, [6 if s.compression == 7 else 2]),
        *([text_entry(270, s.description)] if s.description is not None else []),
        entry(277, SHORT, [3]),
        entry(322, LONG, [s.tile_w]),
        entry(323, LONG, [s.tile_h]),
        entry(324, LONG8, offsets),
        entry(325, LONG, counts),
    ]


def image_entries(s: ImageSpec, offsets: Iterable[int]) -> list[Entry]:
    return [
        entry(256, LONG, [s.width]),
        entry(257, LONG, [s.height]),
        entry(258, SHORT, s.bits),
        entry(259, SHORT, [s.compression]),
        *([entry(262, SHORT, [s.photometric])] if s.photometric != -1 else []),
        *([text_entry(270, s.description)] if s.description is not None else []),
        entry(273, LONG8, offsets),
        entry(277, SHORT, [s.samples]),
        entry(278, LONG, [s.rows_per_strip]),
        entry(279, LONG, [len(x) for x in s.strips]),
        *([entry(317, SHORT, [s.predictor])] if s.predictor != 1 else []),
    ]


def directory_size(entries: list[Entry]) -> int:
    blobs = sum(len(e.data) + (len(e.data) & 1) for e in entries if len(e.data) > 8)
    return 8 + 20 * len(entries) + 8 + blobs


def directory(entries: list[Entry], at: int, following: int) -> bytes:
    head, blobs = [struct.pack("<Q", len(entries))], []
    place = at + 8 + 20 * len(entries) + 8
    for e in entries:
        if len(e.data) <= 8:
            value = e.data.ljust(8, b"\0")
        else:
            value = struct.pack("<Q", place)
            blobs.append(e.data + b"\0" * (len(e.data) & 1))
            place += len(blobs[-1])
        head.append(struct.pack("<HHQ", e.tag, e.kind, e.count) + value)
    return b"".join([*head, struct.pack("<Q", following), *blobs])


def place(sizes: list[int], at: int) -> tuple[list[int], int]:
    """Even offsets of blobs in sequence (0 for empty ones), and the end."""
    out = []
    for n in sizes:
        out.append(at if n else 0)
        at += n + (n & 1)
    return out, at


def write(out: BinaryIO, levels: list[LevelSpec], tile_sizes: list[list[int]], tiles: Iterable[bytes], images: list[ImageSpec] = ()) -> int:
    """Writes a file; tiles come level by level, row by row, and tile_sizes has their bytes. Returns the length."""
    sizes = [directory_size(level_entries(s, [0] * s.n_tiles, [0] * s.n_tiles)) for s in levels]
    sizes += [directory_size(image_entries(s, [0] * len(s.strips))) for s in images]
    starts, at = [], 16
    for n in sizes:
        starts.append(at)
        at += n + (n & 1)
    end_of_head = at
    entries = []
    for s, counts in zip(levels, tile_sizes, strict=True):
        offsets, at = place(counts, at)
        entries.append(level_entries(s, offsets, counts))
    for s in images:
        offsets, at = place([len(x) for x in s.strips], at)
        entries.append(image_entries(s, offsets))
    head = bytearray(struct.pack("<2sHHHQ", b"II", 43, 8, 0, 16))
    for i, (e, start) in enumerate(zip(entries, starts)):
        head += b"\0" * (start - len(head))
        head += directory(e, start, starts[i + 1] if i + 1 < len(starts) else 0)
    out.write(bytes(head).ljust(end_of_head, b"\0"))
    written = 0
    for t in tiles:
        out.write(t + b"\0" * (len(t) & 1))
        written += 1
    if written != sum(map(len, tile_sizes)):
        raise ValueError(f"{written} tiles for {sum(map(len, tile_sizes))} places")
    for s in images:
        for x in s.strips:
            out.write(x + b"\0" * (len(x) & 1))
    return at
