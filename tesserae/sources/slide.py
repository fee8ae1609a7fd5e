"""A slide's directories as levels and associated images."""

from __future__ import annotations

from dataclasses import dataclass

from tesserae.errors import SlideFormatError, TileReadError, UnsupportedCompressionError
from tesserae.sources.bytesource import MemorySource, source_of
from tesserae.sources.tiff import Ifd, read_ifds

JPEG, JPEG_OLD, LZW, RAW, DEFLATE, PACKBITS, DEFLATE_OLD, JP2K = 7, 6, 5, 1, 8, 32773, 32946, 33005
LEVEL_COMPRESSIONS = (JPEG, JP2K)


@dataclass
class Level:
    ifd: Ifd
    index: int
    width: int
    height: int
    tile_w: int
    tile_h: int
    compression: int
    photometric: int  # -1: absent
    downsample: float

    @property
    def tiles_x(self) -> int:
        return -(-self.width // self.tile_w)

    @property
    def tiles_y(self) -> int:
        return -(-self.height // self.tile_h)

    def tile_table(self) -> tuple[list[int], list[int]]:
        """Offsets and byte counts, row by row; the tables must fill the grid."""
        self._check()
        return self.ifd.ints(324), self.ifd.ints(325)

    def tile_place(self, i: int) -> tuple[int, int]:
        """Offset and byte count of one tile, without the tables of a large level."""
        self._check()
        return self.ifd.int_at(324, i), self.ifd.int_at(325, i)

    def _check(self) -> None:
        offsets, counts = (self.ifd.tags[t].count if t in self.ifd.tags else 0 for t in (324, 325))
        if not offsets == counts == self.tiles_x * self.tiles_y:
            raise SlideFormatError(f"level {self.index}: {offsets} offsets and {counts} counts for {self.tiles_x} x {self.tiles_y} tiles")


@dataclass
class Associated:
    ifd: Ifd
    kind: str
    width: int
    height: int
    compression: int
    photometric: int
    samples: int
    bits: list[int]
    predictor: int

    @property
    def rows_per_strip(self) -> int:
        return min(self.ifd.int(278, self.height), self.height)

    def strip_table(self) -> tuple[list[int], list[int]]:
        offsets, counts = self.ifd.ints(273), self.ifd.ints(279)
        if len(offsets) != len(counts):
            raise SlideFormatError("strip offsets and byte counts differ in number")
        return offsets, counts

    @property
    def decodable(self) -> bool:
        raw = self.compression in (RAW, LZW, DEFLATE, PACKBITS, DEFLATE_OLD)
        return self.compression == JPEG or (raw and self.photometric == 2 and self.samples in (3, 4) and all(b == 8 for b in self.bits) and self.predictor in (1, 2))


@dataclass
class Slide:
    source: object
    ifds: list[Ifd]
    levels: list[Level]
    associated: list[Associated]
    description: str | None

    def close(self) -> None:
        self.source.close()

    def tile_bytes(self, level: int, tx: int, ty: int, tables: tuple[list[int], list[int]] | None = None) -> bytes:
        """A tile as stored; empty if sparse."""
        lv = self.levels[level]
        if not (0 <= tx < lv.tiles_x and 0 <= ty < lv.tiles_y):
            raise TileReadError(f"tile {tx}, {ty} lies outside level {level}")
        i = ty * lv.tiles_x + tx
        offset, count = (tables[0][i], tables[1][i]) if tables else lv.tile_place(i)
        data = self.source.read(offset, count) if count else b""
        if len(data) != count:
            raise TileReadError(f"tile {tx}, {ty} of level {level} is cut off")
        return data


def kind_of(description: str | None) -> str:
    low = (description or "").lower()
    return "macro" if "macro" in low else "label" if "label" in low else "thumbnail"


def analyse(source) -> Slide:
    ifds = read_ifds(source)
    if not ifds:
        raise SlideFormatError("the file has no directory")
    levels: list[Level] = []
    images: list[Associated] = []
    for ifd in ifds:
        width, height, photometric = ifd.int(256), ifd.int(257), ifd.int(262, -1)
        if ifd.tiled:
            compression = ifd.int(259, JPEG)
            if compression not in LEVEL_COMPRESSIONS:
                raise UnsupportedCompressionError(compression, f"directory {ifd.index}: compression {compression} of a level")
            base = levels[0].width if levels else width
            levels.append(Level(ifd, len(levels), width, height, ifd.int(322), ifd.int(323), compression, photometric, base / width))
        else:
            bits = ifd.ints(258) if 258 in ifd.tags else [1]
            images.append(Associated(ifd, kind_of(ifd.text(270)), width, height, ifd.int(259, 0), photometric, ifd.int(277, 1), bits, ifd.int(317, 1)))
    if not levels:
        raise SlideFormatError("no tiled directory: not a whole-slide image")
    return Slide(source, ifds, levels, images, levels[0].ifd.text(270))


def open_slide(path: str) -> Slide:
    source = source_of(path)
    try:
        return analyse(source)
    except Exception:
        source.close()
        raise


def open_bytes(data: bytes) -> Slide:
    return analyse(MemorySource(data))
