"""JPEG: baseline encoder, baseline and progressive decoder, and tile stream surgery (ITU-T T.81)."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np

from tesserae.errors import SlideFormatError, UnsupportedCompressionError

# Quantisation tables of Annex K, row by row.
LUMA_QUANT = (
    16, 11, 10, 16, 24, 40, 51, 61,
    12, 12, 14, 19, 26, 58, 60, 55,
    14, 13, 16, 24, 40, 57, 69, 56,
    14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77,
    24, 35, 55, 64, 81, 104, 113, 92,
    49, 64, 78, 87, 103, 121, 120, 101,
    72, 92, 95, 98, 112, 100, 103, 99,
)
CHROMA_QUANT = (
    17, 18, 24, 47, 99, 99, 99, 99,
    18, 21, 26, 66, 99, 99, 99, 99,
    24, 26, 56, 99, 99, 99, 99, 99,
    47, 66, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
)
# Huffman code counts by length, and symbols, of Annex K.
DC_LUMA = ((0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0), tuple(range(12)))
DC_CHROMA = ((0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0), tuple(range(12)))
AC_LUMA = (
    (0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125),
    (
        0x01, 0x02, 0x03, 0x00, 0x04, 0x11, 0x05, 0x12, 0x21, 0x31, 0x41, 0x06,
        0x13, 0x51, 0x61, 0x07, 0x22, 0x71, 0x14, 0x32, 0x81, 0x91, 0xA1, 0x08,
        0x23, 0x42, 0xB1, 0xC1, 0x15, 0x52, 0xD1, 0xF0, 0x24, 0x33, 0x62, 0x72,
        0x82, 0x09, 0x0A, 0x16, 0x17, 0x18, 0x19, 0x1A, 0x25, 0x26, 0x27, 0x28,
        0x29, 0x2A, 0x34, 0x35, 0x36, 0x37, 0x38, 0x39, 0x3A, 0x43, 0x44, 0x45,
        0x46, 0x47, 0x48, 0x49, 0x4A, 0x53, 0x54, 0x55, 0x56, 0x57, 0x58, 0x59,
        0x5A, 0x63, 0x64, 0x65, 0x66, 0x67, 0x68, 0x69, 0x6A, 0x73, 0x74, 0x75,
        0x76, 0x77, 0x78, 0x79, 0x7A, 0x83, 0x84, 0x85, 0x86, 0x87, 0x88, 0x89,
        0x8A, 0x92, 0x93, 0x94, 0x95, 0x96, 0x97, 0x98, 0x99, 0x9A, 0xA2, 0xA3,
        0xA4, 0xA5, 0xA6, 0xA7, 0xA8, 0xA9, 0xAA, 0xB2, 0xB3, 0xB4, 0xB5, 0xB6,
        0xB7, 0xB8, 0xB9, 0xBA, 0xC2, 0xC3, 0xC4, 0xC5, 0xC6, 0xC7, 0xC8, 0xC9,
        0xCA, 0xD2, 0xD3, 0xD4, 0xD5, 0xD6, 0xD7, 0xD8, 0xD9, 0xDA, 0xE1, 0xE2,
        0xE3, 0xE4, 0xE5, 0xE6, 0xE7, 0xE8, 0xE9, 0xEA, 0xF1, 0xF2, 0xF3, 0xF4,
        0xF5, 0xF6, 0xF7, 0xF8, 0xF9, 0xFA,
    ),
)
AC_CHROMA = (
    (0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119),
    (
        0x00, 0x01, 0x02, 0x03, 0x11, 0x04, 0x05, 0x21, 0x31, 0x06, 0x12, 0x41,
        0x51, 0x07, 0x61, 0x71, 0x13, 0x22, 0x32, 0x81, 0x08, 0x14, 0x42, 0x91,
        0xA1, 0xB1, 0xC1, 0x09, 0x23, 0x33, 0x52, 0xF0, 0x15, 0x62, 0x72, 0xD1,
        0x0A, 0x16, 0x24, 0x34, 0xE1, 0x25, 0xF1, 0x17, 0x18, 0x19, 0x1A, 0x26,
        0x27, 0x28, 0x29, 0x2A, 0x35, 0x36, 0x37, 0x38, 0x39, 0x3A, 0x43, 0x44,
        0x45, 0x46, 0x47, 0x48, 0x49, 0x4A, 0x53, 0x54, 0x55, 0x56, 0x57, 0x58,
        0x59, 0x5A, 0x63, 0x64, 0x65, 0x66, 0x67, 0x68, 0x69, 0x6A, 0x73, 0x74,
        0x75, 0x76, 0x77, 0x78, 0x79, 0x7A, 0x82, 0x83, 0x84, 0x85, 0x86, 0x87,
        0x88, 0x89, 0x8A, 0x92, 0x93, 0x94, 0x95, 0x96, 0x97, 0x98, 0x99, 0x9A,
        0xA2, 0xA3, 0xA4, 0xA5, 0xA6, 0xA7, 0xA8, 0xA9, 0xAA, 0xB2, 0xB3, 0xB4,
        0xB5, 0xB6, 0xB7, 0xB8, 0xB9, 0xBA, 0xC2, 0xC3, 0xC4, 0xC5, 0xC6, 0xC7,
        0xC8, 0xC9, 0xCA, 0xD2, 0xD3, 0xD4, 0xD5, 0xD6, 0xD7, 0xD8, 0xD9, 0xDA,
        0xE2, 0xE3, 0xE4, 0xE5, 0xE6, 0xE7, 0xE8, 0xE9, 0xEA, 0xF2, 0xF3, 0xF4,
        0xF5, 0xF6, 0xF7, 0xF8, 0xF9, 0xFA,
    ),
)


def _zigzag() -> np.ndarray:
    """Natural index of each zigzag place."""
    cells = [(i, j) for i in range(8) for j in range(8)]
    cells.sort(key=lambda c: (c[0] + c[1], c[0] if (c[0] + c[1]) % 2 else c[1]))
    return np.array([8 * i + j for i, j in cells])


ZIGZAG = _zigzag()
_k = np.arange(8)
#: Orthonormal DCT-II: row u, column x.
DCT = np.where(_k[:, None] == 0, np.sqrt(1 / 8), 0.5) * np.cos((2 * _k[None, :] + 1) * _k[:, None] * np.pi / 16)


def _fixed(a: np.ndarray) -> np.ndarray:
    """An array that calls share, and so must not change."""
    a.flags.writeable = False
    return a


@lru_cache(maxsize=256)
def quality_table(base: tuple[int, ...], quality: int) -> np.ndarray:
    """The scaled table of a quality from 1 to 100 (others are clamped)."""
    q = min(100, max(1, quality))
    scale = 5000 // q if q < 50 else 200 - 2 * q
    return _fixed(np.clip((np.array(base) * scale + 50) // 100, 1, 255))


def huffman_codes(counts: tuple[int, ...], symbols: tuple[int, ...]) -> dict[int, tuple[int, int]]:
    """symbol: (code, bits), canonical."""
    out, code, i = {}, 0, 0
    for bits, n in enumerate(counts, 1):
        for _ in range(n):
            out[symbols[i]] = (code, bits)
            code += 1
            i += 1
        code <<= 1
    return out


@lru_cache(maxsize=16)
def _lookup(table) -> tuple[np.ndarray, np.ndarray]:
    code, bits = np.zeros(256, np.int64), np.zeros(256, np.int64)
    for s, (c, b) in huffman_codes(*table).items():
        code[s], bits[s] = c, b
    return _fixed(code), _fixed(bits)


def _magnitude(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Category, and the bits that follow it."""
    size = np.frexp(np.abs(v).astype(np.float64))[1].astype(np.int64)
    return size, np.where(v >= 0, v, v + (1 << size) - 1)


def pack_bits(values: np.ndarray, sizes: np.ndarray) -> bytes:
    """Values of given bit sizes, most significant bit first, padded with ones."""
    total = int(sizes.sum())
    ends = np.cumsum(sizes)
    shift = np.repeat(ends, sizes) - 1 - np.arange(total)
    bits = (np.repeat(values, sizes) >> shift & 1).astype(np.uint8)
    return np.packbits(np.concatenate((bits, np.ones(-total % 8, np.uint8)))).tobytes()


def _plane_tokens(blocks: np.ndarray, dc_table, ac_table) -> tuple[np.ndarray, ...]:
    """(block, order in it, value, size) of the codes of zigzag blocks (n, 64)."""
    n = len(blocks)
    dc_code, dc_bits = _lookup(dc_table)
    ac_code, ac_bits = _lookup(ac_table)
    size, extra = _magnitude(np.diff(blocks[:, 0], prepend=0))
    out = [(np.arange(n), np.zeros(n, np.int64), dc_code[size] << size | extra, dc_bits[size] + size)]
    block, place = np.nonzero(blocks[:, 1:])
    place += 1
    before = np.where(np.concatenate(([True], block[1:] != block[:-1])), 0, np.concatenate(([0], place[:-1]))) if len(block) else place
    run = place - before - 1
    size, extra = _magnitude(blocks[block, place])
    symbol = (run % 16) << 4 | size
    out.append((block, place * 4 + 3, ac_code[symbol] << size | extra, ac_bits[symbol] + size))
    for k in range(3):  # runs of sixteen zeros
        long = np.flatnonzero(run // 16 > k)
        out.append((block[long], place[long] * 4 + k, np.full(len(long), ac_code[0xF0]), np.full(len(long), ac_bits[0xF0])))
    last = np.zeros(n, np.int64)
    last[block] = place  # places ascend, so the last stays
    ends = np.flatnonzero(last < 63)
    out.append((ends, np.full(len(ends), 400), np.full(len(ends), ac_code[0]), np.full(len(ends), ac_bits[0])))
    return tuple(np.concatenate(x) for x in zip(*out))


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def encode(rgba: np.ndarray, quality: int = 90) -> bytes:
    """Baseline JFIF, 4:4:4 YCbCr; alpha is dropped and edges are repeated up to whole blocks."""
    h, w = rgba.shape[:2]
    rgb = np.pad(rgba[..., :3], ((0, -h % 8), (0, -w % 8), (0, 0)), mode="edge").astype(np.float64)
    r, g, b = rgb[..., 0], rgb[..., 1], rgb[..., 2]
    y = 0.299 * r + 0.587 * g + 0.114 * b
    planes = (y - 128, (b - y) / 1.772, (r - y) / 1.402)
    quants = [quality_table(t, quality) for t in (LUMA_QUANT, CHROMA_QUANT)]
    tokens = []
    for c, plane in enumerate(planes):
        tiles = plane.reshape(plane.shape[0] // 8, 8, -1, 8).swapaxes(1, 2).reshape(-1, 8, 8)
        coefficients = np.rint((DCT @ tiles @ DCT.T).reshape(-1, 64) / quants[c > 0]).astype(np.int64)
        coefficients[:, 1:] = np.clip(coefficients[:, 1:], -1023, 1023)
        block, order, value, size = _plane_tokens(coefficients[:, ZIGZAG], *((DC_LUMA, AC_LUMA) if c == 0 else (DC_CHROMA, AC_CHROMA)))
        tokens.append((block * 3 + c, order, value, size))
    block, order, value, size = (np.concatenate(x) for x in zip(*tokens))
    sort = np.lexsort((order, block))
    scan = pack_bits(value[sort], size[sort]).replace(b"\xff", b"\xff\x00")
    head = [b"\xff\xd8", _segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0")]
    head += [_segment(0xDB, bytes([i]) + bytes(q[ZIGZAG].tolist())) for i, q in enumerate(quants)]
    head.append(_segment(0xC0, struct.pack(">BHHB", 8, h, w, 3) + bytes([1, 0x11, 0, 2, 0x11, 1, 3, 0x11, 1])))
    head += [_segment(0xC4, bytes([kind]) + bytes(t[0]) + bytes(t[1])) for kind, t in ((0, DC_LUMA), (0x10, AC_LUMA), (1, DC_CHROMA), (0x11, AC_CHROMA))]
    head.append(_segment(0xDA, bytes([3, 1, 0, 2, 0x11, 3, 0x11, 0, 63, 0])))
    return b"".join(head) + scan + b"\xff\xd9"


def splice_tables(tables: bytes | None, tile: bytes) -> bytes:
    """An abbreviated tile with its shared tables before it; unchanged without tables."""
    if not tables:
        return tile
    return (tables[:-2] if tables.endswith(b"\xff\xd9") else tables) + (tile[2:] if tile.startswith(b"\xff\xd8") else tile)


#: APP14 marker that says: no colour transform.
RGB_MARKER = bytes.fromhex("FFEE000E41646F626500640000000000")


def mark_rgb(jpeg: bytes) -> bytes:
    return jpeg[:2] + RGB_MARKER + jpeg[2:]


@dataclass
class _Component:
    id: int
    h: int
    v: int
    quant: int
    dc: int = 0
    ac: int = 0
    blocks: np.ndarray = field(default=None, repr=False)  # (rows, columns, 64), natural order


class _Bits:
    """Bits of an entropy-coded segment without its stuffing."""

    def __init__(self, data: bytes):
        self.data = data + b"\0" * 8
        self.at = 0
        self.end = len(data) * 8

    def peek(self) -> int:
        byte = self.at >> 3
        return int.from_bytes(self.data[byte : byte + 3], "big") >> (8 - (self.at & 7)) & 0xFFFF

    def take(self, n: int) -> int:
        if not n:
            return 0
        if self.at > self.end:
            raise SlideFormatError("JPEG data end early")
        v = self.peek() >> (16 - n)
        self.at += n
        return v

    def symbol(self, table) -> int:
        got = table[self.peek()]
        if got < 0:
            raise SlideFormatError("JPEG Huffman code")
        self.at += got >> 8
        if self.at > self.end + 64:
            raise SlideFormatError("JPEG data end early")
        return got & 255

    def signed(self, n: int) -> int:
        v = self.take(n)
        return v if not n or v >> (n - 1) else v - (1 << n) + 1


@lru_cache(maxsize=32)
def _decoding_table(counts: bytes, symbols: bytes) -> list[int]:
    """Of each 16 bits: bits of the code << 8 | symbol, or -1. Tiles mostly have the same few tables, which calls share."""
    out = [-1] * (1 << 16)
    for s, (code, bits) in huffman_codes(tuple(counts), tuple(symbols)).items():
        n = 1 << (16 - bits)
        at, end = code * n, min(1 << 16, (code + 1) * n)  # a damaged table may have too many codes
        out[at:end] = [bits << 8 | s] * (end - at)
    return out


class _Decoder:
    def __init__(self, data: bytes):
        self.data = data
        self.quants: dict[int, np.ndarray] = {}
        self.tables: dict[int, list[int]] = {}
        self.components: list[_Component] = []
        self.width = self.height = self.restart = 0
        self.transform: int | None = None
        self.progressive = False

    def run(self) -> np.ndarray:
        if self.data[:2] != b"\xff\xd8":
            raise SlideFormatError("not a JPEG")
        at = 2
        while True:
            at = self.data.find(b"\xff", at)
            if at < 0 or at + 1 >= len(self.data):
                break
            marker = self.data[at + 1]
            if marker in (0, 0xFF) or 0xD0 <= marker <= 0xD8:
                at += 1 if marker == 0xFF else 2
                continue
            if marker == 0xD9:
                break
            size = struct.unpack(">H", self.data[at + 2 : at + 4])[0]
            body = self.data[at + 4 : at + 2 + size]
            at += 2 + size
            if marker == 0xDB:
                self.read_quants(body)
            elif marker == 0xC4:
                self.read_tables(body)
            elif marker in (0xC0, 0xC1, 0xC2):
                self.read_frame(body, marker == 0xC2)
            elif 0xC3 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
                raise UnsupportedCompressionError(7, f"JPEG process {marker:#x}")
            elif marker == 0xDD:
                self.restart = struct.unpack(">H", body[:2])[0]
            elif marker == 0xEE and body[:5] == b"Adobe":
                self.transform = body[11]
            elif marker == 0xDA:
                at = self.read_scan(body, at)
        if not self.components:
            raise SlideFormatError("JPEG without a frame")
        return self.picture()

    def read_quants(self, b: bytes) -> None:
        while b:
            wide, n = b[0] >> 4, 128 if b[0] >> 4 else 64
            q = np.zeros(64, np.int64)
            q[ZIGZAG] = np.frombuffer(b[1 : 1 + n], ">u2" if wide else "u1")
            self.quants[b[0] & 15] = q
            b = b[1 + n :]

    def read_tables(self, b: bytes) -> None:
        while b:
            n = sum(b[1:17])
            self.tables[b[0]] = _decoding_table(b[1:17], b[17 : 17 + n])
            b = b[17 + n :]

    def read_frame(self, b: bytes, progressive: bool) -> None:
        if b[0] != 8:
            raise UnsupportedCompressionError(7, f"JPEG of {b[0]} bits")
        self.height, self.width, n = struct.unpack(">HHB", b[1:6])
        self.progressive = progressive
        self.components = [_Component(b[i], b[i + 1] >> 4, b[i + 1] & 15, b[i + 2]) for i in range(6, 6 + 3 * n, 3)]
        self.h, self.v = max(c.h for c in self.components), max(c.v for c in self.components)
        self.mcus_x, self.mcus_y = -(-self.width // (8 * self.h)), -(-self.height // (8 * self.v))
        for c in self.components:
            c.blocks = np.zeros((self.mcus_y * c.v, self.mcus_x * c.h, 64), np.int32)

    def read_scan(self, b: bytes, at: int) -> int:
        some = []
        for i in range(b[0]):
            c = next(x for x in self.components if x.id == b[1 + 2 * i])
            c.dc, c.ac = b[2 + 2 * i] >> 4, b[2 + 2 * i] & 15
            some.append(c)
        first, last, approx = b[1 + 2 * b[0] : 4 + 2 * b[0]]
        end = at
        segments, start = [], at
        while True:  # restart markers divide the scan
            end = self.data.find(b"\xff", end)
            if end < 0 or end + 1 >= len(self.data):
                end = len(self.data)
                break
            m = self.data[end + 1]
            if m == 0:
                end += 2
            elif 0xD0 <= m <= 0xD7:
                segments.append(self.data[start:end])
                end += 2
                start = end
            elif m == 0xFF:
                end += 1
            else:
                break
        segments.append(self.data[start:end])
        if len(some) == 1:
            c = some[0]
            w, h = -(-(-(-self.width * c.h // self.h)) // 8), -(-(-(-self.height * c.v // self.v)) // 8)
            places = [[(c, y, x)] for y in range(h) for x in range(w)]
        else:
            places = [[(c, my * c.v + v, mx * c.h + h) for c in some for v in range(c.v) for h in range(c.h)] for my in range(self.mcus_y) for mx in range(self.mcus_x)]
        step = self.restart or len(places)
        for i, raw in enumerate(segments):
            if i * step >= len(places):
                break
            self.read_segment(_Bits(raw.replace(b"\xff\x00", b"\xff")), places[i * step : (i + 1) * step], first, last, approx >> 4, approx & 15)
        return end

    def read_segment(self, bits: _Bits, places, first: int, last: int, high: int, low: int) -> None:
        previous = {c.id: 0 for c in self.components}
        self.band = 0
        for mcu in places:
            for c, y, x in mcu:
                block = c.blocks[y, x]
                if not self.progressive:
                    self.baseline(bits, c, block, previous)
                elif first == 0:
                    if high == 0:
                        previous[c.id] += bits.signed(bits.symbol(self.tables[c.dc]))
                        block[0] = previous[c.id] << low
                    elif bits.take(1):
                        block[0] |= 1 << low
                elif high == 0:
                    self.band_first(bits, c, block, first, last, low)
                else:
                    self.band_refine(bits, c, block, first, last, low)

    def baseline(self, bits: _Bits, c: _Component, block: np.ndarray, previous: dict) -> None:
        previous[c.id] += bits.signed(bits.symbol(self.tables[c.dc]))
        block[0] = previous[c.id]
        table, k = self.tables[0x10 | c.ac], 1
        while k < 64:
            s = bits.symbol(table)
            size = s & 15
            if size:
                k += s >> 4
                if k > 63:
                    raise SlideFormatError("JPEG coefficient beyond its block")
                block[ZIGZAG[k]] = bits.signed(size)
                k += 1
            elif s == 0xF0:
                k += 16
            else:
                break

    def band_first(self, bits: _Bits, c: _Component, block: np.ndarray, first: int, last: int, low: int) -> None:
        if self.band:
            self.band -= 1
            return
        table, k = self.tables[0x10 | c.ac], first
        while k <= last:
            s = bits.symbol(table)
            run, size = s >> 4, s & 15
            if size:
                k += run
                if k > 63:
                    raise SlideFormatError("JPEG coefficient beyond its block")
                block[ZIGZAG[k]] = bits.signed(size) * (1 << low)
                k += 1
            elif run == 15:
                k += 16
            else:
                self.band = (1 << run) + bits.take(run) - 1
                break

    def band_refine(self, bits: _Bits, c: _Component, block: np.ndarray, first: int, last: int, low: int) -> None:
        table, k, one = self.tables[0x10 | c.ac], first, 1 << low

        def correct(i: int) -> None:
            if bits.take(1) and not abs(int(block[i])) & one:
                block[i] += one if block[i] > 0 else -one

        while k <= last and not self.band:
            s = bits.symbol(table)
            run, size = s >> 4, s & 15
            fresh = 0
            if size:
                fresh = one if bits.take(1) else -one
            elif run < 15:
                self.band = (1 << run) + bits.take(run)
                break
            while k <= last:
                i = ZIGZAG[k]
                if block[i]:
                    correct(i)
                elif run == 0:
                    if fresh:
                        block[i] = fresh
                    k += 1
                    break
                else:
                    run -= 1
                k += 1
        if self.band:
            while k <= last:
                if block[ZIGZAG[k]]:
                    correct(ZIGZAG[k])
                k += 1
            self.band -= 1

    def picture(self) -> np.ndarray:
        planes = []
        for c in self.components:
            rows, cols = c.blocks.shape[:2]
            f = (c.blocks * self.quants[c.quant]).reshape(-1, 8, 8).astype(np.float64)
            pixels = (DCT.T @ f @ DCT + 128).reshape(rows, cols, 8, 8).swapaxes(1, 2).reshape(rows * 8, cols * 8)
            pixels = np.repeat(np.repeat(pixels, self.v // c.v, axis=0), self.h // c.h, axis=1)
            planes.append(pixels[: self.height, : self.width])
        to_byte = lambda p: np.clip(np.floor(p + 0.5), 0, 255).astype(np.uint8)
        if len(planes) == 1:
            return to_byte(planes[0])
        by_letter = [c.id for c in self.components[:3]] == [82, 71, 66]
        if len(planes) == 3 and self.transform != 0 and not by_letter:
            y, cb, cr = (np.clip(np.floor(p + 0.5), 0, 255) for p in planes)
            planes = [y + 1.402 * (cr - 128), y - 0.344136 * (cb - 128) - 0.714136 * (cr - 128), y + 1.772 * (cb - 128)]
        return np.dstack([to_byte(p) for p in planes[:3]])


def decode(data: bytes) -> np.ndarray:
    """uint8 (height, width) of a grey image, else (height, width, 3) in RGB."""
    return _Decoder(data).run()


def decode_rgba(data: bytes) -> np.ndarray:
    p = decode(data)
    p = np.dstack([p] * 3) if p.ndim == 2 else p
    return np.dstack((p, np.full(p.shape[:2], 255, np.uint8)))
