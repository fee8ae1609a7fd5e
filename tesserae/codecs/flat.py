"""Flat image encoders: PNG, BMP and TIFF. Rasters are uint8 arrays (height, width, 4)."""

from __future__ import annotations

import struct
import zlib

import numpy as np

IDAT_BYTES = 1 << 20
#: Bytes of rows filtered at a time, which fit a processor cache with their candidates.
BAND_BYTES = 1 << 16


def _png_chunk(name: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))


def png_filter(rows: np.ndarray) -> np.ndarray:
    """Filtered rows with their filter byte: of five filters the one with the least sum of absolute values.

    rows: (height, width * 4). Ties take the lower filter.
    """
    left = np.zeros_like(rows)
    left[:, 4:] = rows[:, :-4]
    up = np.zeros_like(rows)
    up[1:] = rows[:-1]
    corner = np.zeros_like(rows)
    corner[1:, 4:] = rows[:-1, :-4]
    a, b, c = (v.astype(np.int16) for v in (left, up, corner))
    to_left, to_up, to_corner = np.abs(b - c), np.abs(a - c), np.abs(a + b - 2 * c)  # of the guess left + up - corner
    paeth = np.where((to_left <= to_up) & (to_left <= to_corner), left, np.where(to_up <= to_corner, up, corner))
    options = np.stack((rows, rows - left, rows - up, rows - ((a + b) >> 1).astype(np.uint8), rows - paeth))
    size = np.minimum(options, -options)  # the absolute value of a signed byte
    best = size.sum(axis=2, dtype=np.uint32).argmin(axis=0)
    out = np.empty((len(rows), rows.shape[1] + 1), np.uint8)
    out[:, 0] = best
    out[:, 1:] = options[best, np.arange(len(rows))]
    return out


def png(rgba: np.ndarray, level: int = 3) -> bytes:
    h, w = rgba.shape[:2]
    rows = rgba.reshape(h, w * 4)
    squeeze = zlib.compressobj(level)
    parts = []
    band = max(1, BAND_BYTES // (4 * w))
    for y in range(0, h, band):  # the row above a band is filtered with it, and its result dropped
        parts.append(squeeze.compress(png_filter(rows[max(0, y - 1) : y + band])[min(y, 1) :]))
    data = b"".join([*parts, squeeze.flush()])
    body = b"".join(_png_chunk(b"IDAT", data[i : i + IDAT_BYTES]) for i in range(0, len(data), IDAT_BYTES))
    return b"\x89PNG\r\n\x1a\n" + _png_chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)) + body + _png_chunk(b"IEND", b"")


def bmp(rgba: np.ndarray) -> bytes:
    """24 bits, bottom row first, rows padded to four bytes; alpha is dropped."""
    h, w = rgba.shape[:2]
    rows = np.zeros((h, -(-w * 3 // 4) * 4), np.uint8)
    rows[:, : w * 3] = rgba[::-1, :, 2::-1].reshape(h, w * 3)
    head = struct.pack("<2sIHHI", b"BM", 54 + rows.size, 0, 0, 54)
    return head + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, rows.size, 2835, 2835, 0, 0) + rows.tobytes()


def tiff(rgba: np.ndarray) -> bytes:
    """Classic little-endian TIFF of one uncompressed RGBA strip."""
    h, w = rgba.shape[:2]
    n_tags, at = 14, 8
    bits_at = at + 2 + n_tags * 12 + 4
    x_at, y_at, data_at = bits_at + 8, bits_at + 16, bits_at + 24
    tags = [
        (256, 4, 1, w),
        (257, 4, 1, h),
        (258, 3, 4, bits_at),
        (259, 3, 1, 1),
        (262, 3, 1, 2),
        (273, 4, 1, data_at),
        (277, 3, 1, 4),
        (278, 4, 1, h),
        (279, 4, 1, w * h * 4),
        (282, 5, 1, x_at),
        (283, 5, 1, y_at),
        (284, 3, 1, 1),
        (296, 3, 1, 2),
        (338, 3, 1, 2),
    ]
    ifd = struct.pack("<H", n_tags) + b"".join(struct.pack("<HHII", *t) for t in tags) + struct.pack("<I", 0)
    return struct.pack("<2sHI", b"II", 42, at) + ifd + struct.pack("<4H", 8, 8, 8, 8) + struct.pack("<4I", 72, 1, 72, 1) + rgba.tobytes()
