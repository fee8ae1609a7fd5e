"""Rasters as uint8 arrays (height, width, 4): decoding tiles, resizing, halving and encoding."""

from __future__ import annotations

import numpy as np

from tesserae.codecs import flat, jpeg, jpeg2000, strips
from tesserae.errors import SlideError, SlideFormatError, TileReadError, UnsupportedCompressionError
from tesserae.functions.adjust import Adjustments

JPEG, JP2K = 7, 33005
FORMATS = ("png", "jpeg", "bmp", "tiff", "webp")


def tile_jpeg(data: bytes, tables: bytes | None, photometric: int) -> bytes:
    """A tile's JPEG stream on its own: shared tables spliced in, and marked where it holds RGB."""
    out = jpeg.splice_tables(tables, data)
    return jpeg.mark_rgb(out) if photometric == 2 else out


def decode_tile(data: bytes, compression: int, photometric: int = -1, tables: bytes | None = None, reduction: int = 0) -> np.ndarray:
    """A tile at 1 / 2**reduction of its size; JPEG 2000 without enough resolutions is decoded whole and averaged."""
    if compression == JP2K:
        try:
            samples = jpeg2000.decode(data, reduction)
        except SlideFormatError:
            if not reduction:
                raise
            whole = strips.to_rgba(jpeg2000.decode(data))
            return shrink(whole, reduction)
        return strips.to_rgba(samples)
    if compression == JPEG:
        return shrink(jpeg.decode_rgba(tile_jpeg(data, tables, photometric)), reduction)
    raise UnsupportedCompressionError(compression)


def shrink(rgba: np.ndarray, reduction: int) -> np.ndarray:
    if not reduction:
        return rgba
    h, w = ((n + (1 << reduction) - 1) >> reduction for n in rgba.shape[:2])
    return resize(rgba, w, h)


def resize(rgba: np.ndarray, width: int, height: int) -> np.ndarray:
    """Mean of each footprint when shrinking, the nearest place when enlarging."""
    h, w = rgba.shape[:2]
    if min(width, height, w, h) <= 0:
        raise ValueError(f"cannot resize {w} x {h} to {width} x {height}")

    def spans(n: int, new: int) -> tuple[np.ndarray, np.ndarray]:
        o = np.arange(new)
        start = np.minimum(np.floor(o * (n / new)).astype(np.int64), n - 1)
        return start, np.maximum(start + 1, np.minimum(np.floor((o + 1) * (n / new)).astype(np.int64), n))

    sums = np.zeros((h + 1, w + 1, rgba.shape[2]), np.int64)
    sums[1:, 1:] = rgba.cumsum(axis=0, dtype=np.int64).cumsum(axis=1)
    (x0, x1), (y0, y1) = spans(w, width), spans(h, height)
    total = sums[y1][:, x1] - sums[y0][:, x1] - sums[y1][:, x0] + sums[y0][:, x0]
    count = ((y1 - y0)[:, None] * (x1 - x0)[None, :])[..., None]
    return ((total + count // 2) // count).astype(np.uint8)


def halve(rgba: np.ndarray) -> np.ndarray:
    """The mean of the one to four pixels under each, half up."""
    h, w = rgba.shape[:2]
    padded = np.zeros((h + (h & 1), w + (w & 1), rgba.shape[2]), np.int64)
    padded[:h, :w] = rgba
    count = np.zeros(padded.shape[:2] + (1,), np.int64)
    count[:h, :w] = 1
    four = lambda a: a[0::2, 0::2] + a[1::2, 0::2] + a[0::2, 1::2] + a[1::2, 1::2]
    s, n = four(padded), four(count)
    return ((2 * s + n) // (2 * n)).astype(np.uint8)


def paste(target: np.ndarray, image: np.ndarray, x: int, y: int) -> None:
    """Copies image to (x, y), cut to the target."""
    h, w = target.shape[:2]
    x0, y0, x1, y1 = max(0, x), max(0, y), min(w, x + image.shape[1]), min(h, y + image.shape[0])
    if x1 > x0 and y1 > y0:
        target[y0:y1, x0:x1] = image[y0 - y : y1 - y, x0 - x : x1 - x]


def encode_image(rgba: np.ndarray, kind: str, quality: int = 92, adjustments: Adjustments = Adjustments()) -> bytes:
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind}")
    if kind == "jpeg" and not 1 <= quality <= 100:
        raise ValueError("a JPEG quality lies from 1 to 100")
    rgba = adjustments.apply(rgba)
    if kind == "jpeg":
        return jpeg.encode(rgba, quality)
    if kind == "webp":
        from tesserae.codecs.webp import webp

        return webp(rgba)
    return getattr(flat, kind)(rgba)


def encode_tile(rgba: np.ndarray, compression: int, tile: int, quality: int, ratio: float) -> bytes:
    """A JPEG tile at its true size, or a JPEG 2000 tile padded with black to the whole tile."""
    if compression == JPEG:
        return jpeg.encode(rgba, quality)
    full = np.zeros((tile, tile, 3), np.uint8)
    full[: rgba.shape[0], : rgba.shape[1]] = rgba[..., :3]
    return jpeg2000.encode(full, ratio)


def stack_strips(parts: list[tuple[int, int, bytes | None]], width: int, height: int, compression: int, samples: int, predictor: int, tables: bytes | None, photometric: int) -> np.ndarray:
    """An associated image of strips (first row, rows, data).

    A JPEG strip that cannot be read leaves its rows blank, unless none can; another is an error.
    """
    out, read = np.zeros((height, width, 4), np.uint8), 0
    for row, rows, data in parts:
        if compression == JPEG:
            try:
                if not data:
                    continue
                image = jpeg.decode_rgba(tile_jpeg(data, tables, photometric))
            except (SlideError, IndexError, KeyError, ValueError):
                continue
        else:
            image = strips.strip_rgba(data or b"", compression, width, rows, samples, predictor)
        paste(out, image, 0, row)
        read += 1
    if not read:
        raise TileReadError("no strip of the image can be decoded")
    return out
