"""TIFF strip codecs: PackBits, LZW, Deflate, the horizontal predictor, and RGBA rasters."""

from __future__ import annotations

import zlib

import numpy as np

from tesserae.errors import SlideFormatError, UnsupportedCompressionError


def unpack_bits(data: bytes, expected: int) -> bytes:
    """Runs of literals (0 to 127) and repeats (129 to 255); 128 is skipped."""
    out, i = bytearray(), 0
    while i < len(data) and len(out) < expected:
        n = data[i]
        i += 1
        if n < 128:
            out += data[i : i + n + 1]
            i += n + 1
        elif n > 128:
            if i >= len(data):
                break
            out += data[i : i + 1] * (257 - n)
            i += 1
    return _sized(bytes(out), expected)


def pack_bits(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        run = 1
        while run < 128 and i + run < len(data) and data[i + run] == data[i]:
            run += 1
        if run > 1:
            out += bytes((257 - run, data[i]))
            i += run
            continue
        j = i + 1
        while j < len(data) and j - i < 128 and (j + 1 >= len(data) or data[j] != data[j + 1]):
            j += 1
        out += bytes((j - i - 1,)) + data[i:j]
        i = j
    return bytes(out)


def lzw_decode(data: bytes, expected: int) -> bytes:
    """MSB-first codes of 9 to 12 bits that widen one code early; 256 clears, 257 ends."""
    base = [bytes((i,)) for i in range(256)] + [b"", b""]
    table, out, size = list(base), [], 0
    bits = n_bits = at = 0
    width, last = 9, None
    while size < expected:
        while n_bits < width:
            if at >= len(data):
                raise SlideFormatError("LZW data end early")
            bits = bits << 8 | data[at]
            at += 1
            n_bits += 8
        n_bits -= width
        code = bits >> n_bits
        bits &= (1 << n_bits) - 1
        if code == 257:
            break
        if code == 256:
            table, width, last = list(base), 9, None
            continue
        if last is None:
            if code > 255:
                raise SlideFormatError("LZW data begin with a string")
            word = table[code]
        else:
            if code > len(table):
                raise SlideFormatError(f"LZW code {code} is not in use")
            word = table[code] if code < len(table) else last + last[:1]
            if len(table) < 4096:
                table.append(last + word[:1])
        out.append(word)
        size += len(word)
        last = word
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return _sized(b"".join(out), expected)


def lzw_encode(data: bytes) -> bytes:
    table = {bytes((i,)): i for i in range(256)}
    acc, n_bits, width, out = 0, 0, 9, bytearray()

    def emit(code: int) -> None:
        nonlocal acc, n_bits
        acc = acc << width | code
        n_bits += width
        while n_bits >= 8:
            n_bits -= 8
            out.append(acc >> n_bits & 255)
        acc &= (1 << n_bits) - 1

    emit(256)
    word, free = b"", 258
    for b in data:
        longer = word + bytes((b,))
        if longer in table:
            word = longer
            continue
        emit(table[word])
        table[longer] = free
        free += 1
        if free == 4094:
            emit(256)
            table, free, width = {bytes((i,)): i for i in range(256)}, 258, 9
        elif free in (512, 1024, 2048):
            width += 1
        word = bytes((b,))
    if word:
        emit(table[word])
        if free + 1 in (512, 1024, 2048):
            width += 1
    emit(257)
    if n_bits:
        out.append(acc << 8 - n_bits & 255)
    return bytes(out)


def _sized(data: bytes, expected: int) -> bytes:
    if len(data) < expected:
        raise SlideFormatError(f"{len(data)} of {expected} bytes")
    return data[:expected]


def decompress(data: bytes, compression: int, expected: int) -> bytes:
    if compression == 1:
        return _sized(data, expected)
    if compression == 5:
        return lzw_decode(data, expected)
    if compression in (8, 32946):
        try:
            return _sized(zlib.decompressobj().decompress(data), expected)
        except zlib.error as e:
            raise SlideFormatError(f"Deflate: {e}") from e
    if compression == 32773:
        return unpack_bits(data, expected)
    raise UnsupportedCompressionError(compression)


def undo_predictor(samples: np.ndarray) -> np.ndarray:
    """Rasters (height, width, channels) whose rows hold differences."""
    return np.cumsum(samples, axis=1, dtype=np.uint8)


def apply_predictor(samples: np.ndarray) -> np.ndarray:
    out = samples.copy()
    out[:, 1:] -= samples[:, :-1]
    return out


def to_rgba(samples: np.ndarray) -> np.ndarray:
    """(height, width, 3 or 4) with alpha 255 where there is none."""
    if samples.shape[2] == 4:
        return samples
    if samples.shape[2] != 3:
        raise SlideFormatError(f"{samples.shape[2]} samples a pixel")
    return np.dstack((samples, np.full(samples.shape[:2], 255, np.uint8)))


def strip_rgba(data: bytes, compression: int, width: int, rows: int, samples: int, predictor: int) -> np.ndarray:
    raw = np.frombuffer(decompress(data, compression, width * rows * samples), np.uint8).reshape(rows, width, samples)
    return to_rgba(undo_predictor(raw) if predictor == 2 else raw)
