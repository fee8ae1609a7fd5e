"""Tier 1: bit planes of a code block in three passes each."""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

import numpy as np

from tesserae.codecs.jpeg2000.arith import RUN, UNIFORM, MqDecoder, MqEncoder, RawBits, fresh_contexts

LL, HL, LH, HH = 0, 1, 2, 3
BYPASS, RESET, TERMALL, CAUSAL, PREDICTABLE, SEGMARK = 1, 2, 4, 8, 16, 32


def _zero_context(band: int, h: int, v: int, d: int) -> int:
    """Context of a coefficient that is not significant, by its significant neighbours."""
    if band == HH:
        hv = h + v
        if d >= 3:
            return 8
        if d == 2:
            return 7 if hv else 6
        if d == 1:
            return 5 if hv >= 2 else 3 + hv
        return min(hv, 2)
    if band == HL:
        h, v = v, h
    if h == 2:
        return 8
    if h == 1:
        return 7 if v else 6 if d else 5
    if v:
        return 2 + v
    return min(d, 2)


#: Context by band, and 15 h + 5 v + d.
ZERO = [[_zero_context(b, k // 15, k // 5 % 3, k % 5) for k in range(45)] for b in range(4)]


def _sign_context(h: int, v: int) -> tuple[int, int]:
    """(context, flip) for the signs of the neighbours, each from -1 to 1."""
    flip = h < 0 or (h == 0 and v < 0)
    if flip:
        h, v = -h, -v
    return (12 + v if h else 9 + v), int(flip)


def _clamped_sign_context(h: int, v: int) -> tuple[int, int]:
    return _sign_context((h > 0) - (h < 0), (v > 0) - (v < 0))


#: By 5 (h + 2) + v + 2, of the summed signs of two neighbours each.
SIGN = [_clamped_sign_context(k // 5 - 2, k % 5 - 2) for k in range(25)]


@lru_cache(maxsize=64)
def _orders(width: int, height: int) -> tuple[list[int], list[tuple[int, int]]]:
    """Places in the order of a pass (stripes of four rows, column by column), and (place, rows) of the columns."""
    stride, order, columns = width + 2, [], []
    for y0 in range(0, height, 4):
        rows = min(4, height - y0)
        for x in range(width):
            first = (y0 + 1) * stride + x + 1
            columns.append((first, rows))
            order += [first + j * stride for j in range(rows)]
    return order, columns


class _Block:
    """State of a code block with a border of one; place = (y + 1) * stride + x + 1.

    Sums over significant neighbours are kept up to date as coefficients become significant,
    which is rare, so that passes only look them up.
    """

    def __init__(self, width: int, height: int, band: int, causal: bool):
        self.w, self.h, self.stride = width, height, width + 2
        n = self.stride * (height + 2)
        self.significant = [0] * n
        self.sign = [0] * n  # 1 or -1 of significant coefficients
        self.magnitude = [0] * n
        self.visited = [0] * n
        self.refined = [0] * n
        self.near = [0] * n  # 15 h + 5 v + d
        self.signs = [12] * n  # 5 (h + 2) + v + 2
        self.zero = ZERO[band]
        self.causal = causal
        self.order, self.columns = _orders(width, height)

    def grow(self, i: int, negative: int) -> None:
        """Coefficient i becomes significant."""
        near, signs, s = self.near, self.signs, self.stride
        sign = -1 if negative else 1
        self.significant[i], self.sign[i] = 1, sign
        near[i - 1] += 15
        near[i + 1] += 15
        signs[i - 1] += 5 * sign
        signs[i + 1] += 5 * sign
        near[i + s] += 5
        signs[i + s] += sign
        near[i + s - 1] += 1
        near[i + s + 1] += 1
        if not (self.causal and (i // s - 1) % 4 == 0):  # a stripe does not look into the next one
            near[i - s] += 5
            signs[i - s] += sign
            near[i - s - 1] += 1
            near[i - s + 1] += 1


class _Decoder(_Block):
    def run(self, segments: list[tuple[bytes, int]], planes: int, style: int) -> None:
        """segments: (bytes, passes) of each codeword segment; planes: bit planes that the block has.

        Magnitudes get twice their value with half a step added, so that a truncated block
        decodes to the middle of its intervals.
        """
        contexts = fresh_contexts()
        kind, plane = 2, planes - 1
        done = 0
        for data, passes in segments:
            raw = bool(style & BYPASS) and done >= 10 and kind < 2
            coder = RawBits(data) if raw else MqDecoder(data)
            for _ in range(passes):
                if plane < 0:
                    return
                self.one = 2 << plane
                if kind == 0:
                    self.propagate(coder, contexts, raw)
                elif kind == 1:
                    self.refine(coder, contexts, raw)
                else:
                    self.clean(coder, contexts, style)
                if style & RESET:
                    contexts = fresh_contexts()
                done += 1
                kind += 1
                if kind == 3:
                    kind, plane = 0, plane - 1

    def found(self, i: int, coder, contexts, raw: bool) -> None:
        if raw:
            negative = coder.bit()
        else:
            c, flip = SIGN[self.signs[i]]
            negative = coder.bit(contexts, c) ^ flip
        self.grow(i, negative)
        self.magnitude[i] = self.one + (self.one >> 1)

    def propagate(self, coder, contexts, raw: bool) -> None:
        g, near, zero, visited, bit = self.significant, self.near, self.zero, self.visited, coder.bit
        for i in self.order:
            if near[i] and not g[i]:
                visited[i] = 1
                if bit() if raw else bit(contexts, zero[near[i]]):
                    self.found(i, coder, contexts, raw)

    def refine(self, coder, contexts, raw: bool) -> None:
        g, near, visited, refined, magnitude, bit = self.significant, self.near, self.visited, self.refined, self.magnitude, coder.bit
        half = self.one >> 1
        for i in self.order:
            if g[i] and not visited[i]:
                b = bit() if raw else bit(contexts, 16 if refined[i] else 15 if near[i] else 14)
                refined[i] = 1
                magnitude[i] += half if b else -half

    def clean(self, coder, contexts, style: int) -> None:
        g, near, zero, s, visited, bit = self.significant, self.near, self.zero, self.stride, self.visited, coder.bit
        for first, rows in self.columns:
            i, end = first, first + rows * s
            if rows == 4 and not (near[i] or near[i + s] or near[i + 2 * s] or near[i + 3 * s] or g[i] or g[i + s] or g[i + 2 * s] or g[i + 3 * s]):
                if not bit(contexts, RUN):
                    continue
                i += (bit(contexts, UNIFORM) << 1 | bit(contexts, UNIFORM)) * s
                self.found(i, coder, contexts, False)
                i += s
            while i < end:
                if not g[i] and not visited[i] and bit(contexts, zero[near[i]]):
                    self.found(i, coder, contexts, False)
                i += s
        self.visited = [0] * len(g)
        if style & SEGMARK:
            for _ in range(4):
                bit(contexts, UNIFORM)


def decode_block(segments: list[tuple[bytes, int]], width: int, height: int, band: int, planes: int, style: int) -> np.ndarray:
    """Signed doubled coefficients (height, width)."""
    if width == height == 1:
        return _decoded_single(tuple(segments), band, planes, style)
    return _decoded(segments, width, height, band, planes, style)


def _decoded(segments: Sequence[tuple[bytes, int]], width: int, height: int, band: int, planes: int, style: int) -> np.ndarray:
    b = _Decoder(width, height, band, bool(style & CAUSAL))
    b.run(segments, planes, style)
    signed = np.array(b.magnitude, np.int64) * np.array(b.sign, np.int64)
    return signed.reshape(height + 2, width + 2)[1:-1, 1:-1]


@lru_cache(maxsize=4096)
def _decoded_single(segments: tuple[tuple[bytes, int], ...], band: int, planes: int, style: int) -> np.ndarray:
    """The coarsest bands of small tiles have one coefficient, of few values."""
    return _decoded(segments, 1, 1, band, planes, style)


class _Encoder(_Block):
    def run(self, values: np.ndarray) -> tuple[int, bytes, list[int], list[float]]:
        padded = np.zeros((self.h + 2, self.stride), np.int64)
        padded[1:-1, 1:-1] = values
        self.values = padded.reshape(-1).tolist()
        self.target = list(map(abs, self.values))
        planes = max(self.target).bit_length()
        if not planes:
            return 0, b"", [], []
        coder, contexts = MqEncoder(), fresh_contexts()
        lengths, gains = [], []
        for p in range(planes - 1, -1, -1):
            self.p = p
            for kind in (0, 1, 2) if p < planes - 1 else (2,):
                self.gain = 0.0
                (self.propagate, self.refine, self.clean)[kind](coder, contexts)
                lengths.append(coder.upper_length())
                gains.append(self.gain)
        data = coder.flush()
        return planes, data, [min(n, len(data)) for n in lengths[:-1]] + [len(data)], gains

    def gained(self, i: int, before: float) -> None:
        """Squared error that the bit took away; a coefficient decodes to the middle of its interval."""
        m, p = self.target[i], self.p
        after = ((m >> p) + 0.5) * (1 << p) if p else m
        self.gain += (m - before) ** 2 - (m - after) ** 2

    def found(self, i: int, coder, contexts) -> None:
        c, flip = SIGN[self.signs[i]]
        negative = int(self.values[i] < 0)
        coder.bit(contexts, c, negative ^ flip)
        self.grow(i, negative)
        self.gained(i, 0.0)

    def propagate(self, coder, contexts) -> None:
        g, near, zero, visited, target, p, bit = self.significant, self.near, self.zero, self.visited, self.target, self.p, coder.bit
        for i in self.order:
            if near[i] and not g[i]:
                visited[i] = 1
                b = target[i] >> p & 1
                bit(contexts, zero[near[i]], b)
                if b:
                    self.found(i, coder, contexts)

    def refine(self, coder, contexts) -> None:
        g, near, visited, refined, target, p, bit = self.significant, self.near, self.visited, self.refined, self.target, self.p, coder.bit
        for i in self.order:
            if g[i] and not visited[i]:
                bit(contexts, 16 if refined[i] else 15 if near[i] else 14, target[i] >> p & 1)
                refined[i] = 1
                self.gained(i, ((target[i] >> p + 1) + 0.5) * (2 << p))

    def clean(self, coder, contexts) -> None:
        g, near, zero, s, visited, target, p, bit = self.significant, self.near, self.zero, self.stride, self.visited, self.target, self.p, coder.bit
        for first, rows in self.columns:
            i, end = first, first + rows * s
            if rows == 4 and not (near[i] or near[i + s] or near[i + 2 * s] or near[i + 3 * s] or g[i] or g[i + s] or g[i + 2 * s] or g[i + 3 * s]):
                k = next((j for j in range(4) if target[i + j * s] >> p & 1), 4)
                bit(contexts, RUN, int(k < 4))
                if k == 4:
                    continue
                bit(contexts, UNIFORM, k >> 1)
                bit(contexts, UNIFORM, k & 1)
                i += k * s
                self.found(i, coder, contexts)
                i += s
            while i < end:
                if not g[i] and not visited[i]:
                    b = target[i] >> p & 1
                    bit(contexts, zero[near[i]], b)
                    if b:
                        self.found(i, coder, contexts)
                i += s
        self.visited = [0] * len(g)


def encode_block(values: np.ndarray, band: int) -> tuple[int, bytes, list[int], list[float]]:
    """(bit planes, bytes, bytes after each pass, squared error taken away by each pass)."""
    h, w = values.shape
    if not values.any():
        return 0, b"", [], []
    return _encoded_single(int(values[0, 0]), band) if w == h == 1 else _Encoder(w, h, band, False).run(values)


@lru_cache(maxsize=4096)
def _encoded_single(value: int, band: int) -> tuple[int, bytes, list[int], list[float]]:
    return _Encoder(1, 1, band, False).run(np.array([[value]]))
