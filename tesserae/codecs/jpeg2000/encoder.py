"""Codestream encoder: one tile, one layer, LRCP, 64 x 64 code blocks, no colour transform.

Lossless with the 5/3 wavelet; with a compression ratio, the 9/7 wavelet and truncation of the
code blocks at the slopes of their rate-distortion hulls that meet the size.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

from tesserae.codecs.jpeg2000 import wavelet
from tesserae.codecs.jpeg2000.arith import HeaderWriter, TagTree
from tesserae.codecs.jpeg2000.blocks import encode_block

BLOCK = 64
MAX_LEVELS = 5
GUARD = 2


@dataclass
class Block:
    planes: int
    data: bytes
    lengths: list[int]  # bytes after each pass
    gains: list[float]  # squared error in the image that each pass takes away
    passes: int = 0  # sent

    @property
    def size(self) -> int:
        return self.lengths[self.passes - 1] if self.passes else 0


@dataclass
class Band:
    kind: int
    level: int  # decompositions below the image
    exponent: int
    mantissa: int
    grid: list[list[Block]]


def n_levels(width: int, height: int) -> int:
    """Decompositions while both sides stay above one sample."""
    return min(MAX_LEVELS, max(0, min(width, height).bit_length() - 1))


@lru_cache(maxsize=64)
def synthesis_norm(kind: int, level: int, reversible: bool) -> float:
    """The image's norm of one unit in a band's coefficient, far from borders."""
    one = lambda high: _norm_1d(high, level, reversible)
    return one(bool(kind & 1)) * one(bool(kind >> 1))


@lru_cache(maxsize=64)
def _norm_1d(high: bool, level: int, reversible: bool) -> float:
    if level == 0:
        return 1.0
    n = 16
    a = np.zeros((n, 1))
    a[n // 2] = 1.0
    for k in range(level):
        out = np.zeros((2 * len(a), 1))
        out[1 if k == 0 and high else 0 :: 2] = a
        a = _lift(out, reversible)
    return float(np.sqrt((a**2).sum()))


def _lift(a: np.ndarray, reversible: bool) -> np.ndarray:
    """Synthesis in floats, also of the 5/3 wavelet, whose rounding has no norm."""
    if not reversible:
        return wavelet._synthesise(a, 0, False)
    e, o, at = wavelet._halves(a, 0)
    e[1:] -= (o[:-1] + o[1:]) / 4
    o[:-1] += (e[:-1] + e[1:]) / 2
    return wavelet._weave(e, o, at, len(a))


def step_of(kind: int, level: int) -> tuple[int, int]:
    """Exponent and mantissa of a step near 1 / 16 of the band's norm, for eight bits."""
    gain = (0, 1, 1, 2)[kind]
    step = 1 / 16 / synthesis_norm(kind, level, False)
    power = int(np.floor(np.log2(step)))
    mantissa = int((step / 2.0**power - 1) * 2048)
    return 8 + gain - power, mantissa


def encode_component(plane: np.ndarray, levels: int, reversible: bool) -> list[list[Band]]:
    """Bands by resolution, lowest first."""
    a = plane.astype(np.int64) - 128
    a = a if reversible else a.astype(np.float64)
    by_resolution: list[list[tuple[int, int, np.ndarray]]] = []
    for level in range(1, levels + 1):
        a, hl, lh, hh = wavelet.forward(a, reversible)
        by_resolution.insert(0, [(1, level, hl), (2, level, lh), (3, level, hh)])
    by_resolution.insert(0, [(0, levels, a)])
    out = []
    for group in by_resolution:
        bands = []
        for kind, level, c in group:
            if reversible:
                exponent, mantissa, step = 8 + (0, 1, 1, 2)[kind] + 1, 0, 1.0
                q = c
            else:
                exponent, mantissa = step_of(kind, level)
                step = 2.0 ** (8 + (0, 1, 1, 2)[kind] - exponent) * (1 + mantissa / 2048)
                q = np.sign(c) * np.floor(np.abs(c) / step)
            q = q.astype(np.int64)
            weight = (step * synthesis_norm(kind, level, reversible)) ** 2
            grid = []
            for y in range(0, q.shape[0], BLOCK):
                row = []
                for x in range(0, q.shape[1], BLOCK):
                    planes, data, lengths, gains = encode_block(q[y : y + BLOCK, x : x + BLOCK], kind)
                    row.append(Block(planes, data, lengths, [g * weight for g in gains], len(lengths)))
                grid.append(row)
            bands.append(Band(kind, level, exponent, mantissa, grid if q.size else []))
        out.append(bands)
    return out


def hull(b: Block) -> list[tuple[float, int]]:
    """(slope, passes) of the truncation points on the convex hull, steepest first."""
    points = [(0, 0.0, 0)]
    total = 0.0
    for i, (n, g) in enumerate(zip(b.lengths, b.gains), 1):
        total += g
        while points and total <= points[-1][1]:
            points.pop()
        points = points or [(0, 0.0, 0)]
        if n <= points[-1][0]:
            points[-1] = (n, total, i) if len(points) > 1 else points[-1]
            if len(points) == 1:
                continue
        else:
            points.append((n, total, i))
        while len(points) > 2:
            (n0, d0, _), (n1, d1, _), (n2, d2, _) = points[-3:]
            if (d1 - d0) * (n2 - n1) <= (d2 - d1) * (n1 - n0):
                points.pop(-2)
            else:
                break
    return [((d1 - d0) / (n1 - n0), i) for (n0, d0, _), (n1, d1, i) in zip(points, points[1:])]


def truncate(components: list[list[list[Band]]], budget: int) -> None:
    """Cuts code blocks to the common slope at which all packets fit the budget."""
    blocks = [b for c in components for r in c for band in r for row in band.grid for b in row if b.planes]
    hulls = [hull(b) for b in blocks]
    slopes = [s for h in hulls for s, _ in h]
    if not slopes:
        return

    def apply(limit: float) -> None:
        for b, h in zip(blocks, hulls):
            b.passes = max([0, *(i for s, i in h if s >= limit)])

    apply(0.0)
    if len(packets(components)) <= budget:
        return
    limits = [*sorted(set(slopes)), max(slopes) * 2]
    low, high = 0, len(limits) - 1  # too many bytes, and none
    while high - low > 1:
        mid = (low + high) // 2
        apply(limits[mid])
        if len(packets(components)) <= budget:
            high = mid
        else:
            low = mid
    apply(limits[high])


def packets(components: list[list[list[Band]]]) -> bytes:
    """All packets: resolution by resolution, component by component; those of equal planes are made once."""
    out = []
    for r in range(len(components[0])):
        made: dict[int, bytes] = {}
        for c in components:
            if id(c) not in made:
                made[id(c)] = packet(c[r]) if any(band.grid for band in c[r]) else b"\0"
            out.append(made[id(c)])
    return b"".join(out)


def packet(bands: list[Band]) -> bytes:
    h, body = HeaderWriter(), []
    h.bit(1)
    for band in bands:
        if not band.grid:
            continue
        rows, cols = len(band.grid), len(band.grid[0])
        flat = [b for row in band.grid for b in row]
        most = GUARD + band.exponent - 1
        inclusion, planes = TagTree(cols, rows), TagTree(cols, rows)
        inclusion.set([0 if b.passes else 1 for b in flat])
        planes.set([most - b.planes for b in flat])
        for i, b in enumerate(flat):
            x, y = i % cols, i // cols
            inclusion.write(h, x, y, 1)
            if not b.passes:
                continue
            planes.write(h, x, y, most - b.planes + 1)
            h.passes(b.passes)
            width = b.passes.bit_length() - 1
            more = max(0, b.size.bit_length() - 3 - width)
            for _ in range(more):
                h.bit(1)
            h.bit(0)
            h.bits(b.size, 3 + more + width)
            body.append(b.data[: b.size])
    return h.end() + b"".join(body)


def _marker(code: int, body: bytes) -> bytes:
    return struct.pack(">HH", code, len(body) + 2) + body


def encode(image: np.ndarray, ratio: float = 0.0) -> bytes:
    """A codestream of uint8 samples (height, width, components).

    ratio: uncompressed bytes over the codestream's, which does not exceed its share; 0 is lossless.
    """
    h, w, n = image.shape
    if not h or not w:
        raise ValueError("an empty image")
    reversible = ratio <= 0
    levels = n_levels(w, h)
    coded: dict[bytes, list[list[Band]]] = {}
    components = []
    for c in range(n):  # of grey images all planes are one
        plane = image[..., c].tobytes()
        if plane not in coded:
            coded[plane] = encode_component(image[..., c], levels, reversible)
        components.append(coded[plane])
    siz = struct.pack(">H8IH", 0, w, h, 0, 0, w, h, 0, 0, n) + b"\x07\x01\x01" * n
    cod = struct.pack(">BBHBBBBBB", 0, 0, 1, 0, levels, 4, 4, 0, int(reversible))
    bands = [b for r in components[0] for b in r]
    if reversible:
        qcd = bytes([GUARD << 5, *(b.exponent << 3 for b in bands)])
    else:
        qcd = bytes([GUARD << 5 | 2]) + b"".join(struct.pack(">H", b.exponent << 11 | b.mantissa) for b in bands)
    head = b"\xff\x4f" + _marker(0xFF51, siz) + _marker(0xFF52, cod) + _marker(0xFF5C, qcd)
    if not reversible:
        truncate(components, max(0, int(h * w * n / ratio) - len(head) - 16))
    body = packets(components)
    return head + _marker(0xFF90, struct.pack(">HIBB", 0, len(body) + 14, 0, 1)) + b"\xff\x93" + body + b"\xff\xd9"
