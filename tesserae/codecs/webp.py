"""WebP lossless (VP8L): subtract green, spatial predictors per 16 x 16 block, copies and prefix codes."""

from __future__ import annotations

import heapq
import struct

import numpy as np

BLOCK_BITS = 4
#: Predictors that are tried: left, top, mean of both, select, clamped sums.
MODES = (1, 2, 7, 11, 12, 13)
MAX_SIDE = 16383
LEAST_COPY, MOST_COPY = 4, 4096


class Bits:
    """Least significant bit first."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.sizes: list[int] = []

    def put(self, value: int, size: int) -> None:
        if size:
            self.values.append(value)
            self.sizes.append(size)

    def bytes(self) -> bytes:
        sizes = np.array(self.sizes, np.int64)
        total = int(sizes.sum())
        shift = np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        bits = (np.repeat(np.array(self.values, np.int64), sizes) >> shift & 1).astype(np.uint8)
        return np.packbits(bits, bitorder="little").tobytes()


def code_lengths(counts: list[int], most: int) -> list[int]:
    """Huffman code lengths up to most; rare symbols are raised until the tree is low enough."""
    counts = list(counts)
    used = [i for i, c in enumerate(counts) if c]
    out = [0] * len(counts)
    if len(used) < 2:
        for i in used:
            out[i] = 1
        return out
    floor = 1
    while True:
        heap = [(max(floor, counts[i]), i, (i,)) for i in used]
        heapq.heapify(heap)
        depth = dict.fromkeys(used, 0)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            for i in a[2] + b[2]:
                depth[i] += 1
            heapq.heappush(heap, (a[0] + b[0], min(a[1], b[1]), a[2] + b[2]))
        if max(depth.values()) <= most:
            for i, d in depth.items():
                out[i] = d
            return out
        floor *= 2


def canonical(lengths: list[int]) -> list[int]:
    """Codes with their bits reversed, as they are written."""
    code, out = 0, [0] * len(lengths)
    for n in range(1, max(lengths, default=0) + 1):
        for i, v in enumerate(lengths):
            if v == n:
                out[i] = int(f"{code:0{n}b}"[::-1], 2)
                code += 1
        code <<= 1
    return out


class Code:
    """A prefix code: written once, then used."""

    # Order in which the lengths of the code-length code are written.
    ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)

    def __init__(self, counts: list[int]):
        self.used = [i for i, c in enumerate(counts) if c]
        self.lengths = code_lengths(counts, 15)
        self.codes = canonical(self.lengths)

    def write(self, out: Bits) -> None:
        if len(self.used) <= 2 and all(i < 256 for i in self.used):
            symbols = self.used or [0]
            out.put(1, 1)
            out.put(len(symbols) - 1, 1)
            wide = int(symbols[0] > 1)
            out.put(wide, 1)
            out.put(symbols[0], 8 if wide else 1)
            if len(symbols) == 2:
                out.put(symbols[1], 8)
            if len(symbols) == 1:
                self.lengths = [0] * len(self.lengths)  # takes no bits
            return
        runs = self._runs()
        counts = [0] * 19
        for s, _, _ in runs:
            counts[s] += 1
        lengths = code_lengths(counts, 7)
        codes = canonical(lengths)
        n = max(4, 1 + max(i for i, s in enumerate(self.ORDER) if lengths[s]))
        out.put(0, 1)
        out.put(n - 4, 4)
        for s in self.ORDER[:n]:
            out.put(lengths[s], 3)
        out.put(0, 1)  # all symbols have a length
        single = sum(c > 0 for c in counts) == 1
        for s, extra, bits in runs:
            if not single:
                out.put(codes[s], lengths[s])
            out.put(extra, bits)
        if len(self.used) == 1:
            self.lengths = [0] * len(self.lengths)

    def _runs(self) -> list[tuple[int, int, int]]:
        """(symbol, extra, bits): lengths, 16 repeats the last one, 17 and 18 are zeros."""
        out, i, last = [], 0, 8
        while i < len(self.lengths):
            v, n = self.lengths[i], 1
            while i + n < len(self.lengths) and self.lengths[i + n] == v:
                n += 1
            i += n
            if v == 0:
                while n >= 3:
                    k = min(n, 138)
                    out.append((17, k - 3, 3) if k <= 10 else (18, k - 11, 7))
                    n -= k
                out += [(0, 0, 0)] * n
                continue
            if v != last:
                out.append((v, 0, 0))
                n, last = n - 1, v
            while n >= 3:
                k = min(n, 6)
                out.append((16, k - 3, 2))
                n -= k
            out += [(v, 0, 0)] * n
        return out

    def put(self, out: Bits, symbol: int) -> None:
        out.put(self.codes[symbol], self.lengths[symbol])


def prefix_value(v: int) -> tuple[int, int, int]:
    """(symbol, extra, bits) of a length or distance from 1."""
    if v <= 4:
        return v - 1, 0, 0
    v -= 1
    top = v.bit_length() - 1
    second = v >> (top - 1) & 1
    return 2 * top + second, v & ((1 << top - 1) - 1), top - 1


def predictions(argb: np.ndarray) -> dict[int, np.ndarray]:
    """Of each mode, the prediction of every pixel (int16, not of the first row and column)."""
    a = argb.astype(np.int16)
    left, top, corner = np.zeros_like(a), np.zeros_like(a), np.zeros_like(a)
    left[:, 1:], top[1:], corner[1:, 1:] = a[:, :-1], a[:-1], a[:-1, :-1]
    mean = (left + top) >> 1
    to_left = np.abs(top - corner).sum(axis=2, keepdims=True)
    to_top = np.abs(left - corner).sum(axis=2, keepdims=True)
    half = mean + np.trunc((mean - corner) / 2).astype(np.int16)
    return {
        1: left,
        2: top,
        7: mean,
        11: np.where(to_left < to_top, left, top),
        12: np.clip(left + top - corner, 0, 255),
        13: np.clip(half, 0, 255),
    }


def residuals(argb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Predictor residuals, and the mode of each block: the least sum of absolute residuals."""
    h, w = argb.shape[:2]
    size = 1 << BLOCK_BITS
    by, bx = -(-h // size), -(-w // size)
    each = {m: (argb.astype(np.int16) - p).astype(np.uint8) for m, p in predictions(argb).items()}
    costs = []
    for m in MODES:
        cost = np.zeros((by * size, bx * size), np.int64)
        cost[:h, :w] = np.abs(each[m].view(np.int8).astype(np.int64)).sum(axis=2)
        costs.append(cost.reshape(by, size, bx, size).sum(axis=(1, 3)))
    mode = np.array(MODES)[np.argmin(costs, axis=0)]
    wide = np.repeat(np.repeat(mode, size, axis=0), size, axis=1)[:h, :w, None]
    out = np.zeros_like(argb)
    for m in MODES:
        out = np.where(wide == m, each[m], out)
    # fixed predictions: the first row from the left, the first column from above, the first pixel black
    out[0, 1:] = argb[0, 1:] - argb[0, :-1]
    out[1:, 0] = argb[1:, 0] - argb[:-1, 0]
    out[0, 0] = argb[0, 0] - np.array([255, 0, 0, 0], np.uint8)
    return out, mode


def tokens(argb: np.ndarray) -> list[tuple]:
    """('p', pixel) or ('c', length, distance code): copies of the pixel to the left or above."""
    h, w = argb.shape[:2]
    flat = argb.reshape(-1, 4)
    n = len(flat)
    packed = flat.astype(np.uint32) @ np.array([1 << 24, 1 << 16, 1 << 8, 1], np.uint32)
    same_left = np.concatenate(([False], packed[1:] == packed[:-1]))
    same_top = np.concatenate((np.zeros(min(w, n), bool), packed[w:] == packed[:-w] if n > w else np.zeros(0, bool)))

    def run_ends(same: np.ndarray) -> np.ndarray:
        """Of each place, where its run of True ends."""
        stop = np.where(same, n, np.arange(n))
        return np.minimum.accumulate(stop[::-1])[::-1]

    left, top = run_ends(same_left), run_ends(same_top)
    pixels, out, i = flat.tolist(), [], 0
    left, top = left.tolist(), top.tolist()
    while i < n:
        a, b = min(left[i] - i, MOST_COPY), min(top[i] - i, MOST_COPY)
        if max(a, b) >= LEAST_COPY:
            out.append(("c", max(a, b), 2 if a >= b else 1))
            i += max(a, b)
        else:
            out.append(("p", pixels[i]))
            i += 1
    return out


def write_image(out: Bits, argb: np.ndarray, top: bool) -> None:
    """An entropy-coded image; the main one (top) says that it has no meta codes."""
    out.put(0, 1)  # no colour cache
    if top:
        out.put(0, 1)
    counts = [[0] * n for n in (280, 256, 256, 256, 40)]
    some = tokens(argb)
    for t in some:
        if t[0] == "p":
            a, r, g, b = t[1]
            for code, v in zip(counts, (g, r, b, a)):
                code[v] += 1
        else:
            counts[0][256 + prefix_value(t[1])[0]] += 1
            counts[4][prefix_value(t[2])[0]] += 1
    codes = [Code(c) for c in counts]
    for c in codes:
        c.write(out)
    for t in some:
        if t[0] == "p":
            a, r, g, b = t[1]
            for code, v in zip(codes, (g, r, b, a)):
                code.put(out, v)
        else:
            for code, base, v in ((codes[0], 256, t[1]), (codes[4], 0, t[2])):
                symbol, extra, bits = prefix_value(v)
                code.put(out, base + symbol)
                out.put(extra, bits)


def webp(rgba: np.ndarray) -> bytes:
    h, w = rgba.shape[:2]
    if not 0 < max(w, h) <= MAX_SIDE or not min(w, h):
        raise ValueError(f"WebP cannot hold {w} x {h} pixels")
    argb = rgba[..., [3, 0, 1, 2]].copy()
    argb[..., 1] -= argb[..., 2]
    argb[..., 3] -= argb[..., 2]
    rest, modes = residuals(argb)
    out = Bits()
    out.put(0x2F, 8)
    out.put(w - 1, 14)
    out.put(h - 1, 14)
    out.put(int((rgba[..., 3] != 255).any()), 1)
    out.put(0, 3)
    out.put(1, 1)
    out.put(2, 2)  # subtract green
    out.put(1, 1)
    out.put(0, 2)  # predictor
    out.put(BLOCK_BITS - 2, 3)
    table = np.zeros((*modes.shape, 4), np.uint8)
    table[..., 0], table[..., 2] = 255, modes
    write_image(out, table, False)
    out.put(0, 1)
    write_image(out, rest, True)
    body = out.bytes()
    chunk = b"VP8L" + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)
    return b"RIFF" + struct.pack("<I", 4 + len(chunk)) + b"WEBP" + chunk
