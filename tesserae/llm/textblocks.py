"""Vectorised views of text columns: byte blocks, words and polynomial hashes.

A block joins the UTF-8 bytes of several documents with line feeds, which no word spans, so
that one numpy pass serves many documents. What decides equality are residues of polynomials
over the field of 2**61 - 1 elements at fixed random points ("lanes"): two different strings of
n bytes agree in a lane for n of the 2**61 points at most, in both lanes for n * n of 2**122.
Grams that only choose places (anchors, features) are hashed modulo 2**64, which is cheaper.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
FIELD = (1 << 61) - 1
#: The points at which the lanes evaluate.
POINTS = (0x0B5297A4D3F1C68E, 0x15D4E8A36F09B27C)
#: Symbols whose terms are added up before they are reduced.
SEGMENT = 1 << 19
_TABLE = np.random.default_rng(20240229).integers(0, 1 << 64, 256, dtype=np.uint64)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
BLOCK = 1 << 18
#: Masks of the first bytes of a 64-bit integer.
_HEAD = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
_P, _LOW31, _LOW30 = np.uint64(FIELD), np.uint64((1 << 31) - 1), np.uint64((1 << 30) - 1)
_30, _31, _61, _1 = np.uint64(30), np.uint64(31), np.uint64(61), np.uint64(1)


@lru_cache(maxsize=4)
def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def powers_to(base: int, n: int) -> np.ndarray:
    return powers(base, at_least(n))[:n]


def at_least(n: int) -> int:
    """The next multiple of half a million: tables of powers grow with the longest text, not with the power of two above."""
    return max(1, -(-n >> 19)) << 19


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective)."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def values(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each row; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.binary()), b"").to_pylist()


@lru_cache(maxsize=1)
def _trimmer() -> Callable[[int], int] | None:
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def release() -> None:
    """Gives freed memory back to the system: workers live on, and what they keep counts beside the next stage."""
    pa.default_memory_pool().release_unused()
    if trim := _trimmer():
        trim(0)


def released(run: Callable, *args: object) -> object:
    """run(*args), for one group; what it freed goes back."""
    try:
        return run(*args)
    finally:
        release()


def releasing(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, over a task's batches; what it freed goes back at its end."""

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return inner


@dataclass
class Block:
    lo: int  # first row
    data: np.ndarray  # bytes, one line feed after each document
    starts: np.ndarray  # of each document
    ends: np.ndarray


def blocks(rows: list[bytes], size: int = BLOCK) -> Iterator[Block]:
    """Rows in blocks of about size bytes; a longer document is a block of its own."""
    lo = 0
    while lo < len(rows):
        hi, total = lo, 0
        while hi < len(rows) and (hi == lo or total + len(rows[hi]) <= size):
            total += len(rows[hi]) + 1
            hi += 1
        part = rows[lo:hi]
        data = np.frombuffer(b"\n".join(part) + b"\n", np.uint8)
        ends = np.cumsum(np.fromiter((len(x) + 1 for x in part), np.int64, len(part))) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        yield Block(lo, data, starts, ends)
        lo = hi


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products in the field, below FIELD; a below 2**63, b below 2**61."""
    a1, a0, b1, b0 = a >> _31, a & _LOW31, b >> _31, b & _LOW31
    mid = a1 * b0
    mid += a0 * b1
    out = a1 * b1
    out <<= _1
    out += mid >> _30
    out += (mid & _LOW30) << _31
    out += a0 * b0
    out = (out & _P) + (out >> _61)
    out -= np.where(out >= _P, _P, np.uint64(0))
    return out


@lru_cache(maxsize=4)
def field_powers(point: int) -> np.ndarray:
    """The first SEGMENT powers."""
    out = np.ones(SEGMENT, np.uint64)
    size = 1
    while size < SEGMENT:
        out[size : 2 * size] = times(out[: min(size, SEGMENT - size)], np.uint64(pow(point, size, FIELD)))
        size *= 2
    return out


def lane_prefix(data: np.ndarray, lane: int) -> np.ndarray:
    """p with p[j] - p[i] = sum of (data[k] + 1) * POINTS[lane]**k over i <= k < j, in the field.

    Segments take the same powers, times that of their first place.
    """
    out = np.zeros(len(data) + 1, np.uint64)
    powers_here = field_powers(POINTS[lane])
    carry = np.uint64(0)
    for lo in range(0, len(data), SEGMENT):
        hi = min(len(data), lo + SEGMENT)
        symbol = data[lo:hi].astype(np.uint64)
        symbol += _1
        top = np.cumsum(symbol * (powers_here[: hi - lo] >> _31), dtype=np.uint64)
        top = (top & _P) + (top >> _61)
        symbol *= powers_here[: hi - lo] & _LOW31
        part = np.cumsum(symbol, dtype=np.uint64, out=symbol)
        part = (part & _P) + (part >> _61) + (top >> _30) + ((top & _LOW30) << _31)  # top * 2**31
        part = times(part, np.uint64(pow(POINTS[lane], lo, FIELD))) if lo else part
        part += carry
        part = (part & _P) + (part >> _61)
        out[lo + 1 : hi + 1] = part
        carry = part[-1]
    return out


def lane_span(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray, lane: int) -> np.ndarray:
    """Mixed residues of the spans [starts, ends): a function of their bytes alone."""
    inverse = pow(POINTS[lane], -1, FIELD)
    # prefixes are below FIELD + 8
    out = prefix[ends] + _P + _P - prefix[starts]
    if len(prefix) <= SEGMENT:
        return mix(times(out, field_powers(inverse)[starts]))
    segments = np.array([pow(inverse, lo, FIELD) for lo in range(0, len(prefix), SEGMENT)], np.uint64)
    return mix(times(times(out, field_powers(inverse)[starts % SEGMENT]), segments[starts // SEGMENT]))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """h with h[j] - h[i] = sum of T[data[k]] * BASE**k over i <= k < j, modulo 2**64; for places and features."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * powers_to(BASE, len(data)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the spans [starts, ends), equal for equal contents."""
    return mix((prefix[ends] - prefix[starts]) * powers_to(INVERSE, len(prefix))[starts])


@dataclass
class Words:
    starts: np.ndarray  # in the block
    ends: np.ndarray
    bounds: np.ndarray  # words of document i: bounds[i] to bounds[i + 1]
    data: np.ndarray  # the words, each with one space after it
    at: np.ndarray  # where each word starts in data
    lanes: dict[int, np.ndarray] = field(default_factory=dict)

    def spans(self, first: np.ndarray, last: np.ndarray, lane: int = 0) -> np.ndarray:
        """Hashes of the word sequences [first, last), none of them empty: a function of the words alone."""
        if lane not in self.lanes:
            self.lanes[lane] = lane_prefix(self.data, lane)
        end = last - 1
        return lane_span(self.lanes[lane], self.at[first], self.at[end] + (self.ends[end] - self.starts[end]), lane)

    def each(self, lane: int = 0) -> np.ndarray:
        """A hash of every word."""
        every = np.arange(len(self.starts))
        return self.spans(every, every + 1, lane)

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """128 bits of every word: for words of eight bytes or fewer their bytes and their length, else both lanes."""
        size = self.ends - self.starts
        padded = np.concatenate((self.data, np.zeros(8, np.uint8)))
        heads = np.lib.stride_tricks.as_strided(padded[:8].view("<u8"), (len(self.data),), (1,))[self.at]
        h = mix(heads & _HEAD[np.minimum(size, 8)])
        check = size.astype(np.uint64)
        long = np.flatnonzero(size > 8)
        if len(long):
            ends = np.cumsum(size[long])
            starts = ends - size[long]
            data = self.data[np.repeat(self.at[long] - starts, size[long]) + np.arange(ends[-1])]
            h[long], check[long] = (lane_span(lane_prefix(data, k), starts, ends, k) for k in (0, 1))
        return h, check


def words(block: Block, fold: bool) -> Words:
    """Maximal runs of bytes other than space and 0x09 to 0x0D; fold lower-cases A to Z."""
    data = _FOLD[block.data] if fold else block.data
    gap = _SPACE[data]
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    if len(data) and not gap[0]:
        edge = np.concatenate(([0], edge))
    starts, ends = edge[::2], edge[1::2]  # the block ends with a line feed
    bounds = np.concatenate((np.searchsorted(starts, block.starts), [len(starts)]))
    kept = ~gap
    kept[1:] |= ~gap[:-1]
    data = np.where(gap, np.uint8(32), data)[kept]
    after = np.cumsum(ends - starts + 1)
    return Words(starts, ends, bounds, data, np.concatenate(([0], after[:-1])) if len(starts) else after)


def sequence_prefix(symbols: np.ndarray) -> np.ndarray:
    """Like prefix_hash, over 64-bit symbols; for places."""
    out = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum(mix(symbols) * powers_to(BASE, len(symbols)), out=out[1:])
    return out


def window_hash(prefix: np.ndarray, width: int) -> np.ndarray:
    """Hash of each window of width symbols (or bytes)."""
    n = len(prefix) - width
    if n <= 0:
        return np.zeros(0, np.uint64)
    return mix((prefix[width:] - prefix[:-width]) * powers_to(INVERSE, n))


def shingles(w: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes and the document of each: every run of width words, or all words of a shorter document."""
    counts = np.diff(w.bounds)
    doc = np.repeat(np.arange(len(counts)), counts)
    full = np.flatnonzero(doc[: max(0, len(doc) - width + 1)] == doc[width - 1 :])
    short = np.flatnonzero((counts > 0) & (counts < width))
    # a shorter sequence has fewer spaces than any shingle
    first = np.concatenate((full, w.bounds[short]))
    last = np.concatenate((full + width, w.bounds[short + 1]))
    return w.spans(first, last), np.concatenate((doc[full], short))


def distinct(hashes: np.ndarray, docs: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each document, and their bounds."""
    order = np.lexsort((hashes, docs))
    hashes, docs = hashes[order], docs[order]
    keep = np.ones(len(hashes), bool)
    keep[1:] = (hashes[1:] != hashes[:-1]) | (docs[1:] != docs[:-1])
    hashes, docs = hashes[keep], docs[keep]
    return hashes, np.searchsorted(docs, np.arange(n_docs + 1))


def rank_pairs(h: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of 128-bit keys (h, check): the first place of each distinct one, the number of each row's key, and their counts."""
    order = np.argsort(h)
    new = np.ones(len(h), bool)
    new[1:] = h[order][1:] != h[order][:-1]
    at = np.flatnonzero(new)
    number = np.empty(len(h), np.int64)
    number[order] = np.cumsum(new) - 1
    first = np.minimum.reduceat(order, at) if len(h) else order
    counts = np.diff(np.append(at, len(h)))
    if (check[first][number] == check).all():
        return first, number, counts
    order = np.lexsort((check, h))  # stable, so the first place leads
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (check[order][1:] != check[order][:-1])
    number = np.empty(len(h), np.int64)
    number[order] = np.cumsum(new) - 1
    return order[new], number, np.bincount(number)
