"""Suffix-array deduplication by threshold-bounded interval expansion.

A byte is removed when a string of `length` bytes that also starts earlier in the corpus covers
it. Candidate strings meet in buckets (see anchors); there a suffix array of the strings gives a
Burrows-Wheeler transform, and common prefixes are derived by breadth-first backward extension:
the intervals of all strings of l symbols are extended to the left by each symbol, and the right
boundary of each new interval, if it has no value yet, gets the common prefix l and is extended
in turn. The expansion stops at the minimum length; boundaries without a value then join equal
windows, of which the first place stays.

Null and empty texts lose nothing. Rows with the same doc_id count as documents in the order of
their text; rows without an id come last.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tesserae.llm.anchors import Chunk, Scheme, Strings, repeated

LENGTH = 100


#: Symbols (below 512) that one integer holds, so that prefixes double from there.
PACKED = 7


def ranks_of(keys: np.ndarray) -> np.ndarray:
    order = np.argsort(keys)
    new = np.ones(len(keys), bool)
    new[1:] = keys[order][1:] != keys[order][:-1]
    rank = np.empty(len(keys), np.int64)
    rank[order] = np.cumsum(new) - 1
    return rank


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes sorted by more than depth of their first symbols (0 to 511); ties by place."""
    n = len(text)
    padded = np.concatenate((text, np.zeros(PACKED, np.int64)))
    key = np.zeros(n, np.int64)
    for k in range(PACKED):
        key = key << 9 | padded[k : n + k]
    rank, step = ranks_of(key), PACKED
    while step <= depth:
        after = np.zeros(n, np.int64)
        after[:-step] = rank[step:] + 1
        rank = ranks_of(rank * (n + 1) + after)
        step *= 2
    return np.argsort(rank * n + np.arange(n))


def long_common_prefixes(text: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Of each suffix in order, whether it shares its first `length` symbols with the one before."""
    n = len(text)
    last = text[order - 1]  # the transform; the text is taken as a circle
    by_symbol = np.argsort(last.astype(np.int16), kind="stable")
    forward = np.empty(n, np.int64)  # place of the suffix one symbol longer
    forward[by_symbol] = np.arange(n)
    valued = np.zeros(n + 1, bool)
    valued[[0, n]] = True
    lo, hi = np.array([0]), np.array([n])
    width = int(last.max()) + 1
    for _ in range(length):
        if not len(lo):
            break
        one = hi - lo == 1
        new_lo, new_hi = [forward[lo[one]]], [forward[lo[one]] + 1]
        a, b = lo[~one], hi[~one]
        if len(a):
            size = b - a
            interval = np.repeat(np.arange(len(a)), size)
            place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(a, size)
            key = interval * width + last[place]
            sort = np.argsort(key)
            key, place = key[sort], place[sort]
            first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            new_lo.append(forward[np.minimum.reduceat(place, first)])
            new_hi.append(new_lo[-1] + np.diff(np.append(first, len(key))))
        lo, hi = np.concatenate(new_lo), np.concatenate(new_hi)
        fresh = ~valued[hi]
        lo, hi = lo[fresh], hi[fresh]
        valued[hi] = True
    return ~valued[:n]


def earlier(length: int):
    """A solver: bit o of a string's mask says that its window o also starts earlier."""

    def run(s: Strings) -> np.ndarray:
        sizes = np.array([len(t) for t in s.texts], np.int64)
        text = np.frombuffer(b"".join([t + b"\0" for t in s.texts]), np.uint8).astype(np.int64) + 1
        ends = np.cumsum(sizes + 1) - 1
        text[ends] = 0
        order = suffix_order(text, length)
        same = long_common_prefixes(text, order, length)
        group = np.cumsum(~same)
        string = np.searchsorted(ends, order)
        offset = order - (ends - sizes)[string]
        window = offset + length <= sizes[string]
        group, string, offset = group[window], string[window], offset[window]
        by = np.lexsort((s.start[string] + offset, s.doc[string], group))
        later = np.zeros(len(by), bool)
        later[1:] = group[by][1:] == group[by][:-1]
        mask = np.zeros(len(sizes), np.uint64)
        np.bitwise_or.at(mask, string[by[later]], np.uint64(1) << offset[by[later]].astype(np.uint64))
        return mask

    return run


def spans(gone: np.ndarray) -> int:
    return int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())


def digests(c: Chunk, gone: list[np.ndarray]) -> pa.Table:
    rows = []
    for s, g in zip(c.symbols, gone):
        for a, b in zip(s.block.starts.tolist(), s.block.ends.tolist()):
            here, data = g[a:b], s.block.data[a:b]
            n = int(here.sum())
            rows.append((b - a, n, spans(here) if n else 0, hashlib.sha256(data[~here] if n else data).hexdigest()))
    columns = list(zip(*rows)) or [[]] * 4
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
    return pa.table([c.rows.column("doc_id"), *(pa.array(x, k) for x, k in zip(columns, kinds))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def removal_digests(docs: DataFrame, length: int = LENGTH, **limits: int) -> DataFrame:
    return repeated(docs, Scheme(length, words=False, **limits), earlier(length), True, digests, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def deduplicated(docs: DataFrame, length: int = LENGTH, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, text, keep's columns, n_removed): the texts without their removed bytes.

    A character of which a part is removed goes as a whole. A null text stays null.
    """
    kept_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields)

    def texts(c: Chunk, gone: list[np.ndarray]) -> pa.Table:
        kept, counts = [], []
        for s, g in zip(c.symbols, gone):
            for a, b in zip(s.block.starts.tolist(), s.block.ends.tolist()):
                here, data = g[a:b], s.block.data[a:b]
                counts.append(int(here.sum()))
                kept.append((data[~here] if counts[-1] else data).tobytes().decode("utf-8", "ignore"))
        text = pc.if_else(c.rows.column("text").is_null(), None, pa.chunked_array([pa.array(kept, pa.string())]))
        return pa.table([c.rows.column("doc_id"), text, *(c.rows.column(k) for k in keep), pa.array(counts, pa.int64())], names=["doc_id", "text", *keep, "n_removed"])

    return repeated(docs, Scheme(length, words=False), earlier(length), True, texts, f"doc_id bigint, text string, {kept_schema + ', ' if keep else ''}n_removed bigint", keep)
