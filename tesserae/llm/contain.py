"""Benchmark decontamination: size-partitioned MinHash containment search.

A test item with n shingles is contained in a document when the document's shingle set holds at
least threshold * n of them. Items are partitioned by the power of two below n. The sketch of an
item is its bottom-k MinHash: its k smallest shingle hashes, with k = n - ceil(threshold * n) + 1,
so that any document that contains the item meets at least one of the k (it can miss
n - ceil(threshold * n) at most); no containment is lost however long the document is. A
partition's sketches end at a hash value, which is the smaller the larger its items are; the
sketch of a document for that partition is all its shingle hashes up to this value, and documents
with fewer shingles than the partition's least item needs have none. Candidates are verified by
counting shared shingles over both whole sets.

Items are taken in blocks of bounded size, each of which goes to the executors as a whole.
Null and empty texts (of either side) contain nothing and are contained nowhere. Texts with
fewer words than a shingle are one shingle. Repeated rows give one pair; rows without an id are
searched like others and give pairs without one. Empty tables on either side give an empty
result; other columns are ignored. Very long texts cost memory in proportion to one text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tesserae.llm.textblocks import blocks, distinct, releasing, shingles, values, words

WIDTH = 5
THRESHOLD = 0.8
#: Bytes of item text searched for at a time.
BLOCK_BYTES = 16 << 20
FILTER_BITS = 20
PAIRS = "doc_id bigint, item_id bigint, item_shingles int, shared int"


def text_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    out: list[np.ndarray] = []
    for b in blocks(texts):
        hashes, cut = distinct(*shingles(words(b, fold=True), width), len(b.starts))
        out += [hashes[i:j] for i, j in zip(cut, cut[1:])]
    return out


@dataclass
class Partition:
    """Items of a size class: their sketch hashes, ascending, and the item of each."""

    hashes: np.ndarray
    items: np.ndarray
    least: int  # shingles that a document needs to contain any of them
    present: np.ndarray  # by the first bits of a hash

    def candidates(self, hashes: np.ndarray, docs: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(document, item) that share a sketch hash; sizes: shingles of each document, with repeats."""
        sketch = np.flatnonzero((hashes <= self.hashes[-1]) & self.present[hashes >> np.uint64(64 - FILTER_BITS)])
        sketch = sketch[sizes[docs[sketch]] >= self.least]
        lo = np.searchsorted(self.hashes, hashes[sketch], "left")
        n = np.searchsorted(self.hashes, hashes[sketch], "right") - lo
        at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.repeat(docs[sketch], n), self.items[at]


class Sketches:
    """Item sets, and an index of their sketches for every size class."""

    def __init__(self, ids: list[int], texts: list[bytes], width: int, threshold: float):
        sets = text_sets(texts, width)
        kept = [i for i, s in enumerate(sets) if len(s)]
        self.ids = np.array([ids[i] for i in kept], np.int64)
        sizes = np.array([len(sets[i]) for i in kept], np.int64)
        self.sizes, self.ends = sizes, np.cumsum(sizes)
        self.hashes = np.concatenate([sets[i] for i in kept]) if kept else np.zeros(0, np.uint64)
        self.need = np.ceil(threshold * sizes - 1e-9).astype(np.int64)
        starts, k = self.ends - sizes, sizes - self.need + 1
        self.partitions = []
        for size_class in np.unique(np.frexp(sizes)[1]):
            of = np.flatnonzero(np.frexp(sizes)[1] == size_class)
            items = np.repeat(of, k[of])
            hashes = self.hashes[np.repeat(starts[of] - np.cumsum(k[of]) + k[of], k[of]) + np.arange(len(items))]
            order = np.argsort(hashes, kind="stable")
            present = np.zeros(1 << FILTER_BITS, bool)
            present[hashes >> np.uint64(64 - FILTER_BITS)] = True
            self.partitions.append(Partition(hashes[order], items[order], int(self.need[of].min()), present))

    def candidates(self, hashes: np.ndarray, docs: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (document, item), by document."""
        sizes = np.bincount(docs, minlength=n_docs)
        found = [p.candidates(hashes, docs, sizes) for p in self.partitions]
        pairs = np.unique(np.concatenate([d * len(self.ids) + i for d, i in found]))
        return pairs // len(self.ids), pairs % len(self.ids)

    def shared(self, docs: np.ndarray, items: np.ndarray, sets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Common shingles of each (document, item); sets: sorted distinct hashes of every document."""
        n = self.sizes[items]
        pair = np.repeat(np.arange(len(items)), n)
        hashes = self.hashes[np.repeat(self.ends[items] - np.cumsum(n), n) + np.arange(len(pair))]
        every, number = np.unique(sets, return_inverse=True)
        held = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)) * len(every) + number  # ascending
        at = np.minimum(np.searchsorted(every, hashes), len(every) - 1)
        key = docs[pair] * len(every) + at
        hit = (every[at] == hashes) & (held[np.minimum(np.searchsorted(held, key), len(held) - 1)] == key)
        return np.bincount(pair[hit], minlength=len(items))


def search(docs: DataFrame, items: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """PAIRS for (doc_id, text) documents that contain (item_id, text) items."""
    items = items.select("item_id", "text").where(F.length("text") > 0)
    n_blocks = max(1, -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes))
    found: DataFrame | None = None
    for k in range(n_blocks):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == k).distinct().collect()
        part = _search_block(docs, Sketches([r["item_id"] for r in block], [r["text"].encode() for r in block], width, threshold), width)
        found = part if found is None else found.unionByName(part)
    return found.distinct()


def _search_block(docs: DataFrame, sketches: Sketches, width: int) -> DataFrame:
    shared_copy = docs.sparkSession.sparkContext.broadcast(sketches)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared_copy.value
        for batch in batches:
            ids, rows = batch.column("doc_id"), []
            for b in blocks(values(batch.column("text"))) if len(s.ids) else ():
                hashes, owner = shingles(words(b, fold=True), width)
                found, items = s.candidates(hashes, owner, len(b.starts))
                if not len(found):
                    continue
                some = np.isin(owner, found)
                shared = s.shared(found, items, *distinct(hashes[some], owner[some], len(b.starts)))
                for k in np.flatnonzero(shared >= s.need[items]).tolist():
                    item = items[k]
                    rows.append((ids[b.lo + int(found[k])].as_py(), int(s.ids[item]), int(s.sizes[item]), int(shared[k])))
            columns = list(zip(*rows)) or [[]] * 4
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "item_id", "item_shingles", "shared"])

    return docs.select("doc_id", "text").mapInArrow(releasing(run), PAIRS)
