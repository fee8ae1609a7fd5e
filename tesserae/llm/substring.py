"""Substring deduplication with suffix automata.

A word is removed when a window of `length` words that occurs anywhere else covers it. The
reference is the corpus itself, in shards by content: strings that can share a window meet in one
shard (see anchors). The shard's suffix automaton, whose states count their occurrences, is read
along by each string; the matching statistics say at each word which repeated suffix ends there.
The reference grows with the corpus and has no bound under which it could be broadcast, so
strings are routed to their shard instead.

Null and empty texts have no words. Windows never cross documents.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tesserae.llm.anchors import Chunk, Scheme, Strings, repeated

LENGTH = 35


class SuffixAutomaton:
    """Of several sequences; each state counts the places where its strings end, weighted by sequence."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]
        self.count = [0]

    def _state(self, length: int, link: int, moves: dict) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        self.count.append(0)
        return len(self.link) - 1

    def _split(self, p: int, q: int, symbol) -> int:
        """A state for the strings of q that p + symbol ends."""
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(symbol) == q:
            self.next[p][symbol] = clone
            p = self.link[p]
        return clone

    def add(self, sequence: list, weight: int) -> None:
        last = 0
        for symbol in sequence:
            q = self.next[last].get(symbol)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, q, symbol)
            else:
                new, p = self._state(self.length[last] + 1, 0, {}), last
                while p >= 0 and symbol not in self.next[p]:
                    self.next[p][symbol] = new
                    p = self.link[p]
                if p >= 0:
                    q = self.next[p][symbol]
                    self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, symbol)
                last = new
            self.count[last] += weight

    def finish(self) -> None:
        """Adds each state's count to its suffixes'."""
        for v in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            self.count[self.link[v]] += self.count[v]

    def repeated_ends(self, sequence: list, length: int) -> list[int]:
        """Places after which a window of `length` symbols ends that occurs twice or more."""
        out, v = [], 0
        for i, symbol in enumerate(sequence, 1):
            while v and symbol not in self.next[v]:
                v = self.link[v]
            v = self.next[v].get(symbol, 0)
            while self.length[self.link[v]] >= length if v else False:
                v = self.link[v]
            if i >= length and self.length[v] >= length and self.count[v] > 1:
                out.append(i)
        return out


def elsewhere(length: int):
    """A solver: bit o of a string's mask says that its window o occurs more than once."""

    def run(s: Strings) -> np.ndarray:
        automaton = SuffixAutomaton()
        sequences = [t.split(b" ") for t in s.texts]
        for words, again in zip(sequences, s.again.tolist()):
            automaton.add(words, 2 if again else 1)
        automaton.finish()
        return np.array([sum(1 << (i - length) for i in automaton.repeated_ends(words, length)) for words in sequences], np.uint64)

    return run


def digests(c: Chunk, gone: list[np.ndarray]) -> pa.Table:
    rows = []
    for s, g in zip(c.symbols, gone):
        raw = s.block.data.tobytes()
        each = [raw[a:b] for a, b in zip(s.words.starts.tolist(), s.words.ends.tolist())]
        for a, b in s.bounds.tolist():
            n = int(g[a:b].sum())
            kept = each[a:b] if not n else [each[i] for i in (np.flatnonzero(~g[a:b]) + a).tolist()]
            rows.append((b - a, n, hashlib.sha256(b" ".join(kept)).hexdigest()))
    columns = list(zip(*rows)) or [[]] * 3
    kinds = (pa.int64(), pa.int64(), pa.string())
    return pa.table([c.rows.column("doc_id"), *(pa.array(x, k) for x, k in zip(columns, kinds))], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def removal_digests(docs: DataFrame, length: int = LENGTH, **limits: int) -> DataFrame:
    return repeated(docs, Scheme(length, words=True, **limits), elsewhere(length), False, digests, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string")


def deduplicated(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, text, n_removed): the words that stay, joined by a space."""

    def texts(c: Chunk, gone: list[np.ndarray]) -> pa.Table:
        kept, counts = [], []
        for s, g in zip(c.symbols, gone):
            raw = s.block.data.tobytes()
            for a, b in s.bounds.tolist():
                stay = (np.flatnonzero(~g[a:b]) + a).tolist()
                kept.append(b" ".join([raw[s.words.starts[i] : s.words.ends[i]] for i in stay]).decode())
                counts.append(b - a - len(stay))
        return pa.table([c.rows.column("doc_id"), pa.array(kept, pa.string()), pa.array(counts, pa.int64())], names=["doc_id", "text", "n_removed"])

    return repeated(docs, Scheme(length, words=True), elsewhere(length), False, texts, "doc_id bigint, text string, n_removed bigint")
