"""Repeated windows of a corpus: candidates by anchors, and the exchange of candidate strings.

Every window of L symbols has an anchor: the leftmost k-gram of least hash in it. Consecutive
windows with the same anchor form a run, whose symbols (L + count - 1 of them) are its string.
Equal windows have equal anchors at equal places, so only runs whose anchor hash occurs again
anywhere can hold a repeated window, and only strings under one anchor hash need comparing.

Documents are dealt to chunks by id, once; all steps below read that one exchange.
1. Chunks send their distinct anchor hashes, with a sketch of the distinct strings under each, to
   buckets, which answer two bits each: met again, and by very many different strings?
2. Under an anchor of the second kind (near the edges of a passage that stands in very many
   contexts) no task could hold all strings. Such runs are taken window by window: a window is a
   string of exactly the threshold length, for which comparing is equality, and has a key of its
   own, by which those anchors spread over all buckets. The sketches are merged, so the same
   string in many chunks counts once, however large the corpus is. Chunks send the distinct
   strings of the runs that are left, each with its first place (least doc_id, then start), to
   the buckets, where a solver finds the repeated windows.
3. Chunks get a bit mask of windows for each string, and apply it to their whole documents.
A passage that many documents share is one entry a chunk, whatever its count.

Strings are equal if their 128-bit keys are: a 64-bit polynomial, by which most are told apart at
little cost, and 64 bits of a BLAKE2 digest of those that are left. Anchors, which only say what
is to be compared, are 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tesserae.llm.common import chunks_for, text_bytes
from tesserae.llm.textblocks import Block, Words, blocks, prefix_hash, rank_pairs, released, sequence_prefix, span_hash, values, window_hash, words

#: Bits of a packed minimum that hold its place in a segment of a text.
PLACE = np.uint64((1 << 22) - 1)
BUCKET_BYTES = 4 << 20


@dataclass(frozen=True)
class Scheme:
    """Windows of `length` symbols: bytes, or words."""

    length: int
    words: bool
    #: Different strings under one anchor, as estimated, from which its runs are taken window by window.
    crowded: int = 4096
    #: Bytes of strings that a solver compares at a time.
    solve_bytes: int = 1 << 19
    #: Windows whose anchors are found at a time; at most as many as PLACE tells apart, less a span.
    segment: int = 1 << 21

    @property
    def span(self) -> int:
        """k-grams a window holds; 64 at most, so that a run's windows fit a mask."""
        return max(1, min(64, 2 * self.length // 3))

    @property
    def gram(self) -> int:
        return self.length - self.span + 1


@dataclass
class Symbols:
    block: Block
    bounds: np.ndarray  # (documents, 2): first symbol, and the one after the last
    words: Words | None
    prefix: np.ndarray  # of the hashes of spans

    def hashes(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The first half of the keys of the spans [first, last) of symbols."""
        if not len(self.prefix):
            self.prefix = prefix_of(self.block, self.words)
        return span_hash(self.prefix, first, last)

    def checks(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The other half: digests of their bytes."""
        raw = b"".join([blake2b(x, digest_size=8).digest() for x in self.strings(first, last)])
        return np.frombuffer(raw, np.uint64)

    def forget(self) -> None:
        """Gives the prefix back."""
        self.prefix = np.zeros(0, np.uint64)

    def strings(self, first: np.ndarray, last: np.ndarray) -> list[bytes]:
        """Bytes of each span of symbols; words joined by a space."""
        if not self.words:
            raw = self.block.data.tobytes()
            return [raw[a:b] for a, b in zip(first.tolist(), last.tolist())]
        w, end = self.words, last - 1
        raw = w.data.tobytes()
        return [raw[a:b] for a, b in zip(w.at[first].tolist(), (w.at[end] + w.ends[end] - w.starts[end]).tolist())]

    @property
    def count(self) -> int:
        return int(self.bounds[-1, 1]) + 1


def prefix_of(block: Block, w: Words | None) -> np.ndarray:
    return sequence_prefix(w.keys()[0]) if w else prefix_hash(block.data)


def symbols(block: Block, scheme: Scheme) -> Symbols:
    if not scheme.words:
        return Symbols(block, np.stack((block.starts, block.ends), axis=1), None, prefix_of(block, None))
    w = words(block, fold=False)
    return Symbols(block, np.stack((w.bounds[:-1], w.bounds[1:]), axis=1), w, prefix_of(block, w))


@dataclass
class Runs:
    key: np.ndarray  # anchor hash
    hash: np.ndarray  # of the string
    start: np.ndarray  # first window, as a symbol of the block
    count: np.ndarray  # windows
    doc: np.ndarray  # row of the block

    def take(self, at: np.ndarray) -> Runs:
        return Runs(*(getattr(self, f.name)[at] for f in fields(self)))

    @staticmethod
    def join(parts: list[Runs]) -> Runs:
        return Runs(*(np.concatenate([getattr(r, f.name) for r in parts]) for f in fields(Runs)))


def anchors(hashes: np.ndarray, scheme: Scheme) -> np.ndarray:
    """Place of the leftmost gram of least hash in every window, window by window."""
    span, out = scheme.span, []
    for lo in range(0, len(hashes) - span + 1, scheme.segment):
        part = hashes[lo : lo + scheme.segment + span - 1]
        low = (part & ~PLACE) | np.arange(len(part), dtype=np.uint64)
        size = 1
        while 2 * size <= span:
            low = np.minimum(low[:-size], low[size:])
            size *= 2
        if size < span:
            low = np.minimum(low[: len(low) - span + size], low[span - size :])
        out.append((low & PLACE).astype(np.int64) + lo)
    return np.concatenate(out)


def runs(s: Symbols, scheme: Scheme) -> Runs:
    length, span = scheme.length, scheme.span
    hashes = window_hash(s.prefix, scheme.gram)
    if len(hashes) < span:
        none = np.zeros(0, np.int64)
        return Runs(none.view(np.uint64), none.view(np.uint64), none, none, none)
    every = anchors(hashes, scheme)
    inside = np.zeros(len(every) + 1, np.int8)  # windows that lie in one document
    full = s.bounds[:, 1] - s.bounds[:, 0] >= length
    inside[s.bounds[full, 0]] = 1
    np.add.at(inside, s.bounds[full, 1] - length + 1, -1)
    window = np.flatnonzero(np.cumsum(inside[:-1], dtype=np.int8))
    place = every[window]
    new = np.ones(len(window), bool)
    new[1:] = (place[1:] != place[:-1]) | (window[1:] != window[:-1] + 1)
    doc = np.searchsorted(s.bounds[:, 0], window, "right") - 1
    new[1:] |= doc[1:] != doc[:-1]
    at = np.flatnonzero(new)
    start, count = window[at], np.diff(np.append(at, len(window)))
    return Runs(hashes[place[at]], s.hashes(start, start + count + length - 1), start, count, doc[at])


@dataclass
class Chunk:
    """A chunk's documents in order, with the runs of all blocks."""

    rows: pa.Table  # doc_id, text and the columns that were asked to be kept
    order: np.ndarray  # doc_id of each row, null greatest
    symbols: list[Symbols]
    runs: Runs
    block: np.ndarray  # of each run


def read_chunk(group: pa.Table, scheme: Scheme) -> Chunk:
    group = group.combine_chunks().sort_by([("doc_id", "ascending"), ("text", "ascending")])
    ids = group.column("doc_id").combine_chunks()
    some, each = [], []
    for b in blocks(values(group.column("text"))):
        some.append(symbols(b, scheme))
        each.append(runs(some[-1], scheme))
        some[-1].forget()  # prefixes are eight times as long as texts
    joined = Runs.join(each)
    order = np.asarray(ids.fill_null((1 << 63) - 1), np.int64)  # nulls sort last
    return Chunk(group.drop_columns(["chunk"]), order, some, joined, np.repeat(np.arange(len(each)), [len(r.key) for r in each]))


def bucket_of(keys: np.ndarray, n_buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(31)) % np.uint64(n_buckets)).astype(np.int32)


def by_bucket(keys: np.ndarray, n_buckets: int) -> list[tuple[int, np.ndarray]]:
    """(bucket, places of its keys), ascending, for buckets that have keys."""
    bucket = bucket_of(keys, n_buckets)
    order = np.argsort(bucket, kind="stable")
    used, cuts = np.unique(bucket[order], return_index=True)
    return list(zip(used.tolist(), np.split(order, cuts[1:]))) if len(used) else []


def table(names: str, rows: list[tuple]) -> pa.Table:
    kinds = {"chunk": pa.int32(), "bucket": pa.int32()}
    fields = names.split()
    columns = list(zip(*rows)) or [[]] * len(fields)
    return pa.table([pa.array(c, kinds.get(f, pa.binary())) for f, c in zip(fields, columns)], names=fields)


def distinct_keys(c: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hashes, whether they occur again in the chunk, and sketches of their distinct strings.

    A sketch has a bit for the number of trailing zeros of every string's hash; sketches of the
    same strings are the same, and those of a union are joined by or.
    """
    order = np.argsort(c.runs.key, kind="stable")
    key = c.runs.key[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    low = c.runs.hash[order] & np.uint64(0x7FFFFFFF) | np.uint64(1 << 31)
    bit = (low & (~low + np.uint64(1))).astype(np.uint32)
    sketch = np.bitwise_or.reduceat(bit, first) if len(key) else bit
    return key[first], np.diff(np.append(first, len(key))) > 1, sketch


def estimate(sketch: np.ndarray) -> np.ndarray:
    """How many distinct strings made each sketch, about: 2 to the power of the lowest unset bit, over 0.77351."""
    return ((~sketch & (sketch + np.uint32(1))).astype(np.float64)) / 0.77351


def ask(scheme: Scheme, n_buckets: int) -> Callable:
    def run(key: tuple, group: pa.Table) -> pa.Table:
        keys, again, sketch = distinct_keys(read_chunk(group, scheme))
        rows = [(key[0].as_py(), b, keys[at].tobytes(), np.packbits(again[at]).tobytes(), pa.compress(sketch[at].tobytes(), codec="zstd", asbytes=True)) for b, at in by_bucket(keys, n_buckets)]
        return table("chunk bucket keys again strings", rows)

    return run


def answer(scheme: Scheme) -> Callable:
    def run(key: tuple, group: pa.Table) -> pa.Table:
        keys = [np.frombuffer(k, np.uint64) for k in group.column("keys").to_pylist()]
        again = [np.unpackbits(np.frombuffer(a, np.uint8), count=len(k)) for a, k in zip(group.column("again").to_pylist(), keys)]
        sketch = [np.frombuffer(pa.decompress(n, 4 * len(k), codec="zstd"), np.uint32) for n, k in zip(group.column("strings").to_pylist(), keys)]
        every, at = np.unique(np.concatenate(keys), return_inverse=True)
        met, merged = np.zeros(len(every), np.int64), np.zeros(len(every), np.uint32)
        cuts = np.cumsum([len(k) for k in keys])[:-1]
        for a, k, w in zip(again, sketch, np.split(at, cuts)):  # a chunk names a key once
            met[w] += 1 + a.astype(np.int64)
            merged[w] |= k
        met, crowded = met > 1, estimate(merged) > scheme.crowded
        rows = []
        for chunk, w in zip(group.column("chunk").to_pylist(), np.split(at, cuts)):
            rows.append((chunk, key[0].as_py(), np.packbits(met[w]).tobytes(), np.packbits(crowded[w]).tobytes()))
        return table("chunk bucket met crowded", rows)

    return run


def split_crowded(c: Chunk, crowded: np.ndarray, scheme: Scheme) -> Chunk:
    """The chunk with runs under a crowded anchor (sorted hashes) as single windows, keyed by themselves."""
    if not len(crowded):
        return c
    r = c.runs
    at = np.minimum(np.searchsorted(crowded, r.key), len(crowded) - 1)
    split = crowded[at] == r.key
    parts, blocks_of = [r.take(~split)], [c.block[~split]]
    for b, s in enumerate(c.symbols):
        of = np.flatnonzero(split & (c.block == b))
        if len(of):
            n = r.count[of]
            start = np.repeat(r.start[of] - np.cumsum(n) + n, n) + np.arange(n.sum())
            hashes = s.hashes(start, start + scheme.length)
            s.forget()
            parts.append(Runs(hashes, hashes, start, np.ones(len(start), np.int64), np.repeat(r.doc[of], n)))
            blocks_of.append(np.full(len(start), b))
    joined, block = Runs.join(parts), np.concatenate(blocks_of)
    order = np.lexsort((joined.start, block))
    return Chunk(c.rows, c.order, c.symbols, joined.take(order), block[order])


def checks(c: Chunk, some: np.ndarray, scheme: Scheme) -> np.ndarray:
    """Second halves of the keys of some of the chunk's strings."""
    out = np.zeros(len(some), np.uint64)
    for b, s in enumerate(c.symbols):
        of = np.flatnonzero(c.block[some] == b)
        if len(of):
            start = c.runs.start[some[of]]
            out[of] = s.checks(start, start + c.runs.count[some[of]] + scheme.length - 1)
    return out


#: What a chunk sends of each distinct string: anchor hash and string key, first place, windows, whether it occurs again in the chunk, bytes.
STRING = np.dtype([("key", "<u8"), ("hash", "<u8"), ("check", "<u8"), ("doc", "<i8"), ("start", "<i8"), ("bytes", "<i4"), ("count", "<u1"), ("again", "?")])


def send(scheme: Scheme, n_buckets: int) -> Callable:
    def run(key: tuple, group: pa.Table, answers: pa.Table) -> pa.Table:
        c = read_chunk(group, scheme)
        keys, _, _ = distinct_keys(c)
        met, crowded = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
        answers = answers.sort_by("bucket")
        for (_, at), raw, more in zip(by_bucket(keys, n_buckets), answers.column("met").to_pylist(), answers.column("crowded").to_pylist(), strict=True):
            met[at] = np.unpackbits(np.frombuffer(raw, np.uint8), count=len(at)).astype(bool)
            crowded[at] = np.unpackbits(np.frombuffer(more, np.uint8), count=len(at)).astype(bool)
        left = np.isin(c.runs.key, keys[met], kind="sort")
        c = Chunk(c.rows, c.order, c.symbols, c.runs.take(left), c.block[left])
        c = split_crowded(c, keys[crowded], scheme)
        check = checks(c, np.arange(len(c.runs.key)), scheme)
        first, _, n = rank_pairs(c.runs.hash, check)
        back = np.argsort(first)
        first, n = first[back], n[back]
        texts: list[bytes] = []
        origin = np.zeros(len(first), np.int64)
        for b, s in enumerate(c.symbols):
            of = first[c.block[first] == b]
            if len(of):
                plain = c.runs.key[of] != c.runs.hash[of]  # single windows are known by their key
                some = iter(s.strings(c.runs.start[of[plain]], c.runs.start[of[plain]] + c.runs.count[of[plain]] + scheme.length - 1))
                texts += [next(some) if p else b"" for p in plain.tolist()]
                origin[len(texts) - len(of) : len(texts)] = s.bounds[c.runs.doc[of], 0]
        rows = np.zeros(len(first), STRING)
        rows["key"], rows["hash"], rows["check"], rows["count"], rows["again"] = c.runs.key[first], c.runs.hash[first], check[first], c.runs.count[first], n > 1
        lo = np.array([s.block.lo for s in c.symbols], np.int64)
        rows["doc"] = c.order[lo[c.block[first]] + c.runs.doc[first]] if len(first) else 0
        rows["start"] = c.runs.start[first] - origin
        rows["bytes"] = [len(t) for t in texts]
        out = []
        for bucket, at in by_bucket(rows["key"], n_buckets):
            body = b"".join([texts[i] for i in at.tolist()])
            out.append((key[0].as_py(), bucket, rows[at].tobytes(), pa.compress(body, codec="zstd", asbytes=True)))
        if crowded.any():  # a message to itself, beside the buckets
            out.append((key[0].as_py(), -1 - key[0].as_py(), keys[crowded].tobytes(), None))
        return table("chunk bucket rows body", out)

    return run


@dataclass
class Strings:
    """The distinct strings of a bucket that share an anchor hash with another string."""

    texts: list[bytes]
    doc: np.ndarray
    start: np.ndarray
    count: np.ndarray
    again: np.ndarray  # occurs more than once in the corpus


def strings_at(wanted: np.ndarray, parts: list[np.ndarray], bodies: pa.ChunkedArray) -> dict[int, bytes]:
    """Bytes of some of a bucket's rows, by their place among all."""
    out: dict[int, bytes] = {}
    wanted = np.sort(wanted)
    at = 0
    for part, body in zip(parts, bodies):
        here = wanted[np.searchsorted(wanted, at) : np.searchsorted(wanted, at + len(part))] - at
        if len(here):
            ends = np.cumsum(part["bytes"].astype(np.int64))
            raw = pa.decompress(body.as_buffer(), int(ends[-1]), codec="zstd", asbytes=True)
            for i in here.tolist():
                out[at + i] = raw[ends[i] - part["bytes"][i] : ends[i]]
        at += len(part)
    return out


def solve(scheme: Scheme, solver: Callable[[Strings], np.ndarray], first_stays: bool) -> Callable:
    """Masks of repeated windows for each chunk's strings.

    first_stays: the first occurrence of a window is not repeated (bit 0), and of equal strings
    only the first in the corpus gets its mask; else every occurrence is.
    """

    def run(key: tuple, group: pa.Table) -> pa.Table:
        if key[0].as_py() < 0:
            return table("chunk keys masks", list(zip(group.column("chunk").to_pylist(), group.column("rows").to_pylist(), [None] * group.num_rows)))
        parts = [np.frombuffer(r, STRING) for r in group.column("rows").to_pylist()]
        rows = np.concatenate(parts)
        _, string, _ = rank_pairs(rows["hash"], rows["check"])
        order = np.lexsort((rows["start"], rows["doc"], string))
        new = np.ones(len(rows), bool)
        new[1:] = string[order][1:] != string[order][:-1]
        lead = order[new]  # the first row of each string
        n = len(lead)
        again = np.bincount(string, weights=1 + rows["again"].astype(np.int64), minlength=n) > 1
        _, anchor, strings_of = np.unique(rows["key"][lead], return_inverse=True, return_counts=True)
        some = np.flatnonzero(strings_of[anchor] > 1)
        full = (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - rows["count"].astype(np.uint64)))[lead]
        mask = np.where(again & (not first_stays), full, np.uint64(0))
        if len(some):
            some = some[np.argsort(anchor[some], kind="stable")]
            ends = np.cumsum(rows["bytes"][lead[some]].astype(np.int64))
            batch = ends // scheme.solve_bytes  # whole anchors, about so many bytes together
            batch = np.maximum.accumulate(batch[np.searchsorted(anchor[some], anchor[some], "left")])
            for mine in np.split(some, np.flatnonzero(np.diff(batch)) + 1):
                of = lead[mine]
                texts = strings_at(of, parts, group.column("body"))
                mask[mine] |= solver(Strings([texts[i] for i in of.tolist()], rows["doc"][of], rows["start"][of], rows["count"][of].astype(np.int64), again[mine]))
        result = mask[string]
        if first_stays:
            is_lead = np.zeros(len(rows), bool)
            is_lead[lead] = True
            result = np.where(is_lead, result, full[string])
        out, at = [], 0
        for chunk, part in zip(group.column("chunk").to_pylist(), parts):
            here = result[at : at + len(part)]
            hit = here != 0
            if hit.any() or (first_stays and part["again"].any()):
                hit |= part["again"] & first_stays
                out.append((chunk, np.stack((part["hash"][hit], part["check"][hit])).tobytes(), pa.compress(here[hit].tobytes(), codec="zstd", asbytes=True)))
            at += len(part)
        return table("chunk keys masks", out)

    return run


def removed(c: Chunk, answers: pa.Table, scheme: Scheme, first_stays: bool) -> list[np.ndarray]:
    """Of each block, which symbols a repeated window covers."""
    told = answers.column("masks").is_null().to_pylist()
    crowded = [np.frombuffer(h, np.uint64) for h, t in zip(answers.column("keys").to_pylist(), told) if t]
    if crowded:
        c = split_crowded(c, np.sort(np.concatenate(crowded)), scheme)
        answers = answers.filter(pa.array([not t for t in told]))
    keys = [np.frombuffer(k, np.uint64).reshape(2, -1) for k in answers.column("keys").to_pylist()]
    masks = [np.frombuffer(pa.decompress(m, 8 * k.shape[1], codec="zstd"), np.uint64) for m, k in zip(answers.column("masks").to_pylist(), keys)]
    r = c.runs
    near = np.isin(r.hash, np.concatenate([k[0] for k in keys]), kind="sort") if keys else np.zeros(len(r.hash), bool)
    hit = np.flatnonzero(near)
    _, number, counts = rank_pairs(np.concatenate((*(k[0] for k in keys), r.hash[hit])), np.concatenate((*(k[1] for k in keys), checks(c, hit, scheme))))
    n_told = len(number) - len(hit)
    known, mask = np.zeros(len(counts), bool), np.zeros(len(counts), np.uint64)
    known[number[:n_told]] = True
    if masks:
        mask[number[:n_told]] = np.concatenate(masks)
    mine, number = mask[number[n_told:]], number[n_told:]
    hit, mine, number = hit[known[number]], mine[known[number]], number[known[number]]
    if first_stays and len(hit):
        _, first = np.unique(number, return_index=True)
        later = np.ones(len(hit), bool)
        later[first] = False
        full = np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - r.count[hit].astype(np.uint64))
        mine = np.where(later, full, mine)
    out = []
    for b, s in enumerate(c.symbols):
        n = s.count
        change = np.zeros(n + scheme.length + 1, np.int32)
        of = c.block[hit] == b
        start, bits = r.start[hit[of]], mine[of]
        for o in range(scheme.span):
            on = start[(bits >> np.uint64(o)) & np.uint64(1) == 1] + o
            if len(on):
                np.add.at(change, on, 1)
                np.add.at(change, on + scheme.length, -1)
        out.append(np.cumsum(change)[:n] > 0)
    return out


def repeated(docs: DataFrame, scheme: Scheme, solver: Callable[[Strings], np.ndarray], first_stays: bool, finish: Callable[[Chunk, list[np.ndarray]], pa.Table], schema: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """finish's rows for the documents (doc_id, text, keep's columns) of each chunk."""
    total = text_bytes(docs)
    n_chunks, n_buckets = chunks_for(total, 4 << 20), max(64, -(-total // BUCKET_BYTES))
    spread = F.pmod(F.xxhash64("doc_id"), F.lit(n_chunks)).cast("int")
    # rows without an id are dealt by their text
    spread = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("text"), F.lit(n_chunks)).cast("int")).otherwise(spread)
    dealt = docs.select("doc_id", "text", *keep, spread.alias("chunk")).repartition(n_chunks, "chunk")
    asking, answering, sending, solving = ask(scheme, n_buckets), answer(scheme), send(scheme, n_buckets), solve(scheme, solver, first_stays)
    asked = dealt.groupBy("chunk").applyInArrow(lambda key, group: released(asking, key, group), "chunk int, bucket int, keys binary, again binary, strings binary")
    met = asked.groupBy("bucket").applyInArrow(lambda key, group: released(answering, key, group), "chunk int, bucket int, met binary, crowded binary")
    sent = dealt.groupBy("chunk").cogroup(met.groupBy("chunk")).applyInArrow(lambda key, group, answers: released(sending, key, group, answers), "chunk int, bucket int, rows binary, body binary")
    masks = sent.groupBy("bucket").applyInArrow(lambda key, group: released(solving, key, group), "chunk int, keys binary, masks binary")

    def applying(key: tuple, group: pa.Table, answers: pa.Table) -> pa.Table:
        c = read_chunk(group, scheme)
        return finish(c, removed(c, answers, scheme, first_stays))

    return dealt.groupBy("chunk").cogroup(masks.groupBy("chunk")).applyInArrow(lambda key, group, answers: released(applying, key, group, answers), schema)
