"""MinHash near-deduplication with min-max signatures.

Each permutation of the shingle hashes (an odd multiplier and an addend modulo 2**32) gives two
signature values, its minimum and its maximum, so half the hash evaluations serve a signature.
Bands of a few permutations are hashed to keys; sets that share a key are candidates. Equal sets
are one class from the start. In each key the member with the least share of shingles of its own
is the hub: members are confirmed against hubs on full sets, in rounds with other hubs between
the components that remain. Before each round, members are left out whose links are ruled out by
counts: a set with u shingles that any other candidate has cannot share more than u with a
partner. At last every pair of different components in a key is decided: two sets share at most
the smaller of their overlaps with the hub, and shingles outside the hub; so pairs are confirmed
whose overlaps with the hub alone could do, and those that meet in a shingle outside it. No
candidate link is lost, while groups of copies are never expanded into all pairs. Components are
contracted by minimum labels and pointer jumping in tables.

A text without words has an empty set and is linked with nothing. Null texts count as empty.
Shorter texts are one shingle. Every row is a document of its own: sets belong to classes of
equal content, not to ids, so rows that repeat a doc_id are repeated in the result, each with the
links of its own text. Null ids join no group. Very long texts cost memory in proportion to one
text. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tesserae.llm.common import materialize, scratch
from tesserae.llm.textblocks import blocks, distinct, mix, releasing, shingles, values, words


@dataclass(frozen=True)
class Settings:
    """Links: 100 * intersection >= percent * union of the width-word shingle sets.

    A band has 2 * permutations values; with the defaults, a pair at 85 % shares none of the bands
    with a probability below 1e-6.
    """

    width: int = 3
    percent: int = 85
    bands: int = 48
    permutations: int = 4
    hub_rounds: int = 3
    broadcast_ids: int = 1 << 20
    #: Members of a hub that one task compares with it.
    hub_share: int = 256
    seed: int = 1


def signer(s: Settings):
    """A function from (hashes, bounds) to the band keys of each set, an array (sets, bands)."""
    rng = np.random.default_rng(s.seed)
    n = s.bands * s.permutations
    factor = (rng.integers(0, 1 << 31, n, dtype=np.uint32) << np.uint32(1) | np.uint32(1))[:, None]
    addend = rng.integers(0, 1 << 32, n, dtype=np.uint32)[:, None]
    weights = rng.integers(1, 1 << 63, 2 * s.permutations, dtype=np.uint64) | np.uint64(1)
    band = np.arange(s.bands, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)

    def sign(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        short = (hashes >> np.uint64(32)).astype(np.uint32)
        out = np.zeros((len(bounds) - 1, s.bands), np.int64)
        for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
            if a == b:
                continue
            low = np.full(n, 0xFFFFFFFF, np.uint32)
            high = np.zeros(n, np.uint32)
            for at in range(a, b, 2048):
                v = short[at : min(b, at + 2048)] * factor
                v += addend
                np.minimum(low, v.min(axis=1), out=low)
                np.maximum(high, v.max(axis=1), out=high)
            both = np.concatenate((low.reshape(s.bands, -1), high.reshape(s.bands, -1)), axis=1).astype(np.uint64)
            out[i] = mix((mix(both + band) * weights).sum(axis=1, dtype=np.uint64)).view(np.int64)
        return out

    return sign


def set_keys(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Two 64-bit sums over the shingles of each set, which tell sets apart."""
    sums = np.zeros((2, len(hashes) + 1), np.uint64)
    np.cumsum(mix(hashes), out=sums[0, 1:])
    np.cumsum(mix(hashes ^ np.uint64(0xA5A5A5A55A5A5A5A)), out=sums[1, 1:])
    return (sums[:, bounds[1:]] - sums[:, bounds[:-1]]).view(np.int64)


def signatures(docs: DataFrame, s: Settings) -> DataFrame:
    """(doc_id, n_shingles, k1, k2, keys): set size, a 128-bit key of the set, and its band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sign = signer(s)
        for batch in batches:
            for b in blocks(values(batch.column("text"))):
                hashes, bounds = distinct(*shingles(words(b, fold=True), s.width), len(b.starts))
                k1, k2 = set_keys(hashes, bounds)
                keys = sign(hashes, bounds)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * s.bands), pa.array(keys.reshape(-1)))
                ids = batch.column("doc_id").slice(b.lo, len(b.starts))
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.diff(bounds).astype(np.int64)), pa.array(k1), pa.array(k2), lists], names=["doc_id", "n_shingles", "k1", "k2", "keys"])

    return docs.select("doc_id", "text").mapInArrow(releasing(run), "doc_id bigint, n_shingles bigint, k1 bigint, k2 bigint, keys array<bigint>")


def full_sets(docs: DataFrame, wanted: DataFrame, s: Settings) -> DataFrame:
    """(rep, hashes) of the classes wanted (rep, first_id, k1, k2), each from a document of its own.

    Few classes go to all tasks, after a count; more are met by a shuffle.
    """
    few = wanted.count() <= s.broadcast_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = [batch.column(k).to_numpy() for k in ("k1", "k2")]
            for b in blocks(values(batch.column("text"))):
                hashes, bounds = distinct(*shingles(words(b, fold=True), s.width), len(b.starts))
                of = slice(b.lo, b.lo + len(b.starts))
                # an id may stand in rows of other classes, too
                own = (set_keys(hashes, bounds) == np.stack([k[of] for k in told])).all(axis=0)
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(hashes.view(np.int64)))
                found = pa.RecordBatch.from_arrays([batch.column("rep").slice(b.lo, len(b.starts)), lists], names=["rep", "hashes"])
                yield found.filter(pa.array(own))

    keyed = F.broadcast(wanted) if few else wanted.hint("shuffle_hash")
    found = docs.select(F.col("doc_id").alias("first_id"), "text").join(keyed, "first_id")
    return found.select("rep", "k1", "k2", "text").mapInArrow(releasing(run), "rep bigint, hashes array<bigint>")


def confirmed(edges: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (a, b) edges whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (xs, xo), (ys, yo) = ((c.flatten().to_numpy().view(np.uint64), np.concatenate(([0], np.cumsum(c.value_lengths().to_numpy())))) for c in (batch.column("x"), batch.column("y")))
            keep = []
            for i in range(batch.num_rows):
                p, q = xs[xo[i] : xo[i + 1]], ys[yo[i] : yo[i + 1]]
                small, large = (p, q) if len(p) < len(q) else (q, p)
                at = np.searchsorted(large, small)
                shared = int((large[np.minimum(at, len(large) - 1)] == small).sum())
                keep.append(100 * shared >= percent * (len(p) + len(q) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("rep").alias("a"), F.col("hashes").alias("x"))
    right = sets.select(F.col("rep").alias("b"), F.col("hashes").alias("y"))
    return edges.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(releasing(run), "a bigint, b bigint")


def components(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """labels (rep, comp) merged along edges (a, b): comp becomes the least of each component.

    Each pass hooks every label to its least neighbour, follows pointers twice and relabels;
    only the labels that still differ along an edge take part in it.
    """
    edges = materialize(edges, "links")
    while True:
        side = lambda c, to: edges.join(labels.select(F.col("rep").alias(c), F.col("comp").alias(to)), c)
        apart = side("a", "ca").join(labels.select(F.col("rep").alias("b"), F.col("comp").alias("cb")), "b").where("ca <> cb").select("ca", "cb").distinct()
        apart = materialize(apart, "apart")
        if apart.isEmpty():
            return labels
        both = apart.unionByName(apart.select(F.col("cb").alias("ca"), F.col("ca").alias("cb")))
        hook = both.groupBy(F.col("ca").alias("comp")).agg(F.least(F.min("cb"), F.col("comp")).alias("to"))
        hook = materialize(hook, "hooks")
        for _ in range(2):
            jump = hook.select(F.col("comp").alias("to"), F.col("to").alias("next"))
            hook = hook.join(jump, "to", "left").select("comp", F.coalesce("next", "to").alias("to"))
        labels = materialize(labels.join(hook, "comp", "left").select("rep", F.coalesce("to", "comp").alias("comp")), "labels")


def component_labels(docs: DataFrame, classes: DataFrame, s: Settings) -> DataFrame:
    """(rep, comp) of the classes that share a band key, written as a table."""
    banded = classes.select("rep", "n_shingles", F.explode("keys").alias("key"))
    shared = banded.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    members = materialize(banded.join(shared, "key"), "members")
    ids = members.select("rep").distinct()
    labels = materialize(ids.select("rep", F.col("rep").alias("comp")), "labels")
    if not members.isEmpty():
        wanted = materialize(classes.select("rep", "first_id", "k1", "k2").join(ids, "rep"), "wanted")
        found = full_sets(docs, wanted, s)
        sets = materialize(found.dropDuplicates(["rep"]) if repeats(docs) else found, "sets")
        members = materialize(members.join(common_counts(sets), "rep"), "counted")
        for k in range(s.hub_rounds + 2):
            here = open_members(members.join(labels, "rep"), k, s)
            pairs = materialize(hub_pairs(here, k, s) if k <= s.hub_rounds else all_pairs(here, sets, s), "pairs")
            if not pairs.isEmpty():
                some = pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).distinct()
                labels = components(labels, confirmed(pairs, sets.join(some, "rep", "left_semi"), s.percent))
    return materialize(labels, "labels")


def near_duplicates(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row of docs (doc_id, text)."""
    signed = materialize(signatures(docs, s), "signatures")
    real = signed.where("n_shingles > 0 and doc_id is not null")
    classes = real.groupBy("k1", "k2", "n_shingles").agg(F.min("doc_id").alias("first_id"), F.first("keys").alias("keys"))
    classes = materialize(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    with scratch(docs.sparkSession) as tables:
        labels = component_labels(docs, classes, s)
        tables.pop()  # the last one written is that of the labels
    least = classes.join(labels, "rep").groupBy("comp").agg(F.min("first_id").alias("least"))
    groups = classes.drop("keys").join(labels.join(least, "comp"), "rep", "left")
    groups = groups.select("k1", "k2", "n_shingles", F.coalesce("least", "first_id").alias("component_id"))
    out = signed.drop("keys").join(groups, ["k1", "k2", "n_shingles"], "left")
    linked = F.col("n_shingles") > 0
    out = out.select("doc_id", "n_shingles", F.when(linked & F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def common_counts(sets: DataFrame) -> DataFrame:
    """(rep, u): how many of a set's shingles another set has, too."""
    own = sets.select("rep", F.explode("hashes").alias("h")).groupBy("h").agg(F.min("rep").alias("rep"), F.count(F.lit(1)).alias("n")).where("n = 1")
    counts = own.groupBy("rep").agg(F.count(F.lit(1)).alias("own"))
    return sets.select("rep", F.size("hashes").alias("size")).join(counts, "rep", "left").select("rep", (F.col("size") - F.coalesce("own", F.lit(0))).alias("u"))


def linkable(u: Column, n: Column, v: Column, m: Column, percent: int) -> Column:
    """Whether sets of n and m shingles that share u and v at most can be linked."""
    return ((100 + percent) * F.least(u, v) >= percent * (n + m)) & (100 * F.least(n, m) >= percent * F.greatest(n, m))


def open_members(here: DataFrame, k: int, s: Settings) -> DataFrame:
    """(key, rep, n_shingles, u, comp, hub) of the keys that still hold different components.

    Members that no other in their key can be linked with, by the least size and the largest
    common count there, are left out first, and with them keys of a single component. Each key
    has the most common member as its hub, or in rounds 1 to hub_rounds another one.
    """
    own_share = (F.col("n_shingles") - F.col("u")) / F.col("n_shingles")
    order = F.struct(F.xxhash64("rep", F.lit(k)), "rep") if 0 < k <= s.hub_rounds else F.struct(own_share, "rep")
    for _ in range(2):
        mixed = here.groupBy("key").agg(
            F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("n_shingles").alias("least"), F.max("u").alias("most"), F.min_by(F.struct("rep", "comp", "n_shingles", "u"), order).alias("hub")
        ).where("lo < hi")
        here = here.select("key", "rep", "n_shingles", "u", "comp").join(mixed.drop("lo", "hi"), "key")
        here = here.where((100 + s.percent) * F.least("u", "most") >= s.percent * (F.col("n_shingles") + F.col("least")))
    return here


def hub_pairs(here: DataFrame, k: int, s: Settings) -> DataFrame:
    """Pairs (a, b) of a member and its hub; in round 0 the hub of most of its keys only."""
    hub = lambda f: F.col(f"hub.{f}")
    pairs = here.where((F.col("comp") != hub("comp")) & linkable(F.col("u"), F.col("n_shingles"), hub("u"), hub("n_shingles"), s.percent))
    votes = pairs.groupBy(F.col("rep").alias("a"), hub("rep").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    if k == 0:
        return votes.groupBy("a").agg(F.max_by("b", F.struct("n", -F.col("b"))).alias("b"))
    return votes.drop("n")


def against_hubs(near: DataFrame, sets: DataFrame, s: Settings) -> DataFrame:
    """near (hub, rep, comp, n, u) with c, the shingles in the hub's set, too, and the others.

    A hub's members are dealt to parts of about s.hub_share, each of which gets a copy of the
    hub's set. The numbers of parts go to all tasks where they are few, after a count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, outside = [], []
            for x, y in zip(batch.column("x"), batch.column("y")):
                mine, hub = x.values.to_numpy(), y.values.to_numpy()
                inside = np.isin(mine, hub, assume_unique=True)
                counts.append(int(inside.sum()))
                outside.append(mine[~inside])
            base = batch.select(["hub", "rep", "comp", "n", "u"])
            yield pa.RecordBatch.from_arrays([*base.columns, pa.array(counts, pa.int64()), pa.array(outside, pa.list_(pa.int64()))], names=[*base.schema.names, "c", "outside"])

    left = sets.select("rep", F.col("hashes").alias("x"))
    parts = materialize(near.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / s.hub_share).cast("int").alias("parts")), "parts")
    keyed = F.broadcast(parts) if parts.count() <= s.broadcast_ids else parts
    right = sets.select(F.col("rep").alias("hub"), F.col("hashes").alias("y")).join(keyed, "hub")
    right = right.select("hub", "y", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    dealt = near.join(keyed, "hub").withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    met = dealt.join(left, "rep").join(right, ["hub", "part"]).select("hub", "rep", "comp", "n", "u", "x", "y")
    return met.mapInArrow(releasing(run), "hub bigint, rep bigint, comp bigint, n bigint, u bigint, c bigint, outside array<bigint>")


def all_pairs(here: DataFrame, sets: DataFrame, s: Settings) -> DataFrame:
    """All pairs (a, b) of different components in a key that could be linked."""
    near = here.groupBy(F.col("hub.rep").alias("hub"), "rep", "comp").agg(F.first("n_shingles").alias("n"), F.first("u").cast("long").alias("u"))
    near = materialize(near, "near")
    some = near.select("rep").union(near.select("hub")).distinct()
    told = materialize(against_hubs(near, sets.join(some, "rep", "left_semi"), s), "told")
    mixed = lambda df, *key: df.groupBy(*key).agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select(*key)
    other = lambda df, *key: df.select(*key, *(F.col(f).alias(f"{f}2") for f in ("rep", "comp", "n", "u", "c")))
    whole, share = 100 + s.percent, s.percent
    sizes = 100 * F.least("n", "n2") >= share * F.greatest("n", "n2")

    # what is known of each hub goes to all tasks where hubs are few, after a count: a hub's members need not meet for it
    keyed = F.broadcast if near.select("hub").distinct().count() <= s.broadcast_ids else lambda df: df

    # the overlaps with the hub could do alone: both sides need one as large as the least partner asks
    least = told.groupBy("hub").agg(F.min("n").alias("n_least"))
    big = told.drop("outside").join(keyed(least), "hub").where(whole * F.col("c") >= share * (F.col("n") + F.col("n_least")))
    big = big.join(keyed(mixed(big, "hub")), "hub")
    inside = big.join(other(big, "hub"), "hub").where((F.col("comp") < F.col("comp2")) & sizes & (whole * F.least("c", "c2") >= share * (F.col("n") + F.col("n2"))))

    # they meet in a shingle outside the hub
    each = told.select("hub", F.explode("outside").alias("h"), "rep", "comp", "n", "u", "c")
    each = each.join(mixed(each, "hub", "h"), ["hub", "h"])
    most = F.least("c", "c2") + F.least(F.col("u") - F.col("c"), F.col("u2") - F.col("c2"))
    outside = each.join(other(each, "hub", "h"), ["hub", "h"]).where((F.col("comp") < F.col("comp2")) & sizes & (whole * most >= share * (F.col("n") + F.col("n2"))))
    pick = lambda df: df.select(F.col("rep").alias("a"), F.col("rep2").alias("b"))
    return pick(inside).union(pick(outside)).distinct()


def repeats(docs: DataFrame) -> bool:
    """Whether an id stands in more than one row."""
    return not docs.groupBy("doc_id").count().where("count > 1 and doc_id is not null").isEmpty()
