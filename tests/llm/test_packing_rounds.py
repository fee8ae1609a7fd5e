import collections

import numpy as np
import pyarrow as pa

from tesserae.llm import packing


def test_groups_that_save_nothing_are_offered_again():
    lengths = np.random.default_rng(2).integers(200, 600, 40)
    n = len(lengths)
    first = pa.table({"doc_id": np.arange(n), "piece": np.zeros(n, np.int32), "start": np.zeros(n, np.int64), "length": lengths, "ids_crc32": np.zeros(n, np.int64), "sequence_id": np.arange(n), "offset": np.zeros(n, np.int64), "loose": np.ones(n, bool)})
    once = packing.packer(0, False, 1024)((pa.scalar(0),), first)
    again = packing.packer(1, False, 1024)((pa.scalar(0),), once)
    bins = len(set(once["sequence_id"].to_pylist()))
    assert bins > packing.lower_bound(np.bincount(lengths, minlength=1025))
    assert again["sequence_id"].to_pylist() == once["sequence_id"].to_pylist()
    assert any(again["loose"].to_pylist())


def test_exchange_keeps_all_pieces_and_tells_its_bound(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 40)
    lengths = np.random.default_rng(2).integers(340, 361, 800)
    pieces = spark.createDataFrame([(i, 0, 0, int(n), 0) for i, n in enumerate(lengths)], packing.PIECES)
    out = packing.pack(pieces)
    rows = out.collect()
    load = collections.Counter()
    for r in rows:
        load[r["sequence_id"]] += r["length"]
    bins, bound = packing.certified(out)
    assert sorted(r["doc_id"] for r in rows) == list(range(800))
    assert len(load) == bins >= bound and max(load.values()) <= 1024
    assert bins < packing.certified(packing.pack(pieces, rounds=1))[0]
