"""What Python workers hold beside the JVM: while a chunk is read, and after a task."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from tesserae.llm import anchors, packing, textblocks
from tesserae.llm.queries_packing import tokenizer_path
from tesserae.llm.suffix import LENGTH


def resident():
    with open("/proc/self/statm") as f:
        return int(f.read().split()[1]) * 4096


def test_a_chunk_holds_the_prefixes_of_one_block():
    rnd = random.Random(3)
    texts = [" ".join(f"w{rnd.randint(0, 30000)}" for _ in range(1000)) for _ in range(640)]
    group = pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": texts, "chunk": pa.array([0] * len(texts), pa.int32())})
    total = sum(map(len, texts))
    assert total > 12 * textblocks.BLOCK
    scheme = anchors.Scheme(LENGTH, words=False)
    anchors.read_chunk(group.slice(0, 64), scheme)  # tables of powers are kept
    tracemalloc.start()
    try:
        c = anchors.read_chunk(group, scheme)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(c.symbols) > 12 and not any(len(s.prefix) for s in c.symbols)
    assert peak < 9 * total  # the prefixes of all blocks alone are 8


def test_the_library_is_loaded_only_for_long_white_space(monkeypatch):
    import tokenizers

    loads = []

    class Counted:
        @staticmethod
        def from_file(path):
            loads.append(path)
            return real(path)

    real = tokenizers.Tokenizer.from_file
    monkeypatch.setattr(tokenizers, "Tokenizer", Counted)
    encode = packing.encoder.__wrapped__(tokenizer_path())
    want = real(tokenizer_path())
    assert encode("some words <|endoftext|>") == want.encode("some words <|endoftext|>", add_special_tokens=False).ids and not loads
    long = "a" + " " * (packing.LONG_RUN + 1) + "b"
    for _ in range(2):
        assert encode(long) == want.encode(long, add_special_tokens=False).ids
    assert len(loads) == 1


@pytest.mark.skipif(textblocks._trimmer() is None, reason="malloc_trim is glibc's")
def test_freed_memory_goes_back_after_a_task():
    def run(batches):
        for batch in batches:
            held = [np.ones(12_000) for _ in range(1000)]  # 96 MB in pieces too small to be mapped
            pins.append([np.ones(10) for _ in range(1000)] + held[-1:])  # at the top, so that nothing below goes by itself
            yield batch

    pins, batch = [], pa.record_batch({"x": [1, 2]})
    textblocks.release()
    before = resident()
    assert list(textblocks.releasing(run)(iter([batch]))) == [batch]
    assert resident() - before < 30e6
    assert textblocks.released(lambda a, b: a + b, 1, 2) == 3
