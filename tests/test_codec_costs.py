"""What the JPEG coder and the codec queries do once for many tiles."""

import numpy as np
import pyarrow as pa
import pytest

from tesserae.codecs import jpeg
from tesserae.plans import queries_codecs


@pytest.fixture
def calls(monkeypatch):
    """Counts the calls of a function of a module."""

    def count(module, name: str) -> list:
        seen, f = [], getattr(module, name)
        monkeypatch.setattr(module, name, lambda *a: seen.append(a) or f(*a))
        return seen

    return count


def grey(n: int, seed: int) -> np.ndarray:
    return np.repeat(np.random.default_rng(seed).integers(0, 256, (n, n, 1)), 3, 2).astype(np.uint8)


def test_jpeg_tables_are_made_once_for_all_tiles(calls):
    made = calls(jpeg, "huffman_codes")
    streams = [jpeg.encode(grey(16, i), 77) for i in range(20)]
    before = len(made)
    assert before <= 4
    for s in streams:
        jpeg.decode(s)
    assert len(made) <= before + 4


def test_a_table_with_too_many_codes_stays_one_of_16_bits():
    table = jpeg._decoding_table(bytes([3, *[0] * 15]), bytes([7, 8, 9]))
    assert len(table) == 1 << 16 and table[0] == 1 << 8 | 7 and table[-1] == 1 << 8 | 8


def test_pixels_come_in_large_batches():
    tiles = [(i, np.full((9, 9, 1), i % 251, np.uint8)) for i in range(3000)]
    got = list(queries_codecs.pixel_rows(iter(tiles)))
    assert len(got) <= 4 and all(b.num_rows < queries_codecs.PIXEL_ROWS + 81 for b in got)
    t = pa.Table.from_batches(got).to_pydict()
    assert t["vec_id"][81 * 7 : 81 * 8] == [7] * 81 and t["v"][81 * 300] == 300 % 251 and len(t["v"]) == 81 * 3000
    assert (t["x"][10], t["y"][10], t["c"][10]) == (1, 1, 0)
    assert list(queries_codecs.pixel_rows(iter([]))) == []
