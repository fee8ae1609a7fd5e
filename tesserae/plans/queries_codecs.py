"""Catalogue: what codecs store is read back by independent readers, as pixels.

Tiles are those of the virtual slide, 4 x 4 RGBA. For the transform codecs each becomes a flat
image of its first value, which they must give back exactly.
"""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

from tesserae.codecs import flat, jpeg, jpeg2000, raster, strips, webp_reader
from tesserae.codecs.webp import webp
from tesserae.plans.slide import table
from tesserae.sinks.tiff_writer import ImageSpec, LevelSpec, write
from tesserae.sources.slide import open_bytes
from tesserae.sources.bytesource import MemorySource
from tesserae.sources.tiff import read_ifds


def read_png(data: bytes) -> np.ndarray:
    """RGBA of a PNG of 8 bits a channel, not interlaced."""
    at, body, size = 8, b"", (0, 0)
    while at < len(data):
        n, name = struct.unpack(">I4s", data[at : at + 8])
        chunk = data[at + 8 : at + 8 + n]
        if zlib.crc32(name + chunk) != struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("a PNG chunk is damaged")
        size = struct.unpack(">II", chunk[:8]) if name == b"IHDR" else size
        body += chunk if name == b"IDAT" else b""
        at += 12 + n
    w, h = size
    rows = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, 4 * w + 1).astype(int)
    out = np.zeros((h + 1, 4 * w + 4), int)  # a row above and a pixel to the left of the image
    for y in range(h):
        kind = rows[y, 0]
        for i in range(4 * w):
            left, up, corner = out[y + 1, i], out[y, i + 4], out[y, i]
            guess = left + up - corner
            near = min((abs(guess - left), 0, left), (abs(guess - up), 1, up), (abs(guess - corner), 2, corner))[2]
            out[y + 1, i + 4] = (rows[y, i + 1] + (0, left, up, (left + up) // 2, near)[kind]) & 255
    return out[1:, 4:].reshape(h, w, 4).astype(np.uint8)


def read_bmp(data: bytes) -> np.ndarray:
    at, w, h = struct.unpack("<I", data[10:14])[0], *struct.unpack("<ii", data[18:26])
    stride = -(-w * 3 // 4) * 4
    rows = np.frombuffer(data, np.uint8, stride * h, at).reshape(h, stride)[::-1, : 3 * w].reshape(h, w, 3)
    return rows[..., ::-1]


def read_tiff(data: bytes) -> np.ndarray:
    (ifd,) = read_ifds(MemorySource(data))
    at, n = ifd.ints(273)[0], ifd.ints(279)[0]
    return np.frombuffer(data[at : at + n], np.uint8).reshape(ifd.int(257), ifd.int(256), ifd.int(277))


def strip(compression: int, pack: Callable[[bytes], bytes], predictor: int = 1) -> Callable[[np.ndarray], np.ndarray]:
    """A strip of RGBA samples, as a reader of strips gives it."""

    def run(a: np.ndarray) -> np.ndarray:
        samples = strips.apply_predictor(a) if predictor == 2 else a
        return strips.strip_rgba(pack(samples.tobytes()), compression, 4, 4, 4, predictor)

    return run


def in_slide(a: np.ndarray, codec: int) -> np.ndarray:
    """The label image of a slide whose only tile is black: two strips, stored with a codec."""
    pack = {1: bytes, 5: strips.lzw_encode, 8: zlib.compress, 32773: strips.pack_bits}[codec]
    halves = [pack(a[i : i + 2, :, :3].tobytes()) for i in (0, 2)]
    out = io.BytesIO()
    tile = raster.encode_tile(np.zeros((16, 16, 4), np.uint8), raster.JP2K, 16, 90, 0)
    write(out, [LevelSpec(16, 16, 16, 16, raster.JP2K, "x|label")], [[len(tile)]], [tile], [ImageSpec(4, 4, codec, 2, 3, [8, 8, 8], 2, halves, 1, "a label")])
    slide = open_bytes(out.getvalue())
    (image,) = slide.associated
    parts = [(i * 2, 2, slide.source.read(o, n)) for i, (o, n) in enumerate(zip(*image.strip_table()))]
    return raster.stack_strips(parts, image.width, image.height, image.compression, image.samples, image.predictor, None, image.photometric)[..., :3]


def flat_of(a: np.ndarray, side: int) -> np.ndarray:
    out = np.full((side, side, 4), a[0, 0, 0], np.uint8)
    out[..., 3] = 255
    return out


def split_tables(data: bytes) -> tuple[bytes, bytes]:
    """A JPEG as shared tables and an abbreviated stream: its quantiser and Huffman segments apart."""
    at, tables, rest = 2, b"", b""
    while data[at + 1] != 0xDA:
        n = 2 + int.from_bytes(data[at + 2 : at + 4], "big")
        if data[at + 1] in (0xDB, 0xC4):
            tables += data[at : at + n]
        else:
            rest += data[at : at + n]
        at += n
    return b"\xff\xd8" + tables + b"\xff\xd9", b"\xff\xd8" + rest + data[at:]


def shared_tables(a: np.ndarray) -> np.ndarray:
    tables, tile = split_tables(jpeg.encode(flat_of(a, 8), 100))
    return raster.decode_tile(tile, raster.JPEG, 6, tables)[..., :1]


#: Exact on any tile: name to (function of the tile, channels).
EXACT = {
    "png": (lambda a: read_png(flat.png(a)), 4),
    "bmp": (lambda a: read_bmp(flat.bmp(a)), 3),
    "tiff": (lambda a: read_tiff(flat.tiff(a)), 4),
    "webp": (lambda a: webp_reader.read(webp(a)), 4),
    "raw_strip": (strip(1, bytes), 4),
    "deflate_strip": (strip(8, zlib.compress), 4),
    "old_deflate_strip": (strip(32946, zlib.compress), 4),
    "lzw_strip": (strip(5, strips.lzw_encode), 4),
    "lzw_predictor_strip": (strip(5, strips.lzw_encode, 2), 4),
    "packbits_strip": (strip(32773, strips.pack_bits), 4),
    "label_raw": (lambda a: in_slide(a, 1), 3),
    "label_lzw": (lambda a: in_slide(a, 5), 3),
    "label_deflate": (lambda a: in_slide(a, 8), 3),
    "label_packbits": (lambda a: in_slide(a, 32773), 3),
    "j2k_lossless": (lambda a: raster.decode_tile(jpeg2000.encode(a[..., :3]), raster.JP2K)[..., :3], 3),
}

#: Exact on flat images: the decoded image, of which every value is returned.
FLAT = {
    "jpeg": lambda a: jpeg.decode(jpeg.encode(flat_of(a, 9), 100))[..., :1],
    "jpeg_shared_tables": shared_tables,
    "jpeg_halved": lambda a: raster.decode_tile(jpeg.encode(flat_of(a, 16), 100), raster.JPEG, 6, None, 1)[..., :1],
    "j2k_half": lambda a: jpeg2000.decode(jpeg2000.encode(flat_of(a, 8)[..., :3]), 1)[..., :1],
    "j2k_quarter": lambda a: jpeg2000.decode(jpeg2000.encode(flat_of(a, 16)[..., :3]), 2)[..., :1],
    "j2k_lossy": lambda a: jpeg2000.decode(jpeg2000.encode(flat_of(a, 16)[..., :3], 2.0))[..., :1],
    "j2k_edge_tile": lambda a: raster.decode_tile(raster.encode_tile(flat_of(a, 5), raster.JP2K, 16, 90, 0), raster.JP2K)[:5, :5, :1],
}
SIDES = {"jpeg": 9, "jpeg_shared_tables": 8, "jpeg_halved": 8, "j2k_half": 4, "j2k_quarter": 4, "j2k_lossy": 16, "j2k_edge_tile": 5}

#: Pixels of results handed on at a time.
PIXEL_ROWS = 1 << 16
PIXEL = "vec_id bigint, x bigint, y bigint, c bigint, v bigint"


def pixel_rows(tiles: Iterator[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """PIXEL of decoded tiles (vec_id, image), in batches of many tiles: one a tile costs more than what it holds."""
    ids: list[int] = []
    images: list[np.ndarray] = []

    def batch() -> pa.RecordBatch:
        sizes = [a.size for a in images]
        places = [places_of(a.shape) for a in images]
        columns = [np.repeat(np.array(ids, np.int64), sizes), *(np.concatenate(k) for k in zip(*places)), np.concatenate([a.reshape(-1) for a in images]).astype(np.int64)]
        return pa.RecordBatch.from_arrays([pa.array(k) for k in columns], names=["vec_id", "x", "y", "c", "v"])

    waiting = 0
    for i, a in tiles:
        ids.append(i)
        images.append(a)
        waiting += a.size
        if waiting >= PIXEL_ROWS:
            yield batch()
            ids, images, waiting = [], [], 0
    if images:
        yield batch()


@lru_cache(maxsize=16)
def places_of(shape: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """x, y and c of the samples of an image."""
    y, x, c = (i.reshape(-1).astype(np.int64) for i in np.indices(shape))
    return x, y, c


def coded(name: str, decode: Callable[[np.ndarray], np.ndarray]) -> Callable:
    def query(spark, sf_dir):
        def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
            for batch in batches:
                for vec, e in zip(batch.column("vec_id").to_pylist(), batch.column("embedding")):
                    raw = np.clip(np.floor((e.values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.5) * 255), 0, 255).astype(np.uint8)
                    yield vec, decode(raw.reshape(4, 4, 4))

        # coders are slow for their few bytes: tiles are dealt to all cores
        dealt = table(spark, sf_dir, "embeddings").select("vec_id", "embedding").repartition(spark.sparkContext.defaultParallelism, "vec_id")
        return dealt.mapInArrow(lambda batches: pixel_rows(tiles(batches)), PIXEL)

    query.__name__ = f"codec_{name}"
    return query


_V = "CAST(least(greatest(floor((CAST(e AS DOUBLE) + 0.5) * 255), 0), 255) AS BIGINT)"


def exact_sql(name: str, channels: int) -> str:
    return f"SELECT CAST(vec_id AS BIGINT) AS vec_id, k // 4 % 4 AS x, k // 16 AS y, k % 4 AS c, {_V} AS v FROM (SELECT vec_id, unnest(embedding) AS e, unnest(range(0, 64)) AS k FROM embeddings) WHERE k % 4 < {channels}"


def flat_sql(name: str) -> str:
    n = SIDES[name]
    return f"SELECT CAST(vec_id AS BIGINT) AS vec_id, k % {n} AS x, k // {n} AS y, CAST(0 AS BIGINT) AS c, {_V} AS v FROM (SELECT vec_id, embedding[1] AS e, unnest(range(0, {n * n})) AS k FROM embeddings)"


QUERIES = {f"codec_{name}": (coded(name, decode), exact_sql(name, channels)) for name, (decode, channels) in EXACT.items()}
QUERIES |= {f"codec_{name}": (coded(name, decode), flat_sql(name)) for name, decode in FLAT.items()}
