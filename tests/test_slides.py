"""Slide files: written by our own writer, read by the sources, cropped and rebuilt."""

import io
import struct

import numpy as np
import pytest

from tesserae.codecs import jpeg, jpeg2000, raster, strips
from tesserae.errors import SlideFormatError, UnsupportedCompressionError
from tesserae.functions.adjust import Adjustments
from tesserae.operators import slides
from tesserae.sinks.tiff_writer import ImageSpec, LevelSpec, write
from tesserae.sources.datasource import register
from tesserae.sources.slide import open_bytes, open_slide
from tesserae.sources.tiff import TYPES

TEXT = "Aperio Image Library v11.2.1\r\n800x600 [0,0 800x600] (256x256) JPEG/RGB Q=30|AppMag = 20|MPP = 0.4990|Left = 3|User = me"


def picture(w, h):
    y, x = np.mgrid[:h, :w]
    return np.dstack((x % 256, y % 256, (x + y) // 2 % 256, np.full_like(x, 255))).astype(np.uint8)


def make(path, w=300, h=200, tile=64, codec=7, sparse=(), label=True):
    image = picture(w, h)
    data = []
    for ty in range(-(-h // tile)):
        for tx in range(-(-w // tile)):
            part = image[ty * tile : (ty + 1) * tile, tx * tile : (tx + 1) * tile]
            data.append(b"" if (tx, ty) in sparse else raster.encode_tile(part, codec, tile, 95, 0))
    spec = LevelSpec(w, h, tile, tile, codec, TEXT)
    tag = picture(20, 12)[..., :3]
    coded = strips.lzw_encode(strips.apply_predictor(tag).tobytes())
    images = [ImageSpec(20, 12, 5, 2, 3, [8, 8, 8], 12, [coded], 2, "my label")] if label else []
    with open(path, "wb") as f:
        write(f, [spec], [[len(d) for d in data]], data, images)
    return image


def classic(order, ifds):
    """A classic TIFF of (tag, type, values) entries."""
    out, at = bytearray(struct.pack(order + "2sHI", b"II" if order == "<" else b"MM", 42, 8)), 8
    for i, tags in enumerate(ifds):
        body, blobs, place = b"", b"", at + 2 + 12 * len(tags) + 4
        for tag, kind, values in tags:
            raw = values if isinstance(values, bytes) else np.array(values, order + TYPES[kind][0]).tobytes()
            n = len(raw) // (int(TYPES[kind][0][1]) * TYPES[kind][1])
            body += struct.pack(order + "HHI", tag, kind, n)
            if len(raw) <= 4:
                body += raw.ljust(4, b"\0")
            else:
                body += struct.pack(order + "I", place + len(blobs))
                blobs += raw + b"\0" * (len(raw) & 1)
        end = place + len(blobs)
        out += struct.pack(order + "H", len(tags)) + body + struct.pack(order + "I", end if i + 1 < len(ifds) else 0) + blobs
        at = end
    return bytes(out)


LEVEL = [(256, 4, [800]), (257, 4, [600]), (259, 3, [7]), (270, 2, TEXT.encode() + b"\0"), (322, 4, [256]), (323, 4, [256]), (324, 4, [0] * 12), (325, 4, [0] * 12)]


@pytest.mark.parametrize("order", ["<", ">"])
def test_classic_tiff(order):
    s = open_bytes(classic(order, [LEVEL, [(256, 4, [30]), (257, 4, [20]), (270, 2, b"label macro\0"), (282, 5, [72, 1])]]))
    lv = s.levels[0]
    assert (lv.width, lv.height, lv.tiles_x, lv.tiles_y, lv.photometric, lv.downsample) == (800, 600, 4, 3, -1, 1.0)
    assert s.tile_bytes(0, 3, 2) == b"" and s.description == TEXT
    a = s.associated[0]
    assert (a.kind, a.compression, a.bits, a.decodable) == ("macro", 0, [1], False)
    assert a.ifd.value(282) == [(72, 1)]


def test_damaged_files():
    for data, error in (
        (b"II*\0", SlideFormatError),
        (b"XX*\0\0\0\0\0", SlideFormatError),
        (classic("<", [[(256, 4, [1]), (257, 4, [1])]]), SlideFormatError),
        (classic("<", [[*LEVEL[:2], (259, 3, [6]), *LEVEL[4:]]]), UnsupportedCompressionError),
    ):
        with pytest.raises(error):
            open_bytes(data)
    looped = bytearray(classic("<", [LEVEL]))
    n = struct.unpack_from("<H", looped, 8)[0]
    struct.pack_into("<I", looped, 10 + 12 * n, 8)
    with pytest.raises(SlideFormatError, match="cycle"):
        open_bytes(bytes(looped))
    short = open_bytes(classic("<", [[*LEVEL[:6], (324, 4, [0]), (325, 4, [0])]]))
    with pytest.raises(SlideFormatError):
        short.levels[0].tile_table()


def test_opening_reads_little(tmp_path):
    make(f"{tmp_path}/a.svs", 2000, 2000, 256)
    s = open_slide(f"{tmp_path}/a.svs")
    assert s.source.bytes_read < 2500
    s.close()


def test_sources(spark, tmp_path):
    make(f"{tmp_path}/a.svs", sparse={(1, 1)})
    make(f"{tmp_path}/b.svs", codec=33005, w=130, h=70, label=False)
    register(spark)
    read = lambda t: spark.read.format(t).load(str(tmp_path))
    levels = {r["slide_id"][-5:]: r for r in read("slide_levels").collect()}
    assert levels["a.svs"]["tiles_x"] == 5 and levels["b.svs"]["compression"] == 33005 and levels["a.svs"]["description"] == TEXT
    index = read("slide_tile_index").where("byte_count = 0").collect()
    assert [(r["tx"], r["ty"]) for r in index] == [(1, 1)]
    tiles = read("slide_tiles").where("tx = 1 and level = 0").collect()
    assert {r["tx"] for r in tiles} == {1} and sum(r["data"] is None for r in tiles) == 1
    tags = read("slide_tags").where("tag_id = 256").collect()
    assert sorted(r["value"]["ints"][0] for r in tags) == [20, 130, 300] and tags[0]["tag_name"] == "ImageWidth"
    image = slides.associated_images(spark, f"{tmp_path}/a.svs").collect()[0]
    assert image["kind"] == "label" and bytes(image["rgba"]) == picture(20, 12).tobytes()


def test_regions(spark, tmp_path):
    path = f"{tmp_path}/a.svs"
    image = make(path, codec=33005, sparse={(0, 0)})
    image[:64, :64] = 0
    raw = slides.export_region(spark, path, 0, -5, 30, 150, 100, kind=None)
    want = np.zeros((100, 150, 4), np.uint8)
    want[:, 5:] = image[30:130, :145]
    assert raw == want.tobytes()
    over = slides.export_region(spark, path, 0, 250, 150, 100, 100, kind=None, adjustments=Adjustments(brightness=0.25))
    assert len(over) == 40000
    with pytest.raises(Exception, match="outside"):
        slides.export_region(spark, path, 0, 400, 0, 10, 10)
    with pytest.raises(ValueError):
        slides.export_region(spark, path, 0, 0, 0, 10, 10, max_pixels=50)
    with pytest.raises(ValueError):
        raster.encode_image(image, "jpeg", 0)


@pytest.mark.parametrize("tile", [32, 25])
def test_pyramid(spark, tmp_path, tile):
    path = f"{tmp_path}/a.svs"
    image = make(path, 200, 170, 64, 33005)
    data = slides.to_bytes(slides.export_pyramid, spark, path, f"file://{tmp_path}/w", x=10, y=20, width=150, height=130, encoding=slides.Encoding(33005, ratio=0), tile=tile)
    s = open_bytes(data)
    sizes = slides.pyramid_sizes(150, 130, tile)
    assert [(v.width, v.height) for v in s.levels] == sizes
    want = image[20:150, 10:160]
    for v in s.levels:
        got = np.zeros((v.height, v.width, 3), np.uint8)
        for ty in range(v.tiles_y):
            for tx in range(v.tiles_x):
                raster.paste(got, jpeg2000.decode(s.tile_bytes(v.index, tx, ty)), tx * tile, ty * tile)
        assert (got == want[..., :3]).all()
        bands = [raster.halve(want[k : k + tile]) for k in range(0, len(want), tile)]
        want = np.concatenate(bands)
    meta = slides.metadata_entries(s.description)
    assert meta["AppMag"] == "20" and meta["MPP"] == "0.4990" and meta["User"] == "me" and "Left" not in meta
    assert [a.kind for a in s.associated] == ["thumbnail", "label"]
    offsets = [o for v in s.levels for o in v.tile_table()[0]]
    assert all(o % 2 == 0 for o in offsets)


def test_preserving_and_in_place(spark, tmp_path):
    path = f"{tmp_path}/a.svs"
    make(path, 200, 170, 64)
    data = slides.to_bytes(slides.export_preserving, spark, path, f"file://{tmp_path}/w", level=0, x=-5, y=40, width=100, height=500)
    lv = open_bytes(data).levels[0]
    assert (lv.width, lv.height) == (100, 130)
    slides.rebuild_in_place(spark, path, f"file://{tmp_path}/w2", level_count=2)
    s = open_slide(path)
    assert [(v.width, v.height, v.tile_w) for v in s.levels] == [(200, 170, 64), (100, 85, 64)] and "Q=30" in s.description
    with pytest.raises(ValueError):
        slides.export_pyramid(spark, path, io.BytesIO(), f"file://{tmp_path}/w3", y=0, height=400, tile=64)


def test_jpeg_surgery():
    whole = jpeg.encode(picture(16, 16))
    assert jpeg.splice_tables(None, whole) == whole
    assert jpeg.splice_tables(b"\xff\xd8TT\xff\xd9", b"\xff\xd8xx") == b"\xff\xd8TTxx"
    marked = jpeg.decode(jpeg.mark_rgb(whole))
    assert np.abs(marked.astype(int) - jpeg.decode(whole)).max() > 20


def test_composites(spark, tmp_path):
    path = f"{tmp_path}/a.svs"
    image = make(path, 200, 170, 64, 33005, sparse={(0, 0)})
    image[:64, :64] = 0
    register(spark)
    tiles = slides.decode_tiles(spark.read.format("slide_tiles").load(path))
    got = {(r["tx"], r["ty"]): r for r in slides.composites(tiles, 1, 1, 64, 64).collect()}
    assert set(got) == {(0, 0), (1, 0), (0, 1), (1, 1)}
    first = slides.array(got[0, 0]["width"], got[0, 0]["height"], bytes(got[0, 0]["rgba"]))
    assert first.shape[:2] == (64, 64) and (first[32:, :] == raster.resize(image[64:128, :128], 64, 32)).all() and not first[:32, :32].any()


def test_disk_cache(spark, tmp_path):
    from tesserae.operators.disk_cache import DiskTileCache, listing

    tile = picture(5, 4)
    c = DiskTileCache(f"{tmp_path}/c", max_bytes=200)
    c.put(0, 1, 2, tile)
    c.put(0, 2, 2, tile)
    assert (c.get(0, 1, 2) == tile).all() and c.get(9, 9, 9) is None
    c.put(0, 3, 2, tile)  # 88 bytes a tile: the least recent goes
    assert c.get(0, 2, 2) is None and c.bytes == 176
    again = DiskTileCache(f"{tmp_path}/c", max_bytes=100)
    assert again.bytes == 88
    assert [(r["level"], r["ty"], r["size"]) for r in listing(spark, f"{tmp_path}/c").collect()] == [(0, 2, 88)]
