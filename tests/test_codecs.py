"""Codecs against independent readers, round trips and seeded inverses."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from tesserae.codecs import flat, jpeg, jpeg2000, raster, strips
from tesserae.codecs.jpeg2000 import wavelet
from tesserae.codecs.jpeg2000.arith import HeaderReader, HeaderWriter, MqDecoder, MqEncoder, TagTree, fresh_contexts
from tesserae.codecs.jpeg2000.blocks import decode_block, encode_block
from tesserae.codecs.webp import webp
from tesserae.errors import SlideFormatError, UnsupportedCompressionError
from tesserae.codecs import webp_reader


def image(w, h, seed=0, alpha=False):
    rnd = np.random.default_rng(seed)
    y, x = np.mgrid[:h, :w]
    a = np.dstack(((x * 3) % 256, (y * 5) % 256, (x + y) % 256, np.full_like(x, 255))).astype(np.uint8)
    a[:, w // 3 : 2 * w // 3, :3] = 77
    a[:, 2 * w // 3 :, :3] = rnd.integers(0, 256, a[:, 2 * w // 3 :, :3].shape)
    if alpha:
        a[..., 3] = (x * 7) % 256
    return a


SIZES = [(1, 1), (5, 3), (16, 16), (37, 23), (130, 70)]


def java_pixels(spark, path, w, h):
    jvm = spark._jvm
    im = jvm.javax.imageio.ImageIO.read(jvm.java.io.File(str(path)))
    assert (im.getWidth(), im.getHeight()) == (w, h)
    rgb = np.array(list(im.getRGB(0, 0, w, h, None, 0, w)), np.int64).reshape(h, w)
    return np.dstack([(rgb >> s) & 255 for s in (16, 8, 0, 24)]).astype(np.uint8)


@pytest.mark.parametrize("size", SIZES)
def test_flat_formats_against_imageio(spark, tmp_path, size):
    a = image(*size, alpha=True)
    (tmp_path / "a.png").write_bytes(flat.png(a))
    assert (java_pixels(spark, tmp_path / "a.png", *size) == a).all()
    for kind in ("bmp", "tiff"):
        opaque = image(*size)
        (tmp_path / f"a.{kind}").write_bytes(getattr(flat, kind)(opaque))
        assert (java_pixels(spark, tmp_path / f"a.{kind}", *size)[..., :3] == opaque[..., :3]).all()


@pytest.mark.parametrize("size", SIZES)
def test_webp(size):
    for a in (image(*size, alpha=True), image(*size), np.zeros((size[1], size[0], 4), np.uint8)):
        assert (webp_reader.read(webp(a)) == a).all()
    with pytest.raises(ValueError):
        webp(np.zeros((1, 16384, 4), np.uint8))


@pytest.mark.parametrize("size", SIZES)
def test_jpeg_against_imageio(spark, tmp_path, size):
    a = image(*size)
    a[..., :3] = a[..., :3] // 64 * 8 + 90
    data = jpeg.encode(a, 92)
    (tmp_path / "a.jpg").write_bytes(data)
    theirs, ours = java_pixels(spark, tmp_path / "a.jpg", *size), jpeg.decode_rgba(data)
    assert np.abs(theirs.astype(int) - ours)[..., :3].max() <= 3
    assert np.abs(a.astype(int) - ours)[..., :3].mean() < 4


def test_progressive_jpeg(spark, tmp_path):
    a = image(48, 40)
    a[..., :3] = a[..., :3] // 64 * 8 + 90
    (tmp_path / "a.bmp").write_bytes(flat.bmp(a))
    io = spark._jvm.javax.imageio
    writer = io.ImageIO.getImageWritersByFormatName("jpeg").next()
    p = writer.getDefaultWriteParam()
    p.setProgressiveMode(1)
    out = io.ImageIO.createImageOutputStream(spark._jvm.java.io.File(f"{tmp_path}/p.jpg"))
    writer.setOutput(out)
    writer.write(None, io.IIOImage(io.ImageIO.read(spark._jvm.java.io.File(f"{tmp_path}/a.bmp")), None, None), p)
    out.close()
    data = (tmp_path / "p.jpg").read_bytes()
    assert b"\xff\xc2" in data
    assert np.abs(jpeg.decode_rgba(data).astype(int) - a)[..., :3].mean() < 6


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=3000))
def test_strip_codecs(data):
    assert strips.lzw_decode(strips.lzw_encode(data), len(data)) == data
    assert strips.unpack_bits(strips.pack_bits(data), len(data)) == data
    assert strips.decompress(zlib.compress(data), 8, len(data)) == data


def test_strip_errors():
    with pytest.raises(SlideFormatError):
        strips.decompress(b"abc", 1, 4)
    with pytest.raises(SlideFormatError):
        strips.decompress(b"not zlib", 8, 4)
    with pytest.raises(UnsupportedCompressionError):
        strips.decompress(b"", 99, 0)
    a = image(9, 7)[..., :3]
    assert (strips.undo_predictor(strips.apply_predictor(a)) == a).all()
    with pytest.raises(SlideFormatError):
        strips.to_rgba(a[..., :2])


def test_resize_and_halve():
    a = np.array([[[1, 2, 3, 255]] * 2 + [[11, 12, 13, 255]] * 2, [[5, 6, 7, 255]] * 2 + [[15, 16, 17, 255]] * 2], np.uint8)
    assert raster.resize(a, 2, 1).tolist() == [[[3, 4, 5, 255], [13, 14, 15, 255]]]
    assert raster.resize(a, 8, 2)[:, ::2].tolist() == a.tolist()
    assert raster.halve(a[:, :3]).tolist() == [[[3, 4, 5, 255], [13, 14, 15, 255]]]


def test_associated_strips():
    good = jpeg.encode(image(20, 8))
    out = raster.stack_strips([(0, 8, b"broken"), (8, 8, good)], 20, 16, 7, 3, 1, None, 6)
    assert not out[:8].any() and out[8:, :, 3].all()
    with pytest.raises(Exception, match="no strip"):
        raster.stack_strips([(0, 8, b"broken")], 20, 8, 7, 3, 1, None, 6)
    with pytest.raises(SlideFormatError):
        raster.stack_strips([(0, 8, b"x")], 20, 8, 1, 3, 1, None, 2)


# ---- JPEG 2000 ----


@pytest.mark.parametrize("shape", [(1, 1, 1), (1, 7, 3), (5, 3, 4), (48, 64, 3), (37, 29, 3), (70, 100, 1)])
def test_j2k_lossless(shape):
    rnd = np.random.default_rng(1)
    y, x = np.mgrid[: shape[0], : shape[1]]
    a = np.clip((128 + 60 * np.sin(x / 5) * np.cos(y / 7) + rnd.normal(0, 8, (shape[0], shape[1])))[..., None] + np.arange(shape[2]) * 9, 0, 255).astype(np.uint8)
    data = jpeg2000.encode(a)
    assert (jpeg2000.decode(data) == a).all()
    if min(shape[:2]) > 8:
        small = jpeg2000.decode(data, 2)
        assert small.shape[:2] == tuple((n + 3) // 4 for n in shape[:2])
        assert abs(small.mean() - a.mean()) < 6


def test_j2k_ratio():
    rnd = np.random.default_rng(1)
    y, x = np.mgrid[:96, :96]
    a = np.clip((128 + 60 * np.sin(x / 9) * np.cos(y / 11) + rnd.normal(0, 4, (96, 96)))[..., None] + np.arange(3) * 20, 0, 255).astype(np.uint8)
    last = 99.0
    for ratio in (3, 8, 25):
        data = jpeg2000.encode(a, ratio)
        psnr = 10 * np.log10(65025 / ((jpeg2000.decode(data).astype(float) - a) ** 2).mean())
        assert len(data) <= a.size / ratio + 1 and 30 < psnr < last
        last = psnr


def test_j2k_damaged():
    data = jpeg2000.encode(image(40, 30)[..., :3])
    for cut in (len(data) // 2, len(data) - 10):
        assert jpeg2000.decode(data[:cut]).shape == (30, 40, 3)
    for bad in (b"", b"\xff\x4f", data[:40]):
        with pytest.raises(SlideFormatError):
            jpeg2000.decode(bad)
    with pytest.raises(SlideFormatError):
        jpeg2000.decode(data, 9)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 18), st.integers(0, 1)), max_size=400))
def test_mq_inverse(decisions):
    coder, contexts = MqEncoder(), fresh_contexts()
    for c, d in decisions:
        coder.bit(contexts, c, d)
    decoder, contexts = MqDecoder(coder.flush()), fresh_contexts()
    assert [decoder.bit(contexts, c) for c, _ in decisions] == [d for _, d in decisions]


@settings(max_examples=25, deadline=None)
@given(st.integers(1, 20), st.integers(1, 20), st.integers(0, 3), st.integers(0, 1 << 30))
def test_block_inverse(w, h, band, seed):
    rnd = np.random.default_rng(seed)
    a = rnd.integers(-300, 300, (h, w)) * (rnd.random((h, w)) < 0.4)
    planes, data, lengths, _ = encode_block(a, band)
    if planes:
        got = decode_block([(data, len(lengths))], w, h, band, planes, 0)
        assert (np.sign(got) * (np.abs(got) >> 1) == a).all()
    else:
        assert not a.any()


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 30), st.integers(1, 30), st.booleans(), st.integers(0, 99))
def test_wavelet_inverse(w, h, reversible, seed):
    a = np.random.default_rng(seed).integers(-128, 128, (h, w))
    a = a if reversible else a.astype(float)
    back = wavelet.inverse(wavelet.forward(a, reversible), 0, 0, w, h, reversible)
    assert (back == a).all() if reversible else np.allclose(back, a)


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 6), st.integers(1, 6), st.integers(0, 99))
def test_tag_tree_and_header(w, h, seed):
    values = np.random.default_rng(seed).integers(0, 6, w * h).tolist()
    out, tree = HeaderWriter(), TagTree(w, h)
    tree.set(values)
    for i in range(w * h):
        tree.write(out, i % w, i // w, values[i] + 1)
        out.passes(1 + values[i] * 31)
    read, tree = HeaderReader(out.end() + b"\0\0", 0), TagTree(w, h)
    for i, v in enumerate(values):
        n = 1
        while not tree.read(read, i % w, i // w, n):
            n += 1
        assert n - 1 == v and read.passes() == 1 + v * 31


def test_png_bands_do_not_show(monkeypatch):
    from tesserae.codecs import flat
    from tesserae.plans.queries_codecs import read_png

    a = np.random.default_rng(6).integers(0, 256, (23, 9, 4)).astype(np.uint8)
    whole = flat.png(a)
    monkeypatch.setattr(flat, "BAND_BYTES", 100)
    assert (read_png(flat.png(a)) == a).all() and (read_png(whole) == a).all()
