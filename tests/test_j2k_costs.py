"""What the JPEG 2000 coder does once for equal planes and blocks, and that streams stay the same."""

import hashlib

import numpy as np

from tesserae.codecs import jpeg, jpeg2000
from tesserae.codecs.jpeg2000 import blocks, decoder, encoder
from tests.test_codec_costs import calls, grey  # noqa: F401


def test_equal_planes_are_coded_once(calls):
    coded, decoded = calls(encoder, "encode_component"), calls(decoder, "decode_block")
    image = grey(20, 1)
    data = jpeg2000.encode(image)
    assert len(coded) == 1
    assert (jpeg2000.decode(data) == image).all()
    once = len(decoded)
    image[0, 0, 2] ^= 1
    assert (jpeg2000.decode(jpeg2000.encode(image)) == image).all()
    assert len(coded) == 3 and once < len(decoded) - once <= 2 * once


def test_the_size_is_met_in_few_steps(calls):
    tried = calls(encoder, "packets")
    image = np.random.default_rng(4).integers(0, 256, (40, 40, 3)).astype(np.uint8)
    assert len(jpeg2000.encode(image, 6.0)) <= 40 * 40 * 3 / 6
    assert len(tried) <= 12


def test_single_coefficients_against_their_coder():
    for value in (-255, -3, 1, 2, 128):
        for band in range(4):
            got = blocks.encode_block(np.array([[value]]), band)
            assert got == blocks._Encoder(1, 1, band, False).run(np.array([[value]]))
            planes, data, lengths, _ = got
            doubled = blocks.decode_block([(data, len(lengths))], 1, 1, band, planes, 0)[0, 0]
            assert np.sign(doubled) * (abs(doubled) >> 1) == value
    assert blocks.encode_block(np.zeros((3, 2), np.int64), 1) == (0, b"", [], [])


def test_streams_stay_the_same():
    """Fingerprints of the coders before tables, planes and steps were shared."""
    image = np.dstack([np.add.outer(np.arange(70), np.arange(50) * k) % 256 for k in (1, 2, 3)]).astype(np.uint8)
    kinds = [jpeg2000.encode(image), jpeg2000.encode(image, 5.0), jpeg2000.encode(image[..., [0, 0, 0]], 20.0), jpeg.encode(image, 60)]
    assert [hashlib.md5(s).hexdigest()[:12] for s in kinds] == WANT


WANT = ["511898527b2b", "02ee327e3253", "6bc01835fcc9", "8b84099b43c9"]
