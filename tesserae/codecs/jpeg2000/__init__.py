"""JPEG 2000 Part 1 codestreams (ITU-T T.800): decoder and encoder in numpy and Python."""

from tesserae.codecs.jpeg2000.decoder import decode
from tesserae.codecs.jpeg2000.encoder import encode

__all__ = ["decode", "encode"]
