"""Errors of the slide sources and codecs."""


class SlideError(Exception):
    """Base of all slide errors."""


class SlideFormatError(SlideError):
    """The file is not a slide, or is damaged."""


class UnsupportedCompressionError(SlideError):
    """A compression that no codec here reads."""

    def __init__(self, compression: int, message: str = ""):
        super().__init__(message or f"unsupported compression {compression}")
        self.compression = compression


class TileReadError(SlideError):
    """A tile or strip could not be read."""
