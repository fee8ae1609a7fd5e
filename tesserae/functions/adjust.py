"""Brightness, contrast, shadows and highlights as one affine map per channel."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, functions as F


def _unit(v: float) -> float:
    return min(1.0, max(-1.0, v))


@dataclass(frozen=True)
class Adjustments:
    """Each in [-1, 1]; 0 leaves the image as it is."""

    brightness: float = 0.0
    contrast: float = 0.0
    shadows: float = 0.0
    highlights: float = 0.0

    @property
    def is_identity(self) -> bool:
        return self.brightness == self.contrast == self.shadows == self.highlights == 0

    def affine(self) -> tuple[float, float]:
        black = _unit(self.shadows) * 0.3
        white = 1.0 - _unit(self.highlights) * 0.3
        gain = 1.0 + _unit(self.contrast)
        return (white - black) * gain, ((black - 0.5) * gain + 0.5 + _unit(self.brightness) * 0.5) * 255

    def matrix(self) -> list[float] | None:
        """The map as a 4 x 5 colour matrix; None for the identity."""
        if self.is_identity:
            return None
        slope, shift = self.affine()
        rows = [[slope if i == c else 0.0 for i in range(4)] + [shift] for c in range(3)]
        return sum(rows, []) + [0.0, 0.0, 0.0, 1.0, 0.0]

    def column(self, v: Column, channel: Column) -> Column:
        """v (0 to 255) adjusted, alpha (channel 3) untouched."""
        if self.is_identity:
            return v
        slope, shift = self.affine()
        moved = F.round(F.least(F.greatest(v * slope + shift, F.lit(0.0)), F.lit(255.0)))
        return F.when(channel == 3, v.cast("long")).otherwise(moved.cast("long"))

    def table(self) -> np.ndarray:
        """Adjusted value of each byte."""
        slope, shift = self.affine()
        return np.floor(np.clip(np.arange(256) * slope + shift, 0, 255) + 0.5).astype(np.uint8)

    def apply(self, rgba: np.ndarray) -> np.ndarray:
        """A raster (height, width, 4) adjusted."""
        if self.is_identity:
            return rgba
        out = rgba.copy()
        out[..., :3] = self.table()[rgba[..., :3]]
        return out
