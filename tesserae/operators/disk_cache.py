"""A folder of decoded tiles under a byte budget, least recently used first out.

A file holds width and height as little-endian 32-bit integers, then RGBA; its name is
L{level}_X{tx}_Y{ty}.tile. Composites of several tiles are not kept here: names have no span.
"""

from __future__ import annotations

import hashlib
import os
import struct
from collections import OrderedDict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tesserae.codecs import raster
from tesserae.errors import SlideError
from tesserae.sources.slide import open_slide

NAME = r"L(\d+)_X(\d+)_Y(\d+)\.tile$"
DEFAULT_BYTES = 500 << 20


class DiskTileCache:
    def __init__(self, folder: str, max_bytes: int = DEFAULT_BYTES):
        self.folder, self.max_bytes = folder, max_bytes
        os.makedirs(folder, exist_ok=True)
        found = [(e.stat().st_mtime_ns, e.name, e.stat().st_size) for e in os.scandir(folder) if e.is_file() and e.name.endswith(".tile")]
        self.files: OrderedDict[str, int] = OrderedDict((name, size) for _, name, size in sorted(found))
        self.bytes = sum(self.files.values())
        self._evict(None)

    def _evict(self, keep: str | None) -> None:
        while self.bytes > self.max_bytes:
            name = next(iter(self.files), keep)
            if name == keep:  # the most recent one stands last
                return
            self._forget(name)
            try:
                os.remove(os.path.join(self.folder, name))
            except OSError:
                pass

    def _forget(self, name: str) -> None:
        self.bytes -= self.files.pop(name, 0)

    def put(self, level: int, tx: int, ty: int, rgba: np.ndarray) -> None:
        name = f"L{level}_X{tx}_Y{ty}.tile"
        data = struct.pack("<II", rgba.shape[1], rgba.shape[0]) + rgba.tobytes()
        path = os.path.join(self.folder, name)
        with open(f"{path}.part", "wb") as f:
            f.write(data)
        os.replace(f"{path}.part", path)
        self._forget(name)
        self.files[name] = len(data)
        self.bytes += len(data)
        self._evict(name)

    def get(self, level: int, tx: int, ty: int) -> np.ndarray | None:
        """A tile, which becomes the most recent; any failure is a miss."""
        name = f"L{level}_X{tx}_Y{ty}.tile"
        try:
            with open(os.path.join(self.folder, name), "rb") as f:
                data = f.read()
            w, h = struct.unpack("<II", data[:8])
            out = np.frombuffer(data[8:], np.uint8).reshape(h, w, 4)
            os.utime(os.path.join(self.folder, name))
        except (OSError, ValueError, struct.error):
            self._forget(name)
            return None
        self._forget(name)
        self.files[name] = len(data)
        self.bytes += len(data)
        return out


def load(requests: DataFrame, folder: str, max_bytes: int = DEFAULT_BYTES) -> DataFrame:
    """Tiles (slide_id, level, tx, ty, reduction, landed, width, height, rgba, origin) of requests (slide_id, level, tx, ty, reduction, visible).

    From the disk cache, where one at full resolution is asked for, else from the slide; visible
    ones at full resolution are then kept on disk. origin is disk, slide, or sparse; a tile that
    cannot be read has origin error and no raster. One task serves a slide, whose folder below
    `folder` it alone writes to.
    """

    def run(key: tuple, group: pa.Table) -> pa.Table:
        path, rows = key[0].as_py(), []
        cache = DiskTileCache(os.path.join(folder, hashlib.sha256(path.encode()).hexdigest()[:16]), max_bytes)
        slide = open_slide(path)
        tables: dict = {}
        for r in group.sort_by([("level", "ascending"), ("ty", "ascending"), ("tx", "ascending")]).to_pylist():
            level, tx, ty, reduction = r["level"], r["tx"], r["ty"], r["reduction"]
            image, origin, landed = (cache.get(level, tx, ty) if not reduction else None), "disk", 0
            if image is None:
                try:
                    v = slide.levels[level]
                    if level not in tables:
                        tables[level] = v.ifd.raw(347)
                    data = slide.tile_bytes(level, tx, ty)
                    image = raster.decode_tile(data, v.compression, v.photometric, tables[level], reduction) if data else None
                    origin, landed = "slide" if data else "sparse", reduction
                except (SlideError, IndexError, KeyError, ValueError):
                    origin = "error"
                if image is not None and r["visible"] and not reduction:
                    cache.put(level, tx, ty, image)
            size = (None, None, None) if image is None else (image.shape[1], image.shape[0], image.tobytes())
            rows.append((path, level, tx, ty, reduction, landed, *size, origin))
        slide.close()
        kinds = [pa.string(), *[pa.int32()] * 7, pa.binary(), pa.string()]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[f.split()[0] for f in LOADED.split(", ")])

    return requests.select("slide_id", "level", "tx", "ty", "reduction", "visible").groupBy("slide_id").applyInArrow(run, LOADED)


LOADED = "slide_id string, level int, tx int, ty int, reduction int, landed int, width int, height int, rgba binary, origin string"


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """(level, tx, ty, size, used) of a cache folder, as a table for the eviction operator."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tile").load(folder).select("path", "modificationTime", "length")
    part = lambda i: F.regexp_extract("path", NAME, i).cast("int")
    return files.where(F.col("path").rlike(NAME)).select(part(1).alias("level"), part(2).alias("tx"), part(3).alias("ty"), F.col("length").alias("size"), F.col("modificationTime").alias("used"))
