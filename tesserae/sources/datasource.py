"""Slides as Spark data sources.

spark.read.format("slide_levels").load("/slides/*.svs"), and likewise slide_tags, slide_tile_index,
slide_tiles, slide_associated and slide_strips. Tables are separate so that choosing one is the
column pruning: an index is read without pixels. Filters on slide_id, level, tag_id and tile
places are pushed into the readers where spark.sql.python.filterPushdown.enabled is true.
Option mode: FAILFAST (default), or PERMISSIVE, in which a value that cannot be read has an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from tesserae.errors import SlideError
from tesserae.functions.metadata import TAG_NAMES
from tesserae.session import reachable
from tesserae.sources.bytesource import expand
from tesserae.sources.slide import Slide, open_slide
from tesserae.sources.tiff import Ifd

VALUE = "struct<ints: array<bigint>, rationals: array<struct<num: bigint, den: bigint>>, floats: array<double>, text: string, raw: binary, error: string>"
SCHEMAS = {
    "slide_tags": f"slide_id string, ifd_index int, tag_id int, tag_name string, tiff_type int, count bigint, value {VALUE}",
    "slide_levels": "slide_id string, level int, ifd_index int, width bigint, height bigint, tile_w int, tile_h int, compression int, photometric int, downsample double, tiles_x int, tiles_y int, description string",
    "slide_tile_index": "slide_id string, level int, tx int, ty int, file_offset bigint, byte_count bigint",
    "slide_tiles": "slide_id string, level int, tx int, ty int, compression int, photometric int, tile_w int, tile_h int, tables binary, data binary",
    "slide_associated": "slide_id string, ifd_index int, kind string, width int, height int, compression int, photometric int, samples_per_pixel int, bits_per_sample array<int>, predictor int, decodable boolean, description string",
    "slide_strips": "slide_id string, ifd_index int, strip int, file_offset bigint, byte_count bigint, row0 int, rows int, data binary",
}
TILES_PER_PARTITION = 256
_COMPARE = {EqualTo: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b, In: lambda a, b: a in b}
_PUSHED = ("slide_id", "level", "ifd_index", "tag_id", "tx", "ty", "kind")


@dataclass
class Part(InputPartition):
    path: str
    level: int = -1
    first: int = 0
    last: int = 0


def tag_value(ifd: Ifd, tag_id: int, failfast: bool) -> tuple:
    """The union value of a tag: one field is set."""
    try:
        v, kind = ifd.value(tag_id), ifd.tags[tag_id].kind
    except SlideError as e:
        if failfast:
            raise
        return (None, None, None, None, None, f"<unreadable: {e}>")
    if kind == 2:
        return (None, None, None, v, None, None)
    if kind == 7:
        return (None, None, None, None, v, None)
    if kind in (5, 10):
        return (None, v, None, None, None, None)
    if kind in (11, 12):
        return (None, None, v, None, None, None)
    return (v, None, None, None, None, None)


class SlideReader(DataSourceReader):
    def __init__(self, table: str, options: dict):
        self.table = table
        self.paths = options.get("path", "")
        self.failfast = options.get("mode", "FAILFAST").upper() != "PERMISSIVE"
        self.tests: list[tuple[str, type, object]] = []

    def pushFilters(self, filters):
        for f in filters:
            if type(f) in _COMPARE and len(f.attribute) == 1 and f.attribute[0] in _PUSHED:
                self.tests.append((f.attribute[0], type(f), f.value))
            yield f  # Spark checks again; the reader only skips

    def passes(self, **known) -> bool:
        return all(_COMPARE[kind](known[name], value) for name, kind, value in self.tests if name in known)

    def partitions(self) -> list[Part]:
        paths = [p for p in expand(self.paths) if self.passes(slide_id=p)]
        if self.table != "slide_tiles":
            return [Part(p) for p in paths]
        parts = []
        for p in paths:  # tables are not read here, only the directories
            slide = open_slide(p)
            for lv in slide.levels:
                n = lv.tiles_x * lv.tiles_y
                if self.passes(level=lv.index):
                    parts += [Part(p, lv.index, a, min(n, a + TILES_PER_PARTITION)) for a in range(0, n, TILES_PER_PARTITION)]
            slide.close()
        return parts

    def read(self, partition: Part) -> Iterator[tuple]:
        if not partition.path:
            return
        slide = open_slide(partition.path)
        try:
            yield from getattr(self, self.table)(slide, partition)
        finally:
            slide.close()

    def slide_tags(self, slide: Slide, part: Part) -> Iterator[tuple]:
        for ifd in slide.ifds:
            for t in ifd.tags.values():
                if self.passes(ifd_index=ifd.index, tag_id=t.id):
                    yield (part.path, ifd.index, t.id, TAG_NAMES.get(t.id, f"Tag{t.id}"), t.kind, t.count, tag_value(ifd, t.id, self.failfast))

    def slide_levels(self, slide: Slide, part: Part) -> Iterator[tuple]:
        for v in slide.levels:
            yield (part.path, v.index, v.ifd.index, v.width, v.height, v.tile_w, v.tile_h, v.compression, v.photometric, v.downsample, v.tiles_x, v.tiles_y, v.ifd.text(270))

    def slide_tile_index(self, slide: Slide, part: Part) -> Iterator[tuple]:
        for v in slide.levels:
            if self.passes(level=v.index):
                for i, (offset, count) in enumerate(zip(*v.tile_table())):
                    yield (part.path, v.index, i % v.tiles_x, i // v.tiles_x, offset, count)

    def slide_tiles(self, slide: Slide, part: Part) -> Iterator[tuple]:
        v = slide.levels[part.level]
        tables, shared = v.tile_table(), v.ifd.raw(347)
        for i in range(part.first, part.last):
            tx, ty = i % v.tiles_x, i // v.tiles_x
            if self.passes(tx=tx, ty=ty):
                data = slide.tile_bytes(part.level, tx, ty, tables) or None
                yield (part.path, v.index, tx, ty, v.compression, v.photometric, v.tile_w, v.tile_h, shared, data)

    def slide_associated(self, slide: Slide, part: Part) -> Iterator[tuple]:
        for a in slide.associated:
            if self.passes(kind=a.kind, ifd_index=a.ifd.index):
                yield (part.path, a.ifd.index, a.kind, a.width, a.height, a.compression, a.photometric, a.samples, a.bits, a.predictor, a.decodable, a.ifd.text(270))

    def slide_strips(self, slide: Slide, part: Part) -> Iterator[tuple]:
        for a in slide.associated:
            if self.passes(ifd_index=a.ifd.index):
                per = a.rows_per_strip
                for i, (offset, count) in enumerate(zip(*a.strip_table())):
                    yield (part.path, a.ifd.index, i, offset, count, i * per, min(per, a.height - i * per), slide.source.read(offset, count) if count else None)


def _source(table: str) -> type[DataSource]:
    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return table

        def schema(self) -> str:
            return SCHEMAS[table]

        def reader(self, schema) -> DataSourceReader:
            return SlideReader(table, dict(self.options))

    Source.__name__ = Source.__qualname__ = "".join(w.title() for w in table.split("_")) + "Source"
    return Source


SOURCES = {name: _source(name) for name in SCHEMAS}


def register(spark: SparkSession) -> None:
    """Makes the sources known to a session."""
    reachable(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in SOURCES.values():
        spark.dataSource.register(source)
