"""Slide descriptions and tags as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Fields that say where a crop lay in its source; dropped from exports.
POSITIONAL = ("Left", "Top", "OriginalWidth", "OriginalHeight")

# TIFF tag names by number.
TAG_NAMES = {
    254: "NewSubfileType",
    256: "ImageWidth",
    257: "ImageLength",
    258: "BitsPerSample",
    259: "Compression",
    262: "PhotometricInterpretation",
    270: "ImageDescription",
    271: "Make",
    272: "Model",
    273: "StripOffsets",
    277: "SamplesPerPixel",
    278: "RowsPerStrip",
    279: "StripByteCounts",
    282: "XResolution",
    283: "YResolution",
    284: "PlanarConfiguration",
    296: "ResolutionUnit",
    305: "Software",
    306: "DateTime",
    315: "Artist",
    317: "Predictor",
    320: "ColorMap",
    322: "TileWidth",
    323: "TileLength",
    324: "TileOffsets",
    325: "TileByteCounts",
    338: "ExtraSamples",
    339: "SampleFormat",
    347: "JPEGTables",
    530: "YCbCrSubSampling",
    531: "YCbCrPositioning",
    532: "ReferenceBlackWhite",
    33432: "Copyright",
    34675: "ICCProfile",
}

_DOUBLE = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
_INT = r"^[+-]?\d+$"


def entries(description: Column) -> Column:
    """(key, value) of the fields after the first `|`, in order; fields without `=` or without a key are dropped."""
    parts = F.filter(F.split(description, "[|]"), lambda t, i: (i > 0) & (F.instr(t, "=") > 0))
    pair = lambda t: F.struct(F.trim(F.substring_index(t, "=", 1)).alias("key"), F.trim(F.substr(t, F.instr(t, "=") + F.lit(1))).alias("value"))
    return F.filter(F.transform(parts, pair), lambda e: e["key"] != "")


def fields(description: Column) -> Column:
    """Map of the fields; the last of a repeated key wins (session setting mapKeyDedupPolicy)."""
    e = entries(description)
    last = F.filter(e, lambda x, i: ~F.exists(F.filter(e, lambda y, j: j > i), lambda y: y["key"] == x["key"]))
    return F.map_from_entries(last)


def number(text: Column) -> Column:
    return F.when(text.rlike(_DOUBLE), text.try_cast("double"))


def whole(text: Column) -> Column:
    return F.when(text.rlike(_INT), text.try_cast("int"))


def mpp(description: Column) -> Column:
    return number(F.element_at(fields(description), "MPP"))


def app_mag(description: Column) -> Column:
    return whole(F.element_at(fields(description), "AppMag"))


def jpeg_quality(description: Column) -> Column:
    """The first `Q = n` of a description, else null."""
    return F.nullif(F.regexp_extract(description, r"Q\s*=\s*(\d+)", 1), F.lit("")).try_cast("int")


def associated_kind(description: Column) -> Column:
    """macro before label before thumbnail."""
    low = F.lower(F.coalesce(description, F.lit("")))
    return F.when(low.contains("macro"), "macro").when(low.contains("label"), "label").otherwise("thumbnail")


def tag_name(tag_id: Column) -> Column:
    names = F.create_map(*(F.lit(x) for kv in TAG_NAMES.items() for x in kv))
    return F.coalesce(F.try_element_at(names, tag_id.cast("int")), F.concat(F.lit("Tag"), tag_id.cast("string")))


def named_tags(tag_id: Column, value: Column) -> Column:
    """Aggregate: the values of a directory's tags by name."""
    return F.map_from_entries(F.collect_list(F.struct(tag_name(tag_id).alias("key"), value.alias("value"))))


def decodable(compression: Column, photometric: Column, samples: Column, bits: Column, predictor: Column) -> Column:
    """Whether an associated image can be decoded: JPEG, or a raw codec of 8-bit RGB or RGBA."""
    raw = compression.isin(1, 5, 8, 32773, 32946) & (photometric == 2) & samples.isin(3, 4) & F.forall(bits, lambda b: b == 8) & predictor.isin(1, 2)
    return (compression == 7) | raw


def needs_rgb_marker(compression: Column, photometric: Column) -> Column:
    """JPEG tiles stored as RGB, which decoders would take for YCbCr."""
    return (compression == 7) & (photometric == 2)


def description_of(width: Column, height: Column, tile: Column, encoding: Column, mag: Column, mpp_text: Column, source: Column) -> Column:
    """A crop's description. mpp_text: four decimals; source: entries of the source's description."""
    pair = lambda e: F.concat(e["key"], F.lit(" = "), e["value"])
    rest = F.transform(F.filter(source, lambda e: ~e["key"].isin("AppMag", "MPP", *POSITIONAL)), pair)
    head = F.concat(F.lit("Aperio Image Library v1.0\r\n"), width, F.lit("x"), height, F.lit(" [0,0 "), width, F.lit("x"), height, F.lit("] ("), tile, F.lit(" x "), tile, F.lit(") "), encoding)
    own = F.array_compact(F.array(F.concat(F.lit("AppMag = "), mag.cast("string")), F.concat(F.lit("MPP = "), mpp_text)))
    return F.array_join(F.concat(F.array(head), own, rest), "|")


def jp2k_ratio(byte_counts: Column, tile_bytes: Column) -> Column:
    """Compression ratio from the byte counts of up to eight evenly spaced tiles; null if all are sparse."""
    n = F.size(byte_counts)
    k = F.least(n, F.lit(8))
    ids = F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.floor(i * n / k).cast("int"))
    picked = F.filter(F.transform(ids, lambda i: F.get(byte_counts, i)), lambda b: b > 0)
    mean = F.aggregate(picked, F.lit(0).cast("long"), lambda a, b: a + b) / F.size(picked)
    return F.when((n > 0) & (F.size(picked) > 0), F.least(F.greatest(tile_bytes / mean, F.lit(1.0)), F.lit(500.0)))
