"""AVI motion-JPEG columns: storing bytes as frames, reading them back, and timed clips.

A payload is stored losslessly as 8-bit luminance samples, one to a block of 8 x 8: a flat block
whose DC is 8 * (sample - 128), with a quantiser of 8, decodes to its sample exactly. Frames are
baseline JPEG, 64 blocks wide and up to 64 high, whose Huffman table gives a difference of
magnitude s a code of 12 - s bits, so that a block, with the four bits of its end, takes two
bytes. Frames are decoded by their own tables: entropy codes, differences, quantiser, and the
inverse transform of what is flat; frames of other makers go through the library's full decoder.
The AVI has the headers, a comment with the payload's length, the `movi` list and an `idx1`
index, through which frames are read.

Shots: the 16-bin histogram of each decoded frame is compared with its predecessor's; a cut is
where half the sum of absolute differences exceeds a floor and the mean of the last differences by
some of their standard deviations.

Null payloads count as empty; an empty payload is one row of zeros. Equal payloads give equal
files; repeated rows and rows without an id are stored each on its own, and an empty table gives
an empty result. Columns are taken by the names given, others are ignored. A payload costs memory
in proportion to itself. Malformed files raise ValueError.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Blocks in a row, and rows in a frame at most.
WIDE = 64
HIGH = 64
PER_FRAME = WIDE * HIGH
FRAME_MICROSECONDS = 40_000
BINS = 16
QUANTISER = 8
#: Magnitudes of a difference of two samples, longest first: their codes have 4 to 12 bits.
MAGNITUDES = range(8, -1, -1)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _codes(lengths: list[int]) -> list[int]:
    """Canonical Huffman codes of ascending lengths."""
    out, code = [], 0
    for i, n in enumerate(lengths):
        code <<= n - lengths[i - 1] if i else 0
        out.append(code)
        code += 1
    return out


@lru_cache(maxsize=1)
def _block_words() -> np.ndarray:
    """The two bytes of a block by its difference + 255: code, magnitude bits, and four zeros that end the block."""
    out = np.zeros(511, np.uint16)
    for code, s in zip(_codes([12 - s for s in MAGNITUDES]), MAGNITUDES):
        for d in range(-(1 << s) + 1, 1 << s) if s else (0,):
            if abs(d).bit_length() == s:
                out[d + 255] = (code << s | (d if d >= 0 else d + (1 << s) - 1)) << 4
    return out


@lru_cache(maxsize=1)
def _differences() -> np.ndarray:
    """The difference of each block of two bytes, -32768 for what no block is."""
    out = np.full(1 << 16, -32768, np.int32)
    out[_block_words()] = np.arange(-255, 256)
    return out


@lru_cache(maxsize=HIGH)
def header(rows: int) -> bytes:
    """All that comes before the scan of a frame of rows x WIDE blocks."""
    table = lambda kind, counts, symbols: bytes([kind, *counts, *symbols])
    return b"".join(
        (
            b"\xff\xd8",
            _segment(0xDB, bytes([0]) + bytes([QUANTISER]) * 64),
            _segment(0xC0, struct.pack(">BHHBBBB", 8, 8 * rows, 8 * WIDE, 1, 1, 0x11, 0)),
            _segment(0xC4, table(0x00, [int(4 <= n <= 12) for n in range(1, 17)], MAGNITUDES)),
            _segment(0xC4, table(0x10, [int(n == 4) for n in range(1, 17)], [0])),  # end of block only
            _segment(0xDA, bytes([1, 1, 0, 0, 63, 0])),
        )
    )


def chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def encode(payload: bytes) -> bytes:
    """An AVI file that holds payload."""
    n_rows = max(1, -(-len(payload) // WIDE))
    n_frames = -(-n_rows // HIGH)
    rows = min(n_rows, HIGH)
    samples = np.full(n_frames * rows * WIDE, 0, np.uint8)
    samples[: len(payload)] = np.frombuffer(payload, np.uint8)
    level = samples.reshape(n_frames, -1).astype(np.int32) - 128
    scans = _block_words()[np.diff(level, axis=1, prepend=0) + 255].astype(">u2")  # no byte is 0xFF: nothing to stuff
    frames = [header(rows) + scan.tobytes() + b"\xff\xd9" for scan in scans]
    movi, index, at = [b"movi"], [], 4
    for f in frames:
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        movi.append(chunk(b"00dc", f))
        at += len(movi[-1])
    largest = max(map(len, frames))
    avih = struct.pack("<14I", FRAME_MICROSECONDS, largest * 25, 0, 0x10, n_frames, 0, 1, largest, 8 * WIDE, 8 * rows, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIIIhhhh", b"vids", b"MJPG", 0, 0, 0, 0, FRAME_MICROSECONDS, 1_000_000, 0, n_frames, largest, 0xFFFFFFFF, 0, 0, 0, 8 * WIDE, 8 * rows)
    strf = struct.pack("<IiiHH4sIiiII", 40, 8 * WIDE, 8 * rows, 1, 8, b"MJPG", 64 * WIDE * rows, 0, 0, 0, 0)
    hdrl = b"hdrl" + chunk(b"avih", avih) + chunk(b"LIST", b"strl" + chunk(b"strh", strh) + chunk(b"strf", strf))
    info = b"INFO" + chunk(b"ICMT", str(len(payload)).encode())
    body = b"AVI " + chunk(b"LIST", hdrl) + chunk(b"LIST", info) + chunk(b"LIST", b"".join(movi)) + chunk(b"idx1", b"".join(index))
    return chunk(b"RIFF", body)


@dataclass
class Avi:
    frame_seconds: float
    frames: list[bytes]
    comment: bytes | None


def parse(data: bytes) -> Avi:
    """Frames in the order of the index; without one, in the order of the movi list."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    micro, comment, movi, index, listed = 0, None, -1, b"", []

    def walk(lo: int, hi: int) -> None:
        nonlocal micro, comment, movi, index
        while lo + 8 <= hi:
            name, size = data[lo : lo + 4], struct.unpack_from("<I", data, lo + 4)[0]
            at, end = lo + 8, lo + 8 + size
            if end > len(data):
                raise ValueError("a chunk exceeds the file")
            if name == b"LIST":
                if data[at : at + 4] == b"movi":
                    movi = at
                walk(at + 4, end)
            elif name == b"avih":
                micro = struct.unpack_from("<I", data, at)[0]
            elif name == b"ICMT":
                comment = data[at:end]
            elif name == b"idx1":
                index = data[at:end]
            elif name[2:] in (b"dc", b"db"):
                listed.append((at, size))
            lo = end + (size & 1)

    walk(12, min(len(data), 8 + struct.unpack_from("<I", data, 4)[0]))
    if index:
        entries = np.frombuffer(index, np.dtype([("id", "S4"), ("flags", "<u4"), ("at", "<u4"), ("size", "<u4")]))
        video = entries[np.char.endswith(entries["id"], b"dc")]
        base = movi if len(video) and video["at"][0] < movi else 0  # offsets count from the list, or from the file
        listed = [(base + int(e["at"]) + 8, int(e["size"])) for e in video]
    return Avi(micro / 1e6, [data[at : at + size] for at, size in listed], comment)


def frame_samples(frame: bytes) -> np.ndarray:
    """The samples of a frame that encode() wrote, decoded: the picture at an eighth of its size."""
    rows = struct.unpack_from(">H", frame, _ROWS_AT)[0] // 8 if len(frame) > _ROWS_AT + 2 else 0
    head = header(rows) if 0 < rows <= HIGH else b""
    if not rows or not frame.startswith(head) or len(frame) != len(head) + 2 * rows * WIDE + 2:
        raise ValueError("not a frame of stored samples")
    step = _differences()[np.frombuffer(frame, ">u2", rows * WIDE, len(head))]
    if step.min() < -255:
        raise ValueError("a block has another code")
    # coefficient times quantiser is DC; a flat block's samples are DC / 8, and 128
    level = np.cumsum(step) * QUANTISER // 8 + 128
    if level.min() < 0 or level.max() > 255:
        raise ValueError("a sample is out of range")
    return level.astype(np.uint8)


#: Where a frame tells its height: after its start, its quantiser and the marker, length and precision.
_ROWS_AT = 2 + 69 + 5


def frame_shares(frame: bytes) -> np.ndarray:
    """The histogram of a decoded frame; of its own frames flat blocks are counted once."""
    try:
        samples = frame_samples(frame)
    except ValueError:
        samples = frame_picture(frame).reshape(-1)
    return histogram(samples)


def frame_picture(frame: bytes) -> np.ndarray:
    """Luminance of any baseline JPEG frame, as a decoder shows it."""
    from tesserae.codecs.jpeg import decode

    picture = decode(frame)
    return picture[..., :3].mean(axis=2).round().astype(np.uint8) if picture.ndim == 3 else picture


def decode(data: bytes) -> tuple[bytes, Avi]:
    """The payload, read back through the index."""
    avi = parse(data)
    if avi.comment is None:
        raise ValueError("no payload length")
    samples = np.concatenate([frame_samples(f) for f in avi.frames])
    return samples[: int(avi.comment.rstrip(b"\0"))].tobytes(), avi


def histogram(samples: np.ndarray) -> np.ndarray:
    """Shares of BINS bins."""
    counts = np.bincount(samples >> 4, minlength=BINS)
    return counts / max(1, counts.sum())


def cuts(shares: np.ndarray, window: int = 8, deviations: float = 2.5, floor: float = 0.08) -> list[int]:
    """Frames that begin a shot (not frame 0)."""
    change = np.abs(np.diff(shares, axis=0)).sum(axis=1) / 2
    out, last = [], 0
    for i, d in enumerate(change):
        past = change[max(last, i - window) : i]
        limit = max(floor, past.mean() + deviations * past.std()) if len(past) else floor * 2
        if d > limit:
            out.append(i + 1)
            last = i + 1
    return out


def clip_rows(shares: np.ndarray, seconds: float) -> list[tuple[int, int, int, float, float]]:
    """(clip, first frame, frame after the last, start, end)."""
    edges = [0, *cuts(shares), len(shares)]
    return [(i, a, b, a * seconds, b * seconds) for i, (a, b) in enumerate(zip(edges, edges[1:]))]


def file_clips(avi: Avi) -> tuple[np.ndarray, list[tuple[int, int, int, float, float]]]:
    """Histograms of all frames, decoded, and the clips between their cuts."""
    shares = np.stack([frame_shares(f) for f in avi.frames]) if avi.frames else np.zeros((0, BINS))
    return shares, clip_rows(shares, avi.frame_seconds) if avi.frames else []


def clips(df: DataFrame, column: str, keep: list[str]) -> DataFrame:
    """Timed clip rows of a column of AVI files of any maker, by their decoded frames.

    A null file, and one without a frame, has no clip.
    """
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, out = [], []
            for i, data in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                if data is None:
                    continue
                got = file_clips(parse(data))[1]
                rows += [i] * len(got)
                out += got
            columns = list(zip(*out)) or [[]] * 5
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64())
            kept = [batch.column(i).take(pa.array(rows, pa.int64())) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(c, t) for c, t in zip(columns, kinds))], names=[*keep, "clip", "first_frame", "end_frame", "start_s", "end_s"])

    return df.select(*keep, F.col(column).alias("__media")).mapInArrow(run, f"{fields}, clip int, first_frame int, end_frame int, start_s double, end_s double")


def store(df: DataFrame, column: str, keep: list[str]) -> DataFrame:
    """keep's columns with media, the AVI file of each payload (null: empty)."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):  # files of few rows at a time
                part = batch.slice(i, 256)
                media = [encode(x or b"") for x in part.column(part.num_columns - 1).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(part.num_columns - 1)), pa.array(media, pa.binary())], names=[*keep, "media"])

    return df.select(*keep, F.col(column).alias("__payload")).mapInArrow(run, f"{fields}, media binary")
