"""op7: every document's bytes as an AVI motion-JPEG file, read back."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tesserae.llm import media
from tesserae.llm.common import table
from tesserae.llm.textblocks import values

SCHEMA = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, n_frames int, n_clips int"


def digest(text: bytes) -> tuple:
    payload = text + b"\0" * (max(64, -(-len(text) // 64) * 64) - len(text))
    stored = media.encode(payload)
    back, avi = media.decode(stored)
    shares, clips = media.file_clips(avi)
    feature = f"{len(avi.frames)} frames; clips " + ",".join(f"{c[3]:.2f}-{c[4]:.2f}" for c in clips) + "; histogram " + ",".join(f"{x:.4f}" for x in shares.mean(axis=0))
    return len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), feature, len(avi.frames), len(clips)


def op7_avi_motion_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [digest(t) for t in values(batch.column("text"))]
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32())
            columns = list(zip(*rows)) or [[]] * len(kinds)
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=names)

    return table(spark, sf_dir, "documents").select("doc_id", "text").mapInArrow(run, SCHEMA)
