"""Media columns: texts as MPEG audio files in a binary column, and what the files say of themselves."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gymlake.llm.common import bounded_batches, read
from gymlake.llm.kernel import column_bytes
from gymlake.llm.mpeg import build, parse

BLOCK = 64

STORED = "doc_id long, n_bytes long, media binary"
PROBED = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, "
    "n_frames long, duration_us long, sample_rate int, bad_checksums long, skipped_bytes long, payload binary, seek_offsets array<long>"
)


def store_audio(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, n_bytes, media): each text's UTF-8 bytes, zero-padded to a positive multiple of 64, as an MPEG file.

    Null counts as empty. Equal texts give equal files. Rows are independent, so
    repeated rows, null keys and empty tables need no care. Other columns are not read.
    """
    bounded_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            raw = data.tobytes()
            media = []
            for lo, hi in zip(offsets[:-1], offsets[1:], strict=True):
                own = raw[lo:hi]
                media.append(build(own.ljust(max(BLOCK, -(-len(own) // BLOCK) * BLOCK), b"\0")))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).mapInArrow(run, STORED)


def probe_audio(stored: DataFrame, with_payload: bool = False) -> DataFrame:
    """What parsing each stored file yields; see PROBED. A null file counts as empty.

    payload and seek_offsets (the byte offset of each frame) are null unless asked for.
    """

    def run(batches):
        for batch in batches:
            columns = [[] for _ in range(13)]
            for raw in batch.column(2):
                raw = raw.as_py() or b""
                audio = parse(raw)
                sums = zlib.crc32(np.array(audio.offsets, "<i8").tobytes())
                feature = f"rate={audio.rate};frames={len(audio.offsets)};us={audio.duration_us};kbps={'/'.join(map(str, sorted(audio.kbps)))};vbr={audio.vbr_frames},{audio.vbr_bytes};seek={sums:08x};bad={audio.bad_checksums}"
                values = (
                    len(audio.data), hashlib.sha256(audio.data).hexdigest(), zlib.crc32(audio.data[-BLOCK:]), len(raw), hashlib.sha256(raw).hexdigest(), feature,
                    len(audio.offsets), audio.duration_us, audio.rate, audio.bad_checksums, audio.skipped, audio.data if with_payload else None, audio.offsets if with_payload else None,
                )
                for column, value in zip(columns, values, strict=True):
                    column.append(value)
            long, string = pa.int64(), pa.string()
            types = (long, string, long, long, string, string, long, long, pa.int32(), long, long, pa.binary(), pa.list_(long))
            arrays = [pa.array(x, t) for x, t in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], [x.split()[0] for x in PROBED.split(", ")])

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, PROBED)


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    probed = probe_audio(store_audio(read(spark, sf_dir, "documents")))
    return probed.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_frames", "duration_us", "bad_checksums")


QUERIES = {"op4_media_columns": op4_media_columns}
ORACLES: dict[str, str] = {}
