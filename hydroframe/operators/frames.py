"""Frame encoding and decoding over tables, one row for each frame, on Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import kernel
from ..functions.params import CodecParams
from ..sources import formats
from . import blocks

P = CodecParams()


def little_endian(pcm: Column) -> Column:
    """Packed samples as 16-bit little-endian PCM."""

    @F.pandas_udf("binary")
    def le(s: pd.Series) -> pd.Series:
        return s.map(lambda x: np.asarray(x).astype("<i2").tobytes())

    return le(pcm)


def pack_frames(samples: DataFrame, channels: int = 1, p: CodecParams = P) -> DataFrame:
    """``rec_id, frame_idx, n_samples, pcm`` from ``rec_id, idx, channel, v``: rows of samples meet by
    frame, so a group is never longer than a frame."""
    if "channel" not in samples.columns:
        samples = samples.withColumn("channel", F.lit(0))
    rows = blocks.frame_bucket(samples, p).groupBy("rec_id", "frame_idx").agg(F.array_sort(F.collect_list(F.struct("idx", "channel", "v"))).alias("s"))
    return rows.select("rec_id", "frame_idx", (F.size("s") / channels).cast("int").alias("n_samples"), F.transform("s", lambda x: x.v.cast("short")).alias("pcm"))


def encode_frames(packed: DataFrame, channels: int | Column = 1, rate: int | Column = 48000, p: CodecParams = P) -> DataFrame:
    """Adds ``payload`` and ``frame`` (header and payload) and drops ``pcm``; channels and rate may be
    columns."""

    def run(batches):
        for b in batches:
            payloads, frames = [], []
            for k, pcm, c, r in zip(b.column("frame_idx").to_pylist(), b.column("pcm"), b.column("c").to_pylist(), b.column("r").to_pylist()):
                x = pcm.values.to_numpy(zero_copy_only=False).reshape(-1, c)
                raw = kernel.encode_frame(x, p)
                payloads.append(raw)
                frames.append(formats.frame_header(1, c, len(x), raw, formats.time_ns(k * p.samples_per_frame, r)) + raw)
            yield pa.RecordBatch.from_arrays([b.column("rec_id"), b.column("frame_idx"), b.column("n_samples"), pa.array(payloads, pa.binary()), pa.array(frames, pa.binary())], ["rec_id", "frame_idx", "n_samples", "payload", "frame"])

    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    rows = packed.select("rec_id", "frame_idx", "n_samples", "pcm", as_column(channels).cast("int").alias("c"), as_column(rate).cast("int").alias("r"))
    return rows.mapInArrow(run, "rec_id string, frame_idx int, n_samples int, payload binary, frame binary")


def decode_frames(coded: DataFrame, channels: int = 1, block_len: int = P.block_len, orders=P.orders, swap: bool = False) -> DataFrame:
    """``rec_id, frame_idx, n_samples, pcm`` from ``payload``."""

    def run(batches):
        for b in batches:
            pcm = [kernel.decode_frame(x, n, channels, block_len, orders, swap).ravel() for x, n in zip(b.column("payload").to_pylist(), b.column("n_samples").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("rec_id"), b.column("frame_idx"), b.column("n_samples"), pa.array([x.astype(np.int16) for x in pcm], pa.list_(pa.int16()))], ["rec_id", "frame_idx", "n_samples", "pcm"])

    return coded.select("rec_id", "frame_idx", "n_samples", "payload").mapInArrow(run, "rec_id string, frame_idx int, n_samples int, pcm array<smallint>")


def explode_frames(packed: DataFrame, channels: int = 1, p: CodecParams = P, offset: str | None = None) -> DataFrame:
    """``rec_id, channel, idx, v``; frames start at ``offset`` or at frame_idx * samples_per_frame."""
    start = F.col(offset) if offset else F.col("frame_idx").cast("long") * p.samples_per_frame
    rows = packed.select("rec_id", start.alias("s"), F.posexplode("pcm").alias("k", "v"))
    return rows.select("rec_id", F.expr(f"cast(k % {channels} as int)").alias("channel"), (F.col("s") + F.expr(f"k div {channels}")).alias("idx"), "v")


def payload_crc(coded: DataFrame) -> DataFrame:
    """Adds ``crc``, the CRC-16 of ``payload``."""
    udf = F.pandas_udf(lambda s: s.map(kernel.crc16).astype("int32"), "int")
    return coded.withColumn("crc", udf("payload"))
