"""Block statistics of a stream of packed frames.

A frame is self-contained, so frames may come in any order and no state is kept between batches; each
micro-batch is coded by the batch operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.params import CodecParams
from ..operators import frames

P = CodecParams()


def stream_payloads(packed: DataFrame, channels: int = 1, rate: int = 48000, p: CodecParams = P) -> DataFrame:
    """Coded frames of a streaming ``rec_id, frame_idx, n_samples, pcm``."""
    return frames.encode_frames(packed, channels, rate, p)


def stream_ratio(packed: DataFrame, channels: int = 1, p: CodecParams = P) -> DataFrame:
    """Running coded and raw bytes for each recording (complete or update mode)."""
    coded = stream_payloads(packed, channels, p=p)
    return coded.groupBy("rec_id").agg(F.count("*").alias("frames"), F.sum(F.length("frame")).alias("coded_bytes"), F.sum(2 * channels * F.col("n_samples")).alias("raw_bytes"))
