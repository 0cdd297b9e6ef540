"""The frame index, and sample ranges answered through it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import expr
from ..functions.params import CodecParams
from . import blocks

P = CodecParams()


def by_frame():
    return Window.partitionBy("rec_id").orderBy("frame_idx")


def with_offsets(frames: DataFrame) -> DataFrame:
    """``frame_idx, n_samples`` with ``sample_offset`` (running sum) and ``last_idx``."""
    before = by_frame().rowsBetween(Window.unboundedPreceding, -1)
    out = frames.withColumn("sample_offset", F.coalesce(F.sum("n_samples").over(before), F.lit(0)).cast("long"))
    return out.withColumn("last_idx", F.col("sample_offset") + F.col("n_samples") - 1)


def frame_index(signal: DataFrame, xml_len: int, rate: int, p: CodecParams = P) -> DataFrame:
    """Where each frame stands in its archive and in its recording."""
    before = by_frame().rowsBetween(Window.unboundedPreceding, -1)
    rows = with_offsets(blocks.frame_sizes(signal, p))
    rows = rows.withColumn("byte_offset", (28 + xml_len + F.coalesce(F.sum(F.col("payload_bytes") + 20).over(before), F.lit(0))).cast("long"))
    return rows.withColumn("time_ns", expr.frame_time_ns(F.col("sample_offset"), F.lit(rate)))


def counts_from_offsets(frames: DataFrame) -> DataFrame:
    """Samples of each frame from the next one's offset; the last frame's from the total."""
    whole = F.sum("n_samples").over(Window.partitionBy("rec_id"))
    return frames.withColumn("from_offsets", (F.coalesce(F.lead("sample_offset").over(by_frame()), whole) - F.col("sample_offset")).cast("long"))


def channel_check(frames: DataFrame) -> DataFrame:
    """``rec_id, channels`` (the last frame's, 1 if it names none) ``, mixed`` (whether they differ)."""
    n = F.greatest(F.col("channels"), F.lit(1))
    return frames.groupBy("rec_id").agg(F.max_by(n, "frame_idx").cast("int").alias("channels"), (F.min(n) != F.max(n)).alias("mixed"))


def chunks_for_window(index: DataFrame, start: int, length: int) -> DataFrame:
    """Frames that a window touches; filters the index alone, before anything is decoded."""
    if start < 0 or length <= 0:
        return index.where(F.lit(False))
    return index.where((F.col("sample_offset") < start + length) & (F.col("last_idx") >= start))


def select_window(signal: DataFrame, start: int, length: int) -> DataFrame:
    """Samples of [start, start + length); rows beyond the end do not exist, so the end is clamped."""
    if start < 0 or length <= 0:
        return signal.where(F.lit(False))
    return signal.where((F.col("idx") >= start) & (F.col("idx") < start + length))


def lookup(samples: DataFrame, index: DataFrame, p: CodecParams = P) -> DataFrame:
    """The frame of each ``rec_id, sample``, -1 outside the recording.

    Frames but the last hold samples_per_frame samples, so the frame number follows from the sample
    by division and the range join becomes an equality join.
    """
    frames = index.select("rec_id", "frame_idx", "sample_offset", "last_idx")
    asked = samples.withColumn("_f", F.expr(f"cast(sample div {p.samples_per_frame} as int)"))
    out = asked.join(frames.withColumnRenamed("frame_idx", "_f"), ["rec_id", "_f"], "left")
    inside = F.col("sample").between(F.col("sample_offset"), F.col("last_idx"))
    return out.select("rec_id", "sample", F.when(inside, F.col("_f")).otherwise(-1).cast("int").alias("frame_idx"))


def lookup_any(samples: DataFrame, index: DataFrame, width: int) -> DataFrame:
    """``lookup`` for frames of any length: each frame is listed under every ``width`` samples that
    it touches, and the range test follows the equality join."""
    frames = index.select("rec_id", "frame_idx", "sample_offset", "last_idx").withColumn("_b", F.explode(F.sequence(F.expr(f"sample_offset div {width}"), F.expr(f"last_idx div {width}"))))
    asked = samples.withColumn("_b", F.expr(f"sample div {width}"))
    inside = F.col("sample").between(F.col("sample_offset"), F.col("last_idx"))
    hits = asked.join(frames, ["rec_id", "_b"]).where(inside).select("rec_id", "sample", "frame_idx")
    return samples.join(hits, ["rec_id", "sample"], "left").select("rec_id", "sample", F.coalesce("frame_idx", F.lit(-1)).alias("frame_idx"))
