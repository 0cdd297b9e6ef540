"""The encoder's intermediate tables: frames, blocks, residuals, codes and sizes.

All windows are bounded by a frame (``block_len * blocks_per_frame`` samples), so a recording of any
length is spread over its frames, and everything stays in generated code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import expr
from ..functions.params import CodecParams

P = CodecParams()


def in_frame():
    return Window.partitionBy("rec_id", "frame_idx").orderBy("idx")


def frame_bucket(signal: DataFrame, p: CodecParams = P) -> DataFrame:
    """Adds ``frame_idx`` and ``j``, the place in the frame."""
    return signal.withColumn("frame_idx", F.expr(f"cast(idx div {p.samples_per_frame} as int)")).withColumn("j", F.expr(f"cast(idx % {p.samples_per_frame} as int)"))


def frame_summary(signal: DataFrame, p: CodecParams = P) -> DataFrame:
    return frame_bucket(signal, p).groupBy("rec_id", "frame_idx").agg(F.count("*").alias("n_samples"), F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"))


def residuals(signal: DataFrame, p: CodecParams = P) -> DataFrame:
    """Rows behind each frame's seed, with ``d`` (difference to the sample before, in INT), ``ri``
    (its Rice index) and ``block_idx``."""
    rows = frame_bucket(signal, p).withColumn("d", F.col("v") - F.lag("v").over(in_frame())).where("j > 0")
    return rows.withColumn("block_idx", F.expr(f"cast((j - 1) div {p.block_len} as int)")).withColumn("ri", expr.rice_index(F.col("d")))


def block_stats(signal: DataFrame, p: CodecParams = P) -> DataFrame:
    """One row for each block: ``n``, ``max_abs``, ``code``, ``bits``, ``peak_bits``."""
    sums = [F.sum(F.shiftright("ri", o)).cast("long").alias(f"s{k}") for k, o in enumerate(p.orders)]
    rows = residuals(signal, p).groupBy("rec_id", "frame_idx", "block_idx").agg(F.count("*").alias("n"), F.max(F.abs("d")).alias("max_abs"), *sums)
    bits = expr.code_bits(F.col("n"), F.col("max_abs"), [F.col(f"s{k}") for k in range(3)], p)
    return rows.select("rec_id", "frame_idx", "block_idx", "n", "max_abs", expr.block_code(F.col("max_abs"), p).alias("code"), expr.bit_length(F.col("max_abs")).alias("peak_bits"), bits.alias("bits"))


def frame_sizes(signal: DataFrame, p: CodecParams = P) -> DataFrame:
    """``n_samples`` and ``payload_bytes`` of each one-channel frame."""
    bits = block_stats(signal, p).groupBy("rec_id", "frame_idx").agg(F.sum("bits").alias("bits"))
    rows = frame_summary(signal, p).join(bits, ["rec_id", "frame_idx"], "left")
    return rows.select("rec_id", "frame_idx", "n_samples", F.expr("cast(2 * ((16 + coalesce(bits, 0) + 15) div 16) as long)").alias("payload_bytes"))


def payload_bound(n: Column, channels: int, p: CodecParams = P) -> Column:
    """Upper bound of a frame's payload bytes."""
    blocks = F.ceil((n - 1) / p.block_len)
    return (2 * F.ceil((16 * channels + channels * (6 * blocks + 16 * (n - 1))) / 16)).cast("long")


def archive_sizes(signal: DataFrame, xml_len: int, p: CodecParams = P) -> DataFrame:
    """Archive bytes of each recording: magic, config frame, and each frame's header and payload."""
    out = frame_sizes(signal, p).groupBy("rec_id").agg(F.count("*").alias("frames"), F.sum("n_samples").alias("samples"), F.sum(F.col("payload_bytes") + 20).alias("coded"))
    return out.select("rec_id", "frames", "samples", (F.col("coded") + 28 + xml_len).alias("archive_bytes"), (44 + 2 * F.col("samples")).alias("wav_bytes"))


def integrate(d: DataFrame) -> DataFrame:
    """Samples from residuals: ``rec_id, frame_idx, j, step, literal``; a literal's step is its sample,
    and starts the sum anew."""
    frame = Window.partitionBy("rec_id", "frame_idx").orderBy("j")
    run = frame.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    part = F.sum(F.col("literal").cast("int")).over(run)
    within = Window.partitionBy("rec_id", "frame_idx", "part").orderBy("j").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return d.withColumn("part", part).withColumn("v", expr.wrap16(F.sum("step").over(within))).drop("part")


def as_steps(signal: DataFrame, p: CodecParams = P) -> DataFrame:
    """What a decoder sees: the seed and literal blocks as samples, other blocks as residuals."""
    rows = frame_bucket(signal, p)
    codes = block_stats(signal, p).select("rec_id", "frame_idx", "block_idx", "code")
    rows = rows.withColumn("d", F.col("v") - F.lag("v").over(in_frame())).withColumn("block_idx", F.expr(f"cast((j - 1) div {p.block_len} as int)"))
    rows = rows.join(codes, ["rec_id", "frame_idx", "block_idx"], "left")
    literal = (F.col("j") == 0) | (F.col("code") == "LITERAL")
    return rows.select("rec_id", "frame_idx", "idx", "j", F.when(literal, F.col("v")).otherwise(F.col("d")).alias("step"), literal.alias("literal"))


def sample_bits(signal: DataFrame, p: CodecParams = P) -> DataFrame:
    """Each residual's bits as a string, by its block's code."""
    rows = residuals(signal, p).join(block_stats(signal, p).select("rec_id", "frame_idx", "block_idx", "code", "peak_bits"), ["rec_id", "frame_idx", "block_idx"])
    out = None
    for o in p.orders:
        case, value = F.col("code") == f"RICE{o}", expr.rice_bits(F.col("ri"), o)
        out = F.when(case, value) if out is None else out.when(case, value)
    out = out.when(F.col("code") == "BFP", expr.packed_bits(F.col("d"), F.col("peak_bits") + 1)).otherwise(expr.packed_bits(F.col("v"), F.lit(16)))
    return rows.select("rec_id", "frame_idx", "block_idx", "idx", "code", out.alias("bits"))


def block_bit_strings(signal: DataFrame, p: CodecParams = P) -> DataFrame:
    """Each block's whole bit string: header, then its samples in order (for short signals)."""
    head = F.when(F.col("code") == f"RICE{p.orders[0]}", "01").when(F.col("code") == f"RICE{p.orders[1]}", "10").when(F.col("code") == f"RICE{p.orders[2]}", "11")
    head = head.otherwise(F.lpad(F.bin(F.when(F.col("code") == "BFP", F.col("peak_bits")).otherwise(15).cast("long")), 6, "0"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "bits"))), lambda x: x.bits), "")
    bodies = sample_bits(signal, p).groupBy("rec_id", "frame_idx", "block_idx").agg(body.alias("body"))
    return block_stats(signal, p).join(bodies, ["rec_id", "frame_idx", "block_idx"]).select("rec_id", "frame_idx", "block_idx", "code", F.concat(head, "body").alias("bits"))


def interleave(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two one-channel signals as one flat signal: sample of time idx, channel c at idx * 2 + c."""
    both = left.join(right.withColumnRenamed("v", "v1"), ["rec_id", "idx"])
    return both.select("rec_id", F.posexplode(F.array("v", "v1")).alias("channel", "v"), "idx").select("rec_id", "channel", (F.col("idx") * 2 + F.col("channel")).alias("pos"), "v")


def deinterleave(flat: DataFrame, channels: int) -> DataFrame:
    return flat.select("rec_id", F.expr(f"cast(pos % {channels} as int)").alias("channel"), F.expr(f"pos div {channels}").alias("idx"), "v")
