"""Conversion jobs: signals or WAV files to archives, archives to WAV files, reports.

Samples are packed to one row for each frame before any shuffle; frames then meet by recording,
sorted, and one task writes each recording as a stream.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from ..functions.params import CodecParams
from ..operators import frames, metadata
from ..sources import datasource, formats

P = CodecParams()


def _deal(rows: DataFrame) -> DataFrame:
    return rows.repartition("rec_id").sortWithinPartitions("rec_id", "frame_idx")


def write_archives(coded: DataFrame, path: str, rate: int = 48000, p: CodecParams = P, recordings: DataFrame | None = None) -> None:
    """Writes ``rec_id, frame_idx, frame`` as one archive for each recording, of one rate or of that in
    ``recordings`` (``rec_id, sample_rate``)."""
    datasource.register(coded.sparkSession)
    rows = coded.select("rec_id", "frame_idx", "frame")
    if recordings is None:
        rows = rows.withColumn("head", F.lit(formats.archive_prefix(rate, p)))
    else:
        prefix = F.pandas_udf(lambda s: s.map(lambda r: formats.archive_prefix(int(r), p)), "binary")
        rows = rows.join(recordings.select("rec_id", prefix("sample_rate").alias("head")), "rec_id")
    _deal(rows).withColumn("sidecar", F.lit(None).cast("string")).write.format("hydro").option("container", "archive").mode("append").save(path)


def write_wavs(packed: DataFrame, recordings: DataFrame, path: str, sidecar: bool = True) -> None:
    """Writes ``rec_id, frame_idx, pcm`` as one WAV for each recording; the header's sizes come from
    ``recordings``, whose metadata text goes to a sidecar if there is any."""
    datasource.register(packed.sparkSession)

    @F.pandas_udf("binary")
    def header(rate: pd.Series, channels: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([formats.wav_header(*map(int, x)) for x in zip(rate, channels, n)], dtype=object)

    heads = recordings.select("rec_id", header("sample_rate", "channels", "frames").alias("head"), (F.col("xml") if sidecar else F.lit(None).cast("string")).alias("sidecar"))
    rows = packed.select("rec_id", "frame_idx", frames.little_endian(F.col("pcm")).alias("frame")).join(heads, "rec_id")
    rows = _deal(rows).select("rec_id", "frame_idx", "frame", "head", F.when(F.col("frame_idx") == 0, F.col("sidecar")).alias("sidecar"))
    rows.write.format("hydro").option("container", "wav").mode("append").save(path)


def read(spark: SparkSession, path: str, table: str = "samples", **options) -> DataFrame:
    datasource.register(spark)
    r = spark.read.format("hydro").option("table", table)
    for k, v in options.items():
        r = r.option(k, str(v))
    return r.load(path)


def to_memory(packed: DataFrame) -> DataFrame:
    """``rec_id, pcm``: each recording's samples as one array, for recordings that fit a row."""
    rows = packed.groupBy("rec_id").agg(F.array_sort(F.collect_list(F.struct("frame_idx", "pcm"))).alias("f"))
    return rows.select("rec_id", F.flatten(F.transform("f", lambda x: x.pcm)).alias("pcm"))


def wav_to_archive(spark: SparkSession, source: str, target: str, p: CodecParams = P) -> None:
    """Every WAV below ``source``, of any rate and channel count, in one job."""
    recs = read(spark, source, "recordings").where("container = 'wav'").select("rec_id", "sample_rate", F.col("channels").alias("n_channels"))
    pcm = read(spark, source, "samples").select("rec_id", "frame_idx", "n_samples", "pcm").join(recs, "rec_id")
    if p.samples_per_frame != formats.WAV_CHUNK:
        # A frame's samples meet by recording and new frame number.
        at = F.col("frame_idx").cast("long") * formats.WAV_CHUNK + F.expr("k div n_channels")
        rows = pcm.select("rec_id", "sample_rate", "n_channels", "frame_idx", F.posexplode("pcm").alias("k", "v")).withColumn("at", at)
        rows = rows.groupBy("rec_id", "sample_rate", "n_channels", F.expr(f"cast(at div {p.samples_per_frame} as int)").alias("frame_idx"))
        rows = rows.agg(F.array_sort(F.collect_list(F.struct("at", F.expr("k % n_channels").alias("c"), "v"))).alias("s"))
        pcm = rows.select("rec_id", "sample_rate", "n_channels", "frame_idx", F.expr("cast(size(s) div n_channels as int)").alias("n_samples"), F.transform("s", lambda x: x.v).alias("pcm"))
    write_archives(frames.encode_frames(pcm, F.col("n_channels"), F.col("sample_rate"), p), target, p=p, recordings=recs)


def archive_to_wav(spark: SparkSession, source: str, target: str, sidecar: bool = True) -> None:
    """Every archive and recorder file below ``source``."""
    recs = read(spark, source, "recordings").where("container <> 'wav'")
    pcm = read(spark, source, "samples").join(recs.select("rec_id"), "rec_id", "left_semi")
    write_wavs(pcm, recs, target, sidecar)


def size_report(recordings: DataFrame, files: DataFrame) -> DataFrame:
    """Coded and WAV bytes and their ratio; ``files`` has ``rec_id, file_bytes``."""
    rows = file_report(recordings, files)
    out = rows.groupBy("container").agg(F.count("*").alias("files"), F.sum("file_bytes").alias("file_bytes"), F.sum("wav_bytes").alias("wav_bytes"))
    return out.withColumn("ratio", F.col("file_bytes") / F.col("wav_bytes"))


def file_report(recordings: DataFrame, files: DataFrame) -> DataFrame:
    """One row a file, by name: coded and WAV bytes and their ratio; with a column ``seconds`` in
    ``files`` also MiB of WAV a second."""
    rows = recordings.select("rec_id", "container", "frames", "channels").join(files, "rec_id").withColumn("wav_bytes", 44 + 2 * F.col("frames") * F.col("channels"))
    out = rows.withColumn("ratio", F.col("file_bytes") / F.col("wav_bytes"))
    cols = ["rec_id", "container", "file_bytes", "wav_bytes", "ratio"]
    if "seconds" in files.columns:
        out = out.withColumn("mib_per_s", F.col("wav_bytes") / (1 << 20) / F.when(F.col("seconds") > 0, F.col("seconds")))
        cols += ["seconds", "mib_per_s"]
    return out.select(*cols).orderBy("rec_id")


def progress(status: DataFrame) -> DataFrame:
    """Counters of a batch from its ``status`` rows: ``total, completed, failed`` (failed ones are
    completed too) and the samples decoded."""
    return status.agg(
        F.count("*").alias("total"), F.count("state").alias("completed"), F.count(F.when(F.col("state") == "failed", 1)).alias("failed"), F.coalesce(F.sum("frames"), F.lit(0)).cast("long").alias("frames")
    )


def observed(status: DataFrame, name: str = "progress") -> tuple[DataFrame, Observation]:
    """``status`` with the same counters as an observed metric, which a listener sees while a job runs
    in a stream of batches, and the caller gets when the action ends."""
    seen = Observation(name)
    return status.observe(seen, F.count("state").alias("completed"), F.count(F.when(F.col("state") == "failed", 1)).alias("failed")), seen


def wav_name(path: Column) -> Column:
    return metadata.swap_extension(path, "wav")
