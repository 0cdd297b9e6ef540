"""Tags, configuration records and their choice among records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def tag_text(text: Column, tag: str) -> Column:
    """Text of the first ``<tag ...>..</tag>`` on one line, trimmed; null if there is none."""
    pattern = rf"<{tag}[^>]*>\s*(.*?)\s*</{tag}>"
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 1))


def tag_int(text: Column, tag: str) -> Column:
    """The tag's number, -1 if there is none or it is no number."""
    return F.coalesce(tag_text(text, tag).try_cast("int"), F.lit(-1))


def swap_byte_pairs(hex_text: Column) -> Column:
    """Hex digits with the bytes of each pair exchanged; an odd last byte stays."""
    return F.regexp_replace(hex_text, "(..)(..)", "$2$1")


def concat_records(records: DataFrame, root: str = "SUD_METADATA") -> DataFrame:
    """Metadata texts of a recording in record order under one root (its tags end their lines); no
    text gives an empty string."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("record_idx", "text")))), lambda x: x.text), "")
    return records.groupBy("rec_id").agg(body.alias("body")).select("rec_id", F.when(F.col("body") == "", "").otherwise(F.concat(F.lit(f"<{root}>\n"), "body", F.lit(f"</{root}>\n"))).alias("xml"))


def choose_config(records: DataFrame) -> DataFrame:
    """``rec_id, record_idx, kind, fs, nchs, nbits, hardware``: the last ``wav`` configuration wins; if
    it has no rate, the first ``audio`` one with a rate (0 or more) stands in with all three values; the first
    hardware id wins."""
    conf = F.struct("fs", "nchs", "nbits")
    rows = records.groupBy("rec_id").agg(
        F.max_by(conf, F.when(F.col("kind") == "wav", F.col("record_idx"))).alias("wav"),
        F.min_by(conf, F.when((F.col("kind") == "audio") & (F.col("fs") >= 0), F.col("record_idx"))).alias("audio"),
        F.min_by("hardware", F.when(F.col("hardware").isNotNull(), F.col("record_idx"))).alias("device"),
    )
    has_wav = F.coalesce(F.col("wav.fs"), F.lit(-1)) >= 0
    pick = lambda c, default: F.coalesce(F.when(has_wav, F.col(f"wav.{c}")).otherwise(F.col(f"audio.{c}")), F.lit(default))
    return rows.select("rec_id", pick("fs", 576000).alias("sample_rate"), pick("nchs", 1).alias("channels"), pick("nbits", 16).alias("bit_depth"), F.coalesce("device", F.lit("UNKNOWN")).alias("device_id"))


def swap_extension(path: Column, ext: str) -> Column:
    """The path with its name's extension replaced; a name without one gets it appended."""
    path = F.regexp_replace(path, "/+$", "")
    return F.when(path.rlike(r"\.[^./]*$"), F.regexp_replace(path, r"\.[^./]*$", "." + ext)).otherwise(F.concat(path, F.lit("." + ext)))
