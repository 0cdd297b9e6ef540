"""Queries over the driver's tables, each with the SQL that DuckDB runs on the same tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from .functions import expr, kernel
from .functions.params import CodecParams, check_channels
from .operators import blocks, frames, index, metadata, signals
from .plans import convert
from .sources import datasource, formats

P = CodecParams()
RATE = 48000
#: Fixed text of the format, with our program name: the configuration, one blank, an even length.
_XML = (
    '<X3ARCH PROG="hydroframe" VERSION="2.0" /><CFG ID="0" FTYPE="XML" /><CFG ID="1" FTYPE="WAV"><FS UNIT="Hz">48000</FS><SUFFIX>wav</SUFFIX>'
    '<CODEC TYPE="X3" VERS="2"><BLKLEN>20</BLKLEN><CODES N="4">RICE0,RICE1,RICE3,BFP</CODES><FILTER>DIFF</FILTER><NBITS>16</NBITS><T N="3">3,8,20</T></CODEC></CFG>'
)
XML_LEN = (len(_XML) + 1) // 2 * 2
START, LENGTH = 12345, 25000

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

_LINE = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice"


def _line(key: str, value: str) -> str:
    part = "" if key == "'all'" else "PARTITION BY l_suppkey "
    return f"SELECT CAST({key} AS VARCHAR) AS rec_id, row_number() OVER ({part}ORDER BY {_LINE}) - 1 AS idx, {value} AS v FROM lineitem"


SIGNAL_SQL = {
    "ev": "SELECT CAST(user_id AS VARCHAR) AS rec_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, least(32767, greatest(-32768, CAST(round(value * 100) AS INTEGER))) AS v FROM events",
    "disc": _line("l_suppkey", "CAST(round(l_discount * 100) AS INTEGER)"),
    "qty": _line("l_suppkey", "CAST(trunc(l_quantity) AS INTEGER)"),
    "price": _line("l_suppkey", "least(32767, greatest(-32768, CAST(round(l_extendedprice) - 40000 AS INTEGER)))"),
    "long": _line("'all'", "CAST(trunc(l_quantity) AS INTEGER)"),
}


def _with(name: str, body: str) -> str:
    """SQL over the block tables of a signal: f (frames), e (residuals), c (blocks)."""
    return f"""
WITH sig AS ({SIGNAL_SQL[name]}),
f AS (SELECT rec_id, idx, v, CAST(idx // 10000 AS INTEGER) AS frame_idx, CAST(idx % 10000 AS INTEGER) AS j FROM sig),
r AS (SELECT *, v - lag(v) OVER (PARTITION BY rec_id, frame_idx ORDER BY idx) AS d FROM f),
e AS (SELECT *, CAST((j - 1) // 20 AS INTEGER) AS block_idx, CAST(CASE WHEN d < 0 THEN -2 * d - 1 ELSE 2 * d END AS INTEGER) AS ri FROM r WHERE j > 0),
b AS (SELECT rec_id, frame_idx, block_idx, count(*) AS n, max(abs(d)) AS max_abs, CAST(sum(ri) AS BIGINT) AS s0, CAST(sum(ri >> 1) AS BIGINT) AS s1, CAST(sum(ri >> 3) AS BIGINT) AS s3 FROM e GROUP BY ALL),
p AS (SELECT *, CASE WHEN max_abs = 0 THEN 0 ELSE length(bin(max_abs)) END AS peak_bits FROM b),
c AS (SELECT rec_id, frame_idx, block_idx, n, max_abs, CAST(peak_bits AS INTEGER) AS peak_bits,
  CASE WHEN max_abs <= 3 THEN 'RICE0' WHEN max_abs <= 8 THEN 'RICE1' WHEN max_abs <= 20 THEN 'RICE3' WHEN peak_bits <= 14 THEN 'BFP' ELSE 'LITERAL' END AS code,
  CAST(CASE WHEN max_abs <= 3 THEN 2 + s0 + n WHEN max_abs <= 8 THEN 2 + s1 + 2 * n WHEN max_abs <= 20 THEN 2 + s3 + 4 * n WHEN peak_bits <= 14 THEN 6 + n * (peak_bits + 1) ELSE 6 + 16 * n END AS BIGINT) AS bits FROM p),
z AS (SELECT g.rec_id, g.frame_idx, g.n_samples, CAST(2 * ((16 + coalesce(x.bits, 0) + 15) // 16) AS BIGINT) AS payload_bytes
  FROM (SELECT rec_id, frame_idx, count(*) AS n_samples FROM f GROUP BY ALL) g LEFT JOIN (SELECT rec_id, frame_idx, sum(bits) AS bits FROM c GROUP BY ALL) x ON g.rec_id = x.rec_id AND g.frame_idx = x.frame_idx),
i AS (SELECT *, CAST(coalesce(sum(n_samples) OVER w, 0) AS BIGINT) AS sample_offset, CAST({28 + XML_LEN} + coalesce(sum(payload_bytes + 20) OVER w, 0) AS BIGINT) AS byte_offset
  FROM z WINDOW w AS (PARTITION BY rec_id ORDER BY frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
{body}"""


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return keep


def _sig(spark, d, name):
    return signals.signal(spark, d, name)


@query("block_bits", _with("ev", "SELECT rec_id, frame_idx, block_idx, n, max_abs, code, bits FROM c"))
def block_bits(spark, d):
    return blocks.block_stats(_sig(spark, d, "ev")).drop("peak_bits")


@query("frame_bucket", _with("long", "SELECT rec_id, frame_idx, count(*) AS n_samples, min(idx) AS first_idx, max(idx) AS last_idx FROM f GROUP BY ALL"))
def frame_bucket(spark, d):
    return blocks.frame_summary(_sig(spark, d, "long"))


@query("block_bucket", _with("qty", "SELECT rec_id, frame_idx, block_idx, count(*) AS n FROM e GROUP BY ALL"))
def block_bucket(spark, d):
    return blocks.residuals(_sig(spark, d, "qty")).groupBy("rec_id", "frame_idx", "block_idx").agg(F.count("*").alias("n"))


@query("delta_residual", _with("ev", "SELECT rec_id, idx, d FROM e"))
def delta_residual(spark, d):
    return blocks.residuals(_sig(spark, d, "ev")).select("rec_id", "idx", "d")


@query("rice_index", _with("disc", "SELECT rec_id, idx, d, ri FROM e"))
def rice_index(spark, d):
    return blocks.residuals(_sig(spark, d, "disc")).select("rec_id", "idx", "d", "ri")


@query("rice_index_inverse", _with("disc", "SELECT rec_id, idx, ri, d AS residual FROM e"))
def rice_index_inverse(spark, d):
    return blocks.residuals(_sig(spark, d, "disc")).select("rec_id", "idx", "ri", expr.rice_residual(F.col("ri")).alias("residual"))


@query("block_peak", _with("price", "SELECT rec_id, frame_idx, block_idx, max_abs, peak_bits FROM c"))
def block_peak(spark, d):
    return blocks.block_stats(_sig(spark, d, "price")).select("rec_id", "frame_idx", "block_idx", "max_abs", "peak_bits")


@query("block_code_select", _with("disc", "SELECT rec_id, frame_idx, block_idx, code FROM c"))
def block_code_select(spark, d):
    return blocks.block_stats(_sig(spark, d, "disc")).select("rec_id", "frame_idx", "block_idx", "code")


@query("code_histogram", " UNION ALL ".join(f"SELECT * FROM ({_with(s, f'''SELECT '{s}' AS signal, code, count(*) AS blocks, CAST(sum(n) AS BIGINT) AS samples FROM c GROUP BY ALL''')})" for s in signals.SIGNALS))
def code_histogram(spark, d):
    """All signals in one pass over their union; ``lineitem`` is numbered once for three of them."""
    named = lambda rows, name: rows.select(F.concat(F.lit(f"{name}:"), "rec_id").alias("rec_id"), "idx", "v")
    rows = named(_sig(spark, d, "ev"), "ev").unionByName(named(_sig(spark, d, "long"), "long")).unionByName(signals.supplier_signals(spark, d))
    stats = blocks.block_stats(rows).groupBy(F.substring_index("rec_id", ":", 1).alias("signal"), "code")
    return stats.agg(F.count("*").alias("blocks"), F.sum("n").alias("samples"))


@query("frame_payload_bytes", _with("price", "SELECT rec_id, frame_idx, n_samples, payload_bytes FROM z"))
def frame_payload_bytes(spark, d):
    return blocks.frame_sizes(_sig(spark, d, "price"))


@query("payload_bound", _with("qty", "SELECT rec_id, frame_idx, payload_bytes, CAST(2 * ceil((16 + 6 * ceil((n_samples - 1) / 20) + 16 * (n_samples - 1)) / 16) AS BIGINT) AS most FROM z"))
def payload_bound(spark, d):
    return blocks.frame_sizes(_sig(spark, d, "qty")).select("rec_id", "frame_idx", "payload_bytes", blocks.payload_bound(F.col("n_samples"), 1).alias("most"))


@query("archive_size", _with("long", f"SELECT rec_id, count(*) AS frames, CAST(sum(n_samples) AS BIGINT) AS samples, CAST(sum(payload_bytes + 20) + {28 + XML_LEN} AS BIGINT) AS archive_bytes, CAST(44 + 2 * sum(n_samples) AS BIGINT) AS wav_bytes FROM z GROUP BY rec_id"))
def archive_size(spark, d):
    return blocks.archive_sizes(_sig(spark, d, "long"), XML_LEN)


@query("frame_index", _with("long", f"SELECT rec_id, frame_idx, n_samples, payload_bytes, sample_offset, sample_offset + n_samples - 1 AS last_idx, byte_offset, CAST(sample_offset // {RATE} * 1000000000 + sample_offset % {RATE} * 1000000000 // {RATE} AS BIGINT) AS time_ns FROM i"))
def frame_index(spark, d):
    return index.frame_index(_sig(spark, d, "long"), XML_LEN, RATE)


@query("frame_time_ns", _with("long", "SELECT rec_id, frame_idx, CAST(sample_offset // 576000 * 1000000000 + sample_offset % 576000 * 1000000000 // 576000 AS BIGINT) AS time_ns FROM i"))
def frame_time_ns(spark, d):
    return index.with_offsets(blocks.frame_summary(_sig(spark, d, "long"))).select("rec_id", "frame_idx", expr.frame_time_ns(F.col("sample_offset"), F.lit(576000)).alias("time_ns"))


@query("frame_sample_counts", _with("long", "SELECT rec_id, frame_idx, n_samples, n_samples AS from_offsets FROM i"))
def frame_sample_counts(spark, d):
    return index.counts_from_offsets(index.with_offsets(blocks.frame_summary(_sig(spark, d, "long")))).select("rec_id", "frame_idx", "n_samples", "from_offsets")


@query("window_int", _with("long", f"SELECT rec_id, idx, v FROM f WHERE idx >= {START} AND idx < {START + LENGTH}"))
def window_int(spark, d):
    return index.select_window(_sig(spark, d, "long"), START, LENGTH)


@query("window_float", _with("long", f"SELECT rec_id, idx, CAST(v AS FLOAT) / CAST(32768 AS FLOAT) AS v FROM f WHERE idx >= {START} AND idx < {START + LENGTH}"))
def window_float(spark, d):
    return index.select_window(_sig(spark, d, "long"), START, LENGTH).select("rec_id", "idx", expr.to_float(F.col("v")).alias("v"))


@query("window_past_end", _with("qty", "SELECT rec_id, idx, v FROM f WHERE idx >= 100000000 AND idx < 100001000"))
def window_past_end(spark, d):
    return index.select_window(_sig(spark, d, "qty"), 100_000_000, 1000)


@query("window_clamped", _with("qty", "SELECT rec_id, idx, v FROM f WHERE idx >= 100 AND idx < 1000100"))
def window_clamped(spark, d):
    return index.select_window(_sig(spark, d, "qty"), 100, 1_000_000)


@query("chunks_for_window", _with("long", f"SELECT rec_id, frame_idx, sample_offset FROM i WHERE sample_offset < {START + LENGTH} AND sample_offset + n_samples - 1 >= {START}"))
def chunks_for_window(spark, d):
    return index.chunks_for_window(index.with_offsets(blocks.frame_summary(_sig(spark, d, "long"))), START, LENGTH).select("rec_id", "frame_idx", "sample_offset")


_ASK = "SELECT DISTINCT 'all' AS rec_id, o_orderkey * 3 - 50 AS sample FROM orders"


@query("chunk_lookup", _with("long", f", a AS ({_ASK}) SELECT a.rec_id, a.sample, coalesce(i.frame_idx, -1) AS frame_idx FROM a LEFT JOIN i ON a.rec_id = i.rec_id AND a.sample >= i.sample_offset AND a.sample < i.sample_offset + i.n_samples"))
def chunk_lookup(spark, d):
    asked = spark.read.parquet(f"{d}/orders.parquet").select(F.lit("all").alias("rec_id"), (F.col("o_orderkey") * 3 - 50).alias("sample")).distinct()
    return index.lookup(asked, index.with_offsets(blocks.frame_summary(_sig(spark, d, "long"))))


@query("chunk_lookup_any", ORACLE["chunk_lookup"])
def chunk_lookup_any(spark, d):
    asked = spark.read.parquet(f"{d}/orders.parquet").select(F.lit("all").alias("rec_id"), (F.col("o_orderkey") * 3 - 50).alias("sample")).distinct()
    return index.lookup_any(asked, index.with_offsets(blocks.frame_summary(_sig(spark, d, "long"))), 4096)


_PAIR = f"WITH l AS ({SIGNAL_SQL['qty']}), r AS ({SIGNAL_SQL['disc']})"


@query("interleave", f"{_PAIR} SELECT rec_id, 0 AS channel, idx * 2 AS pos, v FROM l UNION ALL SELECT rec_id, 1, idx * 2 + 1, v FROM r")
def interleave(spark, d):
    return blocks.interleave(_sig(spark, d, "qty"), _sig(spark, d, "disc"))


@query("deinterleave", f"{_PAIR} SELECT rec_id, 0 AS channel, idx, v FROM l UNION ALL SELECT rec_id, 1, idx, v FROM r")
def deinterleave(spark, d):
    return blocks.deinterleave(interleave(spark, d).drop("channel"), 2)


_RICE = "CASE code WHEN 'RICE0' THEN repeat('0', ri) || '1' WHEN 'RICE1' THEN repeat('0', ri >> 1) || '1' || bin(ri & 1) WHEN 'RICE3' THEN repeat('0', ri >> 3) || '1' || lpad(bin(ri & 7), 3, '0')"
_BITS = _RICE + " WHEN 'BFP' THEN lpad(bin(CAST(d AS BIGINT) & ((CAST(1 AS BIGINT) << (peak_bits + 1)) - 1)), peak_bits + 1, '0') ELSE lpad(bin(CAST(v AS BIGINT) & 65535), 16, '0') END"


def _bits_sql(sig: str, where: str) -> str:
    return _with(sig, f"SELECT e.rec_id, e.frame_idx, e.block_idx, e.idx, c.code, {_BITS} AS bits FROM e JOIN c ON e.rec_id = c.rec_id AND e.frame_idx = c.frame_idx AND e.block_idx = c.block_idx WHERE {where}")


@query("rice_bits", _bits_sql("disc", "c.code LIKE 'RICE%'"))
def rice_bits(spark, d):
    return blocks.sample_bits(_sig(spark, d, "disc")).where("code like 'RICE%'")


@query("bfp_bits", _bits_sql("qty", "c.code = 'BFP'"))
def bfp_bits(spark, d):
    return blocks.sample_bits(_sig(spark, d, "qty")).where("code = 'BFP'")


@query("literal_bits", _bits_sql("price", "c.code = 'LITERAL'"))
def literal_bits(spark, d):
    return blocks.sample_bits(_sig(spark, d, "price")).where("code = 'LITERAL'")


_HEAD = "CASE code WHEN 'RICE0' THEN '01' WHEN 'RICE1' THEN '10' WHEN 'RICE3' THEN '11' WHEN 'BFP' THEN lpad(bin(peak_bits), 6, '0') ELSE '001111' END"


@query("block_bit_strings", _with("ev", f", s AS (SELECT e.*, c.code, c.peak_bits, {_BITS} AS bits FROM e JOIN c ON e.rec_id = c.rec_id AND e.frame_idx = c.frame_idx AND e.block_idx = c.block_idx) SELECT rec_id, frame_idx, block_idx, code, {_HEAD} || string_agg(bits, '' ORDER BY idx) AS bits FROM s GROUP BY rec_id, frame_idx, block_idx, code, peak_bits"))
def block_bit_strings(spark, d):
    return blocks.block_bit_strings(_sig(spark, d, "ev"))


@query("integrate_roundtrip", _with("ev", "SELECT rec_id, idx, v FROM f"))
def integrate_roundtrip(spark, d):
    return blocks.integrate(blocks.as_steps(_sig(spark, d, "ev"))).select("rec_id", "idx", "v")


# ---- metadata: page and document texts stand in for records ---------------------------------


@query("tag_extract", r"SELECT page_id, CASE WHEN regexp_matches(html, '<title[^>]*>\s*(.*?)\s*</title>') THEN regexp_extract(html, '<title[^>]*>\s*(.*?)\s*</title>', 1) END AS title, coalesce(TRY_CAST(CASE WHEN regexp_matches(html, '<h1[^>]*>\s*(.*?)\s*</h1>') THEN regexp_extract(html, '<h1[^>]*>\s*(.*?)\s*</h1>', 1) END AS INTEGER), -1) AS number FROM pages")
def tag_extract(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", metadata.tag_text(F.col("html"), "title").alias("title"), metadata.tag_int(F.col("html"), "h1").alias("number"))


@query("byte_swap_text", "SELECT doc_id, regexp_replace(upper(hex(encode(text))), '(..)(..)', '\\2\\1', 'g') AS swapped FROM documents")
def byte_swap_text(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return docs.select("doc_id", metadata.swap_byte_pairs(F.hex(F.encode("text", "UTF-8"))).alias("swapped"))


_RECORDS = "SELECT CAST(user_id AS VARCHAR) AS rec_id, event_id AS record_idx, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_type END AS text FROM events"


@query("metadata_concat", f"SELECT rec_id, coalesce('<SUD_METADATA>' || chr(10) || string_agg(text, '' ORDER BY record_idx, text) || '</SUD_METADATA>' || chr(10), '') AS xml FROM ({_RECORDS}) GROUP BY rec_id")
def metadata_concat(spark, d):
    rows = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").cast("string").alias("rec_id"), F.col("event_id").alias("record_idx"), F.when(F.col("event_id") % 3 != 0, F.col("event_type")).alias("text"))
    return metadata.concat_records(rows)


_CONFIG = "SELECT CAST(user_id AS VARCHAR) AS rec_id, event_id AS record_idx, CASE event_id % 5 WHEN 0 THEN 'wav' WHEN 1 THEN 'audio' ELSE 'event' END AS kind, CAST(event_id % 7 * 8000 - 8000 AS INTEGER) AS fs, CAST(event_id % 2 + 1 AS INTEGER) AS nchs, 16 AS nbits, CASE WHEN event_id % 5 = 3 THEN event_type END AS hardware FROM events"


@query(
    "first_last_config",
    f"""
WITH r AS ({_CONFIG}),
g AS (SELECT rec_id, max(CASE WHEN kind = 'wav' THEN record_idx END) AS w, min(CASE WHEN kind = 'audio' AND fs >= 0 THEN record_idx END) AS a, min(CASE WHEN hardware IS NOT NULL THEN record_idx END) AS h FROM r GROUP BY rec_id)
SELECT g.rec_id, coalesce(CASE WHEN coalesce(w.fs, -1) >= 0 THEN w.fs ELSE a.fs END, 576000) AS sample_rate, coalesce(CASE WHEN coalesce(w.fs, -1) >= 0 THEN w.nchs ELSE a.nchs END, 1) AS channels,
  coalesce(CASE WHEN coalesce(w.fs, -1) >= 0 THEN w.nbits ELSE a.nbits END, 16) AS bit_depth, coalesce(h.hardware, 'UNKNOWN') AS device_id
FROM g LEFT JOIN r w ON g.rec_id = w.rec_id AND g.w = w.record_idx LEFT JOIN r a ON g.rec_id = a.rec_id AND g.a = a.record_idx LEFT JOIN r h ON g.rec_id = h.rec_id AND g.h = h.record_idx
""",
)
def first_last_config(spark, d):
    e = F.col("event_id")
    rows = spark.read.parquet(f"{d}/events.parquet").select(
        F.col("user_id").cast("string").alias("rec_id"), e.alias("record_idx"), F.when(e % 5 == 0, "wav").when(e % 5 == 1, "audio").otherwise("event").alias("kind"),
        (e % 7 * 8000 - 8000).cast("int").alias("fs"), (e % 2 + 1).cast("int").alias("nchs"), F.lit(16).alias("nbits"), F.when(e % 5 == 3, F.col("event_type")).alias("hardware"),
    )
    return metadata.choose_config(rows)


@query("crc16_text", """
WITH RECURSIVE t AS (SELECT page_id, encode(url) AS raw FROM pages),
s(page_id, raw, k, crc) AS (SELECT page_id, raw, 0, 65535 FROM t
  UNION ALL
  SELECT page_id, raw, k + 1, list_reduce(list_prepend(xor(crc, CAST(('0x' || substr(hex(raw), 2 * k + 1, 2)) AS INTEGER) << 8), range(8)), lambda c, i: CASE WHEN c & 32768 <> 0 THEN xor((c << 1) & 65535, 4129) ELSE (c << 1) & 65535 END)
  FROM s WHERE k < octet_length(raw))
SELECT page_id, CAST(crc AS INTEGER) AS crc FROM s WHERE k = octet_length(raw)
""")
def crc16_text(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", expr.crc16(F.encode("url", "UTF-8")).cast("int").alias("crc"))


@query("path_rename", "SELECT page_id, CASE WHEN regexp_matches(p, '\\.[^./]*$') THEN regexp_replace(p, '\\.[^./]*$', '.wav') ELSE p || '.wav' END AS path FROM (SELECT page_id, regexp_replace(url, '/+$', '') AS p FROM pages)")
def path_rename(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", metadata.swap_extension(F.col("url"), "wav").alias("path"))


@query("channel_check", "SELECT CAST(conv_id AS VARCHAR) AS rec_id, CAST(arg_max(greatest(coalesce(length(role), 0) % 3, 1), turn) AS INTEGER) AS channels, min(greatest(coalesce(length(role), 0) % 3, 1)) <> max(greatest(coalesce(length(role), 0) % 3, 1)) AS mixed FROM conversations GROUP BY conv_id")
def channel_check(spark, d):
    """Turns stand in for frames; a frame without a channel count has one channel."""
    rows = spark.read.parquet(f"{d}/conversations.parquet").select(F.col("conv_id").cast("string").alias("rec_id"), F.col("turn").alias("frame_idx"), (F.coalesce(F.length("role"), F.lit(0)) % 3).alias("channels"))
    return index.channel_check(rows)


# ---- kernels ------------------------------------------------------------------------------


def _coded(spark, d, name):
    return frames.encode_frames(frames.pack_frames(_sig(spark, d, name)), 1, RATE)


@query("encode_frames", _with("ev", "SELECT rec_id, frame_idx, n_samples, payload_bytes FROM z"))
def encode_frames(spark, d):
    return _coded(spark, d, "ev").select("rec_id", "frame_idx", F.col("n_samples").cast("long").alias("n_samples"), F.length("payload").cast("long").alias("payload_bytes"))


@query("encode_decode_roundtrip", _with("price", "SELECT rec_id, 0 AS channel, idx, v FROM f"))
def encode_decode_roundtrip(spark, d):
    return frames.explode_frames(frames.decode_frames(_coded(spark, d, "price")))


@query("stereo_roundtrip", ORACLE["deinterleave"])
def stereo_roundtrip(spark, d):
    left, right = _sig(spark, d, "qty").withColumn("channel", F.lit(0)), _sig(spark, d, "disc").withColumn("channel", F.lit(1))
    packed = frames.pack_frames(left.unionByName(right), 2)
    return frames.explode_frames(frames.decode_frames(frames.encode_frames(packed, 2, RATE), 2), 2)


@query("decode_float", _with("ev", "SELECT rec_id, idx, CAST(v AS FLOAT) / CAST(32768 AS FLOAT) AS v FROM f"))
def decode_float(spark, d):
    return frames.explode_frames(frames.decode_frames(_coded(spark, d, "ev"))).select("rec_id", "idx", expr.to_float(F.col("v")).alias("v"))


_FRAME_BITS = f", s AS (SELECT e.*, c.code, c.peak_bits, {_BITS} AS bits FROM e JOIN c ON e.rec_id = c.rec_id AND e.frame_idx = c.frame_idx AND e.block_idx = c.block_idx), bl AS (SELECT rec_id, frame_idx, block_idx, {_HEAD} || string_agg(bits, '' ORDER BY idx) AS bits FROM s GROUP BY rec_id, frame_idx, block_idx, code, peak_bits), fr AS (SELECT f.rec_id, f.frame_idx, lpad(bin(CAST(f.v AS BIGINT) & 65535), 16, '0') || coalesce(string_agg(bl.bits, '' ORDER BY block_idx), '') AS bits FROM f LEFT JOIN bl ON f.rec_id = bl.rec_id AND f.frame_idx = bl.frame_idx WHERE f.j = 0 GROUP BY f.rec_id, f.frame_idx, f.v) SELECT rec_id, frame_idx, rpad(bits, CAST(16 * ((length(bits) + 15) // 16) AS INTEGER), '0') AS bits FROM fr"


def _frame_bits(spark, d, name):
    bits = F.transform(F.sequence(F.lit(1), F.length("payload")), lambda k: F.lpad(F.bin(expr.byte_at(F.col("payload"), k).cast("long")), 8, "0"))
    return _coded(spark, d, name).select("rec_id", "frame_idx", F.array_join(bits, "").alias("bits"))


@query("kernel_bits", _with("ev", _FRAME_BITS))
def kernel_bits(spark, d):
    """The kernel's payloads bit for bit, against the relational bit strings: packed and literal blocks."""
    return _frame_bits(spark, d, "ev")


@query("kernel_bits_rice", _with("disc", _FRAME_BITS))
def kernel_bits_rice(spark, d):
    """The same where Rice orders 0 and 1 are chosen."""
    return _frame_bits(spark, d, "disc")


@query("kernel_bits_mixed", _with("qty", _FRAME_BITS))
def kernel_bits_mixed(spark, d):
    """The same with Rice order 3 beside packed blocks."""
    return _frame_bits(spark, d, "qty")


@query("other_orders_roundtrip", _with("qty", "SELECT rec_id, 0 AS channel, idx, v FROM f"))
def other_orders_roundtrip(spark, d):
    """Rice orders that only the general decoder reads."""
    p = CodecParams(block_len=16, blocks_per_frame=625, orders=(1, 2, 4), thresholds=(5, 12, 31))
    coded = frames.encode_frames(frames.pack_frames(_sig(spark, d, "qty"), 1, p), 1, RATE, p)
    return frames.explode_frames(frames.decode_frames(coded, 1, 16, (1, 2, 4)), 1, p)


_BITS_OF = "(SELECT page_id, array_to_string([lpad(bin(CAST(('0x' || substr(hex(encode(url)), 2 * k + 1, 2)) AS BIGINT)), 8, '0') for k in range(octet_length(encode(url)))], '') AS b FROM pages)"


@query("bit_reader", f"SELECT page_id, CAST(instr(b, '1') - 1 AS INTEGER) AS zeros, CAST(list_reduce(list_prepend(0, [CAST(x AS INTEGER) for x in string_split(substr(b, instr(b, '1'), 5), '')]), lambda a, x: a * 2 + x) AS INTEGER) AS five, CAST(list_reduce(list_prepend(0, [CAST(x AS INTEGER) for x in string_split(substr(b, instr(b, '1') + 5, 20), '')]), lambda a, x: a * 2 + x) AS INTEGER) AS twenty, CAST(length(b) - instr(b, '1') - 24 AS INTEGER) AS remaining FROM {_BITS_OF}")
def bit_reader(spark, d):
    """Unary count, then 5 and 20 bits, of the urls' bytes."""

    @F.pandas_udf("struct<zeros int, five int, twenty int, remaining int>")
    def read(raw: pd.Series) -> pd.DataFrame:
        rows = []
        for x in raw:
            bits = kernel.BitReader(bytes(x))
            rows.append((bits.zeros(), bits.read(5), bits.read(20), bits.remaining))
        return pd.DataFrame(rows, columns=["zeros", "five", "twenty", "remaining"], dtype="int32")

    rows = spark.read.parquet(f"{d}/pages.parquet").select("page_id", read(F.encode("url", "UTF-8")).alias("r"))
    return rows.select("page_id", "r.*")


@query("frame_headers", _with("long", f"SELECT rec_id, frame_idx, 1 AS source_id, 1 AS channels, n_samples, payload_bytes, CAST(sample_offset // {RATE} * 1000000000 + sample_offset % {RATE} * 1000000000 // {RATE} AS BIGINT) AS time_ns, true AS key_ok, true AS header_crc_ok, true AS payload_crc_ok FROM i"))
def frame_headers(spark, d):
    """Frame headers encoded by the kernel, parsed and checked by built-in functions."""
    f = F.col("frame")
    rows = frames.payload_crc(_coded(spark, d, "long")).withColumn("own", expr.crc16(F.substring(f, 1, 16)))
    u = lambda s, n: expr.unsigned(f, s, n)
    return rows.select(
        "rec_id", "frame_idx", u(2, 1).cast("int").alias("source_id"), u(3, 1).cast("int").alias("channels"), u(4, 2).alias("n_samples"), u(6, 2).alias("payload_bytes"), u(8, 8).alias("time_ns"),
        (u(0, 2) == 0x7833).alias("key_ok"), (u(16, 2) == F.col("own")).alias("header_crc_ok"), (u(18, 2) == F.col("crc")).alias("payload_crc_ok"),
    )


# ---- files: written from a signal, then read again -------------------------------------------


def _folder(spark) -> str:
    """A new folder below ``spark.checkpoint.dir``, removed when the driver ends; without that setting
    (tests on one machine) a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="hydroframe-")
        spark.conf.set("spark.checkpoint.dir", base)
        atexit.register(shutil.rmtree, base, ignore_errors=True)
    path = f"{datasource.local(base).rstrip('/')}/hydro-{uuid.uuid4().hex}"
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


@query("archive_scan", _with("disc", "SELECT rec_id, idx, v FROM f"))
def archive_scan(spark, d):
    path = _folder(spark)
    convert.write_archives(_coded(spark, d, "disc"), path, RATE)
    packed = convert.read(spark, path, "samples", verify_payload_crc=True)
    return frames.explode_frames(packed, offset="sample_offset").select("rec_id", "idx", "v")


@query("archive_index_scan", _with("disc", "SELECT rec_id, frame_idx, n_samples, payload_bytes, sample_offset, byte_offset + 20 AS byte_offset FROM i"))
def archive_index_scan(spark, d):
    path = _folder(spark)
    convert.write_archives(_coded(spark, d, "disc"), path, RATE)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.x3a").load(path)
    rows = datasource.binary_table(files, "frame_index")
    return rows.select("rec_id", "frame_idx", F.col("n_samples").cast("long").alias("n_samples"), F.col("chunk_length").cast("long").alias("payload_bytes"), "sample_offset", "byte_offset")


@query("recordings_scan", _with("disc", f"SELECT rec_id, 'archive' AS container, {RATE} AS sample_rate, 1 AS channels, 16 AS bit_depth, count(*) AS frames, 20 AS block_len, left('{_XML} ', {XML_LEN}) AS xml FROM f GROUP BY rec_id"))
def recordings_scan(spark, d):
    path = _folder(spark)
    convert.write_archives(_coded(spark, d, "disc"), path, RATE)
    return convert.read(spark, path, "recordings").select("rec_id", "container", "sample_rate", "channels", "bit_depth", "frames", "block_len", "xml")


@query("archive_window", _with("qty", "SELECT rec_id, idx, v FROM f WHERE idx >= 37 AND idx < 337"))
def archive_window(spark, d):
    path = _folder(spark)
    convert.write_archives(_coded(spark, d, "qty"), path, RATE)
    packed = convert.read(spark, path, "samples", start=37, length=300)
    return index.select_window(frames.explode_frames(packed, offset="sample_offset"), 37, 300).select("rec_id", "idx", "v")


@query("wav_scan", _with("qty", "SELECT rec_id, idx, v FROM f"))
def wav_scan(spark, d):
    first, second = _folder(spark), _folder(spark)
    convert.write_archives(_coded(spark, d, "qty"), first, RATE)
    convert.archive_to_wav(spark, first, second)
    packed = convert.read(spark, second, "samples")
    return frames.explode_frames(packed, offset="sample_offset").select("rec_id", "idx", "v")


@query("wav_to_archive", _with("disc", "SELECT rec_id, frame_idx, n_samples, payload_bytes FROM z"))
def wav_to_archive(spark, d):
    first, second, third = _folder(spark), _folder(spark), _folder(spark)
    convert.write_archives(_coded(spark, d, "disc"), first, RATE)
    convert.archive_to_wav(spark, first, second)
    convert.wav_to_archive(spark, second, third)
    return convert.read(spark, third, "frame_index").select("rec_id", "frame_idx", F.col("n_samples").cast("long").alias("n_samples"), F.col("chunk_length").cast("long").alias("payload_bytes"))


#: Fixed texts of the format.
_SUD_TEXT = '<CFG ID="4" FTYPE="wav" CODEC="3"><FS> 48000 </FS><NBITS> 16 </NBITS><NCHS> 1 </NCHS></CFG><CFG ID="3" FTYPE="X3V2"><BLKLEN> 20 </BLKLEN></CFG>'
_SUD_TEXT += " " * (len(_SUD_TEXT) % 2)


def _recorder_files(spark, d):
    """Recorder files built in memory from coded frames."""

    @F.pandas_udf("binary")
    def build(payloads: pd.Series, samples: pd.Series) -> pd.Series:
        return pd.Series([b"".join(formats.sud_record(kernel.swap_pairs(bytes(p)), int(n)) for p, n in zip(ps, ns)) for ps, ns in zip(payloads, samples)], dtype=object)

    head = formats.sud_record(kernel.swap_pairs(_SUD_TEXT.encode()), 1)
    parts = F.array_sort(F.collect_list(F.struct("frame_idx", "n_samples", "payload")))
    return _coded(spark, d, "disc").groupBy("rec_id").agg(parts.alias("p")).select("rec_id", build("p.payload", "p.n_samples").alias("body")).select(F.concat(F.lit("/"), "rec_id", F.lit(".sud")).alias("path"), F.concat(F.lit(head), "body").alias("content"))


@query("sud_scan", _with("disc", "SELECT rec_id, idx, v FROM f"))
def sud_scan(spark, d):
    return frames.explode_frames(datasource.binary_table(_recorder_files(spark, d), "samples"), offset="sample_offset").select("rec_id", "idx", "v")


@query("sud_records_scan", _with("disc", f"SELECT rec_id, 0 AS record_idx, true AS is_metadata, NULL AS n_samples, {len(_SUD_TEXT)} AS payload_length, '{_SUD_TEXT}' AS text FROM z GROUP BY rec_id UNION ALL SELECT rec_id, frame_idx + 1, false, n_samples, payload_bytes, NULL FROM z"))
def sud_records_scan(spark, d):
    rows = datasource.binary_table(_recorder_files(spark, d), "sud_records")
    return rows.select("rec_id", "record_idx", "is_metadata", F.col("n_samples").cast("long").alias("n_samples"), F.col("payload_length").cast("long").alias("payload_length"), "text")


@query("sud_index", _with("disc", f"SELECT rec_id, frame_idx, n_samples, payload_bytes, sample_offset, CAST(sample_offset * 1000000000 // 48000 AS BIGINT) AS time_ns, CAST({40 + len(_SUD_TEXT)} + byte_offset - {28 + XML_LEN} AS BIGINT) AS byte_offset FROM i"))
def sud_index(spark, d):
    """Audio records only, with running sample offsets and times from them."""
    rows = datasource.binary_table(_recorder_files(spark, d), "frame_index")
    return rows.select("rec_id", "frame_idx", F.col("n_samples").cast("long").alias("n_samples"), F.col("chunk_length").cast("long").alias("payload_bytes"), "sample_offset", "time_ns", "byte_offset")


@query("sud_recordings", _with("disc", "SELECT rec_id, 48000 AS sample_rate, 1 AS channels, 16 AS bit_depth, count(*) AS frames, 'UNKNOWN' AS device_id, 20 AS block_len FROM f GROUP BY rec_id"))
def sud_recordings(spark, d):
    return datasource.binary_table(_recorder_files(spark, d), "recordings").select("rec_id", "sample_rate", "channels", "bit_depth", "frames", "device_id", "block_len")


@query("pcm_bytes", _with("ev", "SELECT rec_id, frame_idx, upper(string_agg(lpad(to_hex(v & 255), 2, '0') || lpad(to_hex((v >> 8) & 255), 2, '0'), '' ORDER BY idx)) AS bytes FROM f GROUP BY rec_id, frame_idx"))
def pcm_bytes(spark, d):
    """Packed frames as little-endian 16-bit PCM."""
    return frames.pack_frames(_sig(spark, d, "ev")).select("rec_id", "frame_idx", F.hex(frames.little_endian(F.col("pcm"))).alias("bytes"))


@query("size_report", _with("disc", f"SELECT 'archive' AS container, count(*) AS files, CAST(sum(b) AS BIGINT) AS file_bytes, CAST(sum(44 + 2 * n) AS BIGINT) AS wav_bytes, sum(b) / sum(44 + 2 * n) AS ratio FROM (SELECT rec_id, sum(payload_bytes + 20) + {28 + XML_LEN} AS b, sum(n_samples) AS n FROM z GROUP BY rec_id)"))
def size_report(spark, d):
    path = _folder(spark)
    convert.write_archives(_coded(spark, d, "disc"), path, RATE)
    files = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/]*)\.x3a$", 1).alias("rec_id"), F.col("length").alias("file_bytes"))
    return convert.size_report(convert.read(spark, path, "recordings"), files)


@query("content_sniff", "SELECT CAST(page_id AS VARCHAR) AS rec_id, page_id % 2 = 0 AS archive FROM pages")
def content_sniff(spark, d):
    rows = spark.read.parquet(f"{d}/pages.parquet")
    content = F.concat(F.when(F.col("page_id") % 2 == 0, F.lit(b"X3ARCHIV")).otherwise(F.lit(b"X3")), F.encode("url", "UTF-8"))
    return rows.select(F.col("page_id").cast("string").alias("rec_id"), datasource.is_archive(content).alias("archive"))


@query("decoded_archive", _with("disc", "SELECT rec_id, CAST(count(*) AS BIGINT) AS samples, md5(string_agg(CAST(v AS VARCHAR), ',' ORDER BY idx)) AS pcm_md5 FROM f GROUP BY rec_id"))
def decoded_archive(spark, d):
    """Whole archives in memory, one row a recording."""
    path = _folder(spark)
    convert.write_archives(_coded(spark, d, "disc"), path, RATE)
    whole = convert.to_memory(convert.read(spark, path, "samples"))
    return whole.select("rec_id", F.size("pcm").cast("long").alias("samples"), F.md5(F.array_join("pcm", ",")).alias("pcm_md5"))


@query("folder_scan", _with("qty", f"SELECT rec_id, k.container, {RATE} AS sample_rate, count(*) AS frames FROM f, (SELECT unnest(['archive', 'wav']) AS container) k GROUP BY ALL"))
def folder_scan(spark, d):
    """A folder with archives in one subfolder and WAV files with sidecars in a deeper one."""
    path = _folder(spark)
    convert.write_archives(_coded(spark, d, "qty"), f"{path}/a", RATE)
    convert.archive_to_wav(spark, f"{path}/a", f"{path}/b/c")
    return convert.read(spark, path, "recordings").select("rec_id", "container", "sample_rate", "frames")


@query("sidecars", _with("qty", f"SELECT rec_id, left('{_XML} ', {XML_LEN}) AS xml FROM f GROUP BY rec_id"))
def sidecars(spark, d):
    path = _folder(spark)
    convert.write_archives(_coded(spark, d, "qty"), f"{path}/a", RATE)
    convert.archive_to_wav(spark, f"{path}/a", f"{path}/b")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xml").load(f"file://{path}/b")
    return files.select(F.regexp_extract("path", r"([^/]*)\.xml$", 1).alias("rec_id"), F.decode("content", "US-ASCII").alias("xml"))


@query("file_report", _with("disc", f"SELECT rec_id, 'archive' AS container, b AS file_bytes, 44 + 2 * n AS wav_bytes, b / (44 + 2 * n) AS ratio FROM (SELECT rec_id, CAST(sum(payload_bytes + 20) + {28 + XML_LEN} AS BIGINT) AS b, CAST(sum(n_samples) AS BIGINT) AS n FROM z GROUP BY rec_id) ORDER BY rec_id"))
def file_report(spark, d):
    path = _folder(spark)
    convert.write_archives(_coded(spark, d, "disc"), path, RATE)
    files = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/]*)\.x3a$", 1).alias("rec_id"), F.col("length").alias("file_bytes"))
    return convert.file_report(convert.read(spark, path, "recordings"), files)


# ---- faults: one small archive a page, changed in one way -------------------------------------

_SMALL = CodecParams(blocks_per_frame=1)


def faulty_archive(case: int, seed: int) -> bytes:
    """A 60-sample archive of three frames with the fault of ``case``."""
    pcm = ((np.arange(60) * (seed % 97 + 3)) % 400).astype(np.int16)[:, None]
    data = bytearray(formats.encode_archive(pcm, RATE, _SMALL))
    prefix = len(formats.archive_prefix(RATE, _SMALL))
    first = len(formats.frame_header(1, 1, 20, b"", 0)) + len(kernel.encode_frame(pcm[:20], _SMALL))
    own = lambda payload, n: data[:prefix] + formats.frame_header(1, 1, n, payload, 0) + payload
    if case in (1, 2):  # payload byte, header byte
        data[prefix + (24 if case == 1 else 5)] ^= 0xFF
    elif case == 3:
        data = bytearray(b"certainly no archive, but long enough to be one")
    elif case == 4:
        data = data[:20]
    elif case == 5:  # a byte of the configuration
        data[40] ^= 0xFF
    elif case == 6:  # the configuration is cut off
        data = data[: prefix - 10]
    elif case == 7:  # what follows is no frame
        data = data[: prefix + first] + b"padding that is longer than a header"
    elif case == 8:  # the last payload is cut off
        data = data[:-2]
    elif case == 9:  # a frame without samples
        data = data[: prefix + first] + formats.frame_header(1, 1, 0, b"\0\0", 0) + b"\0\0" + data[prefix + first :]
    elif case == 10:  # fewer bits than samples
        data = own(kernel.encode_frame(pcm[:20], _SMALL)[:4], 20)
    elif case == 11:  # a Rice index out of range
        data = own(kernel.pack_fields(np.array([0, 1, 1]), np.array([16, 2, 600]), 2), 2)
    elif case == 12:  # packed fields narrower than any writer makes
        data = own(kernel.pack_fields(np.array([0, 3, 0]), np.array([16, 6, 40]), 2), 10)
    return bytes(data)


_FAULTS = """SELECT CAST(page_id AS VARCHAR) AS rec_id, CAST(page_id % 13 AS INTEGER) AS fault,
  CASE WHEN page_id % 13 IN (0, 7, 8, 9) THEN 'done' ELSE 'failed' END AS state,
  CAST(CASE page_id % 13 WHEN 0 THEN 60 WHEN 7 THEN 20 WHEN 8 THEN 40 WHEN 9 THEN 60 ELSE 0 END AS BIGINT) AS frames FROM pages"""


def _faulty(spark, d):
    build = F.pandas_udf(lambda ids: ids.map(lambda k: faulty_archive(int(k) % 13, int(k))), "binary")
    pages = spark.read.parquet(f"{d}/pages.parquet")
    files = pages.select(F.concat(F.lit("/"), F.col("page_id").cast("string"), F.lit(".x3a")).alias("path"), build("page_id").alias("content"))
    return datasource.binary_table(files, "status", verify=True)


@query("archive_faults", _FAULTS)
def archive_faults(spark, d):
    """How far each faulty archive is decoded; a fault is a row, not an error of the job."""
    return _faulty(spark, d).select("rec_id", F.expr("cast(cast(rec_id as long) % 13 as int)").alias("fault"), "state", "frames")


@query("conversion_progress", f"SELECT count(*) AS total, count(state) AS completed, count(*) FILTER (state = 'failed') AS failed, CAST(sum(frames) AS BIGINT) AS frames FROM ({_FAULTS})")
def conversion_progress(spark, d):
    return convert.progress(_faulty(spark, d))


#: Arguments and whether the reference's rules allow them.
_ARGUMENTS = [
    ("block_len 0", False), ("block_len 1", True), ("block_len 64", True), ("block_len 65", False), ("two orders", False), ("thresholds that fall", False),
    ("blocks_per_frame 0", False), ("samples over 65535", False), ("channels 0", False), ("channels 1", True), ("channels 8", True), ("channels 9", False),
]


@query("argument_checks", "SELECT * FROM (VALUES " + ", ".join(f"('{c}', {str(ok).lower()})" for c, ok in _ARGUMENTS) + ") t(argument, allowed)")
def argument_checks(spark, d):
    def allowed(argument: str) -> bool:
        name, _, n = argument.rpartition(" ")
        one = {"two orders": {"orders": (0, 1)}, "thresholds that fall": {"thresholds": (8, 3, 20)}, "samples over 65535": {"blocks_per_frame": 4000}}
        try:
            check_channels(int(n)) if name == "channels" else CodecParams(**one.get(argument, {name: int(n) if n.isdecimal() else 0}))
        except ValueError:
            return False
        return True

    rows = spark.createDataFrame([(c,) for c, _ in _ARGUMENTS], "argument string")
    return rows.select("argument", F.pandas_udf(lambda s: s.map(allowed), "boolean")("argument").alias("allowed"))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: block coding of every user's event signal."""
    return block_bits(spark, sf_dir)
