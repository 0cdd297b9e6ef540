"""Tables read as sampled 16-bit signals: ``rec_id STRING, idx BIGINT, v INT``.

Sample numbers need the order of a whole recording.  They are made in two levels: rows are counted
by (recording, chunk), chunk starts are a prefix sum of those counts, and rows are numbered within
their chunk.  A recording that holds most of the table is so spread over its chunks, and no task
sorts a recording whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

#: A total order of lineitem rows (order key and line number alone repeat).
LINE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def clamp16(x: Column) -> Column:
    return F.least(F.lit(32767), F.greatest(F.lit(-32768), x.cast("int")))


def number_samples(rows: DataFrame, chunk: Column, order: list[str]) -> DataFrame:
    """Adds ``idx``, the row's place in its ``rec_id`` in the order given; ``chunk`` must not fall
    along that order."""
    rows = rows.withColumn("_chunk", chunk)
    before = Window.partitionBy("rec_id").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("rec_id", "_chunk").agg(F.count("*").alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy("rec_id", "_chunk").orderBy(*order)
    numbered = rows.withColumn("_k", F.row_number().over(inside)).join(starts, ["rec_id", "_chunk"])
    return numbered.withColumn("idx", (F.col("_start") + F.col("_k") - 1).cast("long")).drop("_chunk", "_k", "_start")


def signal(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the signals ``ev, disc, qty, price, long``."""
    if name == "ev":
        rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").cast("string").alias("rec_id"), "ts", "event_id", clamp16(F.round(F.col("value") * 100)).alias("v"))
        return number_samples(rows, F.date_trunc("day", "ts"), ["ts", "event_id"]).select("rec_id", "idx", "v")
    value = {
        "disc": F.round(F.col("l_discount") * 100).cast("int"),
        "qty": F.col("l_quantity").cast("int"),
        "price": clamp16(F.round("l_extendedprice") - 40000),
        "long": F.col("l_quantity").cast("int"),
    }[name]
    rec = F.lit("all") if name == "long" else F.col("l_suppkey").cast("string")
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(rec.alias("rec_id"), *LINE_ORDER, value.alias("v"))
    # For the one long recording a chunk is 1024 order keys; a supplier's rows are fewer by far.
    return number_samples(rows, F.floor(F.col("l_orderkey") / (1024 if name == "long" else 1 << 20)), LINE_ORDER).select("rec_id", "idx", "v")


def supplier_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``disc, qty, price`` from one numbering of ``lineitem``; ``rec_id`` is ``signal:supplier``."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.col("l_suppkey").cast("string").alias("rec_id"), *LINE_ORDER,
        F.map_from_arrays(F.array(F.lit("disc"), F.lit("qty"), F.lit("price")), F.array(F.round(F.col("l_discount") * 100).cast("int"), F.col("l_quantity").cast("int"), clamp16(F.round("l_extendedprice") - 40000))).alias("values"),
    )
    numbered = number_samples(rows, F.floor(F.col("l_orderkey") / (1 << 20)), LINE_ORDER)
    return numbered.select("rec_id", "idx", F.explode("values").alias("signal", "v")).select(F.concat("signal", F.lit(":"), "rec_id").alias("rec_id"), "idx", "v")


SIGNALS = ("ev", "disc", "qty", "price", "long")
