"""Queries beside their SQL, data source behaviour, plans and streams."""

import io
import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from hydroframe import queries
from hydroframe.functions import expr, kernel
from hydroframe.functions.params import CodecParams
from hydroframe.operators import blocks, frames, index, signals
from hydroframe.plans import convert
from hydroframe.sources import datasource, formats
from hydroframe.streaming import blocks as streaming
from tests.test_codec import SUD_TEXT, archive, sud_file
from verify_oracle import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query_matches_sql(spark, name):
    ok, what = compare(spark, SF, name)
    assert ok, what
    assert name in queries.ORACLE


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns and df.count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.fixture(scope="session")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("files")
    os.makedirs(d / "sub")
    (x, a), (y, s) = archive(25_000, 2), sud_file()
    (d / "one.X3A").write_bytes(a)
    (d / "sub" / "two.sud").write_bytes(s)
    (d / "sub" / "three.wav").write_bytes(formats.wav_header(8000, 1, 30_000) + np.arange(30_000, dtype="<i2").tobytes())
    (d / "notes.txt").write_text("no recording")
    return str(d), x, y


def test_source(spark, folder):
    path, x, y = folder
    recs = {r.rec_id: r for r in convert.read(spark, path, "recordings").collect()}
    assert {(r.container, r.frames, r.channels) for r in recs.values()} == {("archive", 25000, 2), ("sud", 1000, 1), ("wav", 30000, 1)}
    assert recs["two"].device_id == "ST600" and recs["two"].xml.count("<CFG") == 3
    pcm = {(r.rec_id, r.frame_idx): r.pcm for r in convert.read(spark, path, "samples", verify_payload_crc=True).collect()}
    assert np.array_equal(np.concatenate([pcm["one", k] for k in range(3)]), x.ravel()) and np.array_equal(np.concatenate([pcm["two", k] for k in range(2)]), y.ravel())
    assert len(pcm["three", 2]) == 10_000
    meta = convert.read(spark, path, "sud_records").where("is_metadata").collect()
    assert [r.text for r in meta if r.rec_id == "two"] == SUD_TEXT


@pytest.mark.parametrize("start,length", [(0, 1), (1, 999), (12345, 4096), (9999, 2), (20904, 50000), (25000, 10), (-1, 5), (3, 0)])
def test_window_is_a_slice(spark, folder, start, length):
    path, x, _ = folder
    packed = convert.read(spark, path, "samples", start=start, length=length).where("rec_id = 'one'")
    rows = index.select_window(frames.explode_frames(packed, 2, offset="sample_offset"), start, length).collect()
    got = sorted((r.idx, r.channel, r.v) for r in rows)
    want = x[start : start + length] if start >= 0 else x[:0]
    assert [g[2] for g in got] == want.ravel().tolist()


def test_pushdown_reads_fewer_frames(spark, folder):
    from pyspark.sql.datasource import GreaterThanOrEqual, LessThan

    reader = datasource.PushingReader({"path": folder[0], "table": "samples"})
    assert len(list(reader.pushFilters([GreaterThanOrEqual(("last_idx",), 15000), LessThan(("sample_offset",), 16000)]))) == 2
    rows = [(r["rec_id"], r["frame_idx"]) for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert set(rows) == {("one", 1), ("three", 1)}


def test_long_file_is_indexed_once(tmp_path, monkeypatch):
    """Partitions of a long file carry their place; a window reads its frames and headers only."""
    x, data = archive(400_000)
    _, sud = sud_file(chunks=((0, 300), (300, 1000)) * 40)
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "long.x3a").write_bytes(data)
    read = {"bytes": 0}

    class Counting(io.FileIO):
        def read(self, n=-1):
            out = super().read(n)
            read["bytes"] += len(out)
            return out

    monkeypatch.setattr(datasource, "open", lambda path, mode: Counting(path), raising=False)
    monkeypatch.setattr(datasource, "PART_BYTES", 60_000)

    def rows(path, **options):
        reader = datasource.HydroReader({"path": str(path), **options})
        read["bytes"] = 0
        groups = reader.partitions()
        planned, read["bytes"] = read["bytes"], 0
        got = [r for g in groups for b in reader.read(g) for r in b.to_pylist()]
        return groups, planned, got

    groups, planned, got = rows(tmp_path / "a", table="samples", verify_payload_crc="true")
    assert sum(len(g.parts) for g in groups) > 5 and planned < len(data) / 100
    assert np.array_equal(np.concatenate([r["pcm"] for r in got]), x.ravel()) and read["bytes"] < len(data) * 1.01 + 20_000
    _, planned, got = rows(tmp_path / "a", table="samples", start="150000", length="5000", verify_payload_crc="true")
    assert [r["frame_idx"] for r in got] == [15] and np.array_equal(got[0]["pcm"], x[150_000:160_000].ravel())
    assert planned + read["bytes"] < len(data) / 20
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "rec.sud").write_bytes(sud)
    monkeypatch.setattr(datasource, "PART_BYTES", 3000)
    groups, _, got = rows(tmp_path / "b", table="frame_index")
    one = [(r["frame_idx"], r["sample_offset"], r["byte_offset"]) for r in got]
    groups, _, got = rows(tmp_path / "b", table="coded")
    assert sum(len(g.parts) for g in groups) > 5 and [(r["frame_idx"], r["sample_offset"], r["byte_offset"]) for r in got] == one


def test_status_and_progress(spark, folder, tmp_path):
    path, _, _ = folder
    status = convert.read(spark, path, "status")
    assert {(r.rec_id, r.container, r.state, r.frames) for r in status.collect()} == {("one", "archive", "done", 25000), ("two", "sud", "done", 1000), ("three", "wav", "done", 30000)}
    (tmp_path / "x.sud").write_bytes(bytes(100))
    watched, seen = convert.observed(convert.read(spark, str(tmp_path), "status"))
    assert [r.message for r in watched.collect()] == ["no recording: no_sync"] and seen.get == {"completed": 1, "failed": 1}
    sizes = spark.createDataFrame([("two", 500, 2.0), ("one", 400, 0.0)], "rec_id string, file_bytes long, seconds double")
    report = convert.file_report(convert.read(spark, path, "recordings"), sizes).collect()
    assert [r.rec_id for r in report] == ["one", "two"] and report[0].mib_per_s is None and report[1].mib_per_s == 2044 / (1 << 20) / 2


def test_conversion_with_other_frames_and_rates(spark, tmp_path):
    x = np.arange(-9000, 9000, dtype=np.int16)
    (tmp_path / "m.wav").write_bytes(formats.wav_header(8000, 1, 18_000) + x.astype("<i2").tobytes())
    (tmp_path / "s.wav").write_bytes(formats.wav_header(96000, 2, 9_000) + x.astype("<i2").tobytes())
    for p in (CodecParams(), CodecParams(blocks_per_frame=37)):
        out = tmp_path / f"out{p.blocks_per_frame}"
        convert.wav_to_archive(spark, str(tmp_path / "m.wav"), str(out), p)
        convert.wav_to_archive(spark, str(tmp_path / "s.wav"), str(out), p)
        assert (out / "m.x3a").read_bytes() == formats.encode_archive(x[:, None], 8000, p)
        assert (out / "s.x3a").read_bytes() == formats.encode_archive(x.reshape(-1, 2), 96000, p)


def test_permissive_and_failfast(spark, tmp_path):
    _, data = archive(12_000)
    broken = bytearray(data)
    broken[28 + len(formats.build_xml(48000)) + 24] ^= 0xFF
    (tmp_path / "bad.x3a").write_bytes(bytes(broken))
    with pytest.raises(Exception, match="CRC"):
        convert.read(spark, str(tmp_path), "coded", verify_payload_crc=True).collect()
    assert convert.read(spark, str(tmp_path), "coded", verify_payload_crc=True, mode="permissive").count() == 0


def test_conversion_round_trip(spark, folder, tmp_path):
    path, x, y = folder
    convert.archive_to_wav(spark, path, f"{tmp_path}/w")
    assert sorted(os.listdir(f"{tmp_path}/w")) == ["one.wav", "one.xml", "two.wav", "two.xml"]
    with open(f"{tmp_path}/w/one.wav", "rb") as f:
        assert f.read() == formats.wav_header(48000, 2, 25_000) + x.astype("<i2").tobytes()
    convert.wav_to_archive(spark, f"{tmp_path}/w", f"{tmp_path}/a")
    with open(f"{tmp_path}/a/one.x3a", "rb") as f:
        assert f.read() == formats.encode_archive(x, 48000)  # byte for byte, whatever the parallelism


def test_header_expressions(spark):
    raw = formats.frame_header(1, 2, 300, b"abcd", 123456789012345)
    df = spark.createDataFrame([(bytearray(raw),), (bytearray(b""),)], "h binary")
    r = df.select(expr.crc16(F.substring("h", 1, 16)).alias("c"), expr.unsigned(F.col("h"), 8, 8).alias("t"), expr.crc16(F.col("h")).alias("e")).collect()
    assert r[0].c == kernel.crc16(raw[:16]) and r[0].t == 123456789012345 and r[1].e == 0xFFFF


def test_wrap_and_overflow(spark):
    df = spark.createDataFrame([(40000,), (-40000,), (5,)], "x int")
    assert [r.w for r in df.select(expr.wrap16(F.col("x")).alias("w")).collect()] == [-25536, 25536, 5]
    t = spark.range(1).select(expr.frame_time_ns(F.lit(10**11), F.lit(576000)).alias("a"), expr.frame_time_ns(F.lit(5), F.lit(0)).alias("b")).first()
    assert t.a == 10**11 * 10**9 // 576000 and t.b is None


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark):
    sig = signals.signal(spark, SF, "ev")
    plan = plan_of(blocks.block_stats(sig))
    assert not re.search("Python|Arrow|Cartesian|NestedLoop", plan)
    assert set(re.findall(r"(\w+):", re.search(r"ReadSchema: struct<([^>]*)", plan)[1])) == {"event_id", "ts", "user_id", "value"}
    # One recording: only its chunk counts meet in one task, never its samples.
    long = plan_of(signals.signal(spark, SF, "long"))
    assert long.count("SinglePartition") == 1 and re.search(r"SinglePartition.*\n.*HashAggregate", long)
    asked = spark.range(10).select(F.lit("all").alias("rec_id"), F.col("id").alias("sample"))
    frames_ = index.with_offsets(blocks.frame_summary(signals.signal(spark, SF, "long")))
    assert not re.search("NestedLoop|Cartesian", plan_of(index.lookup(asked, frames_)))


def test_stream(spark, tmp_path):
    packed = frames.pack_frames(signals.signal(spark, SF, "disc"))
    packed.write.parquet(f"{tmp_path}/in")
    stream = streaming.stream_ratio(spark.readStream.schema(packed.schema).parquet(f"{tmp_path}/in"))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("ratio").start()
    q.processAllAvailable()
    q.stop()
    got = {r.rec_id: (r.frames, r.coded_bytes) for r in spark.table("ratio").collect()}
    sizes = blocks.frame_sizes(signals.signal(spark, SF, "disc")).groupBy("rec_id").agg(F.count("*").alias("n"), F.sum(F.col("payload_bytes") + 20).alias("b")).collect()
    assert got == {r.rec_id: (r.n, r.b) for r in sizes}
