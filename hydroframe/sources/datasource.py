"""The ``hydro`` data source: recordings, frame indexes, coded frames and samples as tables.

``spark.read.format("hydro").option("table", T).load(path)`` with T one of ``recordings,
frame_index, coded, samples, sud_records, status``.  Containers are told by content.  Files are read
by seeking, in partitions of about ``PART_BYTES`` of payload, so a long recording is decoded by many
tasks and many short ones by one.  A file of several partitions is indexed once, when they are
planned: headers are walked, and each partition carries its first frame's place and sample number, so
a task reads its own frames only.  The options ``start`` and ``length`` name a sample range, and only
frames that it touches are read (the index walk ends with the range); with the option ``pushdown`` the
same follows from filters on ``sample_offset`` and ``last_idx``.  Rows leave a task as Arrow batches.

``status`` has one row a file: ``done``, or ``failed`` with the reason, after every payload was decoded.

``df.write.format("hydro").option("container", "archive" or "wav").save(path)`` writes one file for
each ``rec_id`` from rows of ``rec_id, frame_idx, head, frame``; rows must be dealt by ``rec_id`` and
sorted by ``frame_idx`` (``plans.convert`` does).

Paths are of a file system that every executor mounts; for other stores read ``binaryFile`` and use
``sources.tables``.
"""

from __future__ import annotations

import itertools
import os
import re
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from ..functions.params import ARCHIVE_MAGIC, RECORD_HEADER, FormatError
from . import formats

PART_BYTES = 32 << 20
#: What opening a file costs, as bytes read.
OPEN_BYTES = 64 << 10
_FRAME = "frame_idx INT, source_id INT, channels INT, n_samples INT, sample_offset BIGINT, last_idx BIGINT, byte_offset BIGINT, chunk_length INT, time_ns BIGINT, payload_crc INT"
SCHEMAS = {
    "recordings": "rec_id STRING, container STRING, sample_rate INT, channels INT, bit_depth INT, frames BIGINT, device_id STRING, block_len INT, rice_orders ARRAY<INT>, xml STRING, status STRING",
    "frame_index": f"rec_id STRING, {_FRAME}",
    "coded": f"rec_id STRING, {_FRAME}, payload BINARY",
    "samples": f"rec_id STRING, {_FRAME}, pcm ARRAY<SMALLINT>",
    "status": "rec_id STRING, container STRING, state STRING, message STRING, frames BIGINT",
    "sud_records": "rec_id STRING, record_idx INT, byte_offset BIGINT, payload_length INT, is_metadata BOOLEAN, n_samples INT, text STRING, payload BINARY",
}
EXTENSIONS = (".x3a", ".sud", ".wav")


def local(path: str) -> str:
    return re.sub(r"^file:/*(?=/)", "", path)


def list_files(path: str) -> list[str]:
    """A file itself, or the supported files below a folder, sorted within each folder."""
    path = local(path)
    if os.path.isfile(path):
        return [path]
    out = []
    for folder, below, names in os.walk(path):
        below.sort()
        out += [os.path.join(folder, n) for n in sorted(names) if n.lower().endswith(EXTENSIONS)]
    if not out and not os.path.isdir(path):
        raise FileNotFoundError(path)
    return out


def rec_id(path: str) -> str:
    return os.path.splitext(os.path.basename(path))[0]


def frame_values(f: formats.Frame) -> tuple:
    return (f.frame_idx, f.source_id, f.channels, f.n_samples, f.sample_offset, f.sample_offset + f.n_samples - 1, f.byte_offset, f.chunk_length, f.time_ns, f.payload_crc)


@dataclass
class FilePart:
    """Frames of a file from a mark on whose payload starts before ``high``; without a mark all, and the
    recording is opened by the task."""

    path: str
    high: int = 1 << 62
    rec: formats.Recording | None = None
    mark: formats.Mark | None = None


@dataclass
class FileGroup(InputPartition):
    """Parts of files that one task reads: small files share a task."""

    parts: list[FilePart]


def grouped(parts: list[FilePart], sizes: list[int]) -> list[FileGroup]:
    """Parts in order, in groups of PART_BYTES, or less if that gives fewer than 32 groups."""
    weights = [n + OPEN_BYTES for n in sizes]
    most = max(1 << 20, min(PART_BYTES, sum(weights) // 32))
    out, filled = [], 0
    for p, w in zip(parts, weights):
        if not out or filled + w > most:
            out.append(FileGroup([]))
            filled = 0
        out[-1].parts.append(p)
        filled += w
    return out


def table_rows(name: str, table: str, f, size: int, part: FilePart | None = None, first: int = 0, end: int = 1 << 62, verify: bool = False) -> Iterator[tuple]:
    """Rows of a table for one open file: of a part's frames whose samples touch [first, end).  With
    ``verify`` the payloads that are read are checked."""
    if table == "sud_records":
        for r in formats.scan_sud(f, size):
            f.seek(r.byte_offset + RECORD_HEADER)
            raw = f.read(r.payload_length)
            yield (name, r.record_idx, r.byte_offset, r.payload_length, r.is_metadata, None if r.is_metadata else r.kind, formats.sud_text(raw) if r.is_metadata else None, raw)
        return
    if table == "status":
        yield (name, *file_status(f, size, verify))
        return
    part = part or FilePart("")
    rec = part.rec or formats.open_recording(f, size, totals=table == "recordings")
    if table == "recordings":
        yield (name, rec.container, rec.sample_rate, rec.channels, rec.bit_depth, rec.frames, rec.device_id, rec.block_len, list(rec.rice_orders), rec.xml, rec.status)
        return
    for fr in formats.frames_of(f, size, rec, verify and table == "frame_index", part.mark):
        if fr.byte_offset >= part.high or fr.sample_offset >= end:
            return
        if fr.sample_offset + fr.n_samples <= first:
            continue
        if table == "frame_index":
            yield (name, *frame_values(fr))
            continue
        f.seek(fr.byte_offset)
        raw = f.read(fr.chunk_length)
        if verify:
            formats.checked(fr, raw, rec)
        yield (name, *frame_values(fr), raw if table == "coded" else formats.decode(raw, fr, rec).ravel())


def file_status(f, size: int, verify: bool = False) -> tuple[str | None, str, str | None, int]:
    """(container, "done" or "failed", reason, samples a channel that were decoded)."""
    container, total = None, 0
    try:
        rec = formats.open_recording(f, size, totals=False)
        container = rec.container
        if rec.status != "ok":
            raise FormatError(f"no recording: {rec.status}")
        for fr in formats.frames_of(f, size, rec):
            f.seek(fr.byte_offset)
            raw = f.read(fr.chunk_length)
            formats.decode(formats.checked(fr, raw, rec) if verify else raw, fr, rec)
            total += fr.n_samples
    except FormatError as e:
        return container, "failed", str(e), total
    return container, "done", None, total


_ARROW = {"STRING": pa.string(), "INT": pa.int32(), "BIGINT": pa.int64(), "BOOLEAN": pa.bool_(), "BINARY": pa.binary(), "ARRAY<INT>": pa.list_(pa.int32()), "ARRAY<SMALLINT>": pa.list_(pa.int16())}


def arrow_schema(table: str) -> pa.Schema:
    """The Arrow form of a table's schema (made without a session, since tasks have none)."""
    return pa.schema([(name, _ARROW[kind]) for name, kind in (c.strip().split(" ") for c in SCHEMAS[table].split(","))])


def arrow_batches(rows: Iterator[tuple], table: str, most: int = 64) -> Iterator[pa.RecordBatch]:
    """Rows in Arrow batches; samples stay arrays of 16-bit numbers."""
    schema = arrow_schema(table)
    while some := list(itertools.islice(rows, most)):
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*some), schema.types)], names=schema.names)


class HydroReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.table = options["path"], options.get("table", "samples")
        self.verify = options.get("verify_payload_crc", "false").lower() == "true"
        self.permissive = options.get("mode", "failfast").lower() == "permissive"
        self.first, self.end = 0, 1 << 62
        if "start" in options:
            start, length = int(options["start"]), int(options.get("length", 1 << 61))
            self.first, self.end = (start, start + length) if start >= 0 and length > 0 else (1 << 62, 0)

    def partitions(self):
        parts, sizes = [], []
        for p in list_files(self.path):
            size = os.path.getsize(p)
            if self.table in ("coded", "samples") and size > PART_BYTES:
                for part, n in self._split(p, size):
                    parts.append(part)
                    sizes.append(n)
            else:
                parts.append(FilePart(p))
                sizes.append(size)
        return grouped(parts, sizes) or [FileGroup([])]

    def _split(self, path: str, size: int) -> Iterator[tuple[FilePart, int]]:
        """Parts of a long file, from one walk over its headers, which ends with the sample range."""
        try:
            with open(path, "rb") as f:
                rec, at = formats.open_recording(f, size, totals=False), None
                for fr in formats.frames_of(f, size, rec):
                    if fr.sample_offset >= self.end:
                        break
                    if fr.sample_offset + fr.n_samples > self.first and (at is None or fr.byte_offset >= at.pos + PART_BYTES):
                        if at:
                            yield FilePart(path, fr.byte_offset, rec, at), fr.byte_offset - at.pos
                        at = formats.mark_of(rec, fr)
                if at:
                    yield FilePart(path, rec=rec, mark=at), PART_BYTES
        except FormatError:
            if not self.permissive:
                raise

    def read(self, group: FileGroup):
        return arrow_batches(self._rows(group), self.table)

    def _rows(self, group: FileGroup) -> Iterator[tuple]:
        for part in group.parts:
            with open(part.path, "rb") as f:
                try:
                    yield from table_rows(rec_id(part.path), self.table, f, os.path.getsize(part.path), part, self.first, self.end, self.verify)
                except FormatError:
                    if not self.permissive:
                        raise


class PushingReader(HydroReader):
    """Takes ranges on ``sample_offset`` and ``last_idx``; Spark allows such a reader only with
    ``spark.sql.python.filterPushdown.enabled``, so it is chosen by the option ``pushdown``."""

    def pushFilters(self, filters):
        for x in filters:
            name = ".".join(getattr(x, "attribute", ()))
            if name == "last_idx" and isinstance(x, (GreaterThan, GreaterThanOrEqual)):
                self.first = max(self.first, x.value)
            elif name == "sample_offset" and isinstance(x, (LessThan, LessThanOrEqual)):
                self.end = min(self.end, x.value + isinstance(x, LessThanOrEqual))
            yield x  # Spark filters again; the reader only skips whole frames


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class HydroWriter(DataSourceWriter):
    """One file a recording, written beside its final name and renamed when the job succeeds."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = local(options["path"]), overwrite
        self.ext = {"archive": ".x3a", "wav": ".wav"}[options.get("container", "archive")]

    def write(self, rows):
        staging = os.path.join(self.path, "_staging")
        os.makedirs(staging, exist_ok=True)
        done: list[tuple[str, str]] = []
        out, name, last = None, None, None
        try:
            for r in rows:
                if r.rec_id != name:
                    if out:
                        out.close()
                    name, last = r.rec_id, None
                    temp = os.path.join(staging, uuid.uuid4().hex)
                    done.append((temp, os.path.join(self.path, f"{name}{self.ext}")))
                    out = open(temp, "wb")  # noqa: SIM115
                    out.write(r.head)
                if last is not None and r.frame_idx <= last:
                    raise ValueError("frames of a recording are not in order; sort rows by rec_id, frame_idx")
                last = r.frame_idx
                out.write(r.frame)
                if r.sidecar:
                    with open(temp + ".xml", "w") as side:
                        side.write(r.sidecar)
        finally:
            if out:
                out.close()
        return Written(done)

    def commit(self, messages):
        if self.overwrite:
            for f in list_files(self.path):
                os.remove(f)
        names = [n for m in messages if m for _, n in m.files]
        if len(set(names)) != len(names):
            raise ValueError("a recording was written by two tasks; deal rows by rec_id")
        for m in messages:
            for temp, final in m.files if m else ():
                os.replace(temp, final)
                if os.path.exists(temp + ".xml"):
                    os.replace(temp + ".xml", os.path.splitext(final)[0] + ".xml")
        shutil.rmtree(os.path.join(self.path, "_staging"), ignore_errors=True)

    def abort(self, messages):
        shutil.rmtree(os.path.join(self.path, "_staging"), ignore_errors=True)


class HydroSource(DataSource):
    @classmethod
    def name(cls):
        return "hydro"

    def schema(self):
        return SCHEMAS[self.options.get("table", "samples")]

    def reader(self, schema):
        pushing = self.options.get("pushdown", "false").lower() == "true"
        return (PushingReader if pushing else HydroReader)(dict(self.options))

    def writer(self, schema, overwrite):
        return HydroWriter(dict(self.options), overwrite)


def is_archive(content: Column) -> Column:
    """Whether bytes begin like an archive; too few bytes do not."""
    return F.substring(content, 1, len(ARCHIVE_MAGIC)) == F.lit(ARCHIVE_MAGIC)


def register(spark) -> None:
    spark.dataSource.register(HydroSource)


def binary_table(files, table: str, verify: bool = False):
    """A table over ``path, content`` rows (``binaryFile``), for stores that only Spark reads."""

    def run(batches):
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                yield from arrow_batches(table_rows(rec_id(path), table, *formats.from_bytes(content), verify=verify), table)

    return files.select("path", "content").mapInArrow(run, SCHEMAS[table])
