"""Exact removal of repeated byte strings, by run-length indexes.

Every byte covered by a ``LENGTH``-byte string that also starts earlier (in a smaller doc_id, or
earlier in the same document) is marked.  To let equal strings meet, each ``LENGTH``-byte window is
owned by its anchor: its 16 bytes of the smallest hash (the leftmost, if tied).  Equal windows have
equal anchors.  Neighbouring windows of one anchor form a segment.

1. Anchors are counted.  Segments of an anchor that stands at very many places are cut further, into
   at most 8 windows whose anchor lies at neighbouring places; the 93 bytes that those share, with
   that place, are the anchor of the part.  So no anchor's strings pile up in one task.
2. Segments meet by anchor.  Equal ones (by the anchor's 64 and the content's 96 bits of hashes) are
   collapsed to the earliest and a list of the other positions; copies within a task do not leave it.
3. Where an anchor stands at several positions, each distinct segment is cut out of its document
   once.  Each task builds run-length indexes (run-compressed Burrows-Wheeler transform with sampled
   run ends) over those strings, streams their matching statistics, and gets for every window the
   earliest position among all strings.  A window is marked at each position of its string, copies
   included, that is not that earliest one.
4. Marks are merged by document and the remaining bytes are hashed or returned.

The result is exact: an anchor depends on its window's bytes only, so no pair of equal windows is
missed, and nothing is sampled.

Scale: texts are read four times; of the texts only distinct strings of repeated anchors are
shuffled.  Segment rows are 41 bytes for each 38 bytes of text, packed into blobs.  An exact copy
group sends one row a task and segment, whatever its size.

Defined cases: null text counts as empty; texts under ``LENGTH`` bytes have no string and keep all;
a position is (doc_id, start), so a repeated row does not mark itself, and bytes that rows of one
doc_id have at the same place stay in all of them; a row is known by its doc_id and its text (a 64-bit
hash ``tx``), and what is marked in one row stays in another text of the same id; rows without a
doc_id have no place in the order and stay whole; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import bytesops as B, sketch
from .graph import BLOBS, blob_batch, by_bucket, only, pack, sized, unpack
from .rindex import RunLengthIndex
from .store import Store, buckets_for

LENGTH, GRAM = 100, 16
#: Windows of a part of a hot anchor's segment; an anchor is hot with more segments than HOT, and more
#: than four times the mean of the cells.
PART, HOT = 8, 20_000
INDEX_BYTES = 1 << 19
_POSITION = np.uint64((1 << 24) - 1)
_PIECE = 1 << 22
_SEGMENT = np.dtype([("anchor", "<u8"), ("content", "<u8"), ("more", "<u4"), ("doc", "<i8"), ("tx", "<i8"), ("start", "<u4"), ("windows", "u1")])
_SPAN = np.dtype([("doc", "<i8"), ("tx", "<i8"), ("start", "<u4"), ("windows", "<u4")])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    step = 1
    total = width
    while step * 2 <= total:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    rest = total - step
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def anchored(buf: np.ndarray, eight: np.ndarray, offs: np.ndarray, length: int = LENGTH):
    """(anchor hash, anchor position, document row, first window, last window) of the segments of a slice."""
    n = len(buf)
    if n < length:
        z = np.zeros(0, np.int64)
        return z.view(np.uint64), z, z, z, z
    at = np.arange(n - GRAM + 1)
    gram = B.splitmix(eight[: n - GRAM + 1] ^ B.splitmix(eight[8 : n - GRAM + 9] * B.PRIME + B.PRIME))
    owner = (sliding_min((gram & ~_POSITION) | at.astype(np.uint64), length - GRAM + 1) & _POSITION).astype(np.int64)
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(offs))[: len(owner)]
    inside = np.arange(len(owner)) + length <= offs[1:][doc]
    change = (owner[1:] != owner[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(inside & np.r_[True, change])
    last = np.flatnonzero(inside & np.r_[change | ~inside[1:], True])
    return gram[owner[first]], owner[first], doc[first], first, last


def parted(buf, eight, anchor, owner, doc, first, last, length: int = LENGTH):
    """Segments cut into parts of PART neighbouring places of the anchor, each with an anchor of its own."""
    low, high = (owner - last) // PART, (owner - first) // PART
    n = high - low + 1
    of = np.repeat(np.arange(len(n)), n)
    block = low[of] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    begin = owner[of] - block * PART  # what all windows with the anchor at these places hold
    common, _ = B.span_hashes(eight, buf, begin, begin + length - PART + 1, False)
    own = B.splitmix(common ^ B.splitmix(anchor[of] + block.astype(np.uint64)))
    return own, owner[of], doc[of], np.maximum(first[of], begin - PART + 1), np.minimum(last[of], begin)


def segments(buf: np.ndarray, offs: np.ndarray, length: int = LENGTH, hot: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(anchor hash, content hash, more of it, document row, first window, windows) of a slice."""
    eight = B.eights(buf)
    found = anchored(buf, eight, offs, length)
    if hot is not None:
        cut = hot[sketch.cells(found[0])]
        if cut.any():
            parts = parted(buf, eight, *(x[cut] for x in found), length)
            found = tuple(np.concatenate([x[~cut], y]) for x, y in zip(found, parts))
    anchor, owner, doc, first, last = found
    content, more = B.span_hashes(eight, buf, first, last + length)
    # The anchor's place in the segment tells apart equal bytes with different anchors.
    content = B.splitmix(content + (owner - first).astype(np.uint64))
    return anchor, content, more, doc, first - offs[doc], last - first + 1


def _pieces(text: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, int]]:
    """(first row, end row, bytes, offsets, position of the first byte): slices, with a very long
    document in pieces that share LENGTH - 1 bytes, so that each window is in one of them."""
    for lo, hi, buf, offs in B.slices(text):
        if len(buf) <= 2 * _PIECE:
            yield lo, hi, buf, offs, 0
            continue
        for k in range(lo, hi):
            doc = buf[offs[k - lo] : offs[k - lo + 1]]
            for at in range(0, max(len(doc), 1), _PIECE):
                part = doc[at : at + _PIECE + LENGTH - 1]
                yield k, k + 1, part, np.array([0, len(part)]), at


def _not_first(p: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Segments that stand behind the first of theirs."""
    head = np.maximum.accumulate(np.where(first, np.arange(len(p)), 0))
    return (p["doc"] != p["doc"][head]) | (p["start"] != p["start"][head])


def _once(p: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Which of the ordered segments are no repetition of the one before (of a repeated row)."""
    same = np.logical_and.reduce([p[c][1:] == p[c][:-1] for c in ("doc", "tx", "start")]) if len(p) else first
    return first | np.r_[True, ~same] if len(p) else first


def _runs(anchor: np.ndarray, size: np.ndarray, most: int) -> Iterator[slice]:
    """Runs of whole anchors (sorted) of about ``most`` bytes, for indexes that stay in cache."""
    first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]]) if len(anchor) else np.zeros(0, np.int64)
    if not len(first):
        return
    total = np.cumsum(np.add.reduceat(size, first))
    cut = np.flatnonzero(np.r_[True, total[1:] // most != total[:-1] // most])
    edges = np.r_[first[cut], len(anchor)]
    for s, e in zip(edges[:-1], edges[1:]):
        yield slice(int(s), int(e))


def _by_content(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Segments in the order of (anchor, content, position), and which are the first of theirs."""
    order = np.argsort(p["content"])
    p = p[order[np.argsort(p["anchor"][order], kind="stable")]]
    if not len(p):
        return p, np.zeros(0, bool)
    tied = np.r_[(p["anchor"][1:] == p["anchor"][:-1]) & (p["content"][1:] == p["content"][:-1]), False]
    t = np.flatnonzero(tied | np.r_[False, tied[:-1]])
    q = p[t]
    p[t] = q[np.lexsort((q["tx"], q["start"], q["doc"], q["more"], q["content"], q["anchor"]))]
    return p, np.r_[True, (p["anchor"][1:] != p["anchor"][:-1]) | (p["content"][1:] != p["content"][:-1]) | (p["more"][1:] != p["more"][:-1])]


def _places(head: np.ndarray, offsets: np.ndarray) -> np.ndarray | None:
    """The rank of each byte's position, where strings of one document overlap; else None."""
    doc, start, windows = head["doc"], head["start"].astype(np.int64), head["windows"]
    if not ((doc[1:] == doc[:-1]) & (start[1:] < start[:-1] + windows[:-1])).any():
        return None
    size = np.diff(offsets)
    row, at = np.repeat(doc, size), np.repeat(start - offsets[:-1], size) + np.arange(offsets[-1])
    order = np.lexsort((at, row))
    place = np.zeros(len(order), dtype=np.int64)
    place[order[1:]] = np.cumsum((row[order][1:] != row[order][:-1]) | (at[order][1:] != at[order][:-1]))
    return place


def _copies_of(head: np.ndarray, copies: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(head, copy) pairs of equal content."""
    both = np.concatenate([head, copies])
    order = np.lexsort((np.arange(len(both)), both["more"], both["content"], both["anchor"]))
    at = np.where(order < len(head), order, 0)
    at = at[np.maximum.accumulate(np.where(order < len(head), np.arange(len(order)), 0))]
    return at[order >= len(head)], order[order >= len(head)] - len(head)


def _spans(p: np.ndarray) -> np.ndarray:
    return np.rec.fromarrays([p[c] for c in _SPAN.names], dtype=_SPAN)


def _merged(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Sorted disjoint byte runs (touching ones joined), as int64 pairs."""
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    new = np.r_[True, start[1:] > reach[:-1]]
    return np.stack([start[new], reach[np.r_[np.flatnonzero(new)[1:] - 1, len(start) - 1]]], axis=1)


def _groups(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Records ordered by (doc, tx), and where each such group begins, with the total."""
    a = a[np.lexsort((a["start"], a["tx"], a["doc"]))]
    return a, np.flatnonzero(np.r_[True, (a["doc"][1:] != a["doc"][:-1]) | (a["tx"][1:] != a["tx"][:-1]), True]) if len(a) else np.zeros(1, np.int64)


def removed_spans(documents: DataFrame, store: Store | None = None, hot: int = HOT) -> DataFrame:
    """``doc, tx, spans`` (int64 pairs of byte positions) of the documents that lose bytes."""
    spark = documents.sparkSession
    store = store or Store(spark)
    text = F.col("text").cast("string")
    slim = documents.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tx"))
    buckets = buckets_for(slim)

    def count(batches):
        found: list[np.ndarray] = []
        for b in batches:
            for _, _, buf, offs, _ in _pieces(b.column("text")):
                found.append(sketch.cells(anchored(buf, B.eights(buf), offs)[0]))
            if sum(map(len, found)) > 1 << 22:
                yield blob_batch(sketch.cell_rows(found))
                found.clear()
        yield blob_batch(sketch.cell_rows(found))

    packed, total = sketch.classes(slim.mapInArrow(count, BLOBS), hot)
    # An empty cell has class 0, and so has any under ``hot``.
    least = max(1, sketch.class_above(max(hot, 4 * total // sketch.CELLS)))
    shared = store.share(packed if sketch.reaches(packed, least) else None)

    def cut(batches):
        found: list[np.ndarray] = []
        split = None if shared.value is None else sketch.table(shared.value) >= least

        def flush():
            p, first = _by_content(np.concatenate([np.zeros(0, _SEGMENT), *found]))
            found.clear()
            later = _not_first(p, first)
            again = _spans(p[later])
            p = p[~later & _once(p, first)]
            rows = pack((B.splitmix(p["anchor"]) % np.uint64(buckets)).astype(np.int64), p)
            return blob_batch([*rows, *((-1 - k, x) for k, x in pack(again["doc"] % buckets, again))])

        for b in batches:
            ids, tx = b.column("doc_id").to_numpy(), b.column("tx").to_numpy()
            for lo, hi, buf, offs, base in _pieces(b.column("text")):
                anchor, content, more, doc, start, windows = segments(buf, offs, hot=split)
                cols = [anchor, content, more >> np.uint64(32), ids[lo:hi][doc], tx[lo:hi][doc], start + base, windows]
                found.append(np.rec.fromarrays([c.astype(_SEGMENT[k]) for k, c in enumerate(cols)], dtype=_SEGMENT))
            if sum(map(len, found)) > 1 << 20:
                yield flush()
        yield flush()

    def meet(table: pa.Table) -> pa.Table:
        """Marked spans (kind 0) and requests for strings (kind 1), by document; the other positions
        of those strings (kind 2), by anchor."""
        k = table["bucket"][0].as_py()
        if k < 0:
            return _kinds([(-1 - k, 0, x) for x in table["blob"].to_pylist()])
        p, first = _by_content(unpack(table, _SEGMENT))
        once = _once(p, first)
        p, first = p[once], first[once]
        new = np.flatnonzero(np.r_[True, p["anchor"][1:] != p["anchor"][:-1]]) if len(p) else np.zeros(0, np.int64)
        size = np.diff(np.r_[new, len(p)])
        often = np.repeat(size > 1, size)
        p, first = p[often], first[often]
        return _kinds([*((j, 1, x) for j, x in pack(p["doc"][first] % buckets, p[first])), (k, 2, p[~first].tobytes())])

    met = store.write(by_bucket(slim.mapInArrow(cut, BLOBS), meet, "bucket int, kind int, blob binary"))
    store.release()

    def by_doc(table: pa.Table) -> pa.Table:
        a, new = _groups(unpack(table, _SEGMENT))
        asks = pa.array([a[s:e].tobytes() for s, e in zip(new[:-1], new[1:])], pa.binary())
        return pa.table({"doc": pa.array(a["doc"][new[:-1]].copy()), "tx": pa.array(a["tx"][new[:-1]].copy()), "asks": asks})

    asks = store.write(by_bucket(met.where("kind = 1").select("bucket", "blob"), by_doc, "doc long, tx long, asks binary"))

    def contents(batches):
        for b in batches:
            heads, bodies = [np.zeros(0, _SEGMENT)], [np.zeros(0, np.uint8)]
            raw, offs = B.string_buffers(b.column("text"))
            for k, blob in enumerate(b.column("asks").to_pylist()):
                a = np.frombuffer(blob, dtype=_SEGMENT)
                size = a["windows"].astype(np.int64) + LENGTH - 1
                first = np.cumsum(size) - size
                heads.append(a)
                bodies.append(raw[offs[k] + np.repeat(a["start"] - first, size) + np.arange(size.sum())])
            head, body = np.concatenate(heads), np.concatenate(bodies)
            size = head["windows"].astype(np.int64) + LENGTH - 1
            start = np.cumsum(size) - size
            bucket = (B.splitmix(head["anchor"]) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cutoff = np.flatnonzero(np.r_[True, bucket[order][1:] != bucket[order][:-1], True]) if len(order) else np.zeros(1, np.int64)
            out_b, out_h, out_t = [], [], []
            for s, e in zip(cutoff[:-1], cutoff[1:]):
                o = order[s:e]
                n = size[o]
                at = np.repeat(start[o] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                out_b.append(int(bucket[o[0]]))
                out_h.append(head[o].tobytes())
                out_t.append(body[at].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out_b, pa.int32()), pa.array(out_h, pa.binary()), pa.array(out_t, pa.binary())], ["bucket", "blob", "body"])

    def resolve(table: pa.Table, others: pa.Table) -> pa.Table:
        head, copies = unpack(table, _SEGMENT), unpack(others, _SEGMENT)
        body = np.concatenate([np.zeros(0, np.uint8), *(np.frombuffer(x, np.uint8) for x in table["body"].to_pylist())])
        size = head["windows"].astype(np.int64) + LENGTH - 1
        start = np.cumsum(size) - size
        # Repeated rows of a document ask for the same string; it is taken once.
        order = np.lexsort((head["start"], head["tx"], head["doc"], head["anchor"]))
        same = np.logical_and.reduce([head[c][order][1:] == head[c][order][:-1] for c in ("anchor", "doc", "tx", "start")]) if len(head) else np.zeros(0, bool)
        order = order[np.r_[True, ~same]] if len(head) else order
        head, size, start = head[order], size[order], start[order]
        spans, marked = [], np.zeros((2, 0), np.int64)
        for part in _runs(head["anchor"], size, INDEX_BYTES):
            mine = np.arange(part.start, part.stop)
            mine = mine[np.lexsort((head["start"][mine], head["tx"][mine], head["doc"][mine]))]
            h, n = head[mine], size[mine]
            offsets = np.concatenate([np.zeros(1, np.int64), np.cumsum(n)])
            text = body[np.repeat(start[mine] - offsets[:-1], n) + np.arange(n.sum())]
            place = _places(h, offsets)
            at, best = RunLengthIndex(text, offsets).earliest(LENGTH, place)
            again = at[(at if place is None else place[at]) != best]
            k = np.searchsorted(offsets, again, side="right") - 1
            spans.append(np.stack([mine[k], h["start"][k] + (again - offsets[k])]))
        marked = np.concatenate([marked, *spans], axis=1)
        marked = marked[:, np.argsort(marked[0], kind="stable")]
        # A copy's windows stand at its string too, which is earlier, so none of them is the earliest;
        # but a copy at the string's own position (in another row of the id) has the string's marks.
        by_head, copy = _copies_of(head, copies)
        tied = (head["doc"][by_head] == copies["doc"][copy]) & (head["start"][by_head] == copies["start"][copy])
        lo, hi = (np.searchsorted(marked[0], by_head[tied], side=x) for x in ("left", "right"))
        at = np.repeat(lo - (np.cumsum(hi - lo) - (hi - lo)), hi - lo) + np.arange((hi - lo).sum())
        own = np.concatenate([head[["doc", "tx"]][marked[0]], copies[["doc", "tx"]][np.repeat(copy[tied], hi - lo)]])
        where = np.concatenate([marked[1], marked[1][at]])
        spans = [np.rec.fromarrays([own["doc"], own["tx"], where.astype(np.uint32), np.ones(len(own), np.uint32)], dtype=_SPAN), _spans(copies[copy[~tied]])]
        span, _ = _groups(np.concatenate(spans))
        touch = (span["doc"][1:] == span["doc"][:-1]) & (span["tx"][1:] == span["tx"][:-1]) & (span["start"][1:] == span["start"][:-1] + span["windows"][:-1])
        runs = np.flatnonzero(np.r_[True, ~touch]) if len(span) else np.zeros(0, np.int64)
        n = np.add.reduceat(span["windows"].astype(np.int64), runs) if len(runs) else runs
        span = np.rec.fromarrays([span["doc"][runs], span["tx"][runs], span["start"][runs], n.astype(np.uint32)], dtype=_SPAN)
        return _kinds([(k, 0, x) for k, x in pack(span["doc"] % buckets, span)])

    held = only(slim, asks.select("doc").distinct()).join(asks.withColumnRenamed("doc", "doc_id"), ["doc_id", "tx"]).select("text", "asks")
    strings = held.mapInArrow(contents, "bucket int, blob binary, body binary")
    others = met.where("kind = 2").select("bucket", "blob")
    found = strings.groupBy("bucket").cogroup(others.groupBy("bucket")).applyInArrow(resolve, "bucket int, kind int, blob binary")

    def merge(table: pa.Table) -> pa.Table:
        s, new = _groups(unpack(table, _SPAN))
        start = s["start"].astype(np.int64)
        spans = [_merged(start[a:b], start[a:b] + s["windows"][a:b] + LENGTH - 1).tobytes() for a, b in zip(new[:-1], new[1:])]
        return pa.table({"doc": pa.array(s["doc"][new[:-1]].copy()), "tx": pa.array(s["tx"][new[:-1]].copy()), "spans": pa.array(spans, pa.binary())})

    marks = met.where("kind = 0").select("bucket", "blob").unionByName(found.select("bucket", "blob"))
    out = store.write(by_bucket(marks, merge, "doc long, tx long, spans binary"))
    store.drop(met, asks)
    return out


def _kinds(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int32()), "kind": pa.array([r[1] for r in rows], pa.int32()), "blob": pa.array([r[2] for r in rows], pa.binary())})


def _kept(raw: np.ndarray, spans: bytes) -> bytes:
    keep = np.ones(len(raw), dtype=bool)
    for s, e in np.frombuffer(spans, np.int64).reshape(-1, 2):
        keep[s:e] = False
    return raw[keep].tobytes()


def suffix_dedup(documents: DataFrame, hot: int = HOT) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept`` (the remaining bytes of those that lose any)
    and ``kept_sha256``."""
    spans, text = removed_spans(documents, hot=hot), F.col("text").cast("string")
    raw = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"), F.xxhash64(text).alias("tx"))
    raw = raw.withColumn("n_bytes", F.octet_length("text").cast("long"))
    side = sized(spans.withColumnRenamed("doc", "doc_id").select("doc_id", "tx"), spans.count())
    none = F.lit(0).cast("long")
    whole = raw.join(side, ["doc_id", "tx"], "left_anti").select("doc_id", "n_bytes", none.alias("n_removed"), none.alias("n_spans"), F.lit(None).cast("binary").alias("kept"), F.sha2("text", 256).alias("kept_sha256"))

    def strip(batches):
        for b in batches:
            text, offs = B.string_buffers(b.column("text"))
            removed, count, kept, sha = [], [], [], []
            for k, s in enumerate(b.column("spans").to_pylist()):
                left = _kept(text[offs[k] : offs[k + 1]], s)
                removed.append(int(offs[k + 1] - offs[k]) - len(left))
                count.append(len(s) // 16)
                kept.append(left)
                sha.append(hashlib.sha256(left).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(kept, pa.binary()), pa.array(sha, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    part = raw.join(side, ["doc_id", "tx"], "left_semi").join(spans.withColumnRenamed("doc", "doc_id"), ["doc_id", "tx"]).select("doc_id", "text", "n_bytes", "spans")
    part = part.mapInArrow(strip, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")
    return whole.unionByName(part)


def op4_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept")


#: Every window of every text, grouped by its bytes; for small tables.
SQL = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, p, md5(substr(h, 2 * p + 1, {2 * LENGTH})) AS s FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - {LENGTH - 1})) AS p FROM d)),
m AS (SELECT doc_id, p FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS k FROM w) WHERE k > 1),
i AS (SELECT doc_id, min(p) AS a, max(p) + {LENGTH} AS z FROM (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS g FROM (SELECT doc_id, p, CASE WHEN p > lag(p, 1, -1000) OVER (PARTITION BY doc_id ORDER BY p) + {LENGTH} THEN 1 ELSE 0 END AS new FROM m)) GROUP BY doc_id, g),
k AS (SELECT d.doc_id, substr(h, CAST(1 + 2 * from_ AS BIGINT), CAST(2 * (to_ - from_) AS BIGINT)) AS piece, from_ FROM d JOIN (
  SELECT doc_id, z AS from_, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS to_ FROM (SELECT doc_id, a, z FROM i UNION ALL SELECT DISTINCT doc_id, -1, 0 FROM i)) r ON d.doc_id = r.doc_id WHERE to_ IS NOT NULL
  UNION ALL SELECT d.doc_id, substr(h, CAST(1 + 2 * t.z AS BIGINT)), t.z FROM d JOIN (SELECT doc_id, max(z) AS z FROM i GROUP BY doc_id) t ON d.doc_id = t.doc_id),
j AS (SELECT doc_id, string_agg(piece, '' ORDER BY from_) AS kept FROM k GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_spans, sum(z - a) AS n_removed FROM i GROUP BY doc_id)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN j ON d.doc_id = j.doc_id
"""
