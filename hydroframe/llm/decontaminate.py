"""Benchmark decontamination by a broadcast hash set of normalised test n-grams.

Texts are lower-cased (A-Z) and cut into words; a benchmark item gives its windows of ``n``
words (an item of fewer words, but not none, is one window of all of them).  Training documents
are scanned window by window; a hash found in the set is verified word for word against the
benchmark before it counts.

Scale: the benchmark goes to the executors as its normalised texts, in pieces of at most
``max_windows`` windows and ``MAX_BYTES`` (a longer item is cut into parts that share ``n - 1`` words); a window is a
place in such a text, so a piece is about as large as its words.  The driver holds one piece at a
time, and each worker process builds the piece's hash table once.  With one piece documents are read
once and nothing of them is shuffled; a larger benchmark takes several passes over one written copy
of the ids and texts, whose rows are numbered.  Each pass writes its hits before the next piece is
sent, and only hits are shuffled, to be merged by row.

Defined cases: null or empty text has no words and no hits; null benchmark texts and items
without a word give no window; repeated items count once by ``item_id``; windows of an item whose
id is null mark words but name no item; rows that repeat a doc_id, or have none, are judged one by
one; extra columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import bytesops as B
from .store import Store, text_batches

#: Of a piece: windows, and bytes of its texts (an item of more bytes is a piece alone).
MAX_WINDOWS, MAX_BYTES = 2_000_000, 64 << 20
_BITS = 20


class WindowSet:
    """The windows of a piece: ``items`` of (words joined by blanks, item id or None)."""

    def __init__(self, items: list[tuple[bytes, str | None]], n: int):
        self.n, self.names = n, [name for _, name in items]
        self.text = np.frombuffer(b"".join(t for t, _ in items), dtype=np.uint8)
        offs = np.concatenate([[0], np.cumsum([len(t) for t, _ in items])]).astype(np.int64)
        _, self.start, self.end, h, first = B.words(self.text, offs)
        count = np.diff(first)
        self.item = np.repeat(np.arange(len(count)), count)
        self.tables = {}
        for k in sorted({min(n, int(c)) for c in count if c}):
            w = B.window_hash(h, k)
            # Windows of n words of the longer items; a shorter item is one window of all its words.
            at = np.flatnonzero((self.item[: len(w)] == self.item[k - 1 : k - 1 + len(w)]) & ((count[self.item[: len(w)]] == k) | (k == n)))
            at = at[np.argsort(w[at], kind="stable")]
            seen = np.zeros(1 << _BITS, dtype=bool)
            seen[(w[at] >> np.uint64(64 - _BITS)).astype(np.int64)] = True
            self.tables[k] = (w[at], at, seen)

    def scan(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words of each document row; and, for every verified window, its document row, first word,
        words and item row (an array of four columns)."""
        low, start, end, h, first = B.words(buf, offs)
        count = np.diff(first)
        doc = np.repeat(np.arange(len(count)), count)
        found = [np.zeros((0, 4), np.int64)]
        for k, (keys, places, seen) in self.tables.items():
            w = B.window_hash(h, k)
            at = np.flatnonzero(seen[(w >> np.uint64(64 - _BITS)).astype(np.int64)])
            at = at[doc[at] == doc[at + k - 1]]
            lo, hi = (np.searchsorted(keys, w[at], side=x) for x in ("left", "right"))
            many = hi - lo
            i = np.repeat(at, many)
            j = places[np.repeat(lo - (np.cumsum(many) - many), many) + np.arange(many.sum())]
            for d in range(k):  # word for word
                same = end[i + d] - start[i + d] == self.end[j + d] - self.start[j + d]
                i, j = i[same], j[same]
                same = _equal(low, start[i + d], self.text, self.start[j + d], end[i + d] - start[i + d])
                i, j = i[same], j[same]
            found.append(np.stack([doc[i], i - first[doc[i]], np.full(len(i), k), self.item[j]], axis=1))
        return count, np.concatenate(found)


def _equal(a: np.ndarray, at: np.ndarray, b: np.ndarray, bt: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which of the spans a[at:at+size] and b[bt:bt+size] are equal."""
    out = np.ones(len(at), dtype=bool)
    if len(at):
        row = np.repeat(np.arange(len(at)), size)
        step = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        out[row[a[at[row] + step] != b[bt[row] + step]]] = False
    return out


_HELD: dict = {}


def _window_set(shared, name: str, n: int) -> WindowSet:
    """The table of a broadcast piece, built once in a worker process (the last piece is kept)."""
    if name not in _HELD:
        _HELD.clear()
        _HELD[name] = WindowSet(shared.value, n)
    return _HELD[name]


def _pieces(benchmark: DataFrame, n: int, max_windows: int) -> Iterator[list[tuple[bytes, str | None]]]:
    """Normalised items in pieces of at most ``max_windows`` windows; at least one piece."""
    text_batches(benchmark.sparkSession)

    def normal(batches):
        for b in batches:
            out: dict[str, list] = {"words": [], "item": [], "windows": []}
            for t, i in zip(b.column("text").to_pylist(), b.column("item_id").to_pylist()):
                raw = np.frombuffer((t or "").encode(), dtype=np.uint8)
                low = B.LOWER[raw]
                s, e = B.word_spans(low, np.array([0, len(raw)]))
                for k in range(0, max(len(s) - n + 1, min(len(s), 1)), max_windows):
                    part = slice(k, k + max_windows + n - 1)
                    out["words"].append(b" ".join(low[x:y].tobytes() for x, y in zip(s[part], e[part])))
                    out["item"].append(i)
                    out["windows"].append(max(1, len(s[part]) - n + 1))
            yield pa.RecordBatch.from_arrays([pa.array(out["words"], pa.binary()), pa.array(out["item"], pa.string()), pa.array(out["windows"], pa.int64())], list(out))

    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    piece, held, size = [], 0, 0
    for row in items.mapInArrow(normal, "words binary, item string, windows long").toLocalIterator():
        if piece and (held + row.windows > max_windows or size + len(row["words"]) > MAX_BYTES):
            yield piece
            piece, held, size = [], 0, 0
        piece.append((bytes(row["words"]), row["item"]))
        held, size = held + row.windows, size + len(row["words"])
    yield piece


def _scan_pass(documents: DataFrame, shared, n: int) -> DataFrame:
    """One row per row of ``documents`` (``doc_id, text`` and, with several passes, ``row``)."""
    keys, name = [c for c in documents.columns if c != "text"], uuid.uuid4().hex
    schema = ", ".join([*(f"{c} long" for c in keys), "n_words long, hits binary, items array<string>"])

    def scan(batches):
        table = _window_set(shared, name, n)
        for b in batches:
            for lo, hi, buf, offs in B.slices(b.column("text")):
                count, found = table.scan(buf, offs)
                blobs, items = _by_row(found, hi - lo)
                names = [sorted({table.names[i] for i in x} - {None}) for x in items]
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(lo, hi - lo) for c in keys), pa.array(count), pa.array(blobs, pa.binary()), pa.array(names, pa.list_(pa.string()))], [*keys, "n_words", "hits", "items"])

    return documents.mapInArrow(scan, schema)


def _by_row(found: np.ndarray, n: int) -> tuple[list[bytes | None], list]:
    """Merged hit spans and item rows of each of ``n`` document rows."""
    blobs: list[bytes | None] = [None] * n
    items: list = [()] * n
    found = found[np.argsort(found[:, 0], kind="stable")]
    cut = np.flatnonzero(np.r_[True, found[1:, 0] != found[:-1, 0], True]) if len(found) else np.zeros(1, np.int64)
    for s, e in zip(cut[:-1], cut[1:]):
        r = int(found[s, 0])
        blobs[r] = _merge(list(zip(found[s:e, 1].tolist(), (found[s:e, 1] + found[s:e, 2]).tolist()))).tobytes()
        items[r] = np.unique(found[s:e, 3]).tolist()
    return blobs, items


def _merge(spans: list) -> np.ndarray:
    """Disjoint sorted word spans, as int64 pairs."""
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return np.array(out, dtype=np.int64)


def contamination(documents: DataFrame, benchmark: DataFrame, n: int = 10, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """Per row: ``doc_id``, ``n_words``, ``hits`` (int64 pairs of hit word spans, merged; null if none)
    and ``items`` (ids of the benchmark items with a window in it)."""
    spark, pieces = documents.sparkSession, _pieces(benchmark, n, max_windows)
    slim = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    piece, more = next(pieces), next(pieces, None)
    if more is None:
        return _scan_pass(slim, spark.sparkContext.broadcast(piece), n)
    # Numbered once and written, so that every pass reads the same numbers.
    store = Store(spark)
    slim = store.write(slim.withColumn("row", F.monotonically_increasing_id()))
    rows = hits = None
    while piece is not None:
        found = store.write(_scan_pass(slim, store.share(piece), n))
        store.release()
        rows = found.select("row", "doc_id", "n_words") if rows is None else rows
        part = found.where("hits is not null").select("row", "hits", "items")
        hits = part if hits is None else hits.unionByName(part)
        piece, more = more, next(pieces, None)
    store.drop(slim)
    joined = F.pandas_udf(lambda s: s.map(lambda xs: _merge([tuple(p) for x in xs for p in np.frombuffer(x, np.int64).reshape(-1, 2)]).tobytes()), "binary")
    hits = hits.groupBy("row").agg(F.collect_list("hits").alias("h"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    none = F.array().cast("array<string>")
    return rows.join(hits.select("row", joined("h").alias("hits"), "items"), "row", "left").select("doc_id", "n_words", "hits", F.coalesce("items", none).alias("items"))


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns of ``contamination``'s rows."""

    @F.pandas_udf("long")
    def covered(hits):
        return hits.map(lambda x: 0 if x is None else int(np.diff(np.frombuffer(x, np.int64).reshape(-1, 2), axis=1).sum()))

    n_hit = covered("hits")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256")).withColumn("contaminated", F.col("n_hit") > 0)


def _hits(shared, n: int):
    """A column function: the merged hit word spans of a text, null if it has none."""
    name = uuid.uuid4().hex

    def hits(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table = _window_set(shared, name, n)
        for texts in parts:
            out: list = []
            for lo, hi, buf, offs in B.slices(pa.array(texts, pa.string(), from_pandas=True)):
                out += _by_row(table.scan(buf, offs)[1], hi - lo)[0]
            yield pd.Series(out, dtype=object)

    return F.pandas_udf(hits, "binary")


def decontaminate(documents: DataFrame, benchmark: DataFrame, n: int = 10, mode: str = "documents", max_windows: int = MAX_WINDOWS) -> DataFrame:
    """Documents without benchmark passages, in their own columns.

    ``mode="documents"`` drops documents with a hit; ``mode="spans"`` keeps them and cuts the hit
    word spans (from the first byte of the first word to the last byte of the last) out of the text.
    Each row is decided where it is read, so nothing is joined or shuffled.
    """
    spark, pieces = documents.sparkSession, _pieces(benchmark, n, max_windows)
    store, cols, names = Store(spark), documents.columns, []
    piece, more = next(pieces), next(pieces, None)
    several, made = more is not None, []
    while piece is not None:
        # Several passes are written one by one, so that a task holds one window table at a time.
        hit = _hits(store.share(piece), n)(F.col("text").cast("string"))
        names.append(f"__hf_hits{len(names)}")
        documents = documents.where(hit.isNull()) if mode == "documents" else documents.withColumn(names[-1], hit)
        if several:
            documents = store.write(documents)
            store.release()
            store.drop(*made)
            made = [documents]
        piece, more = more, next(pieces, None)
    if mode == "documents":
        return documents

    def cut(text: pd.Series, *hits: pd.Series) -> pd.Series:
        rows = zip(text, *hits)
        return pd.Series([t if t is None or all(h is None for h in hs) else _cut(t, _merge([tuple(p) for h in hs if h is not None for p in np.frombuffer(h, np.int64).reshape(-1, 2)])) for t, *hs in rows], dtype=object)

    return documents.withColumn("text", F.pandas_udf(cut, "string")("text", *names)).select(*cols)


def _cut(text: str, spans: np.ndarray) -> str:
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    s, e = B.word_spans(B.LOWER[raw], np.array([0, len(raw)]))
    keep, at = [], 0
    for a, b in spans:
        keep.append(raw[at : s[a]].tobytes())
        at = int(e[b - 1])
    return b"".join([*keep, raw[at:].tobytes()]).decode()


def op10_decontamination(spark, sf_dir: str) -> DataFrame:
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return digest(contamination(docs, bench))


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item, CASE WHEN len(w) < 10 THEN len(w) ELSE 10 END AS k, array_to_string(w[i:i + CASE WHEN len(w) < 10 THEN len(w) ELSE 10 END - 1], ' ') AS win
       FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS win
       FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
hit AS (SELECT dw.doc_id, dw.i, dw.k, bw.item FROM dw JOIN bw ON dw.win = bw.win AND dw.k = bw.k),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(pos.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(its.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(its.items, '')) AS items_sha256, coalesce(pos.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos ON d.doc_id = pos.doc_id LEFT JOIN its ON d.doc_id = its.doc_id
"""
