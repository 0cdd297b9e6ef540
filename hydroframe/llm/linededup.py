"""Line deduplication by an exact set-similarity join.

A line is the set of its words (A-Z lower-cased).  Words are ordered by rarity; two lines of
Jaccard 4/5 or more share a word among the first ``n - ceil(4n/5) + 1`` of both, so lines meet at
those prefix words only.  Length, position and parity filters drop most meetings (each of 192 bits
is the parity of the words hashed to it, so two lines' parities differ in no more bits than their
words do, and no true pair is dropped); what is left is verified on the whole word sets.  A line goes
if the same set, or a linked one, stands earlier (smaller doc_id, then smaller line number); all is
judged on the input.

Words are 64-bit hashes where two lines are compared, and a word set is known by 128 bits
(``node`` from the first, ``check`` from a second hash of each word); each distinct set in a
candidate group gets a number of its own before links are verified.

Rarity comes from word counts over all documents in a table of hashed counters (``sketch``),
kept as logarithmic classes: a fixed size at any scale.  Any order gives exact results; the counters
only shorten the lists.  A counter of 1 proves that a word stands in one line only, and its row is
dropped.  The prefix rows of each cell are then counted too; lines of a cell with more than ``HOT``
rows are dealt out as pairs of blocks, as many blocks as the count asks for.

Scale: the main passes ship packed records, not text.  A task keeps one position for each distinct
line and settles its other copies at once, so a line that makes up a third of the input is one row
a task in the shuffle.  Only lines in candidate groups ship their word sets.

Defined cases: lines without a word are never removed and have no links; null and empty texts have
no removable lines; a row is known by its doc_id and its text (a 64-bit hash ``tx``): repeated rows
share positions and decisions, so a repeated row does not remove itself, while rows of one doc_id
with other texts are documents of their own, in the order of ``tx``; rows without a doc_id have no
place in the order, lose nothing and remove nothing; extra columns are kept as they are.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import bytesops as B, sketch
from .graph import BLOBS, blob_batch, by_bucket, components, label_min, only, pack, sized, unpack, verified_links
from .store import Store, buckets_for

HOT = 50_000
_LINES = 1 << 13
_PLACE = np.dtype([("node", "<i8"), ("check", "<i8"), ("doc", "<i8"), ("tx", "<i8"), ("line", "<i4")])
_GONE = np.dtype([("doc", "<i8"), ("tx", "<i8"), ("line", "<i4")])
_ENTRY = np.dtype([("token", "<u8"), ("node", "<i8"), ("bits0", "<u8"), ("bits1", "<u8"), ("bits2", "<u8"), ("size", "<i4"), ("pos", "<i4")])


def line_words(buf: np.ndarray, offs: np.ndarray):
    """For each word of a slice: its line's number in the slice and its two hashes; for each line
    of the slice: its document row and its number in the document."""
    _, start, _, h, h2, _ = B.wide_words(buf, offs)
    breaks = np.flatnonzero(buf == 10)
    doc_of_break = np.searchsorted(offs, breaks, side="right") - 1
    n_docs = len(offs) - 1
    count = np.bincount(doc_of_break, minlength=n_docs) + 1
    line_doc = np.repeat(np.arange(n_docs), count)
    line_no = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    word_doc = np.searchsorted(offs, start, side="right") - 1
    return np.searchsorted(breaks, start) + word_doc, h, h2, line_doc, line_no


def line_sets(line: np.ndarray, token: np.ndarray, second: np.ndarray, classes: np.ndarray | None):
    """(line, class, token, second hash) of the distinct words of each line, rarest first, in pieces of lines."""
    if not len(line):
        return
    for lo in range(int(line[0]), int(line[-1]) + 1, _LINES):
        s, e = np.searchsorted(line, (lo, lo + _LINES))
        if s == e:
            continue
        t = token[s:e]
        group = (line[s:e] - lo) << 8
        if classes is not None:
            group = group | classes[sketch.cells(t)]
        order = B.ordered(group, t, 21)
        group, t = group[order], t[order]
        new = np.flatnonzero(np.r_[True, (t[1:] != t[:-1]) | (group[1:] != group[:-1])])
        group = group[new]
        yield (group >> 8) + lo, group & 255, t[new], second[s:e][order[new]]


def set_ids(line: np.ndarray, token: np.ndarray, second: np.ndarray):
    """(line, first word, node, check) of each line in order."""
    first = np.flatnonzero(np.r_[True, line[1:] != line[:-1]])
    node, check = (B.splitmix(np.add.reduceat(B.splitmix(t * B.PRIME + np.uint64(1)), first)).view(np.int64) for t in (token, second))
    return line[first], first, node, check


def in_order(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places by word set and position, and which are the first of their set."""
    order = np.argsort(p["node"])
    node = p["node"][order]
    tied = np.r_[node[1:] == node[:-1], False] if len(p) else np.zeros(0, bool)
    tied |= np.r_[False, tied[:-1]] if len(p) else tied
    t = order[tied]
    order[tied] = t[np.lexsort((p["line"][t], p["tx"][t], p["doc"][t], p["check"][t], p["node"][t]))]
    p = p[order]
    return p, np.r_[True, (p["node"][1:] != p["node"][:-1]) | (p["check"][1:] != p["check"][:-1])] if len(p) else np.zeros(0, bool)


def later_than_first(p: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Of places in order, those behind the first of their set (repeated rows share one)."""
    head = np.maximum.accumulate(np.where(first, np.arange(len(p)), 0))
    return (p["doc"] != p["doc"][head]) | (p["tx"] != p["tx"][head]) | (p["line"] != p["line"][head])


def _scan(batches, piece):
    for b in batches:
        ids, tx = b.column("doc_id").to_numpy(), b.column("tx").to_numpy()
        for lo, hi, buf, offs in B.slices(b.column("text")):
            piece(ids[lo:hi], tx[lo:hi], *line_words(buf, offs))
        yield b


def _count_pass(documents: DataFrame, buckets: int) -> DataFrame:
    """Blobs: word counters (buckets below sketch.RANGES), each task's first positions of word sets
    (from there on) and positions that an earlier one in the same task settles (-1)."""

    def run(batches):
        tokens, places = [], []

        def piece(ids, tx, line, token, second, line_doc, line_no):
            tokens.append(sketch.cells(token))
            for ln, _, tk, t2 in line_sets(line, token, second, None):
                which, _, node, check = set_ids(ln, tk, t2)
                places.append(np.rec.fromarrays([node, check, ids[line_doc[which]], tx[line_doc[which]], line_no[which].astype(np.int32)], dtype=_PLACE))

        def flush():
            rows = sketch.cell_rows(tokens)
            p, first = in_order(np.concatenate([np.zeros(0, _PLACE), *places]))
            gone = p[later_than_first(p, first)]
            gone = np.rec.fromarrays([gone[c] for c in _GONE.names], dtype=_GONE)
            tokens.clear()
            places.clear()
            p = p[first]
            return blob_batch([*rows, *((sketch.RANGES + k, x) for k, x in pack(p["node"] % buckets, p)), (-1, gone.tobytes())])

        for _ in _scan(batches, piece):
            if sum(map(len, tokens)) > 1 << 23:
                yield flush()
        yield flush()

    return documents.mapInArrow(run, BLOBS)


def prefix_rows(line, token, second, classes: np.ndarray):
    """(word set's first row, its words, its node; rows of the prefix words) of each piece of lines."""
    for ln, cls, tk, t2 in line_sets(line, token, second, classes):
        _, first, node, _ = set_ids(ln, tk, t2)
        size = np.diff(np.r_[first, len(ln)])
        once = np.zeros(len(first), bool)
        once[np.unique(node, return_index=True)[1]] = True
        pos = np.arange(len(ln)) - np.repeat(first, size)
        take = np.flatnonzero((pos < np.repeat(np.where(once, size - (4 * size + 4) // 5 + 1, 0), size)) & (cls > 0))
        yield tk, first, size, node, pos, take


def prefix_entries(line, token, second, classes: np.ndarray) -> list[np.ndarray]:
    """Index rows of the prefix words of each distinct line of a slice."""
    out = []
    for tk, first, size, node, pos, take in prefix_rows(line, token, second, classes):
        bit, word = np.uint64(1) << (tk & np.uint64(63)), (tk >> np.uint64(6)) % np.uint64(3)
        bits = [np.bitwise_xor.reduceat(np.where(word == w, bit, np.uint64(0)), first) for w in range(3)]
        of = np.repeat(np.arange(len(first)), size)[take]
        e = np.empty(len(take), dtype=_ENTRY)
        for name, v in (("token", tk[take]), ("node", node[of]), ("bits0", bits[0][of]), ("bits1", bits[1][of]), ("bits2", bits[2][of]), ("size", size[of]), ("pos", pos[take])):
            e[name] = v
        out.append(e)
    return out


def spread(e: np.ndarray, heavy: np.ndarray, hot: int = HOT) -> np.ndarray:
    """Index rows by the key at which they meet: the word, or for a hot word each pair of blocks that
    the line's block takes part in.  ``heavy``: classes of the cells' prefix rows."""
    n = np.maximum(1, np.ceil(sketch.at_most(heavy[sketch.cells(e["token"])]) / hot)).astype(np.int64)
    if len(e) and n.max() > 1:
        other = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        e, blocks = np.repeat(e, n), np.repeat(n, n)
        own = (B.splitmix(e["node"].view(np.uint64)) % blocks.astype(np.uint64)).astype(np.int64)
        part = np.where(blocks > 1, 1 + np.minimum(own, other) * (1 << 31) + np.maximum(own, other), 0)
    else:
        part = np.zeros(len(e), np.int64)
    e["token"] = B.splitmix(e["token"] + B.splitmix(part.astype(np.uint64)))
    return e


def meetings(e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Node pairs that share an index word and pass the filters."""
    e = e[np.argsort(e["node"], kind="stable")]
    e = e[np.argsort(e["size"], kind="stable")]
    e = e[np.argsort(e["token"], kind="stable")]
    if len(e):
        e = e[np.r_[True, (e["token"][1:] != e["token"][:-1]) | (e["node"][1:] != e["node"][:-1])]]
    token, node, bits = e["token"].copy(), e["node"].copy(), [e[f"bits{k}"].copy() for k in range(3)]
    size, pos = e["size"].astype(np.int64), e["pos"].astype(np.int64)
    i, d = np.arange(len(e)), 0
    out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while len(i):
        d += 1
        i = i[: np.searchsorted(i, len(e) - d)]
        j = i + d
        i = i[(token[i] == token[j]) & (5 * size[i] >= 4 * size[j])]  # later ones are longer still
        j = i + d
        need = (4 * (size[i] + size[j]) + 8) // 9
        fits = np.minimum(size[i] - pos[i], size[j] - pos[j]) >= need
        a, b, slack = i[fits], j[fits], (size[i] + size[j] - 2 * need)[fits]
        differ = sum(np.bitwise_count(x[a] ^ x[b]).astype(np.int64) for x in bits)
        near = differ <= slack
        out_a.append(node[a[near]])
        out_b.append(node[b[near]])
    return np.concatenate(out_a), np.concatenate(out_b)


def _heavy(slim: DataFrame, shared) -> DataFrame:
    """Blobs of the cells' prefix rows."""

    def run(batches):
        classes, tokens = sketch.table(shared.value), []

        def piece(ids, tx, line, token, second, *_):
            tokens.extend(sketch.cells(tk[take]) for tk, _, _, _, _, take in prefix_rows(line, token, second, classes))

        for _ in _scan(batches, piece):
            if sum(map(len, tokens)) > 1 << 23:
                yield blob_batch(sketch.cell_rows(tokens))
                tokens.clear()
        yield blob_batch(sketch.cell_rows(tokens))

    return slim.mapInArrow(run, BLOBS)


def _found_at(node: np.ndarray, check: np.ndarray, by_node: np.ndarray, by_check: np.ndarray) -> np.ndarray:
    """Where each (node, check) stands in the sorted (by_node, by_check); -1 if it does not."""
    at = np.searchsorted(by_node, node)
    while True:
        inside = np.minimum(at, len(by_node) - 1)
        same = (at < len(by_node)) & (by_node[inside] == node) if len(by_node) else np.zeros(len(node), bool)
        other = same & (by_check[inside] != check) if len(by_node) else same
        if not other.any():
            return np.where(same, at, -1)
        at = at + other


def decisions(documents: DataFrame, hot: int = HOT) -> DataFrame:
    """``doc_id, tx, gone`` (sorted numbers of removed lines), ``n_links`` (links of the line sets that
    stand first in the document), without documents that have neither."""
    spark, store = documents.sparkSession, Store(documents.sparkSession)
    slim = _slim(documents)
    buckets = buckets_for(slim)
    counted = store.write(_count_pass(slim, buckets))
    packed, _ = sketch.classes(counted)
    shared = store.share(packed)
    # Without a word of more than ``hot`` occurrences no cell can have that many prefix rows.
    many = sketch.reaches(packed, sketch.class_above(hot))
    heavy = store.share(sketch.classes(_heavy(slim, shared), hot)[0] if many else [])

    def index(batches):
        classes, weight, rows = sketch.table(shared.value), sketch.table(heavy.value), []

        def piece(ids, tx, line, token, second, *_):
            rows.extend(prefix_entries(line, token, second, classes))

        def flush():
            e = spread(np.concatenate([np.zeros(0, _ENTRY), *rows]), weight, hot)
            rows.clear()
            return blob_batch(pack((e["token"] % np.uint64(buckets)).astype(np.int64), e))

        for _ in _scan(batches, piece):
            if sum(map(len, rows)) > 1 << 19:
                yield flush()
        yield flush()

    def meet(table: pa.Table) -> pa.Table:
        nodes, root = label_min(*meetings(unpack(table, _ENTRY)))
        return pa.table({"a": root[nodes != root], "b": nodes[nodes != root]})

    coarse = components(by_bucket(slim.mapInArrow(index, BLOBS), meet, "a long, b long"), store)
    store.release()
    places = counted.where(f"bucket >= {sketch.RANGES}").withColumn("bucket", F.col("bucket") - sketch.RANGES)
    asked = coarse.select(F.pmod("node", F.lit(buckets)).cast("int").alias("bucket"), "node")

    def place(left: pa.Table, right: pa.Table) -> pa.Table:
        p = unpack(left, _PLACE)
        p, first = in_order(p[np.isin(p["node"], right["node"].to_numpy())])
        return pa.table({c: np.ascontiguousarray(p[c][first]) for c in _PLACE.names})

    firsts = places.groupBy("bucket").cogroup(asked.groupBy("bucket")).applyInArrow(place, "node long, check long, doc long, tx long, line int")
    firsts = store.write(firsts.withColumn("id", F.monotonically_increasing_id()))
    asking = firsts.groupBy(F.col("doc").alias("doc_id"), "tx").agg(F.collect_list("line").alias("lines"))

    def sets(batches):
        for b in batches:
            want = [set(x) for x in b.column("lines").to_pylist()]
            out: dict[str, list] = {"h": [], "h2": [], "elements": []}
            for lo, hi, buf, offs in B.slices(b.column("text")):
                line, token, second, line_doc, line_no = line_words(buf, offs)
                for ln, _, tk, t2 in line_sets(line, token, second, None):
                    which, first, node, check = set_ids(ln, tk, t2)
                    last = np.r_[first[1:], len(tk)]
                    for k, w in enumerate(which):
                        if int(line_no[w]) in want[lo + int(line_doc[w])]:
                            out["h"].append(int(node[k]))
                            out["h2"].append(int(check[k]))
                            out["elements"].append(tk[first[k] : last[k]].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.binary() if c == "elements" else pa.int64()) for c, v in out.items()], list(out))

    held = only(slim, firsts.select("doc").distinct()).join(asking, ["doc_id", "tx"]).select("text", "lines").mapInArrow(sets, "h long, h2 long, elements binary")
    held = held.dropDuplicates(["h", "h2"])
    labels = firsts.join(coarse, "node").select(F.col("node").alias("h"), F.col("check").alias("h2"), F.col("id").alias("node"), "comp", "doc", "tx", "line")
    linked = verified_links(held, labels, store, groups=buckets).groupBy("node").agg(F.sum("links").alias("links"), F.min(F.struct("doc", "tx", "line")).alias("first"))
    linked = linked.withColumnRenamed("node", "id").join(firsts.select("id", "node", "check"), "id")
    linked = store.write(linked.select(F.pmod("node", F.lit(buckets)).cast("int").alias("bucket"), "node", "check", "links", "first.doc", "first.tx", "first.line"))

    def settle(left: pa.Table, right: pa.Table) -> pa.Table:
        p, first = in_order(unpack(left, _PLACE))
        cols = {c: right[c].to_numpy() for c in right.column_names if c != "bucket"}
        order = np.lexsort((cols["check"], cols["node"]))
        cols = {c: v[order] for c, v in cols.items()}
        at = _found_at(p["node"], p["check"], cols["node"], cols["check"])
        earlier, n_links = np.zeros(len(p), bool), np.zeros(len(p), np.int64)
        use = np.flatnonzero((at >= 0) & first)
        doc, tx, line, mine = (*(cols[c][at[use]] for c in ("doc", "tx", "line")), p[use])
        earlier[use] = (doc < mine["doc"]) | ((doc == mine["doc"]) & ((tx < mine["tx"]) | ((tx == mine["tx"]) & (line < mine["line"]))))
        n_links[use] = cols["links"][at[use]]
        gone = later_than_first(p, first) | earlier
        use = gone | (n_links > 0)
        return pa.table({"doc": p["doc"][use].copy(), "tx": p["tx"][use].copy(), "line": np.where(gone, p["line"], -1)[use].astype(np.int32), "n": n_links[use]})

    rows = places.groupBy("bucket").cogroup(linked.groupBy("bucket")).applyInArrow(settle, "doc long, tx long, line int, n long")

    def local(batches):
        for b in batches:
            g = unpack(pa.Table.from_batches([b]), _GONE)
            yield pa.RecordBatch.from_arrays([*(pa.array(g[c].copy()) for c in _GONE.names), pa.array(np.zeros(len(g), np.int64))], ["doc", "tx", "line", "n"])

    rows = rows.unionByName(counted.where("bucket = -1").mapInArrow(local, "doc long, tx long, line int, n long"))
    out = rows.groupBy("doc", "tx").agg(F.array_sort(F.collect_set(F.when(F.col("line") >= 0, F.col("line")))).alias("gone"), F.sum("n").alias("n_links"))
    out = store.write(out.select(F.col("doc").alias("doc_id"), "tx", "gone", "n_links"))
    store.drop(counted, coarse, firsts, linked)
    return out


def _slim(documents: DataFrame) -> DataFrame:
    """``doc_id, text, tx`` of the rows that have an id."""
    text = F.col("text").cast("string")
    return documents.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tx"))


def line_report(documents: DataFrame) -> DataFrame:
    """``doc_id, class_id`` (smallest id with the same text, by its MD5), ``n_lines, n_removed, n_links``
    of each row."""
    found, text = decisions(documents), F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("tx"), F.md5(text).alias("same"),
        F.when(text == "", 0).otherwise(F.regexp_count(text, F.lit("\n")) + 1).cast("long").alias("n_lines"),
    )
    named, zero = rows.where("doc_id is not null"), F.lit(0).cast("long")
    # Only texts that stand twice; written, so that the rows of one text can be split among tasks.
    first = named.groupBy("same").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("n")).where("n > 1").select("same", "class_id")
    first = Store(documents.sparkSession).write(first)
    out = named.join(sized(first, first.count()), "same", "left").join(found, ["doc_id", "tx"], "left")
    out = out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), "n_lines", F.coalesce(F.size("gone"), zero).cast("long").alias("n_removed"), F.coalesce("n_links", zero).cast("long").alias("n_links"))
    nameless = rows.where("doc_id is null").select("doc_id", F.lit(None).cast("long").alias("class_id"), "n_lines", zero.alias("n_removed"), zero.alias("n_links"))
    return out.unionByName(nameless)


def dedup_lines(documents: DataFrame, drop_emptied: bool = True) -> DataFrame:
    """Documents without their removed lines, in their own columns; with ``drop_emptied`` a
    document that loses its last word goes as a whole."""
    found = decisions(documents).where("size(gone) > 0").select(F.col("doc_id").alias("__hf_doc"), F.col("tx").alias("__hf_tx"), F.col("gone").alias("__hf_gone"))
    found = sized(found, found.agg(F.coalesce(F.sum(F.size("__hf_gone")), F.lit(0))).first()[0])

    cols, schema = documents.columns, documents.schema
    has_word = re.compile(r"[0-9A-Za-z]|[^\x00-\x7F]")

    def rewrite(batches):
        for b in batches:
            gone = b.column("__hf_gone")
            out = [b.column(c) for c in cols]
            if gone.null_count < len(gone):
                texts, keep = b.column("text").to_pylist(), np.ones(len(gone), bool)
                chars = b.column("n_chars").to_pylist() if "n_chars" in cols else None
                for k, dead in enumerate(gone.to_pylist()):
                    if dead is None:
                        continue
                    dead = set(dead)
                    texts[k] = "\n".join(x for n, x in enumerate(texts[k].split("\n")) if n not in dead)
                    keep[k] = not drop_emptied or bool(has_word.search(texts[k]))
                    if chars is not None:
                        chars[k] = len(texts[k])
                out[cols.index("text")] = pa.array(texts, b.column("text").type)
                if chars is not None:
                    out[cols.index("n_chars")] = pa.array(chars, b.column("n_chars").type)
                yield pa.RecordBatch.from_arrays(out, cols).filter(pa.array(keep))
            else:
                yield pa.RecordBatch.from_arrays(out, cols)

    # One pass in Arrow, so that a task needs one Python worker and no second copy of the texts.
    same = (documents.doc_id == F.col("__hf_doc")) & (F.xxhash64(documents.text.cast("string")) == F.col("__hf_tx"))
    rows = documents.join(found, same, "left").drop("__hf_doc", "__hf_tx")
    return rows.mapInArrow(rewrite, schema)


def op6_line_dedup(spark, sf_dir: str) -> DataFrame:
    return line_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: The same join with word counts as rarity and no filter but prefix and length; for small tables.
SQL = """
WITH l AS (SELECT doc_id, i, lines[i] AS t FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))),
w AS (SELECT doc_id, doc_id * 1000000 + i AS pos, list_sort(list_distinct(regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'))) AS ws FROM l),
p AS (SELECT doc_id, pos, ws, min(pos) OVER (PARTITION BY ws) AS sid FROM w WHERE len(ws) > 0),
t AS (SELECT sid, len(ws) AS n, unnest(ws) AS word FROM p WHERE pos = sid),
f AS (SELECT word, count(*) AS df FROM t GROUP BY word),
o AS (SELECT sid, n, t.word, row_number() OVER (PARTITION BY sid ORDER BY df, t.word) AS rk FROM t JOIN f ON t.word = f.word),
x AS (SELECT * FROM o WHERE rk <= n - (4 * n + 4) // 5 + 1),
c AS (SELECT DISTINCT a.sid AS a, z.sid AS z, a.n + z.n AS n FROM x a JOIN x z ON a.word = z.word AND a.sid < z.sid AND 5 * least(a.n, z.n) >= 4 * greatest(a.n, z.n)),
k AS (SELECT a, z FROM c JOIN t ta ON ta.sid = a JOIN t tz ON tz.sid = z AND tz.word = ta.word GROUP BY a, z, c.n HAVING 9 * count(*) >= 4 * c.n),
e AS (SELECT a AS sid, count(*) AS links, false AS later FROM k GROUP BY a UNION ALL SELECT z, count(*), true FROM k GROUP BY z),
q AS (SELECT sid, sum(links) AS links, bool_or(later) AS later FROM e GROUP BY sid),
g AS (SELECT p.doc_id, count(*) FILTER (p.pos <> p.sid OR coalesce(q.later, false)) AS n_removed, sum(CASE WHEN p.pos = p.sid THEN coalesce(q.links, 0) ELSE 0 END) AS n_links FROM p LEFT JOIN q ON p.sid = q.sid GROUP BY p.doc_id),
d AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS class_id, CASE WHEN coalesce(text, '') = '' THEN 0 ELSE len(string_split(text, chr(10))) END AS n_lines FROM documents)
SELECT d.doc_id, d.class_id, CAST(d.n_lines AS BIGINT) AS n_lines, CAST(coalesce(g.n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(g.n_links, 0) AS BIGINT) AS n_links
FROM d LEFT JOIN g ON d.doc_id = g.doc_id
"""
