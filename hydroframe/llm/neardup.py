"""Near-duplicate detection by BagMinHash.

A document is the multiset of its five-word shingles.  Each shingle with weight w owns Poisson
processes over the discretised weight axis, one for each dyadic interval [0, 1), [1, 2), [2, 4), ...
An interval that w covers counts whole; of the interval in which w lies a point counts only if its
position, found by halving the interval again and again, is below w.  The earliest point in each of
``M`` registers is the signature; two signatures agree in a register with the probability of the
weighted Jaccard similarity.  Points are drawn only up to a horizon that fills the registers, so
a signature costs about ``M log M`` points and one draw for each shingle.

``BANDS`` bands of ``ROWS`` registers give candidates (a pair of similarity 0.8 is missed with
probability 3e-6); chains through the buckets give candidate groups, and within those the multiset
overlap is verified exactly for all pairs.  Groups of links are the classes.

Texts are told apart by 128 bits of hashes (``node`` and ``check``); candidate groups may be found by
``node`` alone, since what is in them is compared shingle by shingle.  Each distinct multiset then
gets a number of its own, and all links are between those numbers.

Scale: texts are read twice and never shuffled, but for the representatives of candidate groups.
Documents with the same multiset are one node from the first pass on, and a task sends a node to
a bucket once, so groups of exact copies weigh no more than one document a task.  Bucket rows are
packed into one blob for each task and bucket.

Defined cases: null texts and texts without a word are alone in their class; a text of one to
four words is one shingle; rows that repeat an id stay or go together; a null id never names a class
unless all of it are null, and its row is never removed; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import bytesops as B
from .graph import BLOBS, blob_batch, by_bucket, components, label_min, only, pack, unpack, verified_links, without
from .store import Store, buckets_for

BANDS, ROWS = 32, 5
M = BANDS * ROWS
_ENTRY = np.dtype([("key", "<i8"), ("node", "<i8")])
_MEMBER = np.dtype([("doc", "<i8"), ("node", "<i8"), ("check", "<i8"), ("words", "<i8")])
_SEED = np.uint64(0x5851F42D4C957F2D)
_NO_ID = (1 << 63) - 1  # stands for a null doc_id, behind all others


def multiset(row: np.ndarray, h: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, element, its second hash, weight) of the distinct shingles, rows ascending (fewer than 2**16)."""
    order = B.ordered(row, h, 16)
    row, h = row[order], h[order]
    first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (row[1:] != row[:-1])]) if len(h) else np.zeros(0, np.int64)
    return row[first], h[first], h2[order[first]], np.diff(np.r_[first, len(h)])


def signatures(row: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, m: int = M) -> np.ndarray:
    """n x m registers (uint64); a row without elements has zeros."""
    total = np.bincount(row, weights=weight, minlength=n)
    best = np.full(n * m, np.inf)
    sig = np.zeros(n * m, dtype=np.uint64)
    horizon = np.where(total > 0, m / np.maximum(total, 1) * (np.log(m) + 3), 0)
    todo = total > 0
    levels = np.frexp(weight.astype(np.float64))[1]  # bit length
    levels = np.where(weight == (1 << (levels - 1)), levels, levels + 1)
    while todo.any():
        points = []
        take = np.flatnonzero(todo[row])
        for k in range(int(levels[take].max())):
            live = take[levels[take] > k]
            low, length = (0, 1) if k == 0 else (1 << (k - 1), 1 << (k - 1))
            who, state, t = live, B.splitmix(element[live] * B.PRIME + np.uint64(int(_SEED) * (k + 1) % (1 << 64))), np.zeros(len(live))
            while len(who):
                state = B.splitmix(state + B.PRIME)
                t = t - np.log(((state >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / length
                keep = t <= horizon[row[who]]
                who, state, t = who[keep], state[keep], t[keep]
                mark = B.splitmix(state ^ _SEED)
                inside = slice(None)
                if k:
                    depth = np.uint64(64 - (k - 1)) if k > 1 else None  # halvings of the interval: bits of a second hash
                    at = low + ((B.splitmix(mark) >> depth).astype(np.int64) if depth is not None else 0)
                    inside = at < weight[who]
                register = ((mark >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
                points.append((row[who][inside] * m + register[inside].astype(np.int64), t[inside], mark[inside]))
        cell, when, mark = (np.concatenate(x) for x in zip(*points))
        np.minimum.at(best, cell, when)
        won = when == best[cell]
        sig[cell[won]] = mark[won]
        todo = np.isinf(best.reshape(n, m)).any(axis=1) & (total > 0)
        best.reshape(n, m)[todo] = np.inf
        horizon = horizon * 3
    return sig.reshape(n, m)


def band_keys(sig: np.ndarray) -> np.ndarray:
    """n x BANDS keys."""
    parts = sig.reshape(len(sig), sig.shape[1] // ROWS, ROWS)
    acc = np.zeros(parts.shape[:2], dtype=np.uint64) + np.arange(1, parts.shape[1] + 1, dtype=np.uint64) * _SEED
    for j in range(ROWS):
        acc = B.splitmix(acc * B.PRIME + parts[:, :, j])
    return acc.view(np.int64)


def node_ids(row: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """A hash of each row's multiset (0 for none)."""
    first = np.searchsorted(row, np.arange(n + 1))
    mixed = B.splitmix(element ^ B.splitmix(weight.astype(np.uint64) * B.PRIME))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed, dtype=np.uint64)])
    total = np.maximum(B.splitmix(sums[first[1:]] - sums[first[:-1]]), np.uint64(1))
    return np.where(first[1:] > first[:-1], total, np.uint64(0)).view(np.int64)


def expand(element: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The multiset as a sorted set: the j-th occurrence of an element is an element of its own."""
    j = np.arange(weight.sum()) - np.repeat(np.cumsum(weight) - weight, weight)
    return np.unique(B.splitmix(np.repeat(element, weight) * B.PRIME + j.astype(np.uint64)))


def _distinct(e: np.ndarray) -> np.ndarray:
    """Entries in the order of (key, node), each once."""
    e = e[np.lexsort((e["node"], e["key"]))]
    return e[np.r_[True, (e["key"][1:] != e["key"][:-1]) | (e["node"][1:] != e["node"][:-1])]] if len(e) else e


def _bags(batch_text):
    """(first row, bags, rows) of pieces of a batch, fewer than 2**15 documents each."""
    for lo, hi, buf, offs in B.slices(batch_text):
        for at in range(0, hi - lo, 1 << 15):
            end = min(hi - lo, at + (1 << 15))
            piece = offs[at : end + 1]
            yield lo + at, end - at, multiset(*B.shingles(buf[piece[0] : piece[-1]], piece - piece[0]))


def near_duplicates(documents: DataFrame, num: int = 4, den: int = 5) -> DataFrame:
    """``doc_id, class_id, n_words, n_links``: the class is named by its smallest doc_id; n_words
    counts shingles; n_links is the number of different multisets linked with the document's."""
    spark, store = documents.sparkSession, Store(documents.sparkSession)
    slim = documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID).cast("long")).alias("doc_id"), F.col("text").cast("string").alias("text"))
    buckets = buckets_for(slim)

    def sign(batches):
        entries, members = [], []

        def flush():
            e = _distinct(np.concatenate([np.zeros(0, _ENTRY), *entries]))
            m = np.concatenate([np.zeros(0, _MEMBER), *members])
            entries.clear()
            members.clear()
            return blob_batch([*pack(e["key"] % buckets, e), (-1, m.tobytes())])

        for b in batches:
            ids = b.column("doc_id").to_numpy()
            for lo, n, (row, element, second, weight) in _bags(b.column("text")):
                node, check = node_ids(row, element, weight, n), node_ids(row, second, weight, n)
                members.append(np.rec.fromarrays([ids[lo : lo + n], node, check, np.bincount(row, weights=weight, minlength=n).astype(np.int64)], dtype=_MEMBER))
                once = np.unique(node, return_index=True)[1]
                once = once[node[once] != 0]
                keep = np.zeros(n, bool)
                keep[once] = True
                number = np.cumsum(keep) - 1
                mine = keep[row]
                keys = band_keys(signatures(number[row[mine]], element[mine], weight[mine], int(keep.sum())))
                entries.append(np.rec.fromarrays([keys.ravel(), np.repeat(node[keep], BANDS)], dtype=_ENTRY))
            if sum(map(len, entries)) > 1 << 20:
                yield flush()
        yield flush()

    signed = store.write(slim.mapInArrow(sign, BLOBS))

    def chain(table: pa.Table) -> pa.Table:
        e = _distinct(unpack(table, _ENTRY))
        next_ = e["key"][1:] == e["key"][:-1]
        a, b = e["node"][:-1][next_], e["node"][1:][next_]
        nodes, root = label_min(a, b)
        return pa.table({"a": root[nodes != root], "b": nodes[nodes != root]})

    coarse = components(by_bucket(signed.where("bucket >= 0"), chain, "a long, b long"), store)

    def members_of(batches):
        for b in batches:
            m = unpack(pa.Table.from_batches([b]), _MEMBER)
            yield pa.RecordBatch.from_arrays([pa.array(m[c].copy()) for c in _MEMBER.names], list(_MEMBER.names))

    members = signed.where("bucket = -1").mapInArrow(members_of, "doc long, node long, check long, words long")
    firsts = members.where("node <> 0").groupBy("node", "check").agg(F.min("doc").alias("doc"))
    firsts = store.write(firsts.withColumn("id", F.monotonically_increasing_id()))
    picked = store.write(firsts.join(coarse, "node"))

    def sets(batches):
        for b in batches:
            out = {"h": [], "h2": [], "elements": []}
            for _, n, (row, element, second, weight) in _bags(b.column("text")):
                node, check, first = node_ids(row, element, weight, n), node_ids(row, second, weight, n), np.searchsorted(row, np.arange(n + 1))
                for k in np.flatnonzero(node):
                    s = slice(first[k], first[k + 1])
                    out["h"].append(int(node[k]))
                    out["h2"].append(int(check[k]))
                    out["elements"].append(expand(element[s], weight[s]).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.binary() if c == "elements" else pa.int64()) for c, v in out.items()], list(out))

    held = only(slim, picked.select("doc").distinct()).mapInArrow(sets, "h long, h2 long, elements binary").dropDuplicates(["h", "h2"])
    labels = picked.select(F.col("node").alias("h"), F.col("check").alias("h2"), F.col("id").alias("node"), "comp", "doc", F.lit(0).cast("long").alias("tx"), F.lit(0).alias("line"))
    found = store.write(verified_links(held, labels, store, num, den, groups=buckets))
    groups = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")), store, written=True)
    degree = found.groupBy("node").agg(F.sum("links").alias("links"))
    grouped = firsts.join(groups, firsts.id == groups.node).select("id", "doc", "comp")
    of_node = grouped.join(grouped.groupBy("comp").agg(F.min("doc").alias("class")), "comp").join(degree, F.col("id") == degree.node).select("id", "class", "links")
    own = store.write(firsts.join(of_node, "id", "left").select("node", "check", F.coalesce("class", "doc").alias("class"), F.coalesce("links", F.lit(0)).cast("long").alias("links")))
    store.drop(coarse, firsts, picked, found, groups)
    out = members.join(own, ["node", "check"], "left")
    known = lambda c: F.when(c != _NO_ID, c)
    return out.select(known(F.col("doc")).alias("doc_id"), known(F.coalesce("class", "doc")).alias("class_id"), F.col("words").alias("n_words"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"))


def deduplicate(documents: DataFrame) -> DataFrame:
    """One document of each class (the smallest doc_id), in the documents' own columns."""
    dead = Store(documents.sparkSession).write(near_duplicates(documents).where("doc_id <> class_id").select(F.col("doc_id").alias("doc")).distinct())
    return without(documents, dead)


def op1_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: All pairs that share a shingle, then components; for small tables.
SQL = """
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
s AS (SELECT doc_id, array_to_string(w[i:i + k - 1], ' ') AS sh FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM (SELECT *, least(5, len(w)) AS k FROM d WHERE len(w) > 0))),
b AS (SELECT doc_id, sh, count(*) AS c FROM s GROUP BY ALL),
n AS (SELECT doc_id, md5(string_agg(sh || ':' || c, '|' ORDER BY sh)) AS node, CAST(sum(c) AS BIGINT) AS n_words FROM b GROUP BY doc_id),
r AS (SELECT node, min(doc_id) AS rep, min(n_words) AS t FROM n GROUP BY node),
x AS (SELECT rep, t, sh, c FROM b JOIN r ON doc_id = rep),
l AS (SELECT a.rep AS a, z.rep AS z FROM x a JOIN x z ON a.sh = z.sh AND a.rep < z.rep GROUP BY a.rep, z.rep, a.t, z.t HAVING 9 * sum(least(a.c, z.c)) >= 4 * (a.t + z.t)),
e AS (SELECT a, z FROM l UNION ALL SELECT z, a FROM l),
reach(rep, c) AS (SELECT rep, rep FROM r UNION SELECT e.z, reach.c FROM reach JOIN e ON e.a = reach.rep WHERE reach.c < e.z),
g AS (SELECT rep, min(c) AS class_id FROM reach GROUP BY rep),
k AS (SELECT a AS rep, count(*) AS links FROM e GROUP BY a)
SELECT d.doc_id, coalesce(g.class_id, d.doc_id) AS class_id, coalesce(n.n_words, 0) AS n_words, CAST(coalesce(k.links, 0) AS BIGINT) AS n_links
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN r ON n.node = r.node LEFT JOIN g ON r.rep = g.rep LEFT JOIN k ON r.rep = k.rep
"""
