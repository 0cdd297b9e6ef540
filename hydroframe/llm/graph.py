"""Connected components and exact set similarity over candidate groups.

Both work on tables only.  ``components`` contracts a link table: every label hooks to its smallest
neighbour, chains are shortened by pointer jumping, links between labels that are still different
go to the next round.  A round at least halves the number of labels that have links, and the
tables shrink with it; once they are few, one task settles the rest.  Tables are written between steps, so a lost executor costs one step, and
both sides of each join are read from files, so a hub's rows can be split among tasks.

``verified_links`` compares the sets of the nodes of a group exactly.  A group of more than
``BLOCK`` nodes is cut into blocks by hash and dealt out as pairs of blocks, so no task holds an
unbounded group and no pair of nodes is left out.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .store import Store, partitions

BLOCK = 128
#: Links that one task settles (3 MB); longer tables are contracted by joins until so few are left.
SMALL = 200_000
_CELLS = 1 << 24


def label_min(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) for every node of the links a-b."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        np.minimum.at(label, label[x], low)
        np.minimum.at(label, label[y], low)
        while True:
            jump = label[label]
            if np.array_equal(jump, label):
                break
            label = jump
        open_ = label[x] != label[y]
        if not open_.any():
            return nodes, nodes[label]
        x, y = x[open_], y[open_]


def _settled(links: DataFrame) -> DataFrame:
    """``l, p`` (the smallest node of its component) of at most SMALL links, in one task."""

    def settle(batches):
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for x in batches:
            a.append(x.column("a").to_numpy())
            b.append(x.column("b").to_numpy())
        node, root = label_min(np.concatenate(a), np.concatenate(b))
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], ["l", "p"])

    return links.coalesce(1).mapInArrow(settle, "l long, p long")


def components(links: DataFrame, store: Store, small: int = SMALL, written: bool = False) -> DataFrame:
    """``node, comp`` (the smallest node of its component) from ``a, b`` (long) links; ``written`` says
    that they come from a written table and need no copy."""
    live, label = links.where("a <> b").select("a", "b"), None
    live = live if written else store.write(live)
    while n := live.count():
        if n <= small:
            hook = store.write(_settled(live))
        else:
            both = live.union(live.select("b", "a")).toDF("l", "n")
            hook = store.write(both.groupBy("l").agg(F.min("n").alias("n")).select("l", F.least("l", "n").alias("p")))
            while True:
                up = hook.select(F.col("l").alias("p"), F.col("p").alias("q"))
                jump = store.write(hook.join(up, "p").select("l", F.col("q").alias("p"), (F.col("p") != F.col("q")).alias("moved")))
                store.drop(hook)
                hook, moved = jump, jump.where("moved").limit(1).count()
                if not moved:
                    break
        to = hook.select("l", "p")
        if label is None:
            new_label = to.toDF("node", "comp")
            new_label._hydroframe_path = hook._hydroframe_path
        else:
            new_label = store.write(label.join(to, label.comp == to.l, "left").select("node", F.coalesce("p", "comp").alias("comp")))
            store.drop(label, hook)
        label = new_label
        if n <= small:
            break
        pa_, pb = to.toDF("a", "pa"), to.toDF("b", "pb")
        new_live = store.write(live.join(pa_, "a").join(pb, "b").where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
        store.drop(live)
        live = new_live
    store.drop(live)
    return label if label is not None else live.toDF("node", "comp").limit(0)


def _overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets[left] and sets[right], as a matrix."""
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    if len(left) * len(right) <= 4:
        for i, x in enumerate(left):
            for j, y in enumerate(right):
                out[i, j] = len(sets[x]) if x == y else len(np.intersect1d(sets[x], sets[y], assume_unique=True))
        return out
    use = np.unique(np.concatenate([left, right]))
    size = np.array([len(sets[i]) for i in use])
    at = np.full(len(sets), -1)
    at[use] = np.arange(len(use))
    flat, row = np.concatenate([sets[i] for i in use]), np.repeat(np.arange(len(use)), size)
    order = np.argsort(flat, kind="stable")
    flat, row = flat[order], row[order]
    new = np.r_[True, flat[1:] != flat[:-1]] if len(flat) else np.zeros(0, bool)
    token = np.cumsum(new) - 1
    shared = np.bincount(token)[token] > 1 if len(flat) else new
    row, token = row[shared], token[shared]
    token = np.unique(token, return_inverse=True)[1]
    step = max(1, _CELLS // len(use))
    edges = np.searchsorted(token, np.arange(0, (int(token[-1]) if len(token) else 0) + 1 + step, step))
    for c, (lo, hi) in enumerate(zip(edges[:-1], edges[1:])):
        if lo == hi:
            continue
        m = np.zeros((len(use), min(step, int(token[hi - 1]) - c * step + 1)), dtype=np.float32)
        m[row[lo:hi], token[lo:hi] - c * step] = 1
        out += m[at[left]] @ m[at[right]].T
    same = left[:, None] == right[None, :]
    return np.where(same, np.array([len(sets[i]) for i in left], dtype=np.float32)[:, None], out)


def _links(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of left x right with Jaccard >= num / den, each unordered pair once."""
    o = _overlaps(sets, left, right).astype(np.int64)
    size = np.array([len(s) for s in sets], dtype=np.int64)
    ok = o * (num + den) >= num * (size[left][:, None] + size[right][None, :])
    if left is right:
        ok &= np.arange(len(left))[:, None] < np.arange(len(right))[None, :]
    i, j = np.nonzero(ok)
    return left[i], right[j]


def verified_links(members: DataFrame, labels: DataFrame, store: Store, num: int = 4, den: int = 5, block: int = BLOCK, groups: int = 0) -> DataFrame:
    """Exact links within groups.

    ``members``: a key and ``elements`` (uint64, sorted, distinct); ``labels``: that key and ``comp``.  One
    of the two has ``node`` and its position ``doc, tx, line``; the key is the columns they share, so
    members that lie by their key are not shuffled to be labelled.  Returns ``node, links, doc, tx, line, root``: the number of linked nodes, the
    earliest position among them and the smallest node linked within the task; one row for each
    node and task that found links.
    """
    spark = members.sparkSession
    sizes = labels.groupBy("comp").agg(F.ceil(F.count("*") / block).cast("int").alias("nb"))
    key = [c for c in members.columns if c in labels.columns]
    sized = labels.join(sizes, "comp").withColumn("b", F.pmod(F.xxhash64("node"), F.col("nb").cast("long")).cast("int"))
    rows = members.join(sized, key)
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    rows = rows.withColumn("lo", F.least("b", "other")).withColumn("hi", F.greatest("b", "other"))
    # Small groups share a task's call; each pair of blocks of a large one is a call of its own.
    many = F.lit(groups or 4 * partitions(spark))
    deal = F.when(F.col("nb") > 1, F.xxhash64("comp", "lo", "hi")).otherwise(F.pmod(F.xxhash64("comp"), many))

    def link(table: pa.Table) -> pa.Table:
        col = lambda n: table[n].to_numpy()
        node, comp, lo, hi, b, doc, tx, line = (col(n) for n in ("node", "comp", "lo", "hi", "b", "doc", "tx", "line"))
        sets = [np.frombuffer(x, dtype=np.uint64) for x in table["elements"].to_pylist()]
        order = np.lexsort((node, hi, lo, comp))
        cut = np.flatnonzero(np.r_[True, (comp[order][1:] != comp[order][:-1]) | (lo[order][1:] != lo[order][:-1]) | (hi[order][1:] != hi[order][:-1]), True])
        ax, bx = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for s, e in zip(cut[:-1], cut[1:]):
            g = order[s:e]
            if lo[g[0]] == hi[g[0]]:
                i, j = _links(sets, g, g, num, den)
            else:
                i, j = _links(sets, g[b[g] == lo[g[0]]], g[b[g] == hi[g[0]]], num, den)
            ax.append(i)
            bx.append(j)
        i, j = np.concatenate(ax), np.concatenate(bx)
        a, z = np.concatenate([i, j]), np.concatenate([j, i])
        if not len(a):
            return pa.table({n: pa.array([], pa.int32() if n == "line" else pa.int64()) for n in ("node", "links", "doc", "tx", "line", "root")})
        names, root = label_min(node[i], node[j])
        order = np.lexsort((line[z], tx[z], doc[z], node[a]))
        a, z = a[order], z[order]
        first = np.flatnonzero(np.r_[True, node[a][1:] != node[a][:-1]])
        count = np.diff(np.r_[first, len(a)])
        return pa.table({"node": node[a[first]], "links": count, "doc": doc[z[first]], "tx": tx[z[first]], "line": line[z[first]].astype(np.int32), "root": root[np.searchsorted(names, node[a[first]])]})

    rows = rows.withColumn("deal", deal).select("deal", "node", "comp", "lo", "hi", "b", "doc", "tx", "line", "elements")
    return rows.groupBy("deal").applyInArrow(link, "node long, links long, doc long, tx long, line int, root long")


def pack(key_bucket: np.ndarray, records: np.ndarray) -> list[tuple[int, bytes]]:
    """One blob of records for every bucket that has any."""
    order = np.argsort(key_bucket, kind="stable")
    k, r = key_bucket[order], records[order]
    cut = np.flatnonzero(np.r_[True, k[1:] != k[:-1], True]) if len(k) else np.zeros(1, np.int64)
    return [(int(k[s]), r[s:e].tobytes()) for s, e in zip(cut[:-1], cut[1:])]


def blob_batch(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.int32()), pa.array([y for _, y in rows], pa.binary())], ["bucket", "blob"])


BLOBS = "bucket int, blob binary"


def unpack(table: pa.Table, dtype: np.dtype) -> np.ndarray:
    return np.concatenate([np.zeros(0, dtype), *(np.frombuffer(x, dtype=dtype) for x in table["blob"].to_pylist())])


def by_bucket(blobs: DataFrame, fn: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    return blobs.groupBy("bucket").applyInArrow(fn, schema)


FEW = 1_000_000


def sized(side: DataFrame, rows: int, few: int = FEW) -> DataFrame:
    """``side`` to be broadcast if it was counted to have few rows, else to be joined by shuffle."""
    return F.broadcast(side) if rows <= few else side.hint("merge")


def only(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """Documents whose ``doc_id`` is in ``ids`` (column ``doc``, distinct)."""
    side = sized(ids.select(F.col("doc").alias("__hf_doc")), ids.count())
    return documents.join(side, documents.doc_id == F.col("__hf_doc"), "left_semi")


def without(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """Documents whose ``doc_id`` is not in ``ids`` (column ``doc``, distinct)."""
    side = sized(ids.select(F.col("doc").alias("__hf_doc")), ids.count())
    return documents.join(side, documents.doc_id == F.col("__hf_doc"), "left_anti")
