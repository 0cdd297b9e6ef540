"""Nearest neighbours by multi-index hashing over learned rotated binary codes.

A rotation is learned on a bounded sample (``SAMPLE`` rows, by hash order): principal axes, then
iterative quantisation, so that the signs of the rotated vectors are balanced binary codes.  Each
code is split into m substrings and every substring is indexed by a posting list.  By the pigeonhole
principle a code within Hamming distance R of a query agrees with it in some substring up to
floor(R / m) bits (one less for the later substrings), so probing those values retrieves *every*
code within R.  m is chosen so that the probed lists are shortest for R and the block's rows.  What is retrieved is reranked on the original vectors in double precision.

R is learned on the sample: the distance within which ``COVER`` of the sample's true neighbours
lie.  A query that finds fewer than k rows within R is searched again without a radius.

How much the index saves follows from the data.  Where neighbours agree in most bits, R is small and
probing reads a few posting lists.  Where vectors have no structure (independent random directions), R
comes near half of the bits and the lists to probe hold more rows than the block; a block then
compares its codes with the query's directly, which retrieves the same rows for less.

Scale: every row is indexed, in blocks of ``BLOCK`` rows inside the task that reads it, so the base
table is never shuffled.  Queries are dealt into passes of at most ``PASS_BYTES``; one pass is
collected and broadcast at a time, and its results are written before the next.  A task keeps the k best
of each query over all its blocks and returns those once; they are merged by a grouped top-k.

Defined cases: vectors that are null, zero, of another length than the table's, or holding null or
non-finite components take no part, as query or candidate; rows without an id neither; a repeated id
is returned once, with its best score; ties go to the smaller id; with fewer than k candidates all
are returned; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .store import Store

SAMPLE = 4096
BITS = 64
#: Numbers of substrings to choose from (of 16 to 8 bits), and the cost of a lookup in list entries.
PARTS, PROBE = (4, 5, 6, 8), 10
COVER = 0.97
PASS_BYTES = 32 << 20
BLOCK, ASKED = 8192, 256  # rows of a block, and queries that are compared with it at once
_NEAR = 1e-9  # scores this close are computed again, one by one, before they are ranked


def valid(col: str):
    v = F.col(col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0)


class Coder:
    """Learned projection of vectors to packed codes (uint8 rows of BITS / 8 bytes)."""

    def __init__(self, sample: np.ndarray, rounds: int = 30, seed: int = 7):
        dim = sample.shape[1]
        rng = np.random.default_rng(seed)
        self.mean = sample.mean(0)
        x = sample - self.mean
        _, _, axes = np.linalg.svd(x, full_matrices=True)
        basis = axes[: min(dim, BITS)].T
        if basis.shape[1] < BITS:
            basis = np.hstack([basis, rng.normal(size=(dim, BITS - basis.shape[1])) / np.sqrt(dim)])
        v = x @ basis
        r, _ = np.linalg.qr(rng.normal(size=(BITS, BITS)))
        for _ in range(rounds):
            u, _, w = np.linalg.svd(np.sign(v @ r).T @ v)
            r = (u @ w).T
        self.map = basis @ r

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.packbits((x - self.mean) @ self.map > 0, axis=1)


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int32)


def learn_radius(coder: Coder, sample: np.ndarray, k: int, cover: float = COVER) -> int:
    """The Hamming distance that covers ``cover`` of the true neighbours within the sample."""
    q = sample[:: max(1, len(sample) // 256)]
    score = q @ sample.T
    np.put_along_axis(score, np.arange(0, len(sample), max(1, len(sample) // 256))[: len(q), None], -np.inf, axis=1)
    near = np.argsort(-score, axis=1)[:, : min(k, len(sample) - 1)]
    codes = coder(sample)
    d = hamming(coder(q)[:, None, :], codes[near])
    return int(np.quantile(d, cover, method="higher")) if d.size else BITS


@lru_cache(maxsize=32)
def _masks(width: int, radius: int) -> np.ndarray:
    """The values of ``width`` bits of which at most ``radius`` are set."""
    values = np.arange(1 << width, dtype=np.uint64)
    return values[np.bitwise_count(values) <= radius]


def substring_radii(radius: int, parts: int) -> list[int]:
    """Bits in which each substring may differ: if all differed in more, the code would by more than
    ``radius``.  -1 where a substring need not be probed."""
    base, extra = divmod(radius, parts)
    return [base if p <= extra else base - 1 for p in range(parts)]


def read_share(radius: int, parts: int, rows: int) -> float:
    """Expected work of probing ``rows`` codes without structure, as a share of the rows: entries of
    posting lists, and lookups as PROBE entries each."""
    total, width = 0.0, BITS // parts
    for r in substring_radii(radius, parts):
        probes = sum(math.comb(width, d) for d in range(r + 1))
        total += probes * (PROBE / max(1, rows) + 2.0**-width)
    return total


def best_parts(radius: int, rows: int) -> int:
    """The number of substrings that reads least; 0 if the lists would hold more than the block."""
    share = {m: read_share(radius, m, rows) for m in PARTS}
    m = min(share, key=share.get)
    return m if share[m] < 1 else 0


class MultiIndex:
    """Posting lists of one block's codes, one list set for each substring."""

    def __init__(self, codes: np.ndarray, parts: int):
        self.code = np.ascontiguousarray(codes).view(np.uint64).ravel()
        self.edges = [BITS * p // parts for p in range(parts + 1)]
        self.order, self.values = [], []
        for p in range(parts):
            value = self._part(self.code, p)
            self.order.append(np.argsort(value, kind="stable").astype(np.int32))
            self.values.append(value[self.order[-1]])

    def _part(self, code: np.ndarray, p: int) -> np.ndarray:
        lo, hi = self.edges[p], self.edges[p + 1]
        return (code >> np.uint64(lo)) & np.uint64((1 << (hi - lo)) - 1)

    def lists(self, code: np.ndarray, radius: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each substring the posting lists (begins, ends) to read for a query's code."""
        out = []
        for p, r in enumerate(substring_radii(radius, len(self.order))):
            width = self.edges[p + 1] - self.edges[p]
            keys = _masks(width, min(r, width)) ^ self._part(code, p) if r >= 0 else np.zeros(0, np.uint64)
            out.append((np.searchsorted(self.values[p], keys), np.searchsorted(self.values[p], keys, side="right")))
        return out

    def probe(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows within ``radius`` of ``code``: all of them, by the pigeonhole principle."""
        code = np.ascontiguousarray(code).view(np.uint64)[0]
        mark = np.zeros(len(self.code), dtype=bool)
        for p, (lo, hi) in enumerate(self.lists(code, radius)):
            n = hi - lo
            mark[self.order[p][np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())]] = True
        rows = np.flatnonzero(mark)
        return rows[np.bitwise_count(self.code[rows] ^ code) <= radius]


def retrieve(codes: np.ndarray, asked: np.ndarray, radius: int, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first query, which rows are within ``radius`` of it and the next ones), ASKED queries at a
    time; with ``parts`` 0 by comparing the codes directly, which gives the same rows."""
    index = MultiIndex(codes, parts) if parts else None
    mine, code = (np.ascontiguousarray(x).view(np.uint64).ravel() for x in (codes, asked))
    for lo in range(0, len(asked), ASKED):
        some = asked[lo : lo + ASKED]
        if index:
            within = np.zeros((len(some), len(mine)), dtype=bool)
            for k, c in enumerate(some):
                within[k, index.probe(c, radius)] = True
        else:
            within = np.bitwise_count(code[lo : lo + ASKED, None] ^ mine[None]) <= radius
        yield lo, within


class Best:
    """The k best (score, id) of each query so far."""

    def __init__(self, queries: int, k: int):
        self.k, self.least = k, np.full(queries, -np.inf)
        self.q, self.ids, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def add(self, q: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        q, ids, score = (np.concatenate(x) for x in ((self.q, q), (self.ids, ids), (self.score, score)))
        order = np.lexsort((-score, ids, q))  # a repeated id counts once, with its best score
        order = order[np.r_[True, (q[order][1:] != q[order][:-1]) | (ids[order][1:] != ids[order][:-1])]] if len(q) else order
        order = order[np.lexsort((ids[order], -score[order], q[order]))]
        rank = np.arange(len(order)) - np.searchsorted(q[order], q[order])
        order, rank = order[rank < self.k], rank[rank < self.k]
        self.q, self.ids, self.score = q[order], ids[order], score[order]
        self.least[self.q[rank == self.k - 1]] = self.score[rank == self.k - 1]


def search_block(ids: np.ndarray, vecs: np.ndarray, coder: Coder, radius: int, qids: np.ndarray, qvecs: np.ndarray, qcodes: np.ndarray, best: Best) -> None:
    """Adds the block's rows within ``radius`` of each query to its best ones."""
    unique = len(np.unique(ids)) == len(ids)
    parts = best_parts(radius, len(ids)) if radius < BITS else 0
    for lo, within in retrieve(coder(vecs), qcodes, radius, parts):
        mine = slice(lo, lo + len(within))
        within &= ids[None] != qids[mine, None]
        least = best.least[mine]
        if within.mean() < 0.05:
            q, rows = np.nonzero(within)
        else:
            rough = np.where(within, qvecs[mine] @ vecs.T, -np.inf)
            if unique and len(ids) > best.k and np.isinf(least).any():
                least = np.maximum(least, np.partition(rough, len(ids) - best.k, axis=1)[:, len(ids) - best.k])
            q, rows = np.nonzero(within & (rough >= least[:, None] - _NEAR))
        # Row by row, so that equal vectors have equal scores.
        score = np.einsum("ij,ij->i", qvecs[mine][q], vecs[rows])
        good = score >= least[q] - _NEAR
        best.add(q[good] + lo, ids[rows[good]], score[good])


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _found(base: DataFrame, queries: DataFrame, coder: Coder, radius: int, k: int, dim: int, store: Store) -> DataFrame:
    """``query_id, vec_id, score``: each task's k best rows within ``radius`` of each query."""
    per_pass = max(1, PASS_BYTES // (8 * dim))
    passes = -(-max(1, queries.count()) // per_pass)
    found = None
    for p in range(passes):
        part = queries.where(F.pmod(F.xxhash64("id"), F.lit(passes)) == p) if passes > 1 else queries
        rows = part.toArrow()
        qids, qvecs = rows["id"].to_numpy(), _matrix(rows["v"].combine_chunks(), dim)
        asked = store.share((coder, qids, qvecs, coder(qvecs) if len(qids) else np.zeros((0, BITS // 8), np.uint8)))
        del rows, qvecs

        def search(batches, asked=asked):
            code, qids, qvecs, qcodes = asked.value
            best, ids, vecs = Best(len(qids), k), [], []

            def flush():
                have, mat = np.concatenate(ids), np.concatenate(vecs)
                ids.clear()
                vecs.clear()
                for lo in range(0, len(have), BLOCK):
                    search_block(have[lo : lo + BLOCK], mat[lo : lo + BLOCK], code, radius, qids, qvecs, qcodes, best)

            for b in batches:
                ids.append(b.column("id").to_numpy())
                vecs.append(_matrix(b.column("v"), dim))
                if sum(map(len, ids)) >= BLOCK:
                    flush()
            if ids:
                flush()
            yield pa.RecordBatch.from_arrays([pa.array(qids[best.q]), pa.array(best.ids), pa.array(best.score)], ["query_id", "vec_id", "score"])

        got = store.write(base.mapInArrow(search, "query_id long, vec_id long, score double"))
        store.release()
        found = got if found is None else found.unionByName(got)
    return found


def neighbours(base: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest of ``base`` for each row of ``queries``."""
    spark, store = base.sparkSession, Store(base.sparkSession)
    vec = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & valid("v"))
    base, queries = vec(base), vec(queries)
    sample = base.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow()
    if not sample.num_rows:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sizes = sample["v"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
    dim = int(np.bincount(sizes).argmax())
    base, queries = base.where(F.size("v") == dim), queries.where(F.size("v") == dim)
    drawn = _matrix(sample["v"].combine_chunks().filter(pa.array(sizes == dim)), dim)
    coder = Coder(drawn)
    found = _found(base, queries, coder, learn_radius(coder, drawn, k), k, dim, store)
    enough = found.groupBy("query_id").agg(F.countDistinct("vec_id").alias("n")).where(F.col("n") >= k)
    short = store.write(queries.join(enough, queries.id == enough.query_id, "left_anti"))
    if short.limit(1).count():
        found = found.unionByName(_found(base, short, coder, BITS, k, dim, store))
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op7_nearest_neighbours(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return neighbours(rows, rows.where(F.col("vec_id") % 20 == 0))
