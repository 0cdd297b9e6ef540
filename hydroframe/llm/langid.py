"""Language identification by a byte convolutional network.

Bytes are embedded, filters of several widths slide over fixed-length windows, each filter keeps
its maximum, and a softmax layer names the language.  The network is trained here, in numpy, on a
bounded sample of labelled rows: ``TRAIN_DOCS`` documents, dealt evenly among the languages (at most
``MAX_LANGS``, the most frequent ones) by hash order, and ``TRAIN_WINDOWS`` windows of each, which are
cut on the executors.  A text is cut into all its windows; the languages' log probabilities are averaged over
the windows, weighted by their bytes.

Scale: prediction is one pass on Arrow batches without a shuffle; windows are processed in blocks
of ``BLOCK``, whatever the length of a text.  Only the model (some kB) is sent to the executors.

Defined cases: null texts and texts without a letter are ``und`` with score 0; a text shorter than
a window is padded; a very long text is read in blocks of windows; rows that repeat an id are predicted
one by one, and ties of the sample order go to the smaller id, then text; with no labelled row at all every text is ``und``; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import bytesops as B
from .store import text_batches

TRAIN_DOCS, TRAIN_WINDOWS, MAX_LANGS = 3000, 4, 200
WINDOW, EMBED, FILTERS, WIDTHS = 256, 8, 8, (2, 3, 4, 5)
BLOCK = 128


class ByteCNN:
    """Embedding, convolutions of WIDTHS with max pooling, softmax."""

    def __init__(self, labels: list[str], seed: int = 11):
        rng = np.random.default_rng(seed)
        f = lambda *s: rng.normal(scale=0.3, size=s).astype(np.float32)
        n = FILTERS * len(WIDTHS)
        self.labels = labels
        self.p = {"emb": f(256, EMBED), "out": f(n, len(labels)), "bias": np.zeros(len(labels), np.float32), "shift": np.zeros(n, np.float32)}
        #: One matrix over the widest patch; narrower filters have zeros beyond their width.
        self.p["conv"] = f(max(WIDTHS) * EMBED, n) * self.reach()

    @staticmethod
    def reach() -> np.ndarray:
        rows = np.arange(max(WIDTHS) * EMBED)[:, None] // EMBED
        return (rows < np.repeat(WIDTHS, FILTERS)[None, :]).astype(np.float32)

    def _pooled(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pooled before the rectifier, where each maximum is, patches) of uint8 windows."""
        k = max(WIDTHS)
        padded = np.pad(x, ((0, 0), (0, k - 1)))
        e = self.p["emb"][padded].reshape(len(x), -1)
        view = np.lib.stride_tricks.sliding_window_view(e, k * EMBED, axis=1)[:, ::EMBED]
        patches = np.ascontiguousarray(view)
        conv = patches.reshape(-1, k * EMBED) @ self.p["conv"]
        conv = conv.reshape(len(x), x.shape[1], -1)
        return conv.max(axis=1), conv, patches

    def log_probs(self, x: np.ndarray) -> np.ndarray:
        pooled, _, _ = self._pooled(x)
        z = np.maximum(pooled + self.p["shift"], 0) @ self.p["out"] + self.p["bias"]
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean cross entropy."""
        pooled, conv, patches = self._pooled(x)
        at = conv.argmax(axis=1)
        hidden = np.maximum(pooled + self.p["shift"], 0)
        z = hidden @ self.p["out"] + self.p["bias"]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        d = z / z.sum(axis=1, keepdims=True)
        d[np.arange(len(y)), y] -= 1
        d /= len(y)
        dh = (d @ self.p["out"].T) * (hidden > 0)
        best = np.take_along_axis(patches, at[:, :, None], axis=1)
        d_emb = np.zeros_like(self.p["emb"])
        padded = np.pad(x, ((0, 0), (0, max(WIDTHS) - 1)))
        back = (dh[:, :, None] * self.p["conv"].T[None]).reshape(len(x), -1, max(WIDTHS), EMBED)
        byte = padded[np.arange(len(x))[:, None, None], at[:, :, None] + np.arange(max(WIDTHS))]
        np.add.at(d_emb, byte, back)
        return {"emb": d_emb, "out": hidden.T @ d, "bias": d.sum(0), "shift": dh.sum(0), "conv": np.einsum("bf,bfk->kf", dh, best) * self.reach()}

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 8, rate: float = 0.01, batch: int = 64, seed: int = 3) -> None:
        """Adam on the cross entropy."""
        rng = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        t, total = 0, max(1, epochs * -(-len(x) // batch))
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for lo in range(0, len(x), batch):
                t += 1
                step = rate * (1 - (t - 1) / total)
                for k, g in self.gradients(x[order[lo : lo + batch]], y[order[lo : lo + batch]]).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] -= step * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)


def windows_of(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document row, first byte, bytes) of every window of a slice; empty texts have one empty."""
    n = np.maximum(-(-np.diff(offs) // WINDOW), 1)
    row = np.repeat(np.arange(len(n)), n)
    start = offs[:-1][row] + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * WINDOW
    return row, start, np.minimum(start + WINDOW, offs[1:][row]) - start


def cut_windows(buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    at = start[:, None] + np.arange(WINDOW)
    inside = np.arange(WINDOW) < size[:, None]
    if not len(buf):
        return np.zeros(at.shape, np.uint8)
    return np.where(inside, buf[np.minimum(at, len(buf) - 1)], 0).astype(np.uint8)


def train(labelled: DataFrame, docs: int = TRAIN_DOCS, seed: int = 5) -> ByteCNN | None:
    """A network from a bounded sample of rows with ``doc_id, text, lang``."""
    rows = labelled.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).withColumn("h", F.xxhash64("doc_id", F.lit(seed)))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGS).collect()}
    if not counts:
        return None
    quota = -(-docs // len(counts))
    # About twice the quota of each language by hash, then exactly the quota; texts stay where they are.
    share = F.lit(0.0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, (2.0 * quota + 20) / n))).otherwise(share)
    some = rows.where(F.pmod("h", F.lit(1 << 30)) < share * (1 << 30))

    def cut(batches):
        for b in batches:
            ws = []
            for text, h in zip(b.column("text").to_pylist(), b.column("h").to_pylist()):
                rng, raw, mine = np.random.default_rng(h & ((1 << 63) - 1)), np.frombuffer(text.encode(), dtype=np.uint8), []
                for _ in range(min(TRAIN_WINDOWS, 1 + len(raw) // WINDOW)):
                    at = int(rng.integers(0, max(1, len(raw) - WINDOW + 1)))
                    size = min(len(raw) - at, WINDOW if rng.random() < 0.7 else int(rng.integers(12, WINDOW)))
                    mine.append(raw[at : at + size].tobytes())
                ws.append(mine)
            yield pa.RecordBatch.from_arrays([b.column("lang"), b.column("h"), b.column("doc_id"), pa.array(ws, pa.list_(pa.binary()))], ["lang", "h", "doc_id", "windows"])

    order = Window.partitionBy("lang").orderBy("h", "doc_id", "windows")
    picked = some.mapInArrow(cut, "lang string, h long, doc_id long, windows array<binary>").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= quota)
    labels = sorted(counts)
    found = sorted((labels.index(r["lang"]), r["rank"], [bytes(w) for w in r["windows"]]) for r in picked.select("lang", "rank", "windows").collect())
    if not found:
        return None
    x = np.array([np.frombuffer(w.ljust(WINDOW, b"\0"), np.uint8) for _, _, ws in found for w in ws])
    y = np.array([k for k, _, ws in found for _ in ws])
    model = ByteCNN(labels)
    model.fit(x, y, epochs=max(6, min(40, 60_000 // len(x))))
    return model


def identify(documents: DataFrame, model: ByteCNN | None) -> DataFrame:
    """``doc_id, lang_pred, score`` for every document."""
    slim = documents.select(F.col("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    if model is None:
        return slim.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    text_batches(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(model)
    id_type = dict(slim.dtypes)["doc_id"]

    def predict(batches):
        net = shared.value
        names = np.array([*net.labels, "und"], dtype=object)
        for b in batches:
            for lo, hi, buf, offs in B.slices(b.column("text")):
                row, start, size = windows_of(buf, offs)
                acc = np.zeros((hi - lo, len(net.labels)))
                for k in range(0, len(row), BLOCK):
                    s = slice(k, k + BLOCK)
                    np.add.at(acc, row[s], net.log_probs(cut_windows(buf, start[s], size[s])) * size[s][:, None])
                acc /= np.maximum(np.diff(offs), 1)[:, None]
                prob = np.exp(acc - acc.max(axis=1, keepdims=True))
                prob /= prob.sum(axis=1, keepdims=True)
                ok = b.column("letters").slice(lo, hi - lo).to_numpy(zero_copy_only=False).astype(bool)
                best = np.where(ok, prob.argmax(axis=1), len(net.labels))
                score = np.where(ok, prob.max(axis=1), 0.0)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), pa.array(names[best], pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return slim.mapInArrow(predict, f"doc_id {id_type}, lang_pred string, score double")


def held_out(fold: int, of: int):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % of == fold, F.lit(False))


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.where(~held_out(1, 3)))
    return identify(docs, model).select("doc_id", held_out(1, 3).alias("held_out"), "lang_pred", "score")
