"""Quality classifier: a byte-level convolutional network in numpy.

A document's UTF-8 bytes are covered wholly by chunks of 64 bytes that overlap by half.  In a chunk, learned filters of
four bytes and channels that tell whether a byte repeats the one `lag` before it are averaged; learned chunk filters
combine them; the maximum over all chunks of each chunk filter is combined into one probability.

Null and empty texts have no byte and score as the network's answer to nothing; without any label all score 0.98, and with
labels of one class only all score as that.  Texts of any length are scored in slabs,
so memory doesn't grow with them.  Repeated rows are scored each; further columns
are passed on, but for `score` and `predicted`, which are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, crc_mod, sample_ids, sampled_rows

BLOCK = 32  #: half a chunk
WIDTH = 4  #: bytes under a byte filter
FILTERS, LAGS, CHUNK_FILTERS = 16, range(2, 26), 24
CHANNELS = FILTERS + len(LAGS)
SLAB = 2048  #: blocks worked on at once
SAMPLE_PER_CLASS = 700  #: labelled documents of each class that the network is fitted on, at most
SAMPLE_CHARS = 60_000  #: the longest text it is fitted on


def layout(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One buffer with a block of zeros before each text; the first block and the number of blocks of each text."""
    blocks = np.array([max(1, -(-len(t) // BLOCK)) for t in texts])
    first = np.cumsum(blocks + 1) - blocks
    buf = np.zeros((int(first[-1] + blocks[-1]) + 1) * BLOCK, dtype=np.uint8)
    for t, b in zip(texts, first, strict=True):
        buf[b * BLOCK : b * BLOCK + len(t)] = np.frombuffer(t, dtype=np.uint8)
    return buf, first, blocks


class ByteNet:
    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.p = {
            "table": rng.normal(0, 0.35, (WIDTH, 256, FILTERS)).astype(np.float32),
            "b1": np.zeros(FILTERS, np.float32),
            "W": rng.normal(0, 0.5, (CHANNELS, CHUNK_FILTERS)).astype(np.float32),
            "b2": np.zeros(CHUNK_FILTERS, np.float32),
            "v": rng.normal(0, 0.3, CHUNK_FILTERS).astype(np.float32),
            "c": np.zeros(1, np.float32),
        }

    def byte_filters(self, buf: np.ndarray, at: np.ndarray | slice) -> np.ndarray:
        """The byte filters' output at positions `at` (a slice, or an array of positions)."""
        t = self.p["table"]
        take = (lambda j: buf[at.start + j : at.stop + j]) if isinstance(at, slice) else (lambda j: buf[at + j])
        out = t[0][take(0)]
        for j in range(1, WIDTH):
            out += t[j][take(j)]
        out += self.p["b1"]
        return np.maximum(out, 0, out=out)

    def block_sums(self, buf: np.ndarray, valid: np.ndarray) -> np.ndarray:
        """Sums of every channel over each block of the buffer."""
        n = len(buf) // BLOCK - 1
        sums = np.zeros((n, CHANNELS), np.float32)
        for a in range(1, n, SLAB):
            b = min(n, a + SLAB)
            at = slice(a * BLOCK, b * BLOCK)
            h = self.byte_filters(buf, at)
            h *= valid[at, None]
            sums[a:b, :FILTERS] = h.reshape(b - a, BLOCK, FILTERS).sum(1)
            here, ok = buf[at], valid[at]
            for k, lag in enumerate(LAGS):
                same = (here == buf[at.start - lag : at.stop - lag]) & ok
                sums[a:b, FILTERS + k] = same.view(np.uint8).reshape(-1, BLOCK).sum(1, dtype=np.uint8)
        return sums

    def chunks(self, texts: list[bytes]):
        buf, first, blocks = layout(texts)
        size = np.array([len(t) for t in texts])
        valid = np.zeros(len(buf), bool)
        for b, n in zip(first, size, strict=True):
            valid[b * BLOCK : b * BLOCK + n] = True
        sums = np.vstack([self.block_sums(buf, valid), np.zeros((1, CHANNELS), np.float32)])
        count = np.append(valid[: (len(sums) - 1) * BLOCK].reshape(-1, BLOCK).sum(1), 0)
        per = np.maximum(blocks - 1, 1)
        start = np.cumsum(per) - per
        k = np.repeat(first - start, per) + np.arange(per.sum())
        n = np.maximum(count[k] + count[k + 1], 1).astype(np.float32)
        return buf, k, n, start, per, (sums[k] + sums[k + 1]) / n[:, None]

    def pooled(self, c: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        g = c @ self.p["W"]
        g += self.p["b2"]
        np.maximum(g, 0, out=g)
        return g, np.maximum.reduceat(g, start, axis=0)

    def score(self, texts: list[bytes]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        _, _, _, start, _, c = self.chunks(texts)
        return 1 / (1 + np.exp(-np.clip(self.pooled(c, start)[1] @ self.p["v"] + self.p["c"][0], -30, 30).astype(np.float64)))

    def gradients(self, texts: list[bytes], y: np.ndarray, weight: np.ndarray) -> dict:
        buf, k, n, start, per, c = self.chunks(texts)
        g, m = self.pooled(c, start)
        p = 1 / (1 + np.exp(-np.clip(m @ self.p["v"] + self.p["c"][0], -30, 30)))
        dz = ((p - y) * weight / len(y)).astype(np.float32)
        grad = {"v": m.T @ dz, "c": np.array([dz.sum()], np.float32)}
        doc = np.repeat(np.arange(len(per)), per)
        # the first chunk of each document that has the maximum
        hit = (g == m[doc]) & (m[doc] > 0)
        rows, filt = np.nonzero(hit)
        _, one = np.unique(doc[rows] * CHUNK_FILTERS + filt, return_index=True)
        rows, filt = rows[one], filt[one]
        dg = dz[doc[rows]] * self.p["v"][filt]
        dense = np.zeros((len(rows), CHUNK_FILTERS), np.float32)
        dense[np.arange(len(rows)), filt] = dg
        grad["W"], grad["b2"] = c[rows].T @ dense, dense.sum(0)
        dc = (dense @ self.p["W"][:FILTERS].T) / n[rows, None]
        at = (k[rows, None] * BLOCK + np.arange(2 * BLOCK)).ravel()
        at = np.minimum(at, len(buf) - WIDTH)
        dh = np.repeat(dc, 2 * BLOCK, axis=0) * (self.byte_filters(buf, at) > 0) * (buf[at] > 0)[:, None]
        dt = np.zeros_like(self.p["table"])
        for j in range(WIDTH):
            byte = buf[at + j]
            for f in range(FILTERS):
                dt[j, :, f] = np.bincount(byte, dh[:, f], 256)
        grad["table"], grad["b1"] = dt, dh.sum(0)
        return grad

    def fit(self, texts: list[bytes], y: np.ndarray, epochs: int = 14, batch: int = 48, rate: float = 0.02, seed: int = 7) -> ByteNet:
        """Adam on the log loss, classes weighted to count alike up to a cap of 3."""
        rng, y = np.random.default_rng(seed), np.asarray(y, np.float32)
        if not len(y) or y.min() == y.max():  # one class only: answer with it; without any label nothing speaks against a text
            self.p["v"][:] = 0
            self.p["c"][:] = 4 if not len(y) or y[0] == 1 else -4
            return self
        share = np.array([np.mean(y == 0), np.mean(y == 1)])
        weight = np.minimum(0.5 / share, 3)[y.astype(int)]
        mean = {k: np.zeros_like(x) for k, x in self.p.items()}
        square = {k: np.zeros_like(x) for k, x in self.p.items()}
        step, total = 0, epochs * -(-len(texts) // batch)
        for _ in range(epochs):
            order = rng.permutation(len(texts))
            for a in range(0, len(order), batch):
                pick = order[a : a + batch]
                grad = self.gradients([texts[i] for i in pick], y[pick], weight[pick])
                step += 1
                now = rate * (1 - 0.9 * step / total)
                for k, d in grad.items():
                    mean[k] = 0.9 * mean[k] + 0.1 * d
                    square[k] = 0.99 * square[k] + 0.01 * d * d
                    self.p[k] -= (now * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
                self.p["W"] *= 1 - 1e-4
                self.p["v"] *= 1 - 1e-3
        return self


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = SAMPLE_PER_CLASS) -> ByteNet:
    """A network fitted on at most `per_class` labelled documents of each class."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label).alias("y"))
    texts, y = [], []
    for value in (0, 1):
        for r in sampled_rows(docs.select("doc_id", "text"), sample_ids(known.where(F.col("y") == value), per_class), SAMPLE_CHARS):
            texts.append((r["text"] or "").encode())
            y.append(value)
    return ByteNet().fit(texts, np.array(y))


def score(docs: DataFrame, net: ByteNet, threshold: float = 0.7) -> DataFrame:
    """`docs` with score (0 to 1) and predicted (1 if score >= threshold); every row and column stays."""
    shared = docs.sparkSession.sparkContext.broadcast(net.p)
    named = [c for c in docs.columns if c not in ("score", "predicted")]
    schema = T.StructType([*docs.select(named).schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches):
        own = ByteNet()
        own.p = shared.value
        for b in batches:
            texts = [(t or "").encode() for t in b.column("text").to_pylist()]
            out, a = np.zeros(len(texts)), 0
            while a < len(texts):  # some MB at a time
                e, size = a, 0
                while e < len(texts) and (e == a or size + len(texts[e]) < 400_000):
                    size += len(texts[e])
                    e += 1
                out[a:e] = own.score(texts[a:e])
                a = e
            kept = [b.column(c) for c in named]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(out), pa.array((out >= threshold).astype(np.int32))], [*named, "score", "predicted"])

    return arrow_map(docs.select(named), run, schema)


def op1_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Contract digest: learned where crc32(doc_id) mod 4 isn't 2, every document scored."""
    net = fit(docs, labels.where(crc_mod("doc_id", 4) != 2))
    found = score(docs.select("doc_id", "text"), net)
    return found.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "score", "predicted")
