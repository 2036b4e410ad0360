"""Quality classifier: a byte-level convolutional network trained in numpy.

Every byte of a text is embedded; learned filters of K bytes slide over
overlapping chunks that cover the whole text (each chunk has CHUNK filter
positions, so neighbours share K - 1 bytes), each filter's activations are
max-pooled per chunk, and the mean and the maximum of a document's chunks go
through one logistic unit. A second input plane marks bytes whose 8-byte gram
also stands a few bytes before, so that filters see local repetition.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import append, materialize

CHUNK, K, DIM, FILTERS = 512, 6, 4, 16
_PLANES = DIM + 1
_LAGS = range(2, 25)


def _bytes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All texts' bytes with K zeros after each, the repetition plane, and starts and numbers of filter positions."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    pad = b"\0" * max(K, 8)
    b = np.frombuffer(pad.join(raw) + pad, np.uint8)
    n = np.array([len(r) for r in raw], dtype=np.int64)
    at = np.concatenate([[0], np.cumsum(n + len(pad))[:-1]])
    gram = np.zeros(len(b), np.uint64)
    for j in range(8):
        gram[: len(b) - 8] |= b[j : len(b) - 8 + j].astype(np.uint64) << np.uint64(8 * j)
    # bytes before each gram in its own text, 0 for one that goes over the text's end
    own = np.arange(len(b), dtype=np.int32) - np.repeat(at.astype(np.int32), n + len(pad))
    own[own > np.repeat((n - 8).astype(np.int32), n + len(pad))] = 0
    own = np.minimum(own, 255).astype(np.uint8)
    rep = np.zeros(len(b), bool)
    for lag in _LAGS:
        rep[lag:] |= (gram[lag:] == gram[:-lag]) & (own[lag:] >= lag)
    return b, rep, at, np.maximum(1, n - K + 1)


class Net:
    """Parameters: emb 256 x DIM, conv (K * planes) x FILTERS with bias, out 2 * FILTERS with bias."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.p = {
            "emb": r.normal(0, 0.5, (256, DIM)).astype(np.float32),
            "conv": r.normal(0, (2 / (K * _PLANES)) ** 0.5, (K * _PLANES, FILTERS)).astype(np.float32),
            "bias": np.zeros(FILTERS, np.float32),
            "out": np.zeros(2 * FILTERS, np.float32),
            "off": np.full(1, 1.0, np.float32),
        }

    def forward(self, texts: list[str | None], keep: bool = False):
        b, rep, at, n = _bytes(texts)
        x = np.empty((len(b), _PLANES), np.float32)
        x[:, :DIM] = self.p["emb"][b]
        x[:, DIM] = rep
        win = np.lib.stride_tricks.as_strided(x, (len(b) - K + 1, K * _PLANES), x.strides)
        first = np.concatenate([np.arange(a, a + c, CHUNK) for a, c in zip(at, n)])
        stop = np.minimum(first + CHUNK, np.repeat(at + n, -(-n // CHUNK)))
        top = np.empty((len(first), FILTERS), np.float32)
        arg = np.empty((len(first), FILTERS), np.int64) if keep else None
        step = 64  # chunks at a time, which bounds memory
        for i in range(0, len(first), step):
            a, z = first[i], stop[min(i + step, len(first)) - 1]
            act = np.ascontiguousarray(win[a:z]) @ self.p["conv"]
            if keep:
                for j in range(i, min(i + step, len(first))):
                    part = act[first[j] - a : stop[j] - a]
                    arg[j] = part.argmax(axis=0) + first[j]
                    top[j] = part.max(axis=0)
            else:
                edges = np.stack([first[i : i + step], stop[i : i + step]], axis=1).ravel() - a
                top[i : i + step] = np.maximum.reduceat(np.concatenate([act, act[-1:]]), edges, axis=0)[::2]
        pooled = np.maximum(top + self.p["bias"], 0)
        doc = np.concatenate([[0], np.cumsum(-(-n // CHUNK))])
        mean = np.add.reduceat(pooled, doc[:-1], axis=0) / np.diff(doc)[:, None]
        peak = np.maximum.reduceat(pooled, doc[:-1], axis=0)
        f = np.concatenate([mean, peak], axis=1)
        z = f.astype(np.float64) @ self.p["out"].astype(np.float64) + float(self.p["off"][0])
        score = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        return (score, (b, win, arg, pooled, doc, f)) if keep else score

    def gradient(self, texts: list[str], y: np.ndarray) -> tuple[dict[str, np.ndarray], float]:
        score, (b, win, arg, pooled, doc, f) = self.forward(texts, keep=True)
        dz = ((score - y) / len(y)).astype(np.float32)
        g = {"out": dz @ f, "off": dz.sum(keepdims=True)}
        of = np.repeat(np.arange(len(y)), np.diff(doc))
        w = self.p["out"]
        dp = dz[of, None] * w[:FILTERS] / np.diff(doc)[of, None]
        peak = f[:, FILTERS:]
        is_peak = pooled == peak[of]
        dp += is_peak * dz[of, None] * w[FILTERS:] / np.maximum(1, np.add.reduceat(is_peak, doc[:-1], axis=0))[of]
        dp = (dp * (pooled > 0)).astype(np.float32)
        g["bias"] = dp.sum(axis=0)
        g["conv"], g["emb"] = np.zeros_like(self.p["conv"]), np.zeros_like(self.p["emb"])
        for k in range(FILTERS):
            at = arg[:, k]
            g["conv"][:, k] = dp[:, k] @ win[at]
            dx = dp[:, k, None, None] * self.p["conv"][:, k].reshape(K, _PLANES)[None, :, :DIM]
            np.add.at(g["emb"], b[at[:, None] + np.arange(K)], dx)
        loss = -np.mean(np.where(y > 0, np.log(score + 1e-9), np.log(1 - score + 1e-9)))
        return g, float(loss)


def train(texts: list[str], y: np.ndarray, steps: int = 360, batch: int = 32, rate: float = 0.01, decay: float = 1e-4, seed: int = 7) -> Net:
    """Adam on the logistic loss; the same rows in the same order give the same network."""
    net, r = Net(seed), np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(x) for k, x in net.p.items()}
    t = 0
    while t < steps:
        order = r.permutation(len(y))
        for a in range(0, len(y), batch):
            if t == steps:
                break
            i, lr = order[a : a + batch], rate * (1 - t / steps)
            g, _ = net.gradient([texts[j] for j in i], y[i])
            t += 1
            for k in net.p:
                grad = g[k] + decay * net.p[k]
                m[k] = 0.9 * m[k] + 0.1 * grad
                v[k] = 0.999 * v[k] + 0.001 * grad * grad
                net.p[k] -= (lr * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return net


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = 1000, most_bytes: int = 64 << 20, **how) -> Net:
    """Train on at most sample labelled rows of each class, picked by a hash of doc_id; held-out rows never.

    sample and most_bytes bound what the driver holds: the picked texts, the
    shortest first, are taken whole as long as they are most_bytes together (a
    text alone longer than that takes no part). Labels other than 0 and 1 and
    null doc_ids take no part, nor does a doc_id with both labels; a doc_id that
    stands several times in docs gives its least text only. Null texts are empty ones. One class or none gives an untrained
    network that scores all texts alike, as their share of label 1. Other columns
    take no part.
    """
    rows = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).where(~held_out(F.col("doc_id")))
    rows = rows.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"), F.max("quality").alias("_q")).where("quality = _q").drop("_q")
    pick = None
    for q in (0, 1):
        part = rows.where(F.col("quality") == q).orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(sample)
        pick = part if pick is None else pick.union(part)
    # at most 2 * sample narrow rows
    got = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(pick), "doc_id").withColumn("text", F.coalesce("text", F.lit("")))
    # one text an id, so that the window below has at most 2 * sample rows
    got = materialize(got.groupBy("doc_id", "quality").agg(F.min("text").alias("text")).withColumn("_n", F.octet_length("text")))
    held = F.sum("_n").over(Window.orderBy("_n", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    few = got.select("doc_id", held.alias("_held")).where(F.col("_held") <= most_bytes).select("doc_id")
    got = got.join(F.broadcast(few), "doc_id", "left_semi").select("doc_id", "quality", "text").toPandas().sort_values("doc_id", kind="stable")
    texts, y = got["text"].tolist(), got["quality"].to_numpy().astype(np.float64)
    if len(set(y.tolist())) < 2:
        net = Net()
        p = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.5
        net.p["off"][:] = np.log(p / (1 - p))
        return net
    return train(texts, y, **how)


def score(docs: DataFrame, net: Net, threshold: float = 0.3) -> DataFrame:
    """docs (doc_id, text, ...) with held_out, score and predicted.

    Null texts are scored as empty ones, texts of any length whole. Rows are
    scored one by one: equal texts have equal scores, repeated rows stay; a null
    doc_id is not held out. Columns with the new names are replaced, all others
    stay. An empty table gives no rows.
    """
    params = net.p

    def make(texts):
        net = Net()
        net.p = params
        return [pa.array(net.forward(texts))]

    out = append(docs, make, [("score", "double")])
    return out.withColumns({"held_out": held_out(F.col("doc_id")), "predicted": (F.col("score") >= threshold).cast("int")})
