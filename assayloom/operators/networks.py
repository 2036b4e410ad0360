"""Networks over tables: graph batches and message passing as joins, and a training loop with early stopping and snapshots."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import new_path, stored
from .checks import CheckError
from .features import EDGE_DIM, NODE_DIM, slots, structure_codes
from .order import running

#: What the sum over a graph's nodes is divided by, so that it stays near 1 for graphs of common size.
SUM_SCALE = 100.0


def graph_batch(df: DataFrame, key: str, smiles: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of all structures laid end to end: (id, graph, x) and (src, dst, e, graph), numbered over the whole batch in order of key.

    Structures that can't be read have no nodes. Keys must differ.
    """
    # vectors are numbers until they are asked for
    g = stored(df.select(F.col(key).alias("graph"), structure_codes(F.col(smiles)).alias("g")), "batch")
    g = stored(running(g.withColumn("n", F.size("g.nodes").cast("long")), [F.col("graph")], F.col("n"), "offset"), "batch")
    nodes = g.select("graph", "offset", F.posexplode("g.nodes").alias("i", "x")).select((F.col("offset") + F.col("i")).alias("id"), "graph", slots(F.col("x"), NODE_DIM).alias("x"))
    ends = F.arrays_zip(F.col("g.edges").alias("ends"), F.col("g.bonds").alias("e"))
    edges = g.select("graph", "offset", F.explode(ends).alias("b")).select((F.col("offset") + F.col("b.ends")[0]).alias("src"), (F.col("offset") + F.col("b.ends")[1]).alias("dst"), slots(F.col("b.e"), EDGE_DIM).alias("e"), "graph")
    return nodes, edges


def _each(f):
    """A column function from arrays of one length to arrays, computed by whole batches as matrices."""

    @F.pandas_udf("array<double>")
    def run(*columns: pd.Series) -> pd.Series:
        if not len(columns[0]):
            return pd.Series([], dtype=object)
        return pd.Series(list(f(*[np.stack(c.to_list()).astype(np.float64) for c in columns])), dtype=object)

    return run


def _sums(df: DataFrame, by: str, vector: str, dim: int, *how) -> DataFrame:
    """(by, out...) with each aggregate of how (name, function) over the vectors, position by position; sums are added up before the shuffle."""
    return df.groupBy(by).agg(*[F.array(*[f(F.col(vector)[k]) for k in range(dim)]).alias(name) for name, f in how])


def _norm(h: np.ndarray, scale, shift) -> np.ndarray:
    m, v = h.mean(axis=1, keepdims=True), h.var(axis=1, keepdims=True)
    return (h - m) / np.sqrt(v + 1e-5) * scale + shift


def message_layer(nodes: DataFrame, edges: DataFrame, layer: dict) -> DataFrame:
    """nodes (id, ..., h) after one round of messages along edges (src, dst, e).

    A node adds up relu(h of the source + e @ edge + edge_b) over its incoming
    edges, which may be any number; what it holds, (1 + eps) times itself and that
    sum, goes through two dense layers, is added to it, and is normalised.
    layer: arrays edge, edge_b, in, in_b, out, out_b, scale, shift and eps.
    """
    w = {k: np.asarray(v, dtype=np.float64) for k, v in layer.items()}
    dim = len(w["edge_b"])
    message = _each(lambda h, e: np.maximum(h + e @ w["edge"] + w["edge_b"], 0))
    sent = edges.join(nodes.select(F.col("id").alias("src"), "h"), "src").select("dst", message("h", "e").alias("m"))
    got = _sums(sent, "dst", "m", dim, ("m", F.sum)).select(F.col("dst").alias("id"), "m")
    update = _each(lambda h, m: _norm(h + np.maximum(((1 + w["eps"]) * h + m) @ w["in"] + w["in_b"], 0) @ w["out"] + w["out_b"], w["scale"], w["shift"]))
    j = nodes.join(got, "id", "left").withColumn("m", F.coalesce("m", F.array_repeat(F.lit(0.0), dim)))
    return stored(j.withColumn("h", update("h", "m")).drop("m"), "batch")


def encode_graphs(nodes: DataFrame, edges: DataFrame, weights: dict) -> DataFrame:
    """(graph, pooled, code) of nodes (id, graph, x) and edges (src, dst, e): the mean, greatest and scaled sum of the nodes' states after all layers, and their projection.

    weights: embed, embed_b, layers (see message_layer), and, for code, read,
    read_b, read_scale and read_shift; without them code is null.
    """
    w, b = np.asarray(weights["embed"], dtype=np.float64), np.asarray(weights["embed_b"], dtype=np.float64)
    h = stored(nodes.select("id", "graph", _each(lambda x: x @ w + b)("x").alias("h")), "batch")
    for layer in weights["layers"]:
        h = message_layer(h, edges, layer)
    p = _sums(h, "graph", "h", len(b), ("a", F.avg), ("m", F.max), ("s", F.sum))
    p = p.select("graph", F.concat("a", "m", F.transform("s", lambda v: v / SUM_SCALE)).alias("pooled"))
    if "read" not in weights:
        return p.withColumn("code", F.lit(None).cast("array<double>"))
    r = {k: np.asarray(weights[k], dtype=np.float64) for k in ("read", "read_b", "read_scale", "read_shift")}
    return p.withColumn("code", _each(lambda v: _norm(v @ r["read"] + r["read_b"], r["read_scale"], r["read_shift"]))("pooled"))


# training


def start_weights(dim: int, hidden: int, seed: int) -> dict[str, np.ndarray]:
    """Of a network with one hidden layer, or of a linear one (hidden 0), which starts at 0."""
    if not hidden:
        return {"w": np.zeros(dim), "b": np.zeros(1)}
    r = np.random.default_rng(seed)
    return {"v": r.normal(0, 1 / np.sqrt(dim), (dim, hidden)), "c": np.zeros(hidden), "w": r.normal(0, 1 / np.sqrt(hidden), hidden), "b": np.zeros(1)}


def _forward(p: dict, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = np.maximum(x @ p["v"] + p["c"], 0) if "v" in p else x
    return h, h @ p["w"] + p["b"][0]


def _loss(z: np.ndarray, y: np.ndarray, weight: float) -> np.ndarray:
    """Cross entropy of logits, positives weighed."""
    return np.where(y == 1, weight, 1.0) * (np.logaddexp(0, z) - z * y)


def _pass(data: DataFrame, p: dict, vector: str, label: str, val: str, weight: float) -> dict:
    """Losses, counts and the fit rows' gradient at weights p, from one row of sums a partition; nothing else reaches the driver."""
    names, sizes = list(p), [v.size for v in p.values()]

    def run(it):
        total = np.zeros(5 + sum(sizes))
        for batch in it:
            if not batch.num_rows:
                continue
            x = np.array(batch.column("x").to_pylist(), dtype=np.float64)
            y, v = batch.column("y").to_numpy(zero_copy_only=False).astype(np.float64), batch.column("v").to_numpy(zero_copy_only=False).astype(bool)
            h, z = _forward(p, x)
            loss = _loss(z, y, weight)
            total[:5] += [loss[~v].sum(), (~v).sum(), loss[v].sum(), v.sum(), ((z[v] > 0) == (y[v] == 1)).sum()]
            d = np.where(v, 0.0, np.where(y == 1, weight, 1.0) * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y))
            g = {"w": h.T @ d, "b": np.array([d.sum()])}
            if "v" in p:
                back = d[:, None] * p["w"] * (h > 0)
                g |= {"v": x.T @ back, "c": back.sum(axis=0)}
            total[5:] += np.concatenate([g[k].ravel() for k in names])
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["s"])

    d = data.select(F.col(vector).cast("array<double>").alias("x"), F.col(label).cast("int").alias("y"), F.col(val).alias("v"))
    parts = d.mapInArrow(run, "s array<double>").select(F.spark_partition_id().alias("p"), "s")
    # in order of partitions, so that reruns agree
    s = np.sum([r["s"] for r in parts.orderBy("p").collect()], axis=0)
    cut = np.split(s[5:], np.cumsum(sizes)[:-1])
    n, m = max(s[1], 1.0), max(s[3], 1.0)
    return {"fit_loss": s[0] / n, "val_loss": s[2] / m, "val_accuracy": s[4] / m, "n_fit": s[1], "n_val": s[3], "gradient": {k: g.reshape(p[k].shape) / n for k, g in zip(names, cut)}}


_STATE = "epoch int, fit_loss double, val_loss double, val_accuracy double, best boolean, state string"


def fit_epochs(data: DataFrame, vector: str, label: str, val: str, epochs: int = 30, hidden: int = 0, rate: float = 0.05, adam: bool = True, patience: int = 5, metric: str = "val_loss", weight: float = 1.0, seed: int = 42, folder: str | None = None) -> tuple[DataFrame, str]:
    """(history, folder) of training on the rows of data (vector, 0 or 1 label) that are not val.

    history: (epoch, fit_loss, val_loss, val_accuracy, best), the losses of the
    weights that an epoch starts with; best tells whether metric strictly improved
    (val_loss and fit_loss fall, val_accuracy grows). Training ends patience epochs
    after the last improvement. Each epoch is a pass over the rows, whose sums
    one step of gradient descent or of Adam uses, and leaves a table in folder
    with weights and the optimizer's state: a run that was stopped goes on from
    the last one, and load_epoch() reads any. Without fit rows of both classes it
    raises.
    """
    if metric not in ("val_loss", "fit_loss", "val_accuracy"):
        raise CheckError(f"unknown metric {metric}")
    spark, folder = data.sparkSession, folder or new_path(data.sparkSession, "training")
    facts = data.where(~F.col(val)).agg(F.countDistinct(label).alias("k"), F.max(F.size(vector)).alias("d"), F.min(F.size(vector)).alias("e")).first()
    if facts["k"] != 2:
        raise CheckError("both classes are needed in the fit rows")
    if facts["d"] != facts["e"]:
        raise CheckError("vectors differ in length")
    p = start_weights(facts["d"], hidden, seed)
    zero = lambda: {k: np.zeros_like(v) for k, v in p.items()}
    m, v, best, last, done = zero(), zero(), None, -1, 0
    sign = -1.0 if metric == "val_accuracy" else 1.0
    rows = {r["epoch"]: r for r in _snapshots(spark, folder).collect()}
    while done in rows:
        r = rows[done]
        if r["best"]:
            best, last = sign * r[metric], done
        state = {k: {n: np.array(x) for n, x in s.items()} for k, s in json.loads(r["state"]).items()}
        p, m, v, done = state["next"], state["m"], state["v"], done + 1
    for epoch in range(done, epochs):
        if last >= 0 and epoch - last > patience:
            break
        was = p
        got = _pass(data, p, vector, label, val, weight)
        better = best is None or sign * got[metric] < best
        if better:
            best, last = sign * got[metric], epoch
        g = got["gradient"]
        if adam:
            m = {k: 0.9 * m[k] + 0.1 * g[k] for k in p}
            v = {k: 0.999 * v[k] + 0.001 * g[k] ** 2 for k in p}
            p = {k: p[k] - rate * (m[k] / (1 - 0.9 ** (epoch + 1))) / (np.sqrt(v[k] / (1 - 0.999 ** (epoch + 1))) + 1e-8) for k in p}
        else:
            p = {k: p[k] - rate * g[k] for k in p}
        state = json.dumps({n: {k: x.tolist() for k, x in s.items()} for n, s in (("weights", was), ("next", p), ("m", m), ("v", v))})
        spark.createDataFrame([(epoch, float(got["fit_loss"]), float(got["val_loss"]), float(got["val_accuracy"]), bool(better), state)], _STATE).coalesce(1).write.mode("overwrite").parquet(f"{folder}/epoch={epoch}/")
    return _snapshots(spark, folder).drop("state"), folder


def _snapshots(spark, folder: str) -> DataFrame:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    done = [str(x.getPath()) for x in files.listStatus(path)] if files.exists(path) else []
    done = [x for x in done if files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{x}/_SUCCESS"))]
    return spark.read.schema(_STATE).parquet(*done) if done else spark.createDataFrame([], _STATE)


def load_epoch(spark, folder: str, epoch: int | None = None) -> dict[str, np.ndarray]:
    """The weights that an epoch of fit_epochs() started with; those of the last improvement without epoch."""
    rows = _snapshots(spark, folder)
    r = (rows.where("best") if epoch is None else rows.where(F.col("epoch") == epoch)).orderBy(F.col("epoch").desc()).first()
    if r is None:
        raise CheckError("no such epoch")
    return {k: np.array(x) for k, x in json.loads(r["state"])["weights"].items()}


def probability(vector: Column, weights: dict[str, np.ndarray]) -> Column:
    """The probability of label 1 that a network gives."""

    @F.pandas_udf("double")
    def run(x: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype="float64")
        return pd.Series(1 / (1 + np.exp(-_forward(weights, np.array(x.to_list(), dtype=np.float64))[1])))

    return run(vector.cast("array<double>"))


def principal_axes(df: DataFrame, vector: str, n: int = 2) -> DataFrame:
    """df with axes, each vector's place on the n principal axes of all: a linear layout, which keeps distances as far as n axes can.

    Only the vectors' covariance, a matrix of their length squared, reaches the
    driver. An axis points to where its greatest weight is positive.
    """
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    d = df.withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))
    axes = np.asarray(PCA(k=n, inputCol="_v", outputCol="_o").fit(d).pc.toArray())
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(n)])
    dot = lambda k: F.aggregate(F.zip_with(F.col(vector).cast("array<double>"), F.array(*[F.lit(float(x)) for x in axes[:, k]]), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return df.withColumn("axes", F.array(*[dot(k) for k in range(n)]))
