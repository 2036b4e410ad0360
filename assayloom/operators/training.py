"""Datasets from features and labels, models by name, and cross-validation on Spark's own learners."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .aggregates import scaler, scaler_arrays
from .checks import CheckError, require
from .features import encode, vocabulary
from .joins import lookup_columns
from .order import numbered
from ..functions import vectors as V
from ..sources.scratch import stored


def with_labels(rows: DataFrame, included: list[str], column: str = "label") -> DataFrame:
    """Rows whose label is one of a list; an empty list gives none."""
    return rows.where(F.col(column).isin(*included)) if included else rows.limit(0)


def attach_split(rows: DataFrame, train: DataFrame, test: DataFrame, key: str) -> DataFrame:
    """rows with split, train or test; a key in both or in neither raises when it is read."""
    both = train.select(key).distinct().withColumn("_a", F.lit(True)).join(test.select(key).distinct().withColumn("_b", F.lit(True)), key, "full_outer")
    j = rows.join(both, key, "left")
    say = lambda text: F.raise_error(F.concat(F.lit(text), F.col(key).cast("string"))).cast("string")
    split = F.when(F.col("_a") & F.col("_b"), say("in train and test: ")).when(F.col("_a"), "train").when(F.col("_b"), "test").otherwise(say("in no split: "))
    return j.withColumn("split", split).drop("_a", "_b")


def attach_folds(rows: DataFrame, splits: DataFrame, key: str) -> DataFrame:
    """Train rows with fold_id from (key, split, fold_id); test rows go, a row without a split or a train row without a fold raises when it is read."""
    j = lookup_columns(rows, splits.select(key, "split", "fold_id"), [key]).where("split <> 'test'")
    fold = F.when(F.col("fold_id").isNull(), F.raise_error(F.concat(F.lit("no fold: "), F.col(key).cast("string"))).cast("int")).otherwise(F.col("fold_id"))
    return j.withColumn("fold_id", fold).drop("split")


def indexed_rows(features: DataFrame, key: str, names: list[str], vector: str = "features") -> DataFrame:
    """(key, vector): named columns as one array of doubles in that order; a repeated key or a missing column raises."""
    if lost := [n for n in names if n not in features.columns]:
        raise CheckError(f"columns missing: {', '.join(lost)}")
    return features.groupBy(key).agg(F.when(F.count("*") > 1, F.raise_error(F.concat(F.lit("repeated key "), F.col(key).cast("string"))).cast("array<double>")).otherwise(F.first(F.array(*[F.col(n).cast("double") for n in names]))).alias(vector))


def feature_rows(df: DataFrame, key: str, features: str, most: int = 10) -> DataFrame:
    """df if every row has features; else raises with up to most of the keys that have none."""
    bad = [str(r[0]) for r in df.where(F.col(features).isNull()).select(key).orderBy(key).limit(most).collect()]
    if bad:
        raise CheckError(f"no features for {', '.join(bad)}")
    return df


def assemble(rows: DataFrame, features: DataFrame, key: str, organism: str, label: str, positive: str, fit: Column, vector: str = "features") -> tuple[DataFrame, dict]:
    """(dataset, facts): rows with standardised features, the organism's number and the label as 0 or 1.

    rows (key, organism, label); features (key, vector). The scaler and the
    vocabulary come from the rows that meet fit alone; organisms outside it get
    number 0. A row without features raises when it is read. facts is the one
    description of dimensions, scaler and vocabulary that models are built from.
    """
    fitted = rows.where(fit)
    if fitted.isEmpty():
        raise CheckError("no rows to fit on")
    per_fit_row = fitted.select(key).distinct().join(features, key)
    table = scaler(per_fit_row, vector)
    vocab = vocabulary(fitted, organism)
    stats = scaler_arrays(table)
    j = lookup_columns(rows, features.select(key, vector), [key])
    j = j.crossJoin(F.broadcast(stats)).withColumn(vector, V.standardized(F.col(vector), F.col("mean"), F.col("scale"))).drop("mean", "scale")
    data = encode(j, vocab, organism).withColumnRenamed("index", "organism_index").withColumn("label_int", (F.col(label) == positive).cast("int"))
    s = stats.first()
    facts = {"peptide_dim": len(s["mean"]), "organism_dim": vocab.count() + 1, "peptide_kind": "vector", "organism_kind": "index", "scaler": {"mean": list(s["mean"]), "scale": list(s["scale"])}, "unknown_index": 0}
    return data, facts


def descriptor(facts: dict, spark) -> DataFrame:
    """The facts as a table of one row, scaler as arrays."""
    row = {"peptide_dim": facts["peptide_dim"], "organism_dim": facts["organism_dim"], "peptide_kind": facts["peptide_kind"], "organism_kind": facts["organism_kind"], "mean": facts["scaler"]["mean"], "scale": facts["scaler"]["scale"]}
    return spark.createDataFrame([row], "peptide_dim int, organism_dim int, peptide_kind string, organism_kind string, mean array<double>, scale array<double>")


def from_artifacts(rows: DataFrame, features: DataFrame, key: str, artifact: str, vector: str = "features", **overrides) -> DataFrame:
    """rows with features standardised by a stored facts document; overrides of what it holds are refused."""
    if overrides:
        raise CheckError(f"fixed by the artifact: {', '.join(sorted(overrides))}")
    facts = json.loads(artifact)
    mean, scale = (F.array(*map(F.lit, facts["scaler"][k])) for k in ("mean", "scale"))
    return lookup_columns(rows, features.select(key, vector), [key]).withColumn(vector, V.standardized(F.col(vector), mean, scale))


def tracked_config(typed: dict, facts: dict) -> dict:
    """A run's configuration as it is logged: what the features really are goes before what somebody typed."""
    return {**typed, **{k: v for k, v in facts.items() if k not in ("scaler",)}}


MODELS: dict = {}


def model(name: str):
    """Registers a builder of pyspark.ml estimators under a name."""

    def add(f):
        if name in MODELS:
            raise ValueError(f"{name} is registered already")
        MODELS[name] = f
        return f

    return add


@model("logistic")
def _logistic(dim: int, **options):
    from pyspark.ml.classification import LogisticRegression

    return LogisticRegression(featuresCol="x", labelCol="label_int", weightCol="weight", probabilityCol="p", **options)


@model("mlp")
def _mlp(dim: int, hidden: int = 16, seed: int = 42, **options):
    from pyspark.ml.classification import MultilayerPerceptronClassifier

    return MultilayerPerceptronClassifier(featuresCol="x", labelCol="label_int", probabilityCol="p", layers=[dim, hidden, 2], seed=seed, **options)


def build_model(name: str, dim: int, **options):
    """A registered model's estimator; an unknown name raises with those that are known."""
    if name not in MODELS:
        raise ValueError(f"unknown model {name!r}; known: {', '.join(sorted(MODELS))}")
    return MODELS[name](dim, **options)


def _inputs(df: DataFrame, vector: str, weight: float, organisms=None) -> DataFrame:
    """df with x, the vector and behind it the organism's place among those of the fitted encoder, and weight."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import array_to_vector

    weight = F.when(F.col("label_int") == 1, F.lit(weight)).otherwise(1.0)
    d = df.withColumn("_v", array_to_vector(vector)).withColumn("weight", weight)
    if organisms is None:
        return d.withColumnRenamed("_v", "x")
    return VectorAssembler(inputCols=["_v", "_o"], outputCol="x").transform(organisms.transform(d))


def train_fold(data: DataFrame, fold: int, name: str = "logistic", vector: str = "features", organism: str | None = None, **options) -> DataFrame:
    """data with val_fold_id, eval_group and probability from a model fitted on the other folds, positives weighed by negatives over positives.

    organism: a column of the organism's number, as assemble() gives it, which the
    model gets one-hot beside the vector; numbers that no fit row has add nothing.
    """
    from pyspark.ml.feature import OneHotEncoder
    from pyspark.ml.functions import vector_to_array

    fit = data.where(F.col("fold_id") != fold)
    c = fit.agg(F.count_if(F.col("label_int") == 1).alias("p"), F.count_if(F.col("label_int") == 0).alias("n"), F.max(F.size(vector)).alias("d")).first()
    if not c["p"] or not c["n"]:
        raise CheckError("both classes are needed in the other folds")
    organisms = OneHotEncoder(inputCol=organism, outputCol="_o", dropLast=False, handleInvalid="keep").fit(fit) if organism else None
    # one place more than numbers, for those of other rows
    dim = c["d"] + (organisms.categorySizes[0] + 1 if organisms else 0)
    fitted = build_model(name, dim, **options).fit(_inputs(fit, vector, c["n"] / c["p"], organisms))
    out = fitted.transform(_inputs(data, vector, 1.0, organisms)).withColumn("probability", vector_to_array("p")[1])
    return out.select(*data.columns, F.lit(fold).alias("val_fold_id"), F.when(F.col("fold_id") == fold, "val").otherwise("fit").alias("eval_group"), "probability")


def cross_validate(data: DataFrame, folds: int, **how) -> DataFrame:
    """train_fold() of every fold, one after the other; their rows under each other. data is stored once for all of them."""
    data, out = stored(data, "folds"), None
    for k in range(folds):
        one = train_fold(data, k, **how)
        out = one if out is None else out.unionByName(one)
    return out


def fit_gap(history: DataFrame, keys: list[str], group: str, value: str) -> DataFrame:
    """(keys, gap): the fit group's value less the val group's."""
    side = lambda g: F.max(F.when(F.col(group) == g, F.col(value)))
    return history.groupBy(*keys).agg((side("fit") - side("val")).alias("gap"))


def best_runs(df: DataFrame, run: str, metrics: list[str], smaller: tuple[str, ...] = ()) -> DataFrame:
    """(metric, run, value): the best run of each metric, the first name on ties."""
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), F.lit(-1.0 if m in smaller else 1.0).alias("sign")) for m in metrics])
    long = df.select(F.col(run).alias("run"), F.explode(pairs).alias("x")).select("run", "x.*").where("value is not null")
    return long.groupBy("metric").agg(F.min_by(F.struct("run", "value"), F.struct(-F.col("value") * F.col("sign"), F.col("run"))).alias("b")).select("metric", "b.*")


def snapshot_slices(df: DataFrame, at: str, slices: list[str], value: str) -> DataFrame:
    """(at, slice, member, n, mean): one grouping a slice column and one over all rows, in one pass."""
    sets = [[at]] + [[at, s] for s in slices]
    g = df.groupingSets(sets, at, *slices).agg(*[F.grouping(s).alias(f"_{s}") for s in slices], F.count("*").alias("n"), F.avg(value).alias("mean"))
    name, member = F.lit("all"), F.lit(None).cast("string")
    for s in slices:
        name, member = F.when(F.col(f"_{s}") == 0, s).otherwise(name), F.when(F.col(f"_{s}") == 0, F.col(s).cast("string")).otherwise(member)
    return g.select(at, name.alias("slice"), member.alias("member"), "n", "mean")


def random_mask(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """df with chosen: exactly n of its distinct keys, the first ones in the order of a seeded hash.

    The n-th hash is found by a top-n, so no task orders all keys.
    """
    h = F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")))
    first = df.select(key).distinct().orderBy(h, key).limit(n).withColumn("_c", F.lit(True))
    return df.join(first, key, "left").withColumn("chosen", F.coalesce("_c", F.lit(False))).drop("_c")


def shuffled(df: DataFrame, key: str, seed: int) -> DataFrame:
    """df in the order of a seeded hash of its key: the same on every run and cluster."""
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string"))), key)


def length_batches(df: DataFrame, text: str, key: str, size: int) -> DataFrame:
    """df with batch: rows of like length together, about size rows each, so that padding is short.

    Rows are numbered in the order of (length, key) by ranges, so that rows of one
    length, or without a text, are no single task.
    """
    d = df.withColumn("_n", F.coalesce(F.length(text), F.lit(0)))
    return numbered(d, [F.col("_n"), F.col(key)], "_at").withColumn("batch", F.floor(F.col("_at") / size)).drop("_n", "_at")


def kmeans_sweep(df: DataFrame, vector: str, ks: list[int], seed: int = 42, sample: float | None = None) -> tuple[DataFrame, list[dict]]:
    """(df with cluster, scores): k-means for each k, the one with the greatest silhouette (the smallest k on ties); sample: the share of rows that the silhouette is taken over."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector

    data = df.withColumn("_x", array_to_vector(F.transform(vector, lambda v: v.cast("double"))))
    scores, best = [], None
    for k in ks:
        m = KMeans(k=k, seed=seed, featuresCol="_x", predictionCol="cluster").fit(data)
        out = m.transform(data)
        part = out.where(F.pmod(F.xxhash64(*[c for c in df.columns if c != vector]), F.lit(1000)) < int(sample * 1000)) if sample else out
        s = ClusteringEvaluator(featuresCol="_x", predictionCol="cluster").evaluate(part)
        scores.append({"k": k, "silhouette": s})
        if best is None or s > best[0]:
            best = (s, out)
    return best[1].drop("_x"), scores


def agreement(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: keys only in a, only in b and in both; two artifacts agree if the first two are 0."""
    j = a.select(key).distinct().withColumn("_a", F.lit(1)).join(b.select(key).distinct().withColumn("_b", F.lit(1)), key, "full_outer")
    return j.agg(F.count_if(F.col("_b").isNull()).alias("only_a"), F.count_if(F.col("_a").isNull()).alias("only_b"), F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("both"))


def require_agreement(a: DataFrame, b: DataFrame, key: str, name: str) -> None:
    require(agreement(a, b, key), (F.col("only_a") == 0) & (F.col("only_b") == 0), name)
