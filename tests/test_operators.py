"""Joins, aggregates, splits, graphs, metrics, sources and streams on literal fixtures."""

import itertools
import json
import random
import zipfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from assayloom.functions import registry
from assayloom.operators import aggregates, checks, features, graph, joins, metrics, similarity, splits, taxa, tokenizers, training
from assayloom.plans import catalogue, config
from assayloom.sources import readers
from assayloom.streaming import incremental

INF = float("inf")


def as_set(df):
    return {tuple(r) for r in df.collect()}


def test_robust_mean(spark):
    rows = [("a", 4.0, 4.0), ("b", 0.0, 8.0), ("b", 4.0, INF), ("c", 0.0, INF), *[("d", x, x) for x in (10.0, 11.0, 12.0, 500.0)], ("e", None, None), ("f", 1.0, 9.0)]
    got = {r["k"]: r for r in aggregates.robust_mean(spark.createDataFrame(rows, "k string, low double, high double"), ["k"]).collect()}
    assert set(got) == {"a", "b", "d", "f"}
    assert (got["a"]["mean"], got["a"]["n_points"], got["b"]["mean"], got["f"]["mean"]) == (4.0, 2, 6.0, 5.0)
    p = np.repeat([10.0, 11.0, 12.0, 500.0], 2)
    q1, q3 = np.percentile(p, [25, 75])
    kept = p[(p >= q1 - 1.5 * (q3 - q1)) & (p <= q3 + 1.5 * (q3 - q1))]
    assert got["d"]["mean"] == pytest.approx(kept.mean()) and got["d"]["n_used"] == len(kept) and got["d"]["n_rows"] == 4


def test_lookups(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    b = spark.createDataFrame([(1, 10), (2, 20)], "k int, w int")
    assert as_set(joins.lookup(a, b, ["k"], "t")) == {(1, "x", 10), (2, "y", 20)} == as_set(joins.lookup_columns(a, b, ["k"]))
    with pytest.raises(Exception, match="t: a row has no match"):
        joins.lookup(a, b.where("k = 1"), ["k"], "t").collect()
    with pytest.raises(Exception, match="t: a key stands more than once"):
        joins.lookup(a, b.union(b), ["k"], "t").collect()
    with pytest.raises(Exception, match="no match"):
        joins.lookup_columns(a, b.where("k = 1"), ["k"]).collect()
    table = spark.createDataFrame([("A b", "species", 32.0), ("A", "genus", 64.0), ("C", "genus", None)], "match_key string, level string, v double")
    o = spark.createDataFrame([("A b",), ("A c",), ("C d",)], "o string")
    got = joins.by_level(o, table, F.col("o"), F.substring_index("o", " ", 1), ["v"], {"v": F.lit(0.0)})
    assert as_set(got) == {("A b", 32.0, "species"), ("A c", 64.0, "genus"), ("C d", 0.0, "none")}
    found = spark.createDataFrame([(1, 0.5), (2, 1.0), (2, 2.0)], "k int, lo double")
    got = joins.matches(spark.createDataFrame([(1,), (2,), (3,)], "k int"), found, ["k"], ["lo"], {"lo": F.lit(0.0)})
    assert as_set(got) == {(1, "matched", 0.5), (2, "many_matches", 0.0), (3, "zero_matches", 0.0)}
    assert as_set(joins.single_source(a, found, ["k"])) == {(1, "x", 0.5)}


def test_set_joins(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(2,), (3,), (3,)], "k int")
    assert as_set(joins.three_way(a, b, "k")) == {(1, "left_only"), (2, "both"), (3, "right_only")}
    kept, counts = spark.createDataFrame([(1, "x"), (2, None)], "k int, v string"), spark.createDataFrame([(2, 5), (3, 6)], "k int, n long")
    assert as_set(joins.refresh(kept, counts, ["k"], ["v"])) == {(1, "x", 0, "stale"), (2, None, 5, "kept"), (3, None, 6, "new")}
    assert as_set(joins.add_missing(kept, b.distinct(), ["k"])) == {(1, "x"), (2, None), (3, None)}
    assert as_set(joins.moved_to(spark.createDataFrame([(1, "train"), (2, "train")], "k int, s string"), a.where("k = 2"), "k", "s", "test")) == {(1, "train"), (2, "test")}
    d = spark.createDataFrame([(1, 5, "b"), (1, 3, "a"), (2, 1, None)], "k int, o int, v string")
    assert as_set(joins.first_rows(d, ["k"], [F.col("o")])) == {(1, 3, "a"), (2, 1, None)}


def test_aggregates(spark):
    d = spark.createDataFrame([("a", "x", 1, 0.5), ("a", "y", 2, 0.9), ("a", "x", 3, 0.9), ("b", "y", 1, 0.1)], "k string, c string, e int, v double")
    assert as_set(aggregates.majority(d, ["k"], "c")) == {("a", "x", 2, 2 / 3), ("b", "y", 1, 1.0)}
    assert as_set(aggregates.best_at(d, ["k"], "e", "v")) == {("a", 2, 0.9, 0.9), ("b", 1, 0.1, 0.1)}
    assert as_set(aggregates.best_at(d, ["k"], "e", "v", largest=False)) == {("a", 1, 0.5, 0.9), ("b", 1, 0.1, 0.1)}
    assert {(r["k"], r["n"], r["conflict"]) for r in aggregates.distinct_or_conflict(d, "k", ["c"], {"n": F.count("*")}).collect()} == {("a", 3, True), ("b", 1, False)}
    assert [tuple(r) for r in aggregates.top_counts(d, "c", 2).collect()] == [("x", 2), ("y", 2)]
    assert as_set(aggregates.every_nth(d.select("e").distinct(), "e", 2)) == {(2,), (3,)}
    assert aggregates.size_summary(d, "k").first().asDict() == {"n_clusters": 2, "least": 1, "median": 2.0, "greatest": 3, "mean": 2.0, "imbalanced": True}
    s = aggregates.scaler_arrays(aggregates.scaler(spark.createDataFrame([([1.0, 5.0],), ([3.0, 5.0],)], "v array<double>"), "v")).first()
    assert (s["mean"], s["scale"]) == ([2.0, 5.0], [1.0, 1.0])


def test_checks(spark):
    d = spark.createDataFrame([(1, 2.0), (1, -1.0), (2, INF), (3, None)], "k int, v double")
    assert tuple(checks.key_summary(d, ["k"], ["v"]).first()) == (4, 3, 1, 1, 1, 1)
    with pytest.raises(checks.CheckError, match="2 rows"):
        checks.require(d, F.col("v") > 0, "positive")
    with pytest.raises(checks.CheckError, match="missing"):
        checks.require_columns(d, ["k", "zz"])
    out = checks.run_sections({"fine": lambda s: s.lines.append("ok"), "odd": lambda s: s.flag("look"), "broken": lambda s: 1 / 0})
    assert [s.status for s in out] == ["PASS", "FLAGGED", "FAIL"] and checks.overall(out) == "FAIL" and "ZeroDivisionError" in checks.report(out)
    assert checks.overall(out[:2]) == "FLAGGED" and checks.markdown_table([]) == "(none)"


def by_class(sets: dict, alike) -> set:
    """Pairs as set joins give them: the first keys of different sets that are alike, and each copy with the first key of its set."""
    first = {}
    for k in sorted(sets):
        first.setdefault(sets[k], k)
    pairs = {(min(i, j), max(i, j)) for (a, i), (b, j) in itertools.combinations(first.items(), 2) if alike(a, b)}
    return pairs | {(first[s], k) for k, s in sets.items() if first[s] != k}


def test_similarity(spark):
    r = np.random.default_rng(0)
    rows = [(i, r.normal(size=6).tolist(), i % 2) for i in range(20)]
    d = spark.createDataFrame(rows, "k int, v array<double>, b int")
    cos = lambda a, b: float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b))
    want = {(i, j) for i, a, x in rows for j, b, y in rows if i < j and x == y and cos(a, b) >= 0.3}
    assert {(x["i"], x["j"]) for x in similarity.cosine_pairs(d, "k", "v", "b", 0.3).collect()} == want
    sets = [(i, [int(x) for x in r.integers(0, 12, 6)]) for i in range(40)] + [(99, [])]
    jac = lambda a, b: len(a & b) / len(a | b)
    for t in (0.3, 0.5, 1.0):
        want = by_class({i: frozenset(a) for i, a in sets if a}, lambda a, b: jac(a, b) >= t)
        assert {(x["i"], x["j"]) for x in similarity.set_pairs(spark.createDataFrame(sets, "k int, s array<int>"), "k", "s", t).collect()} == want
    links = spark.createDataFrame([(0, "AAAA", "s"), (1, "AAAA", None), (2, "AXAA", "q"), (3, None, "q"), (4, "KK", "s")], "k int, a string, b string")
    assert as_set(similarity.first_links(links, "k", ["a", "b"])) == {(0, 1), (0, 4), (2, 3)}


def test_alignment(spark):
    assert similarity.align_identity("ACDE", "ACDE") == 1.0 and similarity.align_identity("", "A") == 0.0
    assert similarity.align_identity("ACDEFG", "ACDXFG") == pytest.approx(5 / 6)
    d = spark.createDataFrame([(0, "ACDEFGH"), (1, "acdefgh"), (2, "ACDEFGX"), (3, "WWWWWWW")], "k int, s string")
    assert {(x["i"], x["j"]) for x in similarity.identity_pairs(d, "k", "s", 0.6).collect()} == {(0, 1)}


def test_graph(spark):
    nodes = spark.createDataFrame([(i,) for i in range(9)], "node int")
    edges = spark.createDataFrame([(0, 1, 0.9), (1, 2, 0.8), (4, 3, 0.7), (5, 5, 1.0), (6, 7, 0.5)], "src int, dst int, weight double")
    comp = graph.components(nodes, edges)
    assert as_set(comp) == {(0, 0), (1, 0), (2, 0), (3, 3), (4, 3), (5, 5), (6, 6), (7, 6), (8, 8)}
    more = edges.union(spark.createDataFrame([(2, 3, 0.1), (1, 4, 0.3)], edges.schema))
    assert as_set(graph.contract(more, comp)) == {(0, 3, 0.3)}
    assert dict(as_set(graph.leader_clusters(nodes, edges)))[1] == 1 == dict(as_set(graph.leader_clusters(nodes, edges)))[0]
    c = dict(as_set(graph.communities(nodes, edges)))
    assert c[0] == c[1] == c[2] and c[3] == c[4] and c[8] == 8 and len({c[0], c[3], c[5], c[6], c[8]}) == 5
    assert as_set(graph.with_singletons(nodes.where("node < 4"), nodes.where("node in (0, 2)").withColumn("community", F.lit(5).cast("long")))) == {(0, 5), (2, 5), (1, 6), (3, 7)}
    d = spark.createDataFrame([(1, "a", "x"), (2, "a", "x"), (3, "b", "y"), (4, None, "y")], "k int, a string, b string")
    assert graph.adjusted_rand(d, "a", "b").first()["ari"] == 1.0


def test_splits(spark):
    r = random.Random(4)
    size = {i: r.choice([1, 2, 3, 30]) for i in range(150)}
    special, active = {i: r.randint(0, n) for i, n in size.items()}, {i: r.randint(0, n) for i, n in size.items()}
    targets = {"test": 0.2} | {f"fold_{i}": 0.16 for i in range(5)}
    plan = splits.assign_buckets(size, special, active, targets, 30, 30, 20_000)
    assert plan == splits.assign_buckets(size, special, active, targets, 30, 30, 20_000) and set(plan.bucket_of) == set(size)
    got = {b: sum(n for c, n in size.items() if plan.bucket_of[c] == b) / sum(size.values()) for b in targets}
    assert all(abs(got[b] - t) < 0.02 for b, t in targets.items())
    assert plan.objective < splits.assign_buckets(size, special, active, targets, 30, 30, 0).objective
    for bad in ({"test": 0.5}, {"test": 1.2, "x": -0.2}):
        with pytest.raises(splits.SplitError):
            splits.assign_buckets(size, special, active, bad)
    rows = [(c, k, k < special[c], k < active[c]) for c, n in size.items() for k in range(n)]
    d = splits.stratified_split(spark.createDataFrame(rows, "c int, k int, s boolean, a boolean"), "c", "s", "a", tries=5000)
    assert checks.leakage(d, ["c"], "bucket").first()["leaking"] == 0 and d.where("(split = 'test') <> (fold_id is null)").count() == 0
    g = spark.createDataFrame([(i, n) for i, n in enumerate([5, 1, 4, 10])], "k int, n int")
    assert [x["chosen"] for x in splits.greedy_prefix(g, ["k"], "n", 0.4).orderBy("k").collect()] == [True, True, True, False]
    assert [x["bin"] for x in splits.cumulative_bins(g, ["k"], "n", 2).orderBy("k").collect()] == [0, 0, 0, 1]


def test_metrics(spark):
    r = random.Random(2)
    rows = [("a", r.choice([0.1, 0.3, 0.5, 0.7, 0.9]), r.randint(0, 1)) for _ in range(60)] + [("b", 0.4, 1)]
    got = {x["g"]: x for x in metrics.binary_metrics(spark.createDataFrame(rows, "g string, s double, y int"), ["g"], "s", "y").collect()}
    own = [(s, y) for g, s, y in rows if g == "a"]
    pos, neg = [s for s, y in own if y], [s for s, y in own if not y]
    assert got["a"]["auroc"] == pytest.approx(sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg))
    tp, fp = sum(s >= 0.5 for s in pos), sum(s >= 0.5 for s in neg)
    assert got["a"]["precision"] == pytest.approx(tp / (tp + fp)) and got["a"]["recall"] == pytest.approx(tp / len(pos)) and got["a"]["accuracy"] == pytest.approx((tp + len(neg) - fp) / len(own))
    assert (got["b"]["status"], got["b"]["auroc"], got["b"]["precision"], got["b"]["f1"]) == ("single_class", None, 0.0, 0.0)
    d = spark.createDataFrame(rows, "g string, s double, y int")
    assert metrics.class_weight(d.where("g = 'a'"), "y") == len(neg) / len(pos) and metrics.class_weight(d, "y", "none") is None
    with pytest.raises(ValueError):
        metrics.class_weight(d.where("g = 'b'"), "y")


def test_features(spark):
    v = features.vocabulary(spark.createDataFrame([("b",), ("a",), ("b",)], "o string"), "o")
    assert as_set(v) == {("a", 1), ("b", 2)}
    assert as_set(features.vocabulary(spark.createDataFrame([("b",), ("a",), ("c",)], "o string"), "o", unknown=1)) == {("a", 0), ("b", 2), ("c", 3)}
    with pytest.raises(Exception, match="blank"):
        features.vocabulary(spark.createDataFrame([("",)], "o string"), "o").collect()
    d = spark.createDataFrame([("x", "ACGTACGA"), ("y", "ACGT"), ("y", "ACGA"), ("z", "NN")], "organism string, sequence string")
    f = {r["organism"]: r["features"] for r in features.kmer_vectors(d, "organism", "sequence", (1, 2)).collect()}
    assert len(f["x"]) == 20 and f["z"] == [0.0] * 20 and sum(x * x for x in f["y"]) == pytest.approx(2)
    assert registry.organisms.build("kmer", ks=(1,)).fit(d).count() == 3
    assert features.structure_weight("CCO") == pytest.approx(46.07, abs=0.01) and features.structure_weight("c1ccccc1") == pytest.approx(78.11, abs=0.01)
    assert features.structure_weight("N[C@@H](C)C(=O)O") == pytest.approx(89.09, abs=0.02) and features.structure_weight("[NH4+]") == pytest.approx(18.04, abs=0.01)
    assert features.structure_weight("") is None and features.structure_weight("C(") is None and features.structure_weight("C1CC") is None and features.structure_weight("Q") is None
    s = spark.createDataFrame([("CC(=O)O",), (None,)], "smiles string")
    got = [r["d"] for r in features.descriptors(s, "smiles").select(F.col("descriptors").alias("d")).collect()]
    assert (got[0]["heavy_atoms"], got[0]["double_bonds"], got[0]["hetero_atoms"], got[0]["rings"]) == (4, 1, 2, 0) and got[1]["weight"] is None
    g = s.select(features.structure_graph("smiles").alias("g")).first()["g"]
    assert len(g["nodes"]) == 4 and [0, 1] in g["edges"] and [1, 0] in g["edges"]
    assert {len(x) for x in g["nodes"]} == {features.NODE_DIM} == {36} and {len(x) for x in g["bonds"]} == {features.EDGE_DIM} == {11} and len(g["bonds"]) == len(g["edges"]) == 6
    rows = [("c1ccccc1",), ("CCOCC",), ("C1CC1C#N",), ("c1ccc2ccccc2c1",), ("N[C@@H](C)C(=O)O",)]
    d = [r["d"] for r in features.descriptors(spark.createDataFrame(rows, "smiles string").coalesce(1), "smiles").select(F.col("descriptors").alias("d")).collect()]
    assert [(x["rings"], x["aromatic_rings"], x["rotatable_bonds"]) for x in d] == [(1, 1, 0), (0, 0, 2), (1, 0, 1), (2, 2, 0), (0, 0, 1)]
    assert [round(x["fraction_sp3"], 3) for x in d] == [0.0, 1.0, 0.75, 0.0, 0.667]
    ring = features.structure_graph.func(pd.Series(["C1CC1C#N", "N[C@@H](C)C(=O)O", "c1ccccc1"]))
    at = {n: k for k, n in enumerate(["element", "degree", "charge", "hybrid", "aromatic", "hydrogens", "ring", "chiral"])}
    edge = np.cumsum([0, 10, 7, 4, 4, 1, 5, 1])
    part = lambda v, n: v[edge[at[n]] : edge[at[n]] + [10, 7, 4, 4, 1, 5, 1, 4][at[n]]]
    assert [part(v, "ring") for v in ring["nodes"][0]] == [[1.0], [1.0], [1.0], [0.0], [0.0]] and part(ring["nodes"][0][3], "hybrid") == [1.0, 0.0, 0.0, 0.0]
    assert part(ring["nodes"][1][1], "chiral") == [0.0, 1.0, 0.0, 0.0] and part(ring["nodes"][2][0], "aromatic") == [1.0] and all(b[3] == b[5] == b[6] == 1.0 for b in ring["bonds"][2])


def test_genes_of_full_length_only(spark):
    records = spark.createDataFrame([("f", "c", "ACGT" * 500), ("g", "c", "AC")], "file string, record string, sequence string")
    rows = [("f", "c", 1, 1300, "+", "16S ribosomal RNA, partial", 1), ("f", "c", 1, 1250, "+", "16S ribosomal RNA", 2), ("f", "c", 1, 1900, "+", "16S", 3), ("f", "c", 1, 1500, "+", "5S", 4)]
    f = spark.createDataFrame(rows, "file string, record string, start int, end int, strand string, product string, ordinal int")
    assert [(x["file"], len(x["sequence"])) for x in features.longest_gene(records, f, strict=False).collect()] == [("f", 1300)]
    with pytest.raises(Exception, match="no full-length gene in g"):
        features.longest_gene(records, f).collect()


def test_kmers_of_long_rows(spark):
    r = random.Random(8)
    text = "".join(r.choice("ACGTNacgt-é") for _ in range(30_000))
    got = {(x["k"], x["kmer"]): x["n"] for x in features.kmer_counts(spark.createDataFrame([("a", text), ("a", None), ("a", "AC")], "o string, s string"), "o", "s", (1, 3)).collect()}
    want = {}
    for part in (text.upper(), "AC"):
        for k in (1, 3):
            for i in range(len(part) - k + 1):
                w = part[i : i + k]
                if set(w) <= set("ACGT"):
                    want[k, w] = want.get((k, w), 0) + 1
    assert got == want


def test_tokenizer():
    vocab = {t: i for i, t in enumerate(["[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]", "C", "CC", "O", "CCO", "=", "N"])}
    t = tokenizers.Tokenizer(vocab, [("C", "C"), ("CC", "O"), ("O", "N")])
    assert t.tokens("CCCCO=NBr") == ["CC", "CCO", "=", "N", "Br"] and t.numbers("CCO=Br") == [2, 8, 9, 1, 3] and t.numbers("C", "O") == [2, 5, 3, 7, 3]
    assert tokenizers.Tokenizer(vocab).tokens("CCO") == ["C", "C", "O"] and t.tokens(None) == [] and t.numbers("CCO=", limit=3) == [2, 8, 3]
    assert t.text([2, 8, 9, 1, 3]) == "CCO=" and t.special_mask(2, 1) == [1, 0, 0, 1, 0, 1] and t.segments(2, 1) == [0, 0, 0, 0, 1, 1]
    assert tokenizers.save_vocabulary(t).split() == list(vocab)
    with pytest.raises(ValueError, match="unknown"):
        tokenizers.Tokenizer({"C": 0})
    with pytest.raises(ValueError, match="consecutive"):
        tokenizers.save_vocabulary(tokenizers.Tokenizer({"[UNK]": 0, "C": 2}))


def test_folds_learn_from_organisms(spark, tmp_path):
    # vectors that tell nothing, as many rows as leave a model of them nothing to remember; five of ten labels are told by the organism
    import numpy as np

    r = np.random.default_rng(1)
    rows = [(k, [float(x) for x in r.normal(size=3)], k * 7 % 10) for k in range(1200)]
    sf = tables(spark, tmp_path, embeddings=(rows, "vec_id long, embedding array<float>, label int"))
    want = {("rows", 3600), ("val_rows", 1200), ("probabilities_in_range", 3600), ("folds_that_tell_their_fit_rows_apart", 3), ("folds_with_a_model_of_their_own", 3)}
    assert as_set(catalogue.QUERIES["cross_validation"](spark, sf)) == want
    # an organism that only val rows have, and a network
    data = spark.createDataFrame([(k, [float(k % 3)], k % 2, 9 if k % 4 == 0 else k % 3, k % 4) for k in range(60)], "id int, features array<double>, label_int int, organism_index int, fold_id int")
    for name in ("logistic", "mlp"):
        out = training.train_fold(data, 0, name, organism="organism_index", maxIter=5)
        assert out.columns == [*data.columns, "val_fold_id", "eval_group", "probability"]
        assert out.where("probability between 0 and 1").count() == 60


def test_models_and_datasets(spark, tmp_path):
    rows = [(i, f"o{i % 2}", "active" if i % 3 else "inactive", [float(i % 3), 1.0, float(i)]) for i in range(60)]
    d = spark.createDataFrame(rows, "id int, organism string, y string, features array<double>")
    data, facts = training.assemble(d.drop("features"), d.select("id", "features"), "id", "organism", "y", "active", F.col("id") < 40)
    assert facts["peptide_dim"] == 3 and facts["organism_dim"] == 3 and facts["scaler"]["scale"][1] == 1.0
    cv = training.cross_validate(data.withColumn("fold_id", (F.col("id") % 4).cast("int")), 2, maxIter=20)
    right = cv.where("eval_group = 'val'").agg(F.avg(((F.col("probability") >= 0.5).cast("int") == F.col("label_int")).cast("int"))).first()[0]
    assert cv.count() == 120 and right > 0.95
    with pytest.raises(ValueError, match="unknown model"):
        training.build_model("none", 3)
    with pytest.raises(checks.CheckError, match="fixed by the artifact"):
        training.from_artifacts(d.select("id"), d.select("id", "features"), "id", "{}", scaler=1)
    with pytest.raises(checks.CheckError, match="fit on"):
        training.assemble(d, d, "id", "organism", "y", "active", F.col("id") < 0)
    with pytest.raises(Exception, match="in no split"):
        training.attach_split(d, d.where("id < 5"), d.where("id > 5"), "id").collect()
    with pytest.raises(Exception, match="in train and test"):
        training.attach_split(d, d, d.where("id > 5"), "id").collect()
    with pytest.raises(Exception, match="no fold"):
        training.attach_folds(d.select("id"), d.select("id", F.lit("train").alias("split"), F.lit(None).cast("int").alias("fold_id")), "id").collect()
    with pytest.raises(Exception, match="repeated key"):
        training.indexed_rows(d.union(d), "id", ["id"]).collect()
    with pytest.raises(checks.CheckError, match="no features for 1, 2"):
        training.feature_rows(spark.createDataFrame([(1, None), (2, None), (3, 1)], "id int, f int"), "id", "f")
    from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel

    from pyspark.ml.functions import array_to_vector

    fitted = LogisticRegression(featuresCol="x", labelCol="label_int", maxIter=3).fit(data.withColumn("x", array_to_vector("features")))
    readers.save_model(fitted, f"file://{tmp_path}/m", {"dim": 3})
    again, kept = readers.load_model(LogisticRegressionModel, f"file://{tmp_path}/m")
    assert again.coefficients == fitted.coefficients and kept == {"dim": 3}
    out, scores = training.kmeans_sweep(spark.createDataFrame([(i, [float(i % 3) * 10, 0.1 * (i % 5)]) for i in range(90)], "k int, v array<double>"), "v", [2, 3, 4])
    assert max(scores, key=lambda x: x["silhouette"])["k"] == 3 and out.select("cluster").distinct().count() == 3


def test_thresholds_fail_loud(spark):
    good = [("a b", "species", "1", "2"), ("a", "genus", "", None)]
    schema = "match_key string, level string, active_threshold_uM string, inactive_threshold_uM string"
    assert as_set(taxa.load_thresholds(spark.createDataFrame(good, schema))) == {("a b", "species", 1.0, 2.0)}
    for bad in (("a b", "species", "", ""), ("c", "genus", "1", ""), ("c", "family", "", ""), ("c", "genus", "x", "1"), ("c", "genus", "3", "1")):
        with pytest.raises(checks.CheckError):
            taxa.load_thresholds(spark.createDataFrame([*good, bad], schema))


def test_files_and_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("d/b.fna", ">y\nGG\n")
        z.writestr("d/a.fna", ">x\nAC\n")
        z.writestr("d/b.gff", "second")
        z.writestr("d/a.gff", "first")
    assert readers.archive_fasta(spark, f"{tmp_path}/z.zip").first()["text"] == ">x\nAC\n>y\nGG\n" and readers.archive_first(spark, f"{tmp_path}/z.zip").first()["text"] == "first"
    assert readers.read_text(spark, f"file://{tmp_path}/none.txt") == "(not written yet)"
    readers.write_text(spark, f"file://{tmp_path}/t.txt", "é\nb")
    assert readers.read_text(spark, f"file://{tmp_path}/t.txt") == "é\nb"
    assert readers.latex_table([{"a": "x_1", "b": 0.12345}, {"a": "y", "b": None}]).count(r"\\") == 3
    down = lambda i: (500, "down") if i == 2 else (200, "{}")
    with pytest.raises(RuntimeError, match="error"):
        readers.fetch_missing(spark.range(1, 4), spark.range(1, 2), down, tries=1, pause=0.0)
    out = f"file://{tmp_path}/crawl"
    assert tuple(readers.crawl(spark.range(1, 4), down, out, tries=1, pause=0.0).first()) == (2, 0, 1, 0)
    assert tuple(readers.crawl(spark.range(1, 4), lambda i: (200, "{}"), out, tries=1, pause=0.0).first()) == (1, 0, 0, 2)
    with pytest.raises(ValueError, match="artifact"):
        readers.artifact(spark.range(20), "m", most=10)


def test_settings_and_registry(tmp_path):
    with pytest.raises(ValueError, match="is int"):
        config.strict(config.Settings, {"buckets": {"folds": "5"}})
    with pytest.raises(ValueError, match="unknown method"):
        config.strict(config.Settings, {"features": {"peptide": "none"}})
    with pytest.raises(ValueError, match="unknown descriptors"):
        config.strict(config.Settings, {"features": {"descriptors": {"names": ["x"]}}})
    s = config.strict(config.Settings, {"features": {"organism": "kmer", "kmer": {"ks": [1]}}, "robust_mean": {"fence": 2}})
    assert s.features.active("organism") == {"ks": [1]} and s.robust_mean.fence == 2.0
    assert config.device() == "cpu" and len({id(config.set_up_logging()) for _ in range(2)}) == 1 and len(config.set_up_logging().handlers) == 1
    with pytest.raises(ValueError):
        config.device("cuda")
    f = registry.organisms.build("kmer", ks=(1,))
    assert registry.rehydrate(registry.to_artifact(f, {"ks": (1,)}), registry.organisms).name == "kmer"
    with pytest.raises(ValueError):
        registry.rehydrate({}, registry.organisms)
    plan = splits.sensitivity({0: 5, 1: 3, 2: 2}, {0: 1, 1: 0, 2: 2}, {0: 0, 1: 0, 2: 0}, {"a": 0.5, "b": 0.5}, [1.0, 8.0], [1, 2], tries=50)
    assert len(plan) == 4 and training.tracked_config({"dim": 1, "x": 2}, {"dim": 3, "scaler": {}}) == {"dim": 3, "x": 2}


def test_placement_fills_the_bucket_that_lacks_most():
    plan = splits.assign_buckets({"a": 6, "b": 3, "c": 1}, {"a": 0, "b": 0, "c": 0}, {"a": 0, "b": 0, "c": 0}, {"big": 0.7, "small": 0.3}, tries=0)
    assert plan.bucket_of == {"a": "big", "b": "small", "c": "big"}


def test_alignment_against_all_alignments():
    """The best score's most equal and longest alignment, by trying every way to face or skip letters."""
    import functools

    r = random.Random(9)
    score = {"AA": 4.0, "AC": -1.0, "CC": 5.5, "CD": 0.5, "DD": 3.0}
    for _ in range(60):
        a, b = ("".join(r.choice("ACDE") for _ in range(r.randint(1, 5))) for _ in range(2))

        @functools.cache
        def best(i, j, state):
            if i == len(a) and j == len(b):
                return (0.0, 0, 0)
            ways = []
            if i < len(a) and j < len(b):
                s, e, n = best(i + 1, j + 1, 0)
                ways.append((s + score.get(min(a[i], b[j]) + max(a[i], b[j]), 1.0 if a[i] == b[j] else 0.0), e + (a[i] == b[j]), n + 1))
            for k, (p, q) in ((1, (i + 1, j)), (2, (i, j + 1))):
                if p <= len(a) and q <= len(b):
                    s, e, n = best(p, q, k)
                    ways.append((s - (1.0 if state == k else 2.5), e, n + 1))
            return max(ways)

        _, equal, length = best(0, 0, 0)
        assert similarity.align_identity(a, b, gap_open=2.5, gap_extend=1.0, scores=score) == pytest.approx(equal / length)
    assert similarity.align_identities(["", "AC"], ["A", "AC"]).tolist() == [0.0, 1.0]


def test_tiles_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(similarity, "TILE", 7)
    r = np.random.default_rng(1)
    rows = [(i, "ab"[i % 2], r.normal(size=4).tolist()) for i in range(50)] + [(60, "a", None), (61, "a", [0.0] * 4), (62, "a", [1.0, 2.0]), (63, None, [1.0] * 4)]
    df = spark.createDataFrame(rows, "k long, b string, v array<double>")
    cos = {(i, j): float(np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y)) for i, a, x in rows[:50] for j, b, y in rows[:50] if i < j and a == b}
    got = {(x["i"], x["j"]): x["similarity"] for x in similarity.cosine_pairs(df, "k", "v", "b", 0.5).collect()}
    assert got == pytest.approx({p: s for p, s in cos.items() if s >= 0.5})
    near = {}
    for x in similarity.nearest(df, "k", "v", "b", 3).collect():
        near.setdefault(x["i"], []).append((x["rank"], x["j"]))
    every = {**cos, **{(j, i): s for (i, j), s in cos.items()}}
    for i in range(50):
        want = sorted((j for a, j in every if a == i), key=lambda j: (-every[i, j], j))[:3]
        assert [j for _, j in sorted(near[i])] == want


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k,v\n1,x\n2,\n")
    assert as_set(readers.csv(spark, f"{tmp_path}/a.csv", "k int, v string")) == {(1, "x"), (2, None)}
    assert readers.csv(spark, f"{tmp_path}/none.csv", "k int", optional=True).count() == 0
    (tmp_path / "r.jsonl").write_text('{"id": 1, "v": "old"}\n{"id": 2, "v": "b"}\n{"id": 1, "v": "new"}\n')
    assert as_set(readers.records(spark, f"{tmp_path}/r.jsonl", "id long, v string", key="id")) == {(1, "new"), (2, "b")}
    (tmp_path / "half.jsonl").write_text('{"id": 1}\n\n{"id": 2, "x"')
    assert as_set(readers.fetched_ids(spark, f"{tmp_path}/half.jsonl")) == {(1,)}
    (tmp_path / "g.fa").write_text(">r1 one\nacg\nTT\n\n>r2\n>r3 x\nA C\n")
    assert {(r["record"], r["header"], r["sequence"]) for r in readers.fasta(spark, f"{tmp_path}/g.fa").collect()} == {("r1", "r1 one", "ACGTT"), ("r2", "r2", ""), ("r3", "r3 x", "AC")}
    assert readers.fasta(spark, f"{tmp_path}/g.fa", keep_empty=False).count() == 2
    (tmp_path / "g.gff").write_text("##gff\nr1\tx\trRNA\t2\t4\t.\t-\t.\tID=a;product=16S ribosomal RNA\nr1\tx\tgene\t1\t2\t.\t+\t.\tID=b\nshort\n")
    f = readers.gff(spark, f"{tmp_path}/g.gff")
    assert [(r["record"], r["start"], r["end"], r["strand"], r["product"]) for r in f.collect()] == [("r1", 2, 4, "-", "16S ribosomal RNA")]
    gene = features.longest_gene(readers.fasta(spark, f"{tmp_path}/g.fa").withColumn("file", F.lit("f")), f.withColumn("file", F.lit("f")), least=1).first()
    assert gene["sequence"] == "ACG"
    (tmp_path / "v.txt").write_text("[PAD]\n[UNK]\nC\n")
    assert as_set(readers.vocabulary_file(spark, f"{tmp_path}/v.txt")) == {("[PAD]", 0), ("[UNK]", 1), ("C", 2)}
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("d/a.fna", ">x\nAC")
        z.writestr("d/b.txt", "no")
    assert [(r["member"], r["text"]) for r in readers.archive_members(spark, f"{tmp_path}/z.zip", ".fna").collect()] == [("d/a.fna", ">x\nAC")]
    got = readers.fetch(spark.createDataFrame([(1,), (2,), (3,)], "id long"), lambda i: {1: (200, "ok"), 2: (400, "")}.get(i, (500, "down")), tries=2, pause=0.0)
    assert as_set(got) == {(1, "ok", "ok"), (2, "not_found", None), (3, "error", "down")}


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"id": 1, "v": "a"}\n{"id": 2, "v": "b"}\n')
    run = lambda: incremental.append(incremental.new_records(spark, f"{tmp_path}/in", "id long, v string"), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    run()
    (tmp_path / "in/b.json").write_text('{"id": 2, "v": "again"}\n{"id": 3, "v": "c"}\n{"id"')
    run()
    done = spark.read.parquet(f"{tmp_path}/out").where("id is not null")
    assert as_set(done) == {(1, "a"), (2, "b"), (3, "c")}
    assert as_set(incremental.missing(spark.range(1, 6), done)) == {(4,), (5,)}


def test_settings(tmp_path):
    (tmp_path / "base.json").write_text(json.dumps({"buckets": {"test": 0.2, "folds": 5}, "labels": ["a", "b"]}))
    (tmp_path / "own.json").write_text(json.dumps({"_base_": "base.json", "buckets": {"folds": 3}, "labels": ["a"]}))
    s = config.strict(config.Settings, config.load(tmp_path / "own.json"))
    assert (s.buckets.test, s.buckets.folds, s.labels, s.training.larger_is_better) == (0.2, 3, ["a"], True)
    with pytest.raises(ValueError, match="nothing"):
        config.strict(config.Settings, {"nothing": 1})
    with pytest.raises(ValueError, match="metric"):
        config.strict(config.Settings, {"training": {"select_by": "luck"}})


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_queries_equal_their_sql(spark, name):
    """Rows of each query against DuckDB on the smallest tables."""
    import os

    import duckdb

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no tables here")
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    rel = con.sql(catalogue.ORACLES[name])
    df = catalogue.QUERIES[name](spark, sf)
    names = sorted(df.columns)
    assert names == sorted(rel.columns)
    plain = lambda rows, cols: sorted(str([float(r[cols.index(c)]) if isinstance(r[cols.index(c)], (int, float)) and not isinstance(r[cols.index(c)], bool) else str(r[cols.index(c)]) for c in names]) for r in rows)
    assert plain([tuple(r) for r in df.collect()], df.columns) == plain(rel.fetchall(), rel.columns)


def tables(spark, path, **rows):
    """A folder of tables: name = (rows, schema)."""
    for name, (data, schema) in rows.items():
        spark.createDataFrame(data, schema).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def test_dup_links_compare_whole_texts(spark, tmp_path):
    start = "word " * 50
    sf = tables(spark, tmp_path, documents=([(1, start + "a"), (2, start + "b"), (3, (start + "A").upper()), (4, start + "b"), (5, None), (6, None)], "doc_id long, text string"))
    assert as_set(catalogue.QUERIES["dup_links_first_seen"](spark, sf)) == {(1, 3), (2, 4)}


def test_split_cover_reads_all_documents(spark, tmp_path):
    sf = tables(spark, tmp_path, documents=([(k,) for k in range(6)], "doc_id long"), labels=([(1, 0), (1, 1), (3, 0), (4, 1), (9, 0)], "doc_id long, quality int"))
    assert as_set(catalogue.QUERIES["qa_split_cover"](spark, sf)) == {(1, 3, 1)}


def test_contracted_documents_keep_isolated_nodes(spark, tmp_path):
    start = "word " * 50
    rows = [(1, start + "a", "s", "en"), (2, (start + "a").upper(), "s", "en"), (3, start + "bbb", "s", "en"), (4, "alone", "t", "en"), (5, None, "u", "de"), (6, start + "BBB", "s", "en"), (7, "", "v", "fr")]
    sf = tables(spark, tmp_path, documents=(rows, "doc_id long, text string, source string, lang string"))
    assert as_set(catalogue.QUERIES["contracted_documents"](spark, sf)) == {(1, 2, 3, round(251 / 253, 6)), (3, 2, None, None), (4, 1, None, None), (5, 1, None, None), (7, 1, None, None)}
    assert as_set(catalogue.QUERIES["components_contract"](spark, sf)) == {(1, 1), (2, 1), (3, 3), (6, 3), (4, 4), (5, 5), (7, 7)}


def test_sets_are_stored_once_and_compared_in_rounds(spark, monkeypatch):
    import random

    rnd = random.Random(4)
    rows = []
    for k in range(0, 120, 4):
        one = rnd.sample(range(1000), 30)
        rows += [(k, one), (k + 1, one[::-1]), (k + 2, one[1:]), (k + 3, [*one[:25], k])]
    jac = lambda a, b: len(a & b) / len(a | b)
    want = {(i, j, round(jac(dict(rows_)[i], dict(rows_)[j]), 6)) for rows_ in [[(k, frozenset(x)) for k, x in rows]] for i, j in by_class(dict(rows_), lambda a, b: jac(a, b) >= 0.7)}
    kept, stored = [], similarity.stored
    monkeypatch.setattr(similarity, "stored", lambda df, kind: kept.append(df.columns) or stored(df, kind))
    # cells of four sets, one round for each 100 items
    monkeypatch.setattr(similarity, "CELL", 4)
    monkeypatch.setattr(similarity, "ITEMS", 100, raising=False)
    got = similarity.set_pairs(spark.createDataFrame(rows, "k int, s array<int>"), "k", "s", 0.7)
    assert {(x["i"], x["j"], round(x["similarity"], 6)) for x in got.collect()} == want and got.count() == len(want) > 60
    # 64-bit items of whole sets are on disk once, and 16 rounds send no more than a part of them each
    assert sum("r" in c and "h" in c or c == ["c", "n", "r"] for c in kept) == 1
    assert kept.count(["i", "j", "similarity"]) == 1 + similarity.ROUNDS


def test_shingle_pairs_of_documents(spark, tmp_path):
    import random
    import re

    rnd = random.Random(3)
    texts = []
    for _ in range(20):
        w = [rnd.choice("abcdefgh") * rnd.randint(1, 9) for _ in range(40)]
        texts += [" ".join(w), "  ".join(w).upper(), " ".join(w[:-2]), " ".join([*w[:20], "other", *w[21:]]), " ".join(w[:10])]
    texts += ["one two", "One, two!", "été 1", "", None]
    words = [re.findall(r"[^\W_]+", (x or "").lower()) for x in texts]
    sets = [{" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))} if w else set() for w in words]
    jac = lambda a, b: len(a & b) / len(a | b)
    want = {(i, j, round(jac(sets[i], sets[j]), 6)) for i, j in by_class({i: frozenset(a) for i, a in enumerate(sets) if a}, lambda a, b: jac(a, b) >= 0.8)}
    sf = tables(spark, tmp_path, documents=(list(enumerate(texts)), "doc_id long, text string"))
    assert as_set(catalogue.QUERIES["shingle_jaccard_documents"](spark, sf)) == want and len(want) > 60
    # an item that all sets share, dealt to cells of three sets
    d = spark.createDataFrame([(k, [0, k % 7 + 1]) for k in range(40)] + [(99, [0])], "k int, s array<int>")
    rows = [(k, {0, k % 7 + 1}) for k in range(40)] + [(99, {0})]
    want = sorted(by_class({i: frozenset(a) for i, a in rows}, lambda a, b: jac(a, b) >= 0.3))
    assert sorted((x["i"], x["j"]) for x in similarity.set_pairs(d, "k", "s", 0.3, most=3).collect()) == want
    # copies of one set add a row each, not pairs
    many = spark.createDataFrame([(k, ["a", "b", "c"]) for k in range(5000)] + [(9999, ["a", "b", "c", "d"])], "k long, s array<string>")
    assert similarity.set_pairs(many, "k", "s", 0.7).count() == 5000


def test_whole_texts_are_complemented_and_tokenized(spark, tmp_path):
    sf = tables(spark, tmp_path, documents=([(1, "e" * 100 + "i" * 1200), (2, "")], "doc_id long, text string"), pages=([(1, "C" * 30 + "N"), (2, "")], "page_id long, html string"))
    assert as_set(catalogue.QUERIES["reverse_complement"](spark, sf)) == {(1, 1300, True, "G" * 1200 + "T" * 100), (2, 0, False, "")}
    assert as_set(catalogue.QUERIES["tokenize_structures"](spark, sf)) == {(1, 31, "C " * 30 + "N"), (2, 0, "")}


def test_stored_tables_can_be_removed(spark, tmp_path, monkeypatch):
    from assayloom.sources import scratch

    monkeypatch.setattr(scratch, "shared_folder", lambda _: f"file://{tmp_path}/shared")
    scratch.drop_tables(spark)
    table = scratch.stored(spark.range(5), "one")
    scratch.stored(spark.range(3), "two")
    (tmp_path / "shared/one/other").mkdir()
    assert table.count() == 5
    scratch.drop_tables(spark)
    assert sorted(str(p.relative_to(tmp_path / "shared")) for p in (tmp_path / "shared").rglob("*") if p.is_dir()) == ["one", "one/other", "two"]


def test_batches_by_length_of_equal_lengths(spark):
    d = spark.createDataFrame([(k, None if k % 3 else "abc") for k in range(90)], "k long, s string")
    got = {x["k"]: x["batch"] for x in training.length_batches(d, "s", "k", 32).collect()}
    order = sorted(range(90), key=lambda k: (0 if k % 3 else 3, k))
    assert got == {k: n // 32 for n, k in enumerate(order)}


def test_strict_slices_and_single_rows(spark):
    d = spark.createDataFrame([("a", 0.9, 1, True), ("a", 0.2, 1, False), ("b", 0.7, 1, True)], "k string, s double, y int, f boolean")
    got = {x["k"]: (x["recall_in"], x["recall_out"]) for x in metrics.slice_recall(d, ["k"], "s", "y", "f").collect()}
    assert got == {"a": (1.0, 0.0), "b": (1.0, None)}
    assert metrics.slice_recall(d.where("k = 'a'"), ["k"], "s", "y", "f", strict=True).first()["delta"] == 1.0
    with pytest.raises(Exception, match="one side"):
        metrics.slice_recall(d, ["k"], "s", "y", "f", strict=True).collect()
    assert {x["k"]: x["s_std"] for x in aggregates.mean_std(d, ["k"], ["s"], single=None).collect()}["b"] is None
    assert {x["k"]: x["s_std"] for x in aggregates.mean_std(d, ["k"], ["s"]).collect()}["b"] == 0.0
    t = aggregates.crosstab_totals(d.union(spark.createDataFrame([(None, 0.1, 0, True), ("z", 0.1, 7, True)], d.schema)), "k", "y", [0, 1]).collect()
    assert {(x["k"], x["all_rows"], x["0"], x["1"], x["total"], x["share_1"]) for x in t} == {("a", 0, 0, 2, 2, 100.0), ("b", 0, 0, 1, 1, 100.0), (None, 0, 1, 0, 1, 0.0), (None, 1, 1, 3, 4, 75.0)}


def test_set_pairs_broadcasts_no_side_that_grows(spark):
    d = spark.range(60).selectExpr("id AS k", "transform(sequence(0, 9), x -> int(x + id % 7)) AS s")
    got = similarity.set_pairs(d, "k", "s", 0.8)
    assert "BroadcastHashJoin" not in got._jdf.queryExecution().executedPlan().toString()
    sets = [frozenset(range(i % 7, i % 7 + 10)) for i in range(7)]
    want = {(i, j) for i in range(7) for j in range(i + 1, 7) if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])} | {(i % 7, i) for i in range(7, 60)}
    assert {(x["i"], x["j"]) for x in got.collect()} == want
    # sketches count differing items, also above the size that has one
    big = spark.createDataFrame([(k, [*range(600), *range(1000 + 40 * k, 1040 + 40 * k)]) for k in range(3)], "k int, s array<int>")
    assert sorted((x["i"], x["j"]) for x in similarity.set_pairs(big, "k", "s", 0.88).collect()) == [(0, 1), (0, 2), (1, 2)]


def test_structure_codes_are_the_graphs_vectors(spark):
    d = spark.createDataFrame([("C=CC#N",), ("N[C@@H](C)C(=O)O",), ("C(",), (None,)], "s string")
    codes = features.structure_codes(F.col("s"))
    vectors = lambda c, n: F.transform(c, lambda x: features.slots(x, n))
    for x in d.select(features.structure_graph("s").alias("g"), codes["edges"].alias("e"), vectors(codes["nodes"], features.NODE_DIM).alias("n"), vectors(codes["bonds"], features.EDGE_DIM).alias("b")).collect():
        assert (x["g"]["nodes"], x["g"]["edges"], x["g"]["bonds"]) == (x["n"], x["e"], x["b"])


def test_crowded_keys_are_joined_by_equal_parts(spark, monkeypatch):
    import random

    from assayloom.operators import structures

    rnd, sets, made = random.Random(5), [], []
    for _ in range(30):
        one = set(rnd.sample(range(60), rnd.randint(1, 40)))
        sets += [frozenset(one), *[frozenset(one ^ {rnd.randrange(60) for _ in range(rnd.randint(1, 4))}) for _ in range(3)]]
    parts = similarity._parts
    monkeypatch.setattr(similarity, "_parts", lambda *a: made.append(1) or parts(*a))
    # all keys are crowded, whatever the threshold
    monkeypatch.setattr(similarity, "CROWD", 0)
    monkeypatch.setattr(similarity, "PART", 0)
    for t in (0.6, 0.9, 1.0):
        want = by_class({k: s for k, s in enumerate(sets) if s}, lambda a, b: len(a & b) >= t * len(a | b) - 1e-9)
        got = similarity.set_pairs(spark.createDataFrame([(k, sorted(s)) for k, s in enumerate(sets)], "k int, s array<int>"), "k", "s", t, most=4).collect()
        assert {(x["i"], x["j"]) for x in got} == want and len(got) == len(want)
    assert len(made) == 3
    # fingerprints are larger than the texts that they are made of
    d = structures.with_fingerprint(spark.createDataFrame([(1, "CCO"), (2, "C("), (3, None)], "k int, s string"), "s")
    assert len(d.collect()) == 3 and "BroadcastHashJoin" not in d._jdf.queryExecution().executedPlan().toString()


def test_rows_without_key_take_no_links_away(spark):
    rows = [(None, [1, 2, 3, 4, 5]), (3, [1, 2, 3, 4, 5]), (7, [5, 4, 3, 2, 1]), (9, [1, 2, 3, 4, 5, 6]), (None, [7])]
    got = similarity.set_pairs(spark.createDataFrame(rows, "k int, s array<int>"), "k", "s", 0.8)
    assert sorted((x["i"], x["j"], round(x["similarity"], 3)) for x in got.collect()) == [(3, 7, 1.0), (3, 9, 0.833)]


def test_shingles_are_made_once(spark, tmp_path, monkeypatch):
    kept = []

    def stored(df, kind):
        kept.append(df)
        raise InterruptedError

    sf = tables(spark, tmp_path, documents=([(1, "a b c d"), (2, "a b"), (3, ""), (4, None)], "doc_id long, text string"))
    monkeypatch.setattr(similarity, "stored", stored)
    with pytest.raises(InterruptedError):
        catalogue.QUERIES["shingle_jaccard_documents"](spark, sf)
    # neither a filter nor another column makes the sets again
    assert kept[0]._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
    assert {(x["k"], x["n"] if x["h"] else None) for x in kept[0].collect()} == {(1, 2), (2, 1), (3, None), (4, None)}
