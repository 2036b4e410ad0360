"""Communities, leader clusters, the whole split, message passing and the training loop against plain versions."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayloom.operators import communities, graph, networks, peptide_split, structures
from assayloom.operators.checks import CheckError


def planted(seed, groups, size, inside, outside):
    r = random.Random(seed)
    n = groups * size
    return n, [(i, j, 1.0) for i, j in itertools.combinations(range(n), 2) if r.random() < (inside if i // size == j // size else outside)]


def plain_modularity(n, edges, label):
    k, m2 = [0.0] * n, 2 * sum(w for *_, w in edges)
    for a, b, w in edges:
        k[a] += w
        k[b] += w
    inside = sum(2 * w for a, b, w in edges if label[a] == label[b])
    totals = {}
    for i in range(n):
        totals[label[i]] = totals.get(label[i], 0.0) + k[i]
    return inside / m2 - sum((x / m2) ** 2 for x in totals.values())


def plain_moving(n, edges, seed):
    """Single nodes moved in a random order to the best neighbouring community until none gains, then communities as nodes, and so on."""
    r, of = random.Random(seed), list(range(n))
    m2 = 2 * sum(w for *_, w in edges)
    while True:
        near = {}
        for a, b, w in edges:
            a, b = of[a], of[b]
            for x, y in ((a, b), (b, a)):
                near.setdefault(x, {}).setdefault(y, 0.0)
                near[x][y] += w
        k = {x: sum(v.values()) for x, v in near.items()}
        label = {x: x for x in set(of)}
        total = {x: k.get(x, 0.0) for x in label}
        moved, any_ = True, False
        while moved:
            moved = False
            for x in r.sample(sorted(near), len(near)):
                own = label[x]
                ways = {}
                for y, w in near[x].items():
                    if y != x:
                        ways[label[y]] = ways.get(label[y], 0.0) + w
                total[own] -= k[x]
                best = max([(ways.get(own, 0.0) - k[x] * total[own] / m2 + 1e-12, own), *((w - k[x] * total[c] / m2, c) for c, w in ways.items())])[1]
                total[best] += k[x]
                if best != own:
                    label[x], moved, any_ = best, True, True
        of = [label[x] for x in of]
        if not any_:
            return of


@pytest.mark.parametrize(("seed", "groups", "size", "inside", "outside"), [(1, 6, 15, 0.5, 0.03)])
def test_communities_are_as_good_as_moving_one_by_one(spark, seed, groups, size, inside, outside):
    n, edges = planted(seed, groups, size, inside, outside)
    nodes = spark.createDataFrame([(i,) for i in range(n + 2)], "node long")
    table = spark.createDataFrame(edges, "src long, dst long, weight double")
    found = communities.find_communities(nodes, table)
    got = {x["node"]: x["community"] for x in found.collect()}
    assert set(got) == set(range(n + 2)) and got[n] == n and got[n + 1] == n + 1
    label = [got[i] for i in range(n)]
    score = plain_modularity(n, edges, label)
    assert communities.modularity(nodes, table, found) == pytest.approx(score)
    assert score >= max(plain_modularity(n, edges, plain_moving(n, edges, s)) for s in range(3)) - 0.005
    assert score >= plain_modularity(n, edges, [i // size for i in range(n)]) - 1e-9
    # named by their smallest nodes
    assert all(min(i for i in range(n) if label[i] == c) == c for c in set(label))


def test_communities_of_small_graphs(spark):
    nodes = spark.createDataFrame([(x,) for x in "abcdefg"], "node string")
    # two triangles and a bridge, parallel edges, a loop, an edge of its own
    edges = spark.createDataFrame([("a", "b", 0.5), ("b", "a", 0.5), ("b", "c", 1.0), ("a", "c", 1.0), ("d", "e", 1.0), ("e", "f", 1.0), ("d", "f", 1.0), ("c", "d", 0.2), ("g", "g", 1.0)], "src string, dst string, weight double")
    once = {tuple(x) for x in graph.communities(nodes, edges).collect()}
    assert once == {("a", "a"), ("b", "a"), ("c", "a"), ("d", "d"), ("e", "d"), ("f", "d"), ("g", "g")}
    assert once == {tuple(x) for x in graph.communities(nodes.repartition(3), edges.repartition(5)).collect()}
    assert {tuple(x) for x in graph.communities(nodes, edges.limit(0)).collect()} == {(x, x) for x in "abcdefg"}
    assert graph.communities(nodes.limit(0), edges.limit(0)).count() == 0


def test_leader_clusters(spark):
    r = random.Random(5)
    for n, m in ((40, 70), (12, 0)):
        edges = {tuple(sorted(r.sample(range(n), 2))) for _ in range(m)}
        near = {i: set() for i in range(n)}
        for a, b in edges:
            near[a].add(b)
            near[b].add(a)
        left, want = set(near), set()
        for x in sorted(near, key=lambda x: (-len(near[x]), x)):
            if x in left:
                group = {x} | (near[x] & left)
                want |= {(y, x) for y in group}
                left -= group
        table = spark.createDataFrame([(a, b) for a, b in edges] + [(b, a) for a, b in list(edges)[:5]], "src long, dst long")
        assert {tuple(x) for x in graph.leader_clusters(spark.range(n).withColumnRenamed("id", "node"), table).collect()} == want
    # a path, on which each round decides little
    path = spark.createDataFrame([(i, i + 1) for i in range(8)], "src long, dst long")
    got = dict(tuple(x) for x in graph.leader_clusters(spark.range(9).withColumnRenamed("id", "node"), path).collect())
    assert got == {0: 1, 1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 6: 5, 7: 7, 8: 7}


def records(spark, n=60, bad=False):
    r = random.Random(7)
    rows = []
    for i in range(n):
        seq = "".join(r.choice("ACDEFGHIKL") for _ in range(12)) if i % 3 else rows[-1][1] if rows and i % 6 else "".join(r.choice("ACDEFGHIKL") for _ in range(12))
        if i % 10 == 7:
            seq = "X" + seq[1:]
        text = "".join("N" + structures.FRAGMENTS[c] + "C(=O)" for c in seq if c != "X") + "O" if i % 4 else None
        rows += [(i, seq, text if i % 9 else "C(", i % 5 == 0, (i + k) % 2 == 0) for k in range(1 + i % 3)]
    rows += [(1, "OTHER", None, False, True)] if bad else []
    return spark.createDataFrame(rows, "peptide_id long, sequence string, smiles string, special boolean, active boolean")


def test_the_whole_split(spark, tmp_path, monkeypatch):
    df, folder = records(spark), f"file://{tmp_path}/split"
    plan = peptide_split.SplitPlan(tries=2000, folds=3)
    rows, facts = peptide_split.build_split(df, plan, folder)
    got = {x["peptide_id"]: x for x in rows.collect()}
    assert set(got) == set(range(60)) and all((x["split"] == "test") == (x["fold_id"] is None) for x in got.values())
    place = {k: (x["split"], x["fold_id"]) for k, x in got.items()}
    by_community = {}
    for k, x in got.items():
        by_community.setdefault(x["community"], set()).add(place[k])
    assert all(len(p) == 1 for p in by_community.values()) and len(set(place.values())) == 4
    # equal sequences without a placeholder, and equal structures, are in one place
    units = {x["peptide_id"]: x for x in df.collect()}
    for a, b in itertools.combinations(units, 2):
        u, v = units[a], units[b]
        if (u["sequence"] == v["sequence"] and "X" not in u["sequence"]) or (u["smiles"] and u["smiles"] == v["smiles"]):
            assert place[a] == place[b]
    f = {x["fact"]: x["value"] for x in facts.collect()}
    assert f["peptides"] == 60 and f["records"] == df.count() and f["hard_crossing"] == 0 and f["communities"] == len(by_community) and f["hard_edges"] > 0
    assert f["with_placeholder"] == sum("X" in u["sequence"] for u in units.values()) and sum(v for k, v in f.items() if k.startswith("records_of_")) == df.count()
    # a second run goes on from the stages that are there
    monkeypatch.setattr(peptide_split, "find_communities", lambda *a, **k: pytest.fail("made again"))
    again, _ = peptide_split.build_split(df, plan, folder)
    assert {tuple(x) for x in again.collect()} == {tuple(x) for x in rows.collect()}
    with pytest.raises(peptide_split.SplitError, match="another plan"):
        peptide_split.build_split(df, peptide_split.SplitPlan(), folder)


def test_splits_that_cannot_be(spark):
    with pytest.raises(peptide_split.SplitError, match="first of them 1"):
        peptide_split.build_split(records(spark, 12, bad=True))
    with pytest.raises(peptide_split.SplitError, match="no records"):
        peptide_split.build_split(records(spark, 12).limit(0))


def layer(r, edge_dim, dim):
    n = lambda *s: r.normal(0, 0.5, s).tolist()
    return {"edge": n(edge_dim, dim), "edge_b": n(dim), "in": n(dim, dim), "in_b": n(dim), "out": n(dim, dim), "out_b": n(dim), "scale": n(dim), "shift": n(dim), "eps": 0.3}


def test_message_passing_equals_matrices(spark):
    texts = ["CCO", "c1ccccc1", "C", "C(", None, "N[C@@H](CS)C(=O)O", "[NH4+].[Cl-]"]
    nodes, edges = networks.graph_batch(spark.createDataFrame(list(enumerate(texts)), "id long, smiles string"), "id", "smiles")
    r = np.random.default_rng(3)
    node_rows, edge_rows = sorted(nodes.collect(), key=lambda x: x["id"]), edges.collect()
    assert [x["id"] for x in node_rows] == list(range(len(node_rows))) and [x["graph"] for x in node_rows] == sorted(x["graph"] for x in node_rows)
    of = {x["id"]: x["graph"] for x in node_rows}
    assert all(of[x["src"]] == of[x["dst"]] for x in edge_rows) and len(edge_rows) == 2 * (2 + 6 + 6)
    d, k, dim = len(node_rows[0]["x"]), len(edge_rows[0]["e"]), 5
    w = {"embed": r.normal(size=(d, dim)).tolist(), "embed_b": r.normal(size=dim).tolist(), "layers": [layer(r, k, dim), layer(r, k, dim)], "read": r.normal(size=(3 * dim, 4)).tolist(), "read_b": r.normal(size=4).tolist(), "read_scale": [1.0, 2.0, 0.5, 1.0], "read_shift": [0.0, 1.0, 0.0, 0.0]}
    got = {x["graph"]: x for x in networks.encode_graphs(nodes, edges, w).collect()}
    a = lambda x: np.array(x)
    norm = lambda h, s, b: (h - h.mean(1, keepdims=True)) / np.sqrt(h.var(1, keepdims=True) + 1e-5) * a(s) + a(b)
    h = a([x["x"] for x in node_rows]) @ a(w["embed"]) + a(w["embed_b"])
    for one in w["layers"]:
        sums = np.zeros_like(h)
        for x in edge_rows:
            sums[x["dst"]] += np.maximum(h[x["src"]] + a(x["e"]) @ a(one["edge"]) + a(one["edge_b"]), 0)
        h = norm(h + np.maximum((1.3 * h + sums) @ a(one["in"]) + a(one["in_b"]), 0) @ a(one["out"]) + a(one["out_b"]), one["scale"], one["shift"])
    for g in {0, 1, 2, 5, 6}:
        own = h[[x["id"] for x in node_rows if x["graph"] == g]]
        pooled = np.concatenate([own.mean(0), own.max(0), own.sum(0) / 100])
        assert np.allclose(got[g]["pooled"], pooled) and np.allclose(got[g]["code"], norm(pooled[None] @ a(w["read"]) + a(w["read_b"]), w["read_scale"], w["read_shift"])[0])
    assert set(got) == {0, 1, 2, 5, 6}


def rows_of_two(spark, n=240):
    r = np.random.default_rng(1)
    y = r.integers(0, 2, n)
    x = r.normal(size=(n, 3)) + y[:, None] * np.array([1.5, -1.0, 0.0])
    return x, y, spark.createDataFrame([(i, v.tolist(), int(k), i % 4 == 0) for i, (v, k) in enumerate(zip(x, y))], "id long, x array<double>, y int, v boolean").repartition(3)


def test_training_loop(spark, tmp_path):
    x, y, df = rows_of_two(spark)
    folder = f"file://{tmp_path}/run"
    history, _ = networks.fit_epochs(df, "x", "y", "v", epochs=6, hidden=4, rate=0.05, folder=folder)
    first = [tuple(h) for h in history.orderBy("epoch").collect()]
    assert [h[0] for h in first] == list(range(6)) and first[-1][1] < first[0][1]
    # going on is like never having stopped
    more, _ = networks.fit_epochs(df, "x", "y", "v", epochs=12, hidden=4, rate=0.05, folder=folder)
    whole, other = networks.fit_epochs(df, "x", "y", "v", epochs=12, hidden=4, rate=0.05)
    assert [tuple(h) for h in more.orderBy("epoch").collect()] == [tuple(h) for h in whole.orderBy("epoch").collect()] and [tuple(h) for h in more.orderBy("epoch").limit(6).collect()] == first
    # gradients against differences, with the plain forward pass
    fit = np.arange(len(y)) % 4 != 0
    p = networks.load_epoch(spark, folder, 3)

    def loss(p):
        h = np.maximum(x[fit] @ p["v"] + p["c"], 0)
        z = h @ p["w"] + p["b"][0]
        return float(np.mean(np.log1p(np.exp(z)) - z * y[fit]))

    got = networks._pass(df, p, "x", "y", "v", 1.0)
    assert got["fit_loss"] == pytest.approx(loss(p)) and got["n_fit"] == fit.sum()
    for k, g in got["gradient"].items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        up, down = ({**p, k: p[k].copy()} for _ in range(2))
        up[k][at] += 1e-5
        down[k][at] -= 1e-5
        assert g[at] == pytest.approx((loss(up) - loss(down)) / 2e-5, rel=1e-3)
    best = networks.load_epoch(spark, other)
    said = df.select("id", networks.probability(F.col("x"), best).alias("p")).collect()
    right = np.mean([(s["p"] > 0.5) == (y[s["id"]] == 1) for s in said])
    assert right > 0.7 and all(0 <= s["p"] <= 1 for s in said)


def test_training_stops_early(spark):
    # labels of the val rows are turned over, so that what fits better is worse there
    _, _, df = rows_of_two(spark, 80)
    turned = df.withColumn("y", F.when(F.col("v"), 1 - F.col("y")).otherwise(F.col("y")))
    history, folder = networks.fit_epochs(turned, "x", "y", "v", epochs=20, rate=0.2, adam=False, patience=2)
    rows = history.orderBy("epoch").collect()
    assert [h["epoch"] for h in rows if h["best"]] == [0] and len(rows) == 3
    assert not networks.load_epoch(spark, folder)["w"].any()
    with pytest.raises(CheckError, match="both classes"):
        networks.fit_epochs(df.withColumn("y", F.lit(1)), "x", "y", "v")
    with pytest.raises(CheckError, match="unknown metric"):
        networks.fit_epochs(df, "x", "y", "v", metric="luck")


def test_principal_axes(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(120, 5)) * np.array([5.0, 3.0, 0.2, 0.1, 0.1])
    got = {g["id"]: g["axes"] for g in networks.principal_axes(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>"), "v").collect()}
    _, _, axes = np.linalg.svd(x - x.mean(0), full_matrices=False)
    want = x @ (axes[:2].T * np.sign(axes[:2].T[np.abs(axes[:2].T).argmax(0), range(2)]))
    assert np.allclose([got[i] for i in range(120)], want, atol=1e-6)
    # nearly all variance is on two axes: most of the ten nearest rows stay among them
    near = lambda m: np.argsort(((m[:, None] - m[None]) ** 2).sum(2), axis=1)[:, 1:11]
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(near(x), near(want))]) > 0.7


def test_joins_of_growing_sides_are_not_broadcast(spark):
    from assayloom.llm.near_dup import near_duplicates
    from assayloom.operators.identity import identity_links

    docs = spark.range(12).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(0, 40), x -> concat('w', x * (id % 3)))) AS text")
    got = near_duplicates(docs)
    classes = spark.createDataFrame([(1, "ACDEFG"), (2, "ACDEFH"), (3, "WWWWWW")], "k long, s string")
    links = identity_links(classes, 0.6)
    for d in (got, links):
        assert "BroadcastHashJoin" not in d._jdf.queryExecution().executedPlan().toString()
    assert {(x["doc_id"], x["component_id"]) for x in got.collect()} == {(k, k % 3) for k in range(12)}
    assert {(x["i"], x["j"]) for x in links.collect()} == {(1, 2)}


def test_communities_and_buckets_broadcast_no_side_that_grows(spark, monkeypatch):
    from assayloom.operators import communities as C
    from assayloom.operators import splits

    plans, stored, first = [], C.stored, type(spark.range(0)).first
    note = lambda d: plans.append(d._jdf.queryExecution().executedPlan().toString())
    monkeypatch.setattr(C, "stored", lambda d, kind: note(d) or stored(d, kind))
    monkeypatch.setattr(type(spark.range(0)), "first", lambda d: note(d) or first(d))
    edges = spark.createDataFrame([(a, b, 1.0) for k in (0, 10) for a in range(k, k + 5) for b in range(a + 1, k + 5)] + [(4, 10, 1.0)], "src long, dst long, weight double")
    got = C.find_communities(spark.range(15).select(F.col("id").alias("node")), edges)
    assert {x["node"]: x["community"] for x in got.collect()} == {k: k if 5 <= k < 10 else k // 10 * 10 for k in range(15)}
    assert len(plans) > 5 and not any("BroadcastHashJoin" in p for p in plans)
    # clusters go to the driver as arrays, and are dealt as assign_buckets() deals them
    d = spark.range(60).selectExpr("nullif(id % 13, 12) AS c", "id % 3 = 0 AS s", "id % 5 = 0 AS a")
    n = {x["c"]: (x["size"], x["special"], x["active"]) for x in splits.cluster_rollup(d, "c", "s", "a").collect()}
    plan = splits.assign_buckets(*[{c: v[k] for c, v in n.items()} for k in range(3)], {"test": 0.25} | {f"fold_{k}": 0.25 for k in range(3)}, tries=500)
    monkeypatch.setattr(type(d), "collect", lambda *a: pytest.fail("rows at the driver"))
    rows = splits.cluster_buckets(d, "c", "s", "a", 0.25, 3, tries=500).toArrow().to_pylist()
    assert {x["c"]: "test" if x["split"] == "test" else f"fold_{x['fold_id']}" for x in rows} == plan.bucket_of
