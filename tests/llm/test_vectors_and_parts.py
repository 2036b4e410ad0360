"""Embedding near-dedup, tokens, words and components."""

import random

import numpy as np
import pytest

from assayloom.llm import common, tokens, vector_dup

SCHEMA = "vec_id long, embedding array<float>, label int, n long"


def vectors(dim=16, seed=0):
    r = np.random.default_rng(seed)
    rows, k = [], 0
    for label in (0, 1, None):
        centres = r.normal(size=(6, dim))
        for c in centres:
            for s in (0, 0, 0.02, 0.05, 0.1, 0.12, 0.2):
                rows.append((k, (c + s * r.normal(size=dim)).astype(np.float32).tolist(), label, 1))
                k += 1
    rows += [(k, None, 0, 1), (k + 1, [0.0] * dim, 0, 1), (k + 2, [None] + [1.0] * (dim - 1), 0, 1), (k + 3, [float("inf")] + [1.0] * (dim - 1), 0, 1), (k + 4, [], 0, 1), (k + 5, [1.0, 2.0], 0, 1), (k + 6, [2.0, 4.0], 0, 1), (None, [1.0, 2.0], 0, 1)]
    return rows


@pytest.mark.parametrize("crowd", [3, 512])
def test_near_vectors(spark, crowd):
    rows = vectors()
    got = {g["vec_id"]: tuple(g)[1:] for g in vector_dup.near_vectors(spark.createDataFrame(rows, SCHEMA).repartition(3), 0.98, crowd=crowd).collect()}
    good = [(i, np.array(v, float), y) for i, v, y, _ in rows if i is not None and y is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    top, links = {r[0]: r[0] for r in rows if r[0] is not None}, {r[0]: 0 for r in rows}

    def find(x):
        return x if top[x] == x else find(top[x])

    for k, (i, a, x) in enumerate(good):
        for j, b, y in good[:k]:
            if x == y and len(a) == len(b) and a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= 0.98:
                links[i] += 1
                links[j] += 1
                p, q = find(i), find(j)
                top[max(p, q)] = min(p, q)
    assert got == {i: (links[i], find(i) if i is not None else None, i is None or find(i) == i) for i in links}
    assert sum(links.values()) > 50


def test_near_vectors_of_an_empty_table(spark):
    assert vector_dup.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0


def test_huge_and_tiny_doubles_and_repeated_ids(spark):
    rows = [(1, [1e200, 2e200], "a"), (2, [1.0001e200, 2e200], "a"), (3, [1e-200, 2e-200], "a"), (4, [1e300, -1e300], "a"), (5, [5e-324, 1e-323], "a"), (6, [1.0, 2.0], "b"), (7, [1.0, 2.0], "b"), (7, [-2.0, 1.0], "b"), (8, [-2.0, 1.0], "b")]
    got = sorted(map(tuple, vector_dup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()))
    assert got == [(1, 3, 1, True), (2, 3, 1, False), (3, 3, 1, False), (4, 0, 4, True), (5, 3, 1, False), (6, 1, 6, True), (7, 1, 6, False), (7, 1, 7, True), (8, 1, 7, False)]


def test_pair_within_the_budget_shares_its_midpoints_cell():
    r = np.random.default_rng(1)
    a = vector_dup.units(r.normal(size=(300, 64)))
    b = vector_dup.units(a + 0.02 * r.normal(size=a.shape))
    ok = (a * b).sum(axis=1) >= 0.98
    x, y = vector_dup.rotated(a), vector_dup.rotated(b)
    edges, rad = vector_dup.block_edges(64), vector_dup.radius(0.98, 64)
    found = np.zeros(300, bool)
    for k in range(len(edges) - 1):
        near = ((x - y)[:, edges[k] : edges[k + 1]] ** 2).sum(axis=1) <= rad**2
        for n in (2, 4, 6):
            lead = slice(edges[k], edges[k] + n)
            of = []
            for v in (x, y):
                m = {i: set() for i in range(300)}
                for w, c in zip(*(z.tolist() for z in vector_dup.cells(v[:, lead], np.zeros(300, np.int64), rad))):
                    m[w].add(c)
                of.append(m)
            mid = vector_dup.middle(x[:, lead], y[:, lead], rad).tolist()
            assert all(mid[i] in of[0][i] & of[1][i] for i in np.flatnonzero(near & ok))
        found |= near
    assert ok.sum() > 100 and found[ok].all()


@pytest.mark.parametrize("name,kind", [("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word")])
def test_ids_equal_the_library(name, kind):
    path = pytest.importorskip("public_tokenizers").path(name)
    enc = tokens.Encoder(path, kind, cache_size=50)
    r = random.Random(5)
    parts = [" ", "  ", "\n", "\n\n", "\t", "\r\n", "a", "The", "quick", "it's", "IT'S", "x'll", "12", "3", "½", "é", "É", "ß", "İ", "日本", "😀", "é", "!!", "...", "<|endoftext|>", "<|", " ", "\u0085", "-", "_", "'", "''s", "ſ"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 12))) for _ in range(3000)]
    for t, ids in zip(texts, enc.encode(texts)):
        assert ids.tolist() == enc.tok.encode(t, add_special_tokens=False).ids, repr(t)


def test_word_hashes_depend_on_the_word_only():
    w = common.Words(["aa b\tcc\n", None, "", "x aa", " cc"])
    h = w.hashes()
    assert w.first.tolist() == [0, 3, 3, 3, 5, 6] and h[0] == h[4] and h[2] == h[5] and len(set(h.tolist())) == 4
    assert common.Words(["A"], lower=True).hashes()[0] == common.Words(["a"]).hashes()[0]
    assert len(common.Words([]).hashes()) == 0 and len(common.grams(h, 9)) == 0


def test_components(spark):
    r = random.Random(7)
    edges = [(i, i + 1) for i in range(0, 200) if i % 40] + [(r.randrange(300, 400), r.randrange(300, 400)) for _ in range(60)] + [(5, 5)]
    top = {}

    def find(x):
        top.setdefault(x, x)
        return x if top[x] == x else find(top[x])

    for a, b in edges:
        p, q = find(a), find(b)
        top[max(p, q)] = min(p, q)
    got = {g["id"]: g["component"] for g in common.components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}
    assert common.components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_other_tokenizer_files_go_through_the_library(tmp_path):
    import json

    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        d = json.load(f)
    assert tokens.known(path, "byte") and not tokens.known(path, "word")
    d["pre_tokenizer"]["add_prefix_space"] = True
    other = str(tmp_path / "other.json")
    with open(other, "w", encoding="utf-8") as f:
        json.dump(d, f)
    assert not tokens.known(other, "byte")
    from tokenizers import Tokenizer

    texts = ["hello world", "no space", "", "two  spaces\n"]
    want = [Tokenizer.from_file(other).encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in tokens.Encoder(other, "byte").encode(texts)] == want != [x.tolist() for x in tokens.Encoder(path, "byte").encode(texts)]
