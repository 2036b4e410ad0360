"""Identity graphs, generated structures, canonical texts and fingerprints against plain versions."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from assayloom.operators import features, identity, similarity, structures

LETTERS = "ACDEFGHIKLMNPQRSTVWY"


def plain_identity(rows, threshold, **how):
    """Links of all different sequences by aligning every pair, and each copy with the first of its sequence."""
    up = {k: s.upper() for k, s in rows if k is not None and s and "X" not in s.upper()}
    first = {}
    for k in sorted(up):
        first.setdefault(up[k], k)
    pairs = [(min(i, j), max(i, j), a, b) for (a, i), (b, j) in itertools.combinations(first.items(), 2)]
    same = similarity.align_identities([p[2] for p in pairs], [p[3] for p in pairs], **how)
    out = {(i, j): s for (i, j, *_), s in zip(pairs, same) if s >= threshold}
    return out | {(first[s], k): 1.0 for k, s in up.items() if first[s] != k}


def sequences(seed):
    r = random.Random(seed)
    rows = ["".join(r.choice("ACDE") for _ in range(r.randint(1, 12))) for _ in range(160)]
    rows += ["ACDEF", "AGDHF", "ACB", "ADB", "K", "K", "k", "X", "AXB", "axb", "", None, "A" * 60, "A" * 36, "A" * 37, "A" * 30 + "C" * 30]
    for _ in range(40):
        s = [r.choice(LETTERS) for _ in range(r.randint(8, 45))]
        rows.append("".join(s))
        for _ in range(r.randint(1, len(s) // 2)):
            at = r.randrange(len(s))
            s[at : at + r.randint(0, 2)] = [r.choice(LETTERS) for _ in range(r.randint(0, 2))]
        rows.append("".join(s))
    return list(enumerate(rows))


@pytest.mark.parametrize(("threshold", "cell"), [(0.6, 512), (0.6, 3), (0.3, 7), (0.9, 512)])
def test_identity_pairs_lose_no_link(spark, monkeypatch, threshold, cell):
    monkeypatch.setattr(identity, "CELL", cell)
    rows = sequences(int(threshold * 10))
    df = spark.createDataFrame(rows, "k long, s string").repartition(4)
    got = {(x["i"], x["j"]): x["similarity"] for x in similarity.identity_pairs(df, "k", "s", threshold).collect()}
    assert got == plain_identity(rows, threshold) and len(got) > 4


def test_identity_with_a_substitution_table(spark):
    scores = {"AC": 3.0, "AA": 2.0, "CC": 2.0, "AD": -2.0, "CD": -1.0, "DD": 4.0}
    rows = [(k, s) for k, s in sequences(3) if s and set(s) <= set("ACD")]
    df = spark.createDataFrame(rows, "k long, s string")
    got = {(x["i"], x["j"]): x["similarity"] for x in similarity.identity_pairs(df, "k", "s", 0.6, scores=scores, gap_open=3.0, gap_extend=0.5).collect()}
    assert got == plain_identity(rows, 0.6, scores=scores, gap_open=3.0, gap_extend=0.5)


def test_identity_of_awkward_tables(spark):
    empty = spark.createDataFrame([], "k long, s string")
    assert similarity.identity_pairs(empty, "k", "s", 0.6).count() == 0
    same = spark.createDataFrame([(k, "ACDEFGHIKL") for k in range(4000)] + [(None, "ACDEFGHIKL"), (9000, "ACDEFGHIKV")], "k long, s string")
    got = similarity.identity_pairs(same, "k", "s", 0.6)
    assert got.count() == 4000 and got.where("similarity < 1").collect()[0][:2] == (0, 9000)
    with pytest.raises(ValueError, match="threshold"):
        similarity.identity_pairs(same, "k", "s", 0.0)


def test_common_grams_is_a_lower_bound(spark):
    """Whatever an alignment looks like, the sequences that it came from share as many grams as the lemma says."""
    r = random.Random(9)
    cases = []
    for _ in range(300):
        columns = [(c, c if r.random() < 0.8 else r.choice([r.choice(LETTERS), None])) for c in (r.choice("ACD") for _ in range(r.randint(1, 30)))]
        x, y = "".join(a for a, _ in columns), "".join(b for _, b in columns if b)
        if y:
            cases.append((x, y, sum(a == b for a, b in columns) / len(columns)))
    n = spark.createDataFrame([(len(x),) for x, *_ in cases], "n int")
    for q in (1, 2, 3):
        for t in (0.6, 0.7, 0.85):
            if q * (1 - t) <= 1:
                need = [v[0] for v in n.select(identity.common_grams(F.col("n"), q, t)).collect()]
                for (x, y, same), k in zip(cases, need):
                    if same >= t:
                        bag = lambda s: sorted(s[i : i + q] for i in range(len(s) - q + 1))
                        a, b = bag(x), bag(y)
                        assert sum(min(a.count(g), b.count(g)) for g in set(a)) >= k


# structures


def make(spark, rows):
    df = spark.createDataFrame(rows, "id long, letters string, n string, c string, k string, one int, two int")
    return {x["id"]: x["s"] for x in df.select("id", structures.peptide_structure(*map(F.col, ("letters", "n", "c", "k", "one", "two"))).alias("s")).collect()}


def test_generated_structures(spark):
    none = (None, None, None, None, None)
    got = make(spark, [
        (1, "G", *none), (2, "GA", *none), (3, "Aa", "ACT", "AMD", None, None, None), (4, "GGG", None, None, "HT", None, None), (5, "CGc", None, None, "SS", 1, 3), (6, "PG", None, None, None, None, None),
        (7, "GZ", *none), (8, "", *none), (9, None, *none), (10, "CGC", None, None, "SS", 1, 2), (11, "CGC", None, None, "SS", 1, 9), (12, "GGG", "ACT", None, "HT", None, None), (13, "GA", "FOO", None, None, None, None),
        (14, "GA", None, None, "SCSC", 1, 2), (15, "CGC", None, None, "SS", 0, 3), (16, "PGG", None, None, "HT", None, None), (17, "CC", None, None, "SS", 1, 1), (18, "g", *none),
    ])
    assert got[1] == "NCC(=O)O" and got[2] == "NCC(=O)N[C@@H](C)C(=O)O" and got[3] == "CC(=O)N[C@@H](C)C(=O)N[C@H](C)C(=O)N"
    assert got[4] == "N9CC(=O)NCC(=O)NCC9=O" and got[5] == "N[C@@H](CS8)C(=O)NCC(=O)N[C@H](CS8)C(=O)O" and got[6].startswith("N1CCC[C@H]1C(=O)NCC")
    assert [k for k, v in got.items() if v is None] == [7, 8, 9, 10, 11, 12, 13, 14, 15, 17, 18]
    assert structures.canonical_text(got[16]) == structures.canonical_text(make(spark, [(1, "GGP", None, None, "HT", None, None)])[1])
    assert features.structure_weight(got[1]) == pytest.approx(75.067, abs=1e-3) and features.structure_weight(got[4]) == pytest.approx(3 * 57.052, abs=1e-2)


def other_spelling(r, text, monkeypatch):
    """A structure written in a walk from any atom, with the neighbours in any order."""
    atoms, bonds = features.parse_structure(text)
    for a in atoms:
        if len(a["near"]) + a["h"] != 4 or a["h"] > 1:
            a["chiral"] = ""
    ranks = list(range(len(atoms)))
    r.shuffle(ranks)
    with monkeypatch.context() as m:
        m.setattr(structures, "canonical_ranks", lambda *_: ranks)
        return structures.write_structure(atoms, bonds)


def test_canonical_texts(monkeypatch):
    r = random.Random(2)
    linear = lambda s: "".join("N" + structures.FRAGMENTS[c] + "C(=O)" for c in s) + "O"
    ring = lambda s: "".join("N" + "9" * (k == 0) + structures.FRAGMENTS[c] + ("C9=O" if k == len(s) - 1 else "C(=O)") for k, c in enumerate(s))
    for _ in range(60):
        s = "".join(r.choice(structures.ALPHABET) for _ in range(r.randint(1, 8)))
        for text in (linear(s), ring(s + "GAv")):
            one = structures.canonical_text(text)
            assert structures.canonical_text(one) == one and features.structure_weight(one) == pytest.approx(features.structure_weight(text))
            for _ in range(3):
                assert structures.canonical_text(other_spelling(r, text, monkeypatch)) == one
        c, k = s + "GAv", r.randrange(len(s) + 3)
        assert structures.canonical_text(ring(c)) == structures.canonical_text(ring(c[k:] + c[:k]))
        assert (structures.canonical_text(linear(s)) == structures.canonical_text(structures._mirrored(linear(s)))) == ("@" not in linear(s))
    rings = {x: structures.canonical_text(ring(x)) for x in ("AaAa", "aAaA", "AAaa", "AaaA", "AAAA", "aaaa")}
    assert rings["AaAa"] == rings["aAaA"] and rings["AAaa"] == rings["AaaA"] and len(set(rings.values())) == 4
    same = [["OCC", "CCO", "C(O)C"], ["c1ccccc1-c1ccccc1", "c1cc(ccc1)-c2ccccc2"], ["[NH4+].[Cl-]", "[Cl-].[NH4+]"], ["N#CC([O-])=O", "O=C([O-])C#N"], ["c1cc[nH]c1", "[nH]1cccc1"], ["N[C@@H](C)C(=O)O", "OC(=O)[C@@H](N)C", "C[C@H](N)C(O)=O", "[C@H](N)(C)C(O)=O"]]
    assert all(len({structures.canonical_text(x) for x in g}) == 1 for g in same) and len({structures.canonical_text(g[0]) for g in same}) == len(same)
    assert structures.canonical_text("C(") is None and structures.canonical_text("") is None and structures.canonical_text(None) is None
    # an atom with a hydrogen at the start of the text, and a centre that is none
    assert structures.canonical_text("[C@@H](C)(C)O") == structures.canonical_text("CC(C)O")


def test_integrity(spark):
    rows = [(1, "NCC(=O)O", 75.067), (2, "NCC(=O)O", 75.2), (3, "NCC(", 1.0), (4, None, 1.0), (5, "OC(=O)CN", 75.0671)]
    got = {x["id"]: (x["parses"], x["weight_ok"], x["stable"]) for x in structures.with_integrity(spark.createDataFrame(rows, "id long, smiles string, w double"), "smiles", "w").collect()}
    assert got == {1: (True, True, True), 2: (True, False, True), 3: (False, None, None), 4: (False, None, None), 5: (True, True, True)}


def plain_environments(atoms, bonds, radius):
    """Surroundings as nested tuples, by recursion from every atom."""
    ring = features.ring_bonds(len(atoms), bonds)

    def seen(i, k):
        if not k:
            own = [b for b, r in zip(bonds, ring) if r and i in b[:2]]
            a = atoms[i]
            return (a["symbol"], a["aromatic"], a["h"], a["charge"], sum(i in b[:2] for b in bonds), bool(own))
        return (k, seen(i, k - 1), tuple(sorted(((o, seen(q if p == i else p, k - 1)) for p, q, o in bonds if i in (p, q)), key=repr)))

    return [[seen(i, k) for i in range(len(atoms))] for k in range(radius + 1)]


def test_fingerprints(spark, monkeypatch):
    r = random.Random(4)
    texts = ["".join("N" + structures.FRAGMENTS[r.choice(structures.ALPHABET)] + "C(=O)" for _ in range(r.randint(1, 4))) + "O" for _ in range(40)]
    for text in texts[:15]:
        atoms, bonds = features.parse_structure(text)
        # equal surroundings have equal hashes, and different ones different hashes
        for hashes, plain in zip(structures.environments(atoms, bonds, 2), plain_environments(atoms, bonds, 2)):
            assert len(set(zip(hashes, map(repr, plain)))) == len(set(hashes)) == len(set(map(repr, plain)))
        assert structures.fingerprint_bits(other_spelling(r, text, monkeypatch)) == structures.fingerprint_bits(text)
    assert structures.fingerprint_bits("CC") != structures.fingerprint_bits("CCO") and structures.fingerprint_bits("C(") is None
    rows = [*enumerate(texts), (100, texts[0]), (101, "C("), (102, None), (103, other_spelling(r, texts[1], monkeypatch))]
    got = {(x["i"], x["j"]): x["similarity"] for x in structures.fingerprint_links(spark.createDataFrame(rows, "k long, s string"), "k", "s", 0.6).collect()}
    bits = {k: frozenset(b) for k, s in rows if (b := structures.fingerprint_bits(s))}
    first = {}
    for k in sorted(bits):
        first.setdefault(bits[k], k)
    want = {(min(i, j), max(i, j)): len(a & b) / len(a | b) for (a, i), (b, j) in itertools.combinations(first.items(), 2) if len(a & b) / len(a | b) >= 0.6}
    assert got == pytest.approx(want | {(first[b], k): 1.0 for k, b in bits.items() if first[b] != k}) and len(want) > 5
