"""Column functions against truth tables."""

import math
import random

import pytest
from pyspark.sql import functions as F

from assayloom.functions import measurements as M
from assayloom.functions import registry
from assayloom.functions import sequences as S
from assayloom.functions import vectors as V

INF = float("inf")


def values(spark, rows, schema, *cols):
    df = spark.createDataFrame(rows, schema).coalesce(1)
    return [tuple(r) if len(cols) > 1 else r[0] for r in df.select(*cols).collect()]


@pytest.mark.parametrize("text,low,high", [
    ("8", 8, 8), ("8.50", 8.5, 8.5), (" 8 ", 8, 8), ("8,5", 8.5, 8.5), ("4-8", 4, 8), ("4–8", 4, 8), ("<4-8", 0, 8), ("4->8", 4, INF), ("4.5.5", 4.5, 5), ("16=128", 16, 128),
    (">64", 64, INF), (">=64", 64, INF), ("≥64", 64, INF), ("> 64±3", 64, INF), ("<0.5", 0, 0.5), ("<=0.5", 0, 0.5), ("8±2", 6, 10), ("8 + 2", 6, 10), ("1±2", 0, 3), ("8±0,5", 7.5, 8.5),
    ("~8", 8, 8), ("1E6", 1, 1), ("up to 16", 0, 16), ("Up To 16", 0, 16), ("NA", None, None), ("", None, None), (None, None, None), ("-", None, None), ("abc", None, None), ("5d", None, None), ("1_0", None, None), ("≤5", None, None), ("4-x", None, None),
])
def test_parse_bounds(spark, text, low, high):
    got = values(spark, [(text,)], "t string", M.parse_bounds(F.col("t")))[0]
    assert (got["low"], got["high"]) == (low, high)
    assert got["reason"] == ("ok" if low is not None else "missing" if text in (None, "", "NA") else "unreadable")


def test_spread_of_zero(spark):
    """Only the compatible form deletes a spread of 0.0 from within longer ones."""
    rows = [("5±0.05",), ("8±0.0",), ("NANA",)]
    plain, compat = (values(spark, rows, "t string", M.parse_bounds(F.col("t"), compat=c)) for c in (False, True))
    assert [tuple(x)[:2] for x in plain] == [(4.95, 5.05), (8.0, 8.0), (None, None)] and plain[2]["reason"] == "unreadable"
    assert [tuple(x)[:2] for x in compat] == [(55.0, 55.0), (8.0, 8.0), (None, None)]


def test_numbers_as_text(spark):
    rows = [(" 12 ",), ("1.5",), ("1e3",), ("-2",), ("x",), ("",), (None,)]
    assert values(spark, rows, "t string", M.plain_number(F.col("t")), M.coerced(F.col("t"))) == [(True, 12.0), (True, 1.5), (False, 1000.0), (False, -2.0), (False, None), (False, None), (False, None)]
    assert values(spark, [(1234567,)], "n long", M.thousands(F.col("n"))) == ["1,234,567"]
    assert M.next_version("# Log\n## [1.2.9]\n## 1.2.10 - today\n") == "1.2.11" and M.next_version("") == "0.1.0"


def test_structure_tokens(spark):
    got = values(spark, [("C>>N",), ("C(=O)[nH]//Br%12",)], "s string", S.structure_tokens(F.col("s")))
    assert got == [["C", ">>", "N"], ["C", "(=O)", "[nH]", "//", "Br", "%12"]]


def test_run_names_and_padding(spark):
    rows = [("rdkit_vocab_cv",), ("rdkit_other_cv",), ("a_b",), ("x",)]
    assert values(spark, rows, "r string", S.pretty_label(F.col("r")), S.run_parts(F.col("r"))) == [("RDKit × vocab", ("rdkit", "vocab")), ("rdkit_other_cv", ("rdkit", "other")), ("a_b", None), ("x", None)]
    rows = [(" A", "A"), ("A", "A"), ("A", "A "), (None, "A")]
    assert values(spark, rows, "a string, b string", S.whitespace_state(F.col("a"), F.col("b"))) == ["as_expected", "source_copy_unexpectedly_cleaned", "final_dataset_unexpectedly_dirty", "missing_from_one_or_both_sources"]


def test_censoring_order(spark):
    rows = [(None, 1.0), (0.0, 0.0), (0.0, 4.0), (3.0, INF), (4.0, 4.0), (4.0, 8.0)]
    assert values(spark, rows, "a double, b double", M.censoring(F.col("a"), F.col("b"))) == ["missing", "censored", "censored", "censored", "exact", "ranged"]


def test_significant_digits_equal_printf(spark):
    r = random.Random(1)
    xs = [0.0, 12.35, 234500.0, -0.00123456, 1e-9, 999.5, 2.5e15, *[r.uniform(-1, 1) * 10 ** r.randint(-6, 9) for _ in range(300)]]
    got = values(spark, [(x,) for x in xs], "x double", M.significant(F.col("x")), M.significant(F.col("x"), 5))
    assert got == [(float("%.3g" % x), float("%.5g" % x)) for x in xs]
    assert values(spark, [(None,)], "x double", M.significant(F.col("x"))) == [None]


def test_units(spark):
    rows = [(5.0, "µM", None), (5.0, "µg/ml", 1000.0), (5.0, "µg/ml", 0.0), (5.0, "µg/ml", None), (5.0, "mg", 10.0)]
    assert values(spark, rows, "v double, u string, w double", M.micromolar(F.col("v"), F.col("u"), F.col("w"))) == [5.0, 5.0, None, None, None]


LABELS = [
    ("exact", 10.0, 32.0, 32.0, None, None, "active"), ("exact", 32.0, 32.0, 128.0, None, None, "active"), ("exact", 64.0, 32.0, 128.0, None, None, "uncertain"), ("averaged", 128.0, 32.0, 128.0, None, None, "inactive"),
    ("censored", None, 1.0, 20.0, 0.0, 0.5, "active"), ("censored", None, 10.0, 32.0, 20.0, INF, "uncertain"), ("censored", None, 10.0, 32.0, 32.0, INF, "inactive"), ("censored", None, 32.0, 50.0, 40.0, 60.0, "uncertain"),
    ("exact", 1.0, None, 5.0, None, None, "unlabeled"), ("exact", 1.0, 5.0, None, None, None, "unlabeled"),
]


@pytest.mark.parametrize("row", LABELS)
def test_labels(spark, row):
    cols = [F.col(c) for c in "kvailh"]
    assert values(spark, [row[:6]], "k string, v double, a double, i double, l double, h double", M.label(cols[0], cols[1], cols[2], cols[3], cols[4], cols[5])["label"]) == [row[6]]


@pytest.mark.parametrize("row", [("other", 1.0, 2.0, 3.0, None, None), ("censored", 1.0, 2.0, 3.0, None, 4.0), ("exact", None, 2.0, 3.0, None, None)])
def test_labels_raise(spark, row):
    cols = [F.col(c) for c in "kvailh"]
    with pytest.raises(Exception, match="measurement"):
        values(spark, [row], "k string, v double, a double, i double, l double, h double", M.label(cols[0], cols[1], cols[2], cols[3], cols[4], cols[5]))


def test_small_casts(spark):
    assert values(spark, [("0",), ("3.0",), ("",), (None,), ("x",)], "t string", M.fold_number(F.col("t"))) == [0, 3, None, None, None]
    assert values(spark, [("True",), ("False",), ("false ",), ("",), (None,)], "t string", M.flag(F.col("t"))) == [True, False, False, None, None]


def test_sequences(spark):
    rows = [("ACGTN",), ("acgtn",), ("",), (None,)]
    assert values(spark, rows, "s string", S.reverse_complement(F.col("s"))) == ["NACGT", "nacgt", "", None]
    assert values(spark, [("AAAA",), ("ACNGT",), ("A",), ("",), ("acg",)], "s string", S.kmers(F.col("s"), 2)) == [["AA", "AA", "AA"], ["AC", "GT"], [], [], ["AC", "CG"]]
    assert values(spark, [("ACD",), ("AcX",), ("AB1",)], "s string", S.residue_kinds(F.col("s")), S.outside_alphabet(F.col("s"))) == [("canonical", False), ("D-canonical-residue+other_unresolved(has_smiles)", True), ("dab+other_char:1", True)]
    assert values(spark, [(" D-orn ",), ("Dab",)], "s string", S.residue_code(F.col("s"))) == [("ORN", True), ("DAB", False)]
    assert values(spark, [("AXX", [(2, "ORN"), (3, "FOO")])], "s string, u array<struct<pos:int,name:string>>", S.common_sequence(F.col("s"), F.col("u"))) == ["AOX"]
    assert values(spark, [("CCO", "ACT", "AMD"), ("CCO", None, None)], "s string, n string, c string", S.with_termini(*map(F.col, "snc"))) == ["CC(=O)CCN", "CCO"]
    assert values(spark, [("Homo  sapiens x", " Homo s")], "a string, b string", S.binomial(F.col("a")), S.genus(F.col("b"))) == [("Homo ", "Homo")]
    assert values(spark, [("C[C@H](N)Cl",)], "s string", S.structure_tokens(F.col("s"))) == [["C", "[C@H]", "(N)", "Cl"]]
    assert values(spark, [("bad code: X (pos 2)",)], "s string", S.reason_group(F.col("s"))) == ["bad code"]


@pytest.mark.parametrize("cycle,chain,constraint", [("CST", None, "SS"), ("NCB", "MMB", "HT"), ("DKP", None, "HT"), ("LAC", "SSB", "SCSC"), ("LAC", "SMB", "SCNT_OR_SCCT"), ("LAC", "MMB", None), ("LAN", None, None), (None, None, None)])
def test_bonds(spark, cycle, chain, constraint):
    got = values(spark, [(cycle, chain)], "a string, b string", S.bond_class(F.col("a"), F.col("b")))[0]
    assert got["constraint"] == constraint and got["convertible"] == (constraint is not None) and bool(got["reason"]) == (constraint is None)


def test_baseline_rules_in_order(spark):
    rows = [("Monomer", None, None, "AC", 0, []), ("Dimer", "X", "X", "AX", 0, ["ABC"]), ("Monomer", "FOR", None, "AX", 0, []), ("Monomer", "ACT", "OME", "AC", 0, []), ("Monomer", "ACT", "AMD", "AX", 0, []), ("Monomer", None, None, "AX", 1, ["DSB", None])]
    got = values(spark, rows, "c string, n string, t string, s string, k int, b array<string>", S.baseline_check(*map(F.col, "cntskb")))
    assert got == [None, "non_monomer_complexity", "unsupported_nterminus", "unsupported_cterminus", "unresolved_residue_no_native_smiles", "nonstandard_bond_type"]


def test_vectors(spark):
    rows = [([3.0, 4.0], [0.0, 0.0])]
    got = values(spark, rows, "a array<double>, b array<double>", V.unit(F.col("a")), V.unit(F.col("b")), V.cosine(F.col("a"), F.col("a")), V.cosine(F.col("a"), F.col("b")), V.standardized(F.col("a"), F.lit([1.0, 2.0]), F.lit([2.0, 1.0])))[0]
    assert got == ([0.6, 0.8], [0.0, 0.0], 1.0, None, [1.0, 2.0])
    assert values(spark, [("a",), ("z",), (None,)], "x string", V.one_hot(F.col("x"), ["a", "b"])) == [[1.0, 0.0, 0.0], [0.0, 0.0, 1.0], [0.0, 0.0, 1.0]]
    with pytest.raises(Exception, match="differ in length"):
        values(spark, rows, "a array<double>, b array<double>", V.standardized(F.col("a"), F.lit([1.0]), F.lit([1.0])))
    assert values(spark, [(0.0,)], "x double", V.probability(F.col("x"))) == [0.5] and math.isclose(values(spark, [(2.0,)], "x double", V.probability(F.col("x")))[0], 1 / (1 + math.exp(-2)))


def test_registry():
    assert registry.organisms.names() == ["kmer", "table", "vocabulary"]
    with pytest.raises(ValueError, match="unknown"):
        registry.organisms.build("nothing")
    with pytest.raises(ValueError, match="already"):
        registry.organisms.register("kmer")(None)
