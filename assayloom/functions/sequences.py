"""Column functions for residue sequences, DNA and structure strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The residues of natural peptides, and a structure's tokens.
CANONICAL = "ACDEFGHIKLMNPQRSTVWY"
STRUCTURE_TOKEN = r"(\([^\(\)]{0,4}\)|\[[^\]]+]|Br?|Cl?|N|O|S|P|F|I|b|c|n|o|s|p|\(|\)|\.|=|#|-|\+|\\|\/\/?|:|~|@|\?|>>?|\*|\$|\%[0-9]{2}|[0-9])"


def reverse_complement(seq: Column) -> Column:
    """The other strand; case and N are kept."""
    return F.reverse(F.translate(seq, "ACGTacgtNn", "TGCAtgcaNn"))


def has_placeholder(seq: Column) -> Column:
    return F.upper(seq).contains("X")


def comparable(seq: Column) -> Column:
    """Upper-cased, null for sequences with a placeholder."""
    return F.when(~has_placeholder(seq), F.upper(seq))


def has_lowercase(seq: Column) -> Column:
    return seq.rlike(r"\p{Ll}")


def noncanonical(seq: Column, annotations: Column) -> Column:
    """Any annotated, lower-case or placeholder residue."""
    return (F.size(F.coalesce(annotations, F.array())) > 0) | F.coalesce(has_lowercase(seq) | has_placeholder(seq), F.lit(False))


def d_residue(seq: Column, names: Column) -> Column:
    """A lower-case residue or an annotation that starts with D-."""
    return F.coalesce(has_lowercase(seq), F.lit(False)) | F.coalesce(F.exists(names, lambda n: F.upper(n).startswith("D-")), F.lit(False))


def outside_alphabet(seq: Column) -> Column:
    return ~seq.rlike(f"^[{CANONICAL}]*$")


# What residues outside the natural ones are called.
RESIDUE_KINDS = {"O": "ornithine", "o": "ornithine", "B": "dab", "b": "dab", "X": "other_unresolved(has_smiles)"}
LOWERCASE_KIND, OTHER_KIND, NATURAL_KIND = "D-canonical-residue", "other_char:", "canonical"


def residue_kinds(seq: Column) -> Column:
    """Sorted, distinct kinds of the residues that are not natural, joined by +; canonical if there are none."""
    named = F.create_map(*[F.lit(x) for kv in RESIDUE_KINDS.items() for x in kv])
    kind = lambda c: F.coalesce(F.try_element_at(named, c), F.when(c.rlike(r"^\p{Ll}$"), F.lit(LOWERCASE_KIND)).otherwise(F.concat(F.lit(OTHER_KIND), c)))
    chars = F.filter(F.split(seq, ""), lambda c: (c != "") & ~F.lit(CANONICAL).contains(c))
    out = F.array_join(F.array_sort(F.array_distinct(F.transform(chars, kind))), "+")
    return F.when(out == "", NATURAL_KIND).otherwise(out)


def substitute(seq: Column, changes: Column) -> Column:
    """Residues replaced by position; changes is a map from 1-based positions to letters."""
    return F.array_join(F.transform(F.filter(F.split(seq, ""), lambda c: c != ""), lambda c, i: F.coalesce(F.try_element_at(changes, i + 1), c)), "")


def residue_code(code: Column) -> Column:
    """struct<code, is_d> with an optional D- taken off and upper case."""
    t = F.trim(code)
    return F.struct(F.upper(F.regexp_replace(t, "^[Dd]-", "")).alias("code"), t.rlike("^[Dd]-").alias("is_d"))


def with_termini(structure: Column, n: Column, c: Column) -> Column:
    """Acetyl at the start for ACT, an amide in place of the last character for AMD."""
    out = F.when(n == "ACT", F.concat(F.lit("CC(=O)"), structure)).otherwise(structure)
    return F.when(c == "AMD", F.concat(F.substr(out, F.lit(1), F.length(out) - 1), F.lit("N"))).otherwise(out)


def structure_tokens(structure: Column) -> Column:
    """Atom-level tokens in order."""
    return F.regexp_extract_all(structure, F.lit(STRUCTURE_TOKEN), F.lit(1))


def kmers(seq: Column, k: int) -> Column:
    """Overlapping windows of k letters that hold only A, C, G and T."""
    # a look-ahead finds overlapping windows in one pass over the text
    return F.regexp_extract_all(F.upper(seq), F.lit(f"(?=([ACGT]{{{k}}}))"), F.lit(1))


def genus(organism: Column) -> Column:
    return F.substring_index(F.trim(organism), " ", 1)


def binomial(organism: Column) -> Column:
    return F.substring_index(organism, " ", 2)


def reason_group(reason: Column) -> Column:
    """What stands before the first colon and bracket."""
    return F.trim(F.substring_index(F.substring_index(reason, ":", 1), "(", 1))


def sequence_id(seq: Column) -> Column:
    return F.sha2(seq, 256)


# Cycle types by the ring they close, and single-letter residue codes.
DISULFIDE_CYCLES = ["CST"]
BACKBONE_CYCLES = ["NCB", "DKP"]
LACTAM_CYCLES = ["LAC"]
UNSUPPORTED_CYCLES = ["LAN", "MeLAN", "SCT", "LTN"]  # no structure can be generated for these
COMMON_CODES = {"ORN": "O", "D-ORN": "o", "DAB": "B", "D-DAB": "b"}


#: What a bond becomes by cycle type and chain; * stands for any chain.
BOND_TABLE = {
    **{(c, "*"): "SS" for c in DISULFIDE_CYCLES},
    **{(c, "*"): "HT" for c in BACKBONE_CYCLES},
    **{(c, "SSB"): "SCSC" for c in LACTAM_CYCLES},
    **{(c, "SMB"): "SCNT_OR_SCCT" for c in LACTAM_CYCLES},
}


def bond_class(cycle: Column, chain: Column) -> Column:
    """struct<constraint, convertible, reason> of one intrachain bond, from its cycle type and the chains that take part."""
    known = F.create_map(*[x for (c, h), v in BOND_TABLE.items() for x in (F.lit(f"{c}|{h}"), F.lit(v))])
    name = lambda c: F.coalesce(c, F.lit("none"))
    found = F.coalesce(F.try_element_at(known, F.concat_ws("|", name(cycle), F.lit("*"))), F.try_element_at(known, F.concat_ws("|", name(cycle), name(chain))))
    why = F.when(cycle.isin(LACTAM_CYCLES), F.concat(F.lit("lactam with chain "), name(chain))).when(cycle.isin(UNSUPPORTED_CYCLES), F.concat(F.lit("no generator for cycle type "), cycle)).otherwise(F.concat(F.lit("unknown cycle type "), name(cycle)))
    return F.struct(found.alias("constraint"), found.isNotNull().alias("convertible"), F.when(found.isNull(), why).otherwise("").alias("reason"))


def common_sequence(seq: Column, unusual: Column) -> Column:
    """Annotated positions (array of struct<pos, name>) with a single-letter code replaced by it; others stay."""
    codes = F.create_map(*[F.lit(x) for kv in COMMON_CODES.items() for x in kv])
    known = F.filter(F.coalesce(unusual, F.array().cast("array<struct<pos:int,name:string>>")), lambda u: F.try_element_at(codes, u["name"]).isNotNull())
    return substitute(seq, F.map_from_entries(F.transform(known, lambda u: F.struct(u["pos"], F.try_element_at(codes, u["name"])))))


def baseline_check(complexity: Column, n_terminus: Column, c_terminus: Column, common: Column, n_structures: Column, bond_types: Column) -> Column:
    """First reason why a record would not be in the baseline; null if it would be."""
    from .measurements import first_failure

    return first_failure(
        (~complexity.eqNullSafe("Monomer"), "non_monomer_complexity"),
        (n_terminus.isNotNull() & (n_terminus != "ACT"), "unsupported_nterminus"),
        (c_terminus.isNotNull() & (c_terminus != "AMD"), "unsupported_cterminus"),
        (has_placeholder(common) & (n_structures == 0), "unresolved_residue_no_native_smiles"),
        (F.exists(bond_types, lambda b: ~F.coalesce(b.isin("DSB", "AMD"), F.lit(False))), "nonstandard_bond_type"),
    )


# Featurizers by the names that run ids use, and how tables show them.
PEPTIDE_NAMES = {"rdkit": "RDKit", "peptideclm": "PeptideCLM", "molgraph": "MolGraph"}
ORGANISM_NAMES = {"vocab": "vocab", "kmer": "k-mer", "dnabert": "DNABERT-S"}


def pretty_label(run: Column) -> Column:
    """"rdkit_vocab_cv" as "RDKit × vocab"; a name that does not follow that form stays."""
    table = lambda m: F.create_map(*[F.lit(x) for kv in m.items() for x in kv])
    parts = F.split(F.regexp_replace(run, "_cv$", ""), "_")
    a, b = F.try_element_at(table(PEPTIDE_NAMES), F.element_at(parts, 1)), F.try_element_at(table(ORGANISM_NAMES), F.try_element_at(parts, F.lit(2)))
    return F.when((F.size(parts) == 2) & a.isNotNull() & b.isNotNull(), F.concat(a, F.lit(" × "), b)).otherwise(run)


def run_parts(run: Column) -> Column:
    """struct<peptide, organism> of "<peptide>_<organism>_cv", null for any other form."""
    parts = F.split(run, "_")
    fits = (F.size(parts) == 3) & F.try_element_at(parts, F.lit(3)).eqNullSafe("cv")
    return F.when(fits, F.struct(F.element_at(parts, 1).alias("peptide"), F.try_element_at(parts, F.lit(2)).alias("organism")))


def padded(seq: Column) -> Column:
    """Whether white space stands around a sequence."""
    return seq != F.regexp_replace(seq, r"^\s+|\s+$", "")


def whitespace_state(source: Column, final: Column) -> Column:
    """How a sequence that is padded at its source came through: one of five states."""
    return (
        F.when(source.isNull() | final.isNull(), "missing_from_one_or_both_sources").when(padded(final), "final_dataset_unexpectedly_dirty")
        .when(padded(source), "as_expected").when(~padded(source), "source_copy_unexpectedly_cleaned").otherwise("unexpected_state")
    )
