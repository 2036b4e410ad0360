"""Structures of peptides: generation from residues, canonical texts, and circular fingerprints."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.sequences import with_termini
from ..sources.scratch import stored
from .features import implied_hydrogens, molecular_weight, parse_structure, ring_bonds

# Side chains by residue, what stands between a residue's nitrogen and its carbonyl carbon.
SIDE_CHAINS = {
    "A": "[C@@H](C)", "R": "[C@@H](CCCNC(=N)N)", "N": "[C@@H](CC(=O)N)", "D": "[C@@H](CC(=O)O)", "C": "[C@@H](CS)", "E": "[C@@H](CCC(=O)O)", "Q": "[C@@H](CCC(=O)N)", "G": "C",
    "H": "[C@@H](Cc1c[nH]cn1)", "I": "[C@@H]([C@@H](C)CC)", "L": "[C@@H](CC(C)C)", "K": "[C@@H](CCCCN)", "M": "[C@@H](CCSC)", "F": "[C@@H](Cc1ccccc1)", "P": "1CCC[C@H]1",
    "S": "[C@@H](CO)", "T": "[C@@H]([C@H](O)C)", "W": "[C@@H](Cc1c[nH]c2ccccc12)", "Y": "[C@@H](Cc1ccc(O)cc1)", "V": "[C@@H](C(C)C)", "O": "[C@@H](CCCN)", "B": "[C@@H](CCN)",
}
#: Digits of the rings that bonds between residues close; residues use 1 and 2.
_TAIL, _BRIDGE = "9", "8"


def _mirrored(text: str) -> str:
    """A fragment with every centre turned over."""
    return text.replace("@@", "%").replace("@", "@@").replace("%", "@")


#: By letter, the D forms in lower case; glycine has none.
FRAGMENTS = {**SIDE_CHAINS, **{k.lower(): _mirrored(v) for k, v in SIDE_CHAINS.items() if "@" in v}}
ALPHABET = "".join(FRAGMENTS)


def peptide_structure(letters: Column, n_terminus: Column, c_terminus: Column, constraint: Column, first: Column, second: Column) -> Column:
    """The SMILES text of a peptide from its letters, joined residue by residue.

    constraint: null for a linear peptide, HT for one whose ends are joined, SS
    for a bridge between the cysteines at the 1-based positions first and second;
    anything else gives null, as do unknown letters, an empty sequence, a bridge
    whose ends are no two cysteines, and changed termini of joined ends. ACT and
    AMD are the termini that can be changed.
    """
    table = F.create_map(*[F.lit(x) for kv in FRAGMENTS.items() for x in kv])
    chars = F.filter(F.split(letters, ""), lambda c: c != "")
    n = F.size(chars)
    tail, bridge = F.coalesce(constraint == "HT", F.lit(False)), F.coalesce(constraint == "SS", F.lit(False))

    def residue(c: Column, i: Column) -> Column:
        body = F.try_element_at(table, c)
        body = F.when(bridge & ((i + 1 == first) | (i + 1 == second)), F.regexp_replace(body, "S\\)$", f"S{_BRIDGE})")).otherwise(body)
        carbon = F.when(tail & (i == n - 1), f"C{_TAIL}=O").otherwise("C(=O)")
        return F.concat(F.lit("N"), F.when(tail & (i == 0), _TAIL).otherwise(""), body, carbon)

    parts = F.transform(chars, residue)
    text = F.concat(F.array_join(parts, ""), F.when(tail, "").otherwise("O"))
    cysteine = lambda p: F.coalesce(F.lower(F.try_element_at(chars, p)) == "c", F.lit(False))
    fits = F.when(constraint.isNull(), True).when(tail, (n > 2) & n_terminus.isNull() & c_terminus.isNull()).when(bridge, cysteine(F.greatest(first, F.lit(1))) & cysteine(F.greatest(second, F.lit(1))) & (first != second) & (F.least(first, second) >= 1)).otherwise(False)
    ends = (n_terminus.isNull() | (n_terminus == "ACT")) & (c_terminus.isNull() | (c_terminus == "AMD"))
    known = (n > 0) & ~F.exists(chars, lambda c: F.try_element_at(table, c).isNull())
    return F.when(F.coalesce(known & fits & ends, F.lit(False)), with_termini(text, n_terminus, c_terminus))


# canonical texts


def _odd(a: list, b: list) -> bool:
    """Whether an odd number of swaps leads from one order to the other."""
    at = [b.index(x) for x in a]
    return sum(p > q for k, p in enumerate(at) for q in at[k + 1 :]) % 2 == 1


def _around(a: dict) -> list:
    """An atom's neighbours in the order that its chirality refers to; "H" is its hydrogen, which stands behind the atom before."""
    near = list(a["near"])
    return [*near[: a["lead"]], "H", *near[a["lead"] :]] if a["h"] else near


def _turn(a: dict, order: list) -> str:
    """The mark of a centre whose neighbours come in another order."""
    mark = a["chiral"]
    return {"@": "@@", "@@": "@"}[mark] if _odd(_around(a), order) else mark


class _Cells:
    """Atoms in cells of equal rank; a rank is the number of atoms in the cells before, so that a split changes the ranks of its own atoms only."""

    def __init__(self, keys: list):
        self.ranks = [0] * len(keys)
        self.of = {0: list(range(len(keys)))}
        self.split(0, keys.__getitem__)

    def split(self, cell: int, key) -> list[int]:
        """Parts a cell by its atoms' keys, in their order; gives the atoms whose rank changes."""
        groups: dict = {}
        for k in self.of[cell]:
            groups.setdefault(key(k), []).append(k)
        changed, at = [], cell
        if len(groups) > 1:
            for g in sorted(groups):
                self.of[at] = groups[g]
                if at != cell:
                    changed += groups[g]
                    for k in groups[g]:
                        self.ranks[k] = at
                at += len(groups[g])
        return changed


def canonical_ranks(atoms: list[dict], bonds: list[tuple[int, int, float]]) -> list[int]:
    """A rank for each atom that depends on the structure alone, up to its symmetries.

    Ranks are refined by the neighbours' ranks until they settle; centres whose
    neighbours differ are then told apart by their sense; one atom of the least
    tied rank is put behind the others, and so on until no ties are left. Only
    cells that have a neighbour whose rank has changed are looked at again.
    """
    order = [{} for _ in atoms]
    for i, j, o in bonds:
        order[i][j] = order[j][i] = o
    ring = ring_bonds(len(atoms), bonds)
    cyclic = [False] * len(atoms)
    for (i, j, _), r in zip(bonds, ring):
        cyclic[i], cyclic[j] = cyclic[i] or r, cyclic[j] or r
    cells = _Cells([(a["symbol"], a["aromatic"], a["h"], a["charge"], len(order[k]), cyclic[k]) for k, a in enumerate(atoms)])
    ranks = cells.ranks

    def sense(k: int) -> str:
        around = _around(atoms[k])
        by = [-1 if x == "H" else ranks[x] for x in around]
        return _turn(atoms[k], [x for _, x in sorted(zip(by, around), key=lambda p: p[0])]) if len(set(by)) == len(by) else ""

    centres = [k for k, a in enumerate(atoms) if a["chiral"]]
    in_rings = {(min(i, j), max(i, j)) for (i, j, _), r in zip(bonds, ring) if r}
    changed, broken = list(range(len(atoms))), False
    while True:
        while changed:
            near = sorted({ranks[j] for k in changed for j in order[k]})
            now = list(ranks)  # all cells of a round see the same ranks
            changed = [k for c in near if len(cells.of[c]) > 1 for k in cells.split(c, lambda k: tuple(sorted((o, now[j]) for j, o in order[k].items())))]
        tied = sorted({ranks[k] for k in centres if len(cells.of[ranks[k]]) > 1})
        senses = {k: sense(k) for c in tied for k in cells.of[c]}
        changed = [k for c in tied for k in cells.split(c, senses.__getitem__)]
        if changed:
            continue
        # before any tie is broken: equal branches outside of rings make no centre
        for k in centres if not broken else []:
            out = [ranks[j] for j in order[k] if (min(j, k), max(j, k)) not in in_rings]
            if len(set(out)) < len(out):
                atoms[k]["chiral"] = ""
        broken = True
        tie = min((c for c, own in cells.of.items() if len(own) > 1), default=None)
        if tie is None:
            return ranks
        last = cells.of[tie][0]
        changed = cells.split(tie, lambda k: k == last)


_PLAIN = {"B", "C", "N", "O", "P", "S", "F", "Cl", "Br", "I"}


def write_structure(atoms: list[dict], bonds: list[tuple[int, int, float]]) -> str:
    """The canonical text of a structure: a walk by rank from the least one, parts in order of their texts."""
    ranks = canonical_ranks(atoms, bonds)
    order = [{} for _ in atoms]
    for i, j, o in bonds:
        order[i][j] = order[j][i] = o
    by_rank = [sorted(order[k], key=ranks.__getitem__) for k in range(len(atoms))]
    seen, texts = set(), []
    for root in sorted(range(len(atoms)), key=ranks.__getitem__):
        if root in seen:
            continue
        # the walk's tree, and the bonds that close rings by the atoms where they open and end
        children, closes, opens, at = {root: []}, {}, {}, {root: 0}
        stack = [(root, None, iter(by_rank[root]))]
        while stack:
            v, by, rest = stack[-1]
            for w in rest:
                if w == by:
                    continue
                if w not in at:
                    at[w] = len(at)
                    children[v].append(w)
                    children[w] = []
                    stack.append((w, v, iter(by_rank[w])))
                    break
                if at[w] < at[v]:
                    opens.setdefault(w, []).append(v)
                    closes.setdefault(v, []).append(w)
            else:
                stack.pop()
        seen |= set(at)
        texts.append(_text(root, atoms, order, children, opens, closes, at))
    return ".".join(sorted(texts))


def _atom(a: dict, chiral: str, used: float) -> str:
    name = a["symbol"].lower() if a["aromatic"] else a["symbol"]
    if not chiral and not a["charge"] and a["symbol"] in _PLAIN and implied_hydrogens(a["symbol"], a["aromatic"], used) == a["h"]:
        return name
    h = "" if not a["h"] else "H" if a["h"] == 1 else f"H{a['h']}"
    charge = "" if not a["charge"] else f"{a['charge']:+d}".replace("+1", "+").replace("-1", "-")
    return f"[{name}{chiral}{h}{charge}]"


def _bond(o: float, a: dict, b: dict) -> str:
    both = a["aromatic"] and b["aromatic"]
    return {2.0: "=", 3.0: "#", 1.5: "" if both else ":", 1.0: "-" if both else ""}[o]


def _text(root, atoms, order, children, opens, closes, at) -> str:
    digits: dict[tuple[int, int], int] = {}
    used: set[int] = set()
    label = lambda d: str(d) if d < 10 else f"%{d}"
    out, stack = [], [(root, None, "")]
    while stack:
        v, by, bracket = stack.pop()
        if v is None:
            out.append(bracket)
            continue
        ends = sorted(closes.get(v, []), key=at.__getitem__)
        begins = sorted(opens.get(v, []), key=at.__getitem__)
        a = atoms[v]
        around = [*([by] if by is not None else []), *(["H"] if a["h"] else []), *ends, *begins, *children[v]]
        chiral = _turn(a, around) if a["chiral"] else ""
        out.append((_bond(order[by][v], atoms[by], a) if by is not None else "") + _atom(a, chiral, sum(order[v].values())))
        for w in ends:
            d = digits.pop((w, v))
            out.append(label(d))
            used.discard(d)
        for w in begins:
            d = next(d for d in range(1, 100) if d not in used and d not in digits.values())
            digits[v, w] = d
            used.add(d)
            out.append(_bond(order[v][w], a, atoms[w]) + label(d))
        for k, w in enumerate(reversed(children[v])):
            if k:
                stack += [(None, None, ")"), (w, v, ""), (None, None, "(")]
            else:
                stack.append((w, v, ""))
    return "".join(out)


@lru_cache(maxsize=4096)
def canonical_text(text: str | None) -> str | None:
    """The one text of all spellings of a structure; null if it can't be read. Geometry of double bonds and isotopes are not kept."""
    got = parse_structure(text) if text else None
    if not got:
        return None
    atoms, bonds = got
    for a in atoms:
        if len(a["near"]) + a["h"] != 4 or a["h"] > 1:
            a["chiral"] = ""  # no centre
    return write_structure(atoms, bonds)


@F.pandas_udf(T.StringType())
def canonical(smiles: pd.Series) -> pd.Series:
    return pd.Series([canonical_text(s) for s in smiles], dtype=object)


def _per_structure(df: DataFrame, smiles: str, **make: Column) -> DataFrame:
    """df with further columns that are made once for each different structure, spread over all cores."""
    n = df.sparkSession.sparkContext.defaultParallelism
    each = df.select(F.col(smiles).alias("_smiles")).where("_smiles is not null").distinct().repartition(n, "_smiles").select("_smiles", *[c.alias(k) for k, c in make.items()])
    # what is made is larger than the texts that it is made of, by which Spark would choose to broadcast it
    return df.join(each.hint("merge"), df[smiles] == each["_smiles"], "left").drop("_smiles")


def with_canonical(df: DataFrame, smiles: str) -> DataFrame:
    """df with canonical, the one text of all spellings of each structure; null where it can't be read."""
    return _per_structure(df, smiles, canonical=canonical(F.col("_smiles")))


def with_integrity(df: DataFrame, smiles: str, weight: str, tolerance: float = 1e-3) -> DataFrame:
    """df with parses, weight_ok (the recorded weight is that of the structure within tolerance) and stable (its canonical text reads back as itself).

    A structure that is null or can't be read parses not; the others are null then.
    """
    own = F.col("_smiles")
    d = _per_structure(df, smiles, _weight=molecular_weight(own), _stable=_reads_back(own))
    read = F.col("_weight").isNotNull()
    out = d.withColumn("parses", read).withColumn("weight_ok", F.when(read, F.abs(F.col("_weight") - F.col(weight)) <= tolerance))
    return out.withColumn("stable", F.when(read, F.col("_stable"))).drop("_weight", "_stable")


@F.pandas_udf(T.BooleanType())
def _reads_back(smiles: pd.Series) -> pd.Series:
    texts = [canonical_text(s) for s in smiles]
    return pd.Series([t is not None and canonical_text(t) == t for t in texts])


# circular fingerprints


@lru_cache(maxsize=1 << 18)  # surroundings recur; equal values are of equal types
def _hash(*values) -> int:
    return int.from_bytes(hashlib.blake2b(repr(values).encode(), digest_size=8).digest(), "little")


def environments(atoms: list[dict], bonds: list[tuple[int, int, float]], radius: int = 2) -> list[list[int]]:
    """Hashes of each atom's surroundings, one list for each radius from 0 on: its own kind, then its hash and those of its neighbours with their bonds."""
    near: list[list[tuple[float, int]]] = [[] for _ in atoms]
    ring = ring_bonds(len(atoms), bonds)
    cyclic = [False] * len(atoms)
    for (i, j, o), r in zip(bonds, ring):
        near[i].append((o, j))
        near[j].append((o, i))
        cyclic[i], cyclic[j] = cyclic[i] or r, cyclic[j] or r
    out = [[_hash(a["symbol"], a["aromatic"], a["h"], a["charge"], len(n), c) for a, n, c in zip(atoms, near, cyclic)]]
    for k in range(1, radius + 1):
        now = out[-1]
        out.append([_hash(k, now[i], *sorted((o, now[j]) for o, j in n)) for i, n in enumerate(near)])
    return out


@lru_cache(maxsize=4096)
def fingerprint_bits(text: str | None, radius: int = 2, n_bits: int = 2048) -> tuple[int, ...] | None:
    """The positions that are set in a structure's circular fingerprint, in order; null if it can't be read."""
    got = parse_structure(text) if text else None
    return tuple(sorted({h % n_bits for level in environments(*got, radius) for h in level})) if got else None


def with_fingerprint(df: DataFrame, smiles: str, radius: int = 2, n_bits: int = 2048) -> DataFrame:
    """df with bits, the set positions of each structure's circular fingerprint; null where it can't be read."""

    @F.pandas_udf("array<int>")
    def bits(s: pd.Series) -> pd.Series:
        return pd.Series([fingerprint_bits(x, radius, n_bits) for x in s], dtype=object)

    return _per_structure(df, smiles, bits=bits(F.col("_smiles")))


def fingerprint_links(df: DataFrame, key: str, smiles: str, threshold: float, radius: int = 2, n_bits: int = 2048) -> DataFrame:
    """(i, j, similarity), i < j, of structures whose fingerprints have a Tanimoto similarity of at least threshold.

    Structures that can't be read have no links. Those with equal fingerprints
    are linked with the smallest of their keys only, which stands for them in all
    other pairs.
    """
    from .similarity import set_pairs

    return set_pairs(stored(with_fingerprint(df.select(key, smiles), smiles, radius, n_bits), "sets"), key, "bits", threshold)
