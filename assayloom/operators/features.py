"""Features: vocabularies, k-mer composition, gene extraction and structure descriptors."""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.sequences import reverse_complement
from .order import numbered, running


def vocabulary(df: DataFrame, column: str, unknown: int = 0) -> DataFrame:
    """(column, index): dense numbers in value order that skip the one kept for unknown values; blank values raise."""
    d = df.select(column).distinct()
    d = d.where(F.when(F.coalesce(F.trim(column) == "", F.lit(True)), F.raise_error(F.lit("blank value in a vocabulary")).cast("boolean")).otherwise(True))
    r = F.col("_r").cast("int")
    return numbered(d, [F.col(column)], "_r").select(column, F.when(r >= unknown, r + 1).otherwise(r).alias("index"))


def encode(df: DataFrame, vocab: DataFrame, column: str, unknown: int = 0) -> DataFrame:
    """df with index, that of unknown for values outside the vocabulary."""
    return df.join(vocab, column, "left").withColumn("index", F.coalesce("index", F.lit(unknown)))


def kmer_counts(df: DataFrame, key: str, seq: str, ks: tuple[int, ...]) -> DataFrame:
    """(key, k, kmer, n, value): overlapping windows over all rows of a key, each k scaled to length 1; absent k-mers have no row.

    Windows are counted inside Arrow batches by their base-4 numbers, so a row of
    any length gives at most 4 ** k counts a k; windows with other letters than
    A, C, G and T count nowhere.
    """
    code = np.full(256, 4, np.int64)
    for i, c in enumerate(b"ACGT"):
        code[c] = code[c + 32] = i

    def run(it):
        for batch in it:
            sums: dict = {}
            for name, text in zip(batch.column("key").to_pylist(), batch.column("seq").to_pylist()):
                if not text:
                    continue
                x = code[np.frombuffer(text.encode("ascii", "replace"), np.uint8)]
                bad = np.concatenate([[0], np.cumsum(x == 4)])
                for k in ks:
                    m = len(x) - k + 1
                    if m <= 0:
                        continue
                    number = np.zeros(m, np.int64)
                    for j in range(k):
                        number = number * 4 + x[j : j + m]
                    found = np.bincount(number[bad[k:] == bad[:-k]], minlength=4**k)
                    sums[name, k] = sums[name, k] + found if (name, k) in sums else found
            rows = [(name, k, i, int(n)) for (name, k), found in sums.items() for i, n in zip(np.flatnonzero(found).tolist(), found[found > 0])]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate((batch.schema.field("key").type, pa.int32(), pa.int64(), pa.int64()))], ["key", "k", "number", "n"])

    kind = df.schema[key].dataType.simpleString()
    c = df.select(F.col(key).alias("key"), F.col(seq).alias("seq")).mapInArrow(run, f"key {kind}, k int, number long, n long").groupBy("key", "k", "number").agg(F.sum("n").alias("n"))
    letters = F.array_join(F.transform(F.sequence(F.col("k") - 1, F.lit(0), F.lit(-1)), lambda j: F.substr(F.lit("ACGT"), (F.shiftright(F.col("number"), 0) / F.pow(F.lit(4.0), j)).cast("long") % 4 + 1, F.lit(1))), "")
    size = F.sqrt(F.sum(F.col("n").cast("double") * F.col("n")).over(Window.partitionBy("key", "k")))
    return c.select(F.col("key").alias(key), "k", letters.alias("kmer"), "n", (F.col("n") / size).alias("value"))


def kmer_vectors(df: DataFrame, key: str, seq: str, ks: tuple[int, ...] = (1, 2, 3, 4)) -> DataFrame:
    """(key, features): one slot for every k-mer over ACGT, by k, then in letter order."""
    names = ["".join(p) for k in ks for p in product("ACGT", repeat=k)]
    have = kmer_counts(df, key, seq, ks).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("kmer", "value"))).alias("m"))
    slots = F.transform(F.array(*map(F.lit, names)), lambda x: F.coalesce(F.try_element_at("m", x), F.lit(0.0)))
    return df.select(key).distinct().join(have, key, "left").select(key, F.coalesce(F.when(F.col("m").isNotNull(), slots), F.array_repeat(F.lit(0.0), len(names))).alias("features"))


def longest_gene(records: DataFrame, features: DataFrame, product_name: str = "16S", least: int = 1200, most: int = 1700, strict: bool = True) -> DataFrame:
    """(file, record, start, sequence): per file the longest feature of that product with full length, the first on ties; minus strands reversed.

    records (file, record, sequence); features (file, record, start, end, strand,
    product, ordinal), 1-based and inclusive. A file of records without such a
    feature raises when it is read, unless strict is off, when it has no row.
    """
    n = F.col("end") - F.col("start") + 1
    f = features.where(F.col("product").contains(product_name) & n.between(least, most)).join(records.select("file", "record", "sequence"), ["file", "record"])
    cut = F.substr("sequence", F.col("start"), F.col("end") - F.col("start") + 1)
    f = f.withColumn("gene", F.when(F.col("strand") == "-", reverse_complement(cut)).otherwise(cut)).withColumn("n", F.length("gene"))
    best = f.groupBy("file").agg(F.max_by(F.struct("record", "start", F.col("gene").alias("sequence")), F.struct("n", -F.col("ordinal"))).alias("g"))
    if strict:
        j = records.select("file").distinct().join(best, "file", "left")
        best = j.withColumn("g", F.when(F.col("g").isNull(), F.raise_error(F.concat(F.lit("no full-length gene in "), F.col("file"))).cast(best.schema["g"].dataType)).otherwise(F.col("g")))
    return best.select("file", "g.*")


# Standard atomic weights.
ATOMIC_WEIGHTS = {"H": 1.008, "B": 10.81, "C": 12.011, "N": 14.007, "O": 15.999, "F": 18.998, "P": 30.974, "S": 32.06, "Cl": 35.45, "Se": 78.971, "Br": 79.904, "I": 126.904}
# Usual valences.
VALENCES = {"B": [3], "C": [4], "N": [3, 5], "O": [2], "F": [1], "P": [3, 5], "S": [2, 4, 6], "Cl": [1], "Br": [1], "I": [1]}
_ATOM = re.compile(r"\[(?P<iso>[0-9]*)(?P<sym>[A-Z][a-z]?|[bcnops]|se)(?P<chiral>@{0,2})(?P<h>H[0-9]*)?(?P<charge>[+-][0-9]*|\+\+|--)?(?::[0-9]+)?\]|(?P<plain>Br|Cl|[BCNOPSFI]|[bcnops])|(?P<ring>%[0-9]{2}|[0-9])|(?P<bond>[-=#:/\\])|(?P<open>\()|(?P<close>\))|(?P<dot>\.)")


@lru_cache(maxsize=4096)
def _token(token: str) -> tuple[str, object]:
    """What a token of _ATOM is, and its atom, ring or bond order."""
    m = _ATOM.fullmatch(token)
    if m["sym"] or m["plain"]:
        s = m["sym"] or m["plain"]
        h = None if m["plain"] else (int(m["h"][1:] or 1) if m["h"] else 0)
        c = m["charge"] or ""
        charge = 0 if not c else (int(c) if c.strip("+-") else (1 if c[0] == "+" else -1) * len(c))
        return "atom", (s.capitalize(), s[0].islower(), h, charge, m["chiral"] or "")
    if m["ring"]:
        return "ring", m["ring"].lstrip("%")
    if m["bond"]:
        return "bond", {"=": 2.0, "#": 3.0, ":": 1.5}.get(m["bond"], 1.0 if m["bond"] == "-" else None)
    return "open" if m["open"] else "close" if m["close"] else "dot", None


def parse_structure(text: str) -> tuple[list[dict], list[tuple[int, int, float]]] | None:
    """Atoms (symbol, aromatic, hydrogens, charge, chirality, neighbours) and bonds (i, j, order) of a SMILES text; None if it can't be read.

    Aromatic bonds count 1.5. Neighbours (near) stand in the order of the text, in
    which a ring's digit counts where it opens; lead: how many stand before the atom.
    """
    atoms, bonds, stack, rings, last, order = [], [], [], {}, None, None
    tokens = [m[0] for m in _ATOM.finditer(text)]
    if sum(map(len, tokens)) < len(text):
        return None
    for kind, value in map(_token, tokens):
        if kind == "atom":
            s, aromatic, h, charge, chiral = value
            atoms.append({"symbol": s, "aromatic": aromatic, "h": h, "charge": charge, "chiral": chiral, "near": [], "lead": int(last is not None)})
            if last is not None:
                atoms[last]["near"].append(len(atoms) - 1)
                atoms[-1]["near"].append(last)
                both = atoms[last]["aromatic"] and aromatic
                bonds.append((last, len(atoms) - 1, order or (1.5 if both else 1.0)))
            last, order = len(atoms) - 1, None
        elif kind == "ring":
            if last is None:
                return None
            k = value
            if k in rings:
                i, o = rings.pop(k)
                atoms[i]["near"][atoms[i]["near"].index(("ring", k))] = last
                atoms[last]["near"].append(i)
                both = atoms[i]["aromatic"] and atoms[last]["aromatic"]
                bonds.append((i, last, order or o or (1.5 if both else 1.0)))
            else:
                rings[k] = (last, order)
                atoms[last]["near"].append(("ring", k))
            order = None
        elif kind == "bond":
            order = value
        elif kind == "open":
            stack.append(last)
        elif kind == "close":
            if not stack:
                return None
            last = stack.pop()
        else:
            last, order = None, None
    if not atoms or stack or rings or any(a["symbol"] not in ATOMIC_WEIGHTS for a in atoms):
        return None
    used = [0.0] * len(atoms)
    for i, j, o in bonds:
        used[i] += o
        used[j] += o
    for a, u in zip(atoms, used):
        if a["h"] is None:
            a["h"] = implied_hydrogens(a["symbol"], a["aromatic"], u)
    return atoms, bonds


def implied_hydrogens(symbol: str, aromatic: bool, used: float) -> int:
    """Hydrogens of an atom that is written without brackets, from the orders of its bonds."""
    need = int(used + 0.5) if not aromatic else int(used)
    return max(0, next((v for v in VALENCES.get(symbol, [0]) if v >= need), need) - need)


def structure_weight(text: str | None) -> float | None:
    """Molecular weight of a SMILES text from atom counts, None if empty or unreadable."""
    got = parse_structure(text) if text else None
    return sum(ATOMIC_WEIGHTS[a["symbol"]] + a["h"] * ATOMIC_WEIGHTS["H"] for a in got[0]) if got else None


@F.pandas_udf(T.DoubleType())
def molecular_weight(smiles: pd.Series) -> pd.Series:
    return pd.Series([structure_weight(s) for s in smiles], dtype="float64")


def ring_bonds(n: int, bonds: list[tuple[int, int, float]]) -> list[bool]:
    """Whether each bond is in a ring: a bond is in none if nothing else joins its ends."""
    near: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    for k, (i, j, _) in enumerate(bonds):
        near[i].append((j, k))
        near[j].append((i, k))
    out, seen, low, clock = [True] * len(bonds), [0] * n, [0] * n, 0
    for root in range(n):
        if seen[root]:
            continue
        clock += 1
        seen[root] = low[root] = clock
        stack = [(root, -1, iter(near[root]))]
        while stack:
            v, by, rest = stack[-1]
            for w, k in rest:
                if k == by:
                    continue
                if seen[w]:
                    low[v] = min(low[v], seen[w])
                else:
                    clock += 1
                    seen[w] = low[w] = clock
                    stack.append((w, k, iter(near[w])))
                    break
            else:
                stack.pop()
                if stack:
                    u = stack[-1][0]
                    low[u] = min(low[u], low[v])
                    if low[v] > seen[u]:
                        out[by] = False
    return out


_COUNTS = ("heavy_atoms", "rings", "hetero_atoms", "charge", "aromatic_atoms", "double_bonds", "donors", "acceptors", "rotatable_bonds", "aromatic_rings")
_DESCRIPTORS = T.StructType([T.StructField("weight", T.DoubleType()), *[T.StructField(c, T.IntegerType()) for c in _COUNTS], T.StructField("fraction_sp3", T.DoubleType())])


@F.pandas_udf(_DESCRIPTORS)
def _describe(smiles: pd.Series) -> pd.DataFrame:
    rows = []
    for s in smiles:
        got = parse_structure(s) if s else None
        if not got:
            rows.append([None] * (len(_COUNTS) + 2))
            continue
        atoms, bonds = got
        ring = ring_bonds(len(atoms), bonds)
        degree = [0] * len(atoms)
        for i, j, _ in bonds:
            degree[i] += 1
            degree[j] += 1
        parts = s.count(".") + 1
        turns = sum(o == 1 and not r and degree[i] > 1 and degree[j] > 1 for (i, j, o), r in zip(bonds, ring))
        aromatic = [(i, j) for (i, j, o), r in zip(bonds, ring) if o == 1.5 and r]
        in_rings = {x for b in aromatic for x in b}
        groups = {x: x for x in in_rings}

        def find(x):
            while groups[x] != x:
                x = groups[x]
            return x

        for i, j in aromatic:
            groups[find(i)] = find(j)
        carbons = [k for k, a in enumerate(atoms) if a["symbol"] == "C"]
        flat = {x for i, j, o in bonds if o != 1 for x in (i, j)}
        hetero = [a for a in atoms if a["symbol"] not in ("C", "H")]
        rows.append([
            structure_weight(s), len(atoms), len(bonds) - len(atoms) + parts, len(hetero), sum(a["charge"] for a in atoms), sum(a["aromatic"] for a in atoms), sum(o == 2 for *_, o in bonds),
            sum(a["symbol"] in "NO" and a["h"] > 0 for a in atoms), sum(a["symbol"] in "NO" for a in atoms), turns, len(aromatic) - len(in_rings) + len({find(x) for x in in_rings}),
            sum(k not in flat for k in carbons) / len(carbons) if carbons else 0.0,
        ])
    return pd.DataFrame(rows, columns=_DESCRIPTORS.fieldNames()).astype({"weight": "float64", "fraction_sp3": "float64"} | {c: "Int32" for c in _COUNTS})


def descriptors(df: DataFrame, smiles: str) -> DataFrame:
    """df with a struct of weight and counting descriptors; its fields are null where the structure can't be read."""
    return df.withColumn("descriptors", _describe(F.col(smiles)))


# What the slots of atom and bond vectors stand for; each list has one more slot for anything else.
ELEMENTS = ["C", "N", "O", "S", "F", "Cl", "Br", "I", "P"]
DEGREES = [0, 1, 2, 3, 4, 5]
CHARGES = [-1, 0, 1]
HYBRIDS = ["sp", "sp2", "sp3"]
HYDROGENS = [0, 1, 2, 3]
CHIRALITY = ["", "@@", "@"]
BOND_ORDERS = [1.0, 2.0, 3.0, 1.5]
BOND_STEREO = ["none", "Z", "E"]
NODE_DIM = sum(len(x) + 1 for x in (ELEMENTS, DEGREES, CHARGES, HYBRIDS, HYDROGENS, CHIRALITY)) + 2
EDGE_DIM = sum(len(x) + 1 for x in (BOND_ORDERS, BOND_STEREO)) + 2


@lru_cache(maxsize=4096)
def _code(values: tuple, choices: tuple) -> int:
    """Slots as bits, the first one lowest: a value for each of choices (a list of values, or None for a flag)."""
    code, at = 0, 0
    for v, of in zip(values, choices):
        if of is None:
            code, at = code | int(bool(v)) << at, at + 1
        else:
            code, at = code | 1 << (at + (of.index(v) if v in of else len(of))), at + len(of) + 1
    return code


_NODE_SLOTS = (*map(tuple, (ELEMENTS, DEGREES, CHARGES, HYBRIDS)), None, tuple(HYDROGENS), None, tuple(CHIRALITY))
_EDGE_SLOTS = (tuple(BOND_ORDERS), None, None, tuple(BOND_STEREO))


def graph_codes(text: str | None) -> tuple[list[int], list[int], list[int]]:
    """A structure's atoms as slots in bits, its bonds' ends (i, j, j, i, ...), and each bond's slots in bits; empty if it can't be read."""
    atoms, bonds = (parse_structure(text) if text else None) or ([], [])
    ring = ring_bonds(len(atoms), bonds)
    orders: list[list[float]] = [[] for _ in atoms]
    cyclic = [False] * len(atoms)
    for (i, j, o), r in zip(bonds, ring):
        orders[i].append(o)
        orders[j].append(o)
        if r:
            cyclic[i] = cyclic[j] = True
    nodes = []
    for a, o, c in zip(atoms, orders, cyclic):
        hybrid = "sp" if 3.0 in o or o.count(2.0) > 1 else "sp2" if 2.0 in o or 1.5 in o else "sp3"
        nodes.append(_code((a["symbol"], len(o), a["charge"], hybrid, a["aromatic"], a["h"], c, a["chiral"]), _NODE_SLOTS))
    rich = [any(x != 1.0 for x in o) for o in orders]
    # atoms that a single bond joins to one with another bond, and how many such bonds each has
    beside = [0] * len(atoms)
    for i, j, o in bonds:
        if o == 1.0:
            beside[i] += rich[j]
            beside[j] += rich[i]
    # single bonds beside a double one between the same atoms
    pairs = [frozenset(b[:2]) for b in bonds]
    same = Counter(p for p, b in zip(pairs, bonds) if b[2] == 1.0) if len(set(pairs)) < len(pairs) else {}
    ends, codes = [], []
    for (i, j, o), r in zip(bonds, ring):
        conjugated = o == 1.5 or (o == 1.0 and rich[i] and rich[j]) or (o == 2.0 and beside[i] + beside[j] > (2 * same.get(frozenset((i, j)), 0) if same else 0))
        ends += [i, j, j, i]
        codes.append(_code((o, conjugated, r, "none"), _EDGE_SLOTS))
    return nodes, ends, codes


def _arrays(flat, sizes):
    """An Arrow array of lists of the given sizes."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), flat)


def _graphs(smiles) -> tuple:
    """Of an Arrow array of texts: sizes in atoms and directed bonds, codes of atoms, ends, and codes of directed bonds."""
    got = [graph_codes(s) for s in smiles.to_pylist()]
    flat = lambda k, kind: np.fromiter((x for g in got for x in g[k]), kind)
    return [len(g[0]) for g in got], [len(g[1]) // 2 for g in got], flat(0, np.int64), flat(1, np.int32), np.repeat(flat(2, np.int64), 2)


_ENDS = T.ArrayType(T.ArrayType(T.IntegerType()))
_CODES = T.StructType([T.StructField("nodes", T.ArrayType(T.LongType())), T.StructField("edges", _ENDS), T.StructField("bonds", T.ArrayType(T.LongType()))])


@F.arrow_udf(_CODES)
def structure_codes(smiles: pa.Array) -> pa.Array:
    """structure_graph() with each vector as one number, which slots() turns into the vector: a tenth of the bytes."""
    n, m, nodes, ends, bonds = _graphs(smiles)
    return pa.StructArray.from_arrays([_arrays(pa.array(nodes), n), _arrays(_arrays(pa.array(ends), np.full(len(bonds), 2)), m), _arrays(pa.array(bonds), m)], ["nodes", "edges", "bonds"])


def slots(code: Column, dim: int) -> Column:
    """The vector of a code of structure_codes()."""
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda k: F.getbit(code, k).cast("double"))


_VECTORS = T.ArrayType(T.ArrayType(T.DoubleType()))


@F.pandas_udf(T.StructType([T.StructField("nodes", _VECTORS), T.StructField("edges", _ENDS), T.StructField("bonds", _VECTORS)]))
def structure_graph(smiles: pd.Series) -> pd.DataFrame:
    """Atom vectors, directed bonds both ways and their vectors; empty for a structure that can't be read.

    Atoms: element, degree, charge, hybrid, aromatic, hydrogens, in a ring, chirality.
    Bonds: order, conjugated, in a ring, stereo (told as none: geometry is not read).
    For large tables structure_codes() holds the same in far fewer bytes.
    """
    vectors = lambda codes, dim: [[float(c >> k & 1) for k in range(dim)] for c in codes]
    rows = []
    for s in smiles:
        nodes, ends, bonds = graph_codes(s)
        rows.append([vectors(nodes, NODE_DIM), [list(e) for e in zip(ends[::2], ends[1::2])], [v for v in vectors(bonds, EDGE_DIM) for _ in range(2)]])
    return pd.DataFrame(rows, columns=["nodes", "edges", "bonds"])


def node_offsets(graphs: DataFrame, key: str, n: str) -> DataFrame:
    """graphs with offset: nodes of all graphs before it, as in a batch laid end to end."""
    return running(graphs, [F.col(key)], F.col(n), "offset")
