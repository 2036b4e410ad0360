"""Configuration files with overlays, strict dataclasses and a revision stamp."""

from __future__ import annotations

import dataclasses
import json
import logging
import subprocess
import typing
from pathlib import Path


def merged(base: dict, over: dict) -> dict:
    """over on base: dictionaries merge, anything else replaces."""
    return {k: merged(base[k], over[k]) if isinstance(base.get(k), dict) and isinstance(over.get(k), dict) else over.get(k, base.get(k)) for k in {**base, **over}}


def load(path: str | Path) -> dict:
    """A JSON or YAML file; its _base_ names a file that it is laid over, which may have one too."""
    path = Path(path)
    if path.suffix in (".yaml", ".yml"):
        import yaml

        data = yaml.safe_load(path.read_text()) or {}
    else:
        data = json.loads(path.read_text())
    base = data.pop("_base_", None)
    return merged(load(path.parent / base), data) if base else data


def strict(kind, data: dict):
    """A dataclass from a dictionary; unknown keys and values of another type raise, nested dataclasses are filled likewise."""
    fields = {f.name: f for f in dataclasses.fields(kind)}
    if unknown := sorted(set(data) - set(fields)):
        raise ValueError(f"{kind.__name__} has no {', '.join(unknown)}")
    types = typing.get_type_hints(kind)
    out = {}
    for k, v in data.items():
        if dataclasses.is_dataclass(types[k]):
            if not isinstance(v, dict):
                raise ValueError(f"{kind.__name__}.{k} is a group of settings")
            out[k] = strict(types[k], v)
            continue
        plain = typing.get_origin(types[k]) or types[k]
        if plain is float and isinstance(v, int) and not isinstance(v, bool):
            v = float(v)
        if isinstance(plain, type) and (not isinstance(v, plain) or (plain is int and isinstance(v, bool))):
            raise ValueError(f"{kind.__name__}.{k} is {plain.__name__}, not {type(v).__name__}")
        out[k] = v
    return kind(**out)


@dataclasses.dataclass
class RobustMean:
    fence: float = 1.5
    least: int = 4
    digits: int = 3


@dataclasses.dataclass
class Buckets:
    test: float = 0.2
    folds: int = 5
    weight_special: float = 30.0
    weight_active: float = 30.0
    tries: int = 100_000
    seed: int = 42


@dataclasses.dataclass
class Edges:
    structure: float = 0.8
    structure_hard: float = 0.95
    identity: float = 0.6
    identity_hard: float = 0.9


@dataclasses.dataclass
class Training:
    select_by: str = "val_auroc"
    epochs: int = 30
    seed: int = 42

    def __post_init__(self):
        if self.select_by not in ("val_auroc", "val_f1", "val_accuracy", "val_loss"):
            raise ValueError(f"unknown metric {self.select_by!r}")

    @property
    def larger_is_better(self) -> bool:
        return self.select_by != "val_loss"


# Descriptors that can be asked for.
DESCRIPTORS = ["weight", "heavy_atoms", "rings", "hetero_atoms", "charge", "aromatic_atoms", "double_bonds", "donors", "acceptors", "rotatable_bonds", "aromatic_rings", "fraction_sp3"]


@dataclasses.dataclass
class Descriptors:
    names: list = dataclasses.field(default_factory=lambda: list(DESCRIPTORS))

    def __post_init__(self):
        if unknown := [n for n in self.names if n not in DESCRIPTORS]:
            raise ValueError(f"unknown descriptors {unknown}; known: {DESCRIPTORS}")


@dataclasses.dataclass
class Kmers:
    ks: list = dataclasses.field(default_factory=lambda: [1, 2, 3, 4])


@dataclasses.dataclass
class Vocabulary:
    unknown: int = 0


@dataclasses.dataclass
class Features:
    """Methods by name, with the options of each; active() gives those of the one that is chosen."""

    peptide: str = "descriptors"
    organism: str = "vocabulary"
    descriptors: Descriptors = dataclasses.field(default_factory=Descriptors)
    vocabulary: Vocabulary = dataclasses.field(default_factory=Vocabulary)
    kmer: Kmers = dataclasses.field(default_factory=Kmers)

    def __post_init__(self):
        from ..functions.registry import organisms, peptides

        for name, known in ((self.peptide, peptides.names()), (self.organism, organisms.names())):
            if name not in known:
                raise ValueError(f"unknown method {name!r}; known: {', '.join(known)}")

    def active(self, which: str) -> dict:
        chosen = getattr(self, getattr(self, which), None)
        return dataclasses.asdict(chosen) if dataclasses.is_dataclass(chosen) else {}


@dataclasses.dataclass
class Dataset:
    labels: list = dataclasses.field(default_factory=lambda: ["active", "inactive"])
    validation_share: float = 0.3


@dataclasses.dataclass
class Settings:
    robust_mean: RobustMean = dataclasses.field(default_factory=RobustMean)
    buckets: Buckets = dataclasses.field(default_factory=Buckets)
    edges: Edges = dataclasses.field(default_factory=Edges)
    training: Training = dataclasses.field(default_factory=Training)
    features: Features = dataclasses.field(default_factory=Features)
    dataset: Dataset = dataclasses.field(default_factory=Dataset)
    labels: list = dataclasses.field(default_factory=lambda: ["active", "inactive"])


def revision(folder: str | Path) -> str:
    """The folder's git revision; raises if it can't be told."""
    return subprocess.run(["git", "-C", str(folder), "rev-parse", "HEAD"], check=True, capture_output=True, text=True).stdout.strip()


def device(name: str = "auto") -> str:
    """Where models run: Spark's learners use the CPU, so auto is cpu and any other device raises instead of falling back."""
    if name not in ("auto", "cpu"):
        raise ValueError(f"{name} is not available here; Spark's learners run on cpu")
    return "cpu"


def set_up_logging(level: int = logging.INFO) -> logging.Logger:
    """The library's logger with one handler, however often this is called."""
    log = logging.getLogger("assayloom")
    if not log.handlers:
        h = logging.StreamHandler()
        h.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s"))
        log.addHandler(h)
        log.propagate = False
    log.setLevel(level)
    return log
