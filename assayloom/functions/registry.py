"""Featurizers by name: what the feature steps can be configured with."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame


@dataclass
class Featurizer:
    """fit(df) -> state (None if stateless); transform(df, state) -> df with a features column; kind: vector, index or graph."""

    name: str
    kind: str
    transform: Callable[[DataFrame, object], DataFrame]
    fit: Callable[[DataFrame], object] = field(default=lambda df: None)


class Registry:
    """Names to builders; an unknown or repeated name raises."""

    def __init__(self) -> None:
        self._builders: dict[str, Callable[..., Featurizer]] = {}

    def register(self, name: str):
        def add(builder):
            if name in self._builders:
                raise ValueError(f"{name} is registered already")
            self._builders[name] = builder
            return builder

        return add

    def build(self, name: str, **options) -> Featurizer:
        if name not in self._builders:
            raise ValueError(f"unknown featurizer {name!r}; known: {', '.join(sorted(self._builders))}")
        return self._builders[name](**options)

    def names(self) -> list[str]:
        return sorted(self._builders)


organisms = Registry()
peptides = Registry()


@organisms.register("vocabulary")
def _vocabulary(unknown: int = 0) -> Featurizer:
    from ..operators import features

    return Featurizer("vocabulary", "index", lambda df, vocab: features.encode(df, vocab, "organism", unknown), lambda df: features.vocabulary(df, "organism", unknown))


@organisms.register("kmer")
def _kmer(ks: tuple[int, ...] = (1, 2, 3, 4)) -> Featurizer:
    from ..operators import features

    return Featurizer("kmer", "vector", lambda df, table: df.join(table, "organism", "left"), lambda df: features.kmer_vectors(df, "organism", "sequence", ks))


@peptides.register("descriptors")
def _descriptors(names: tuple[str, ...] = ()) -> Featurizer:
    from ..operators import features

    return Featurizer("descriptors", "vector", lambda df, _: features.descriptors(df, "smiles"))


@peptides.register("graph")
def _graph() -> Featurizer:
    from pyspark.sql import functions as F

    from ..operators import features

    return Featurizer("graph", "graph", lambda df, _: df.withColumn("graph", features.structure_graph(F.col("smiles"))))


@peptides.register("table")
def _peptide_table(key: str = "peptide_id") -> Featurizer:
    """Vectors made elsewhere, by id; fit is given their table (key, features) as it is."""
    from ..operators import joins

    return Featurizer("table", "vector", lambda df, table: joins.lookup_columns(df, table, [key]), lambda table: table)


@organisms.register("table")
def _organism_table(dim: int = 0) -> Featurizer:
    """Vectors by species, else by genus, else zeros, from a table (match_key, level, features)."""
    from pyspark.sql import functions as F

    from ..operators import joins
    from .sequences import genus

    zeros = F.array_repeat(F.lit(0.0), dim)
    return Featurizer("table", "vector", lambda df, table: joins.by_level(df, table, F.trim("organism"), genus(F.col("organism")), ["features"], {"features": zeros}), lambda table: table)


def to_artifact(featurizer: Featurizer, options: dict) -> dict:
    """What is stored beside features so that they can be made again."""
    return {"method": featurizer.name, "kind": featurizer.kind, "options": options}


def rehydrate(artifact: dict, registry: Registry) -> Featurizer:
    """The featurizer that an artifact names; one without method raises."""
    if "method" not in artifact:
        raise ValueError("the artifact names no method")
    return registry.build(artifact["method"], **artifact.get("options", {}))
