"""Structure tokenizers with a vocabulary: atom by atom, or with merged pairs, and special tokens."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sequences import STRUCTURE_TOKEN

#: Names of the special tokens.
SPECIAL = {"unknown": "[UNK]", "separator": "[SEP]", "padding": "[PAD]", "start": "[CLS]", "mask": "[MASK]"}


class Tokenizer:
    """Tokens of structure texts and their numbers in a vocabulary (token to number).

    merges: pairs of neighbouring tokens that become one, the first listed first;
    all places of a pair are merged, from left to right, before the next is looked
    for. Without merges every atom-level token stands for itself.
    """

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]] = (), special: dict[str, str] | None = None):
        self.special = SPECIAL if special is None else special
        self.number, self.name = dict(vocabulary), {i: t for t, i in vocabulary.items()}
        if self.special["unknown"] not in self.number:
            raise ValueError("the vocabulary lacks the unknown token")
        self.rank = {tuple(p): k for k, p in reversed(list(enumerate(merges)))}
        self.atoms = re.compile(STRUCTURE_TOKEN)

    def tokens(self, text: str | None) -> list[str]:
        out = self.atoms.findall(text or "")
        while self.rank and len(out) > 1:
            best = min(zip(out, out[1:]), key=lambda p: self.rank.get(p, len(self.rank)))
            if best not in self.rank:
                break
            joined, k = [], 0
            while k < len(out):
                both = k + 1 < len(out) and (out[k], out[k + 1]) == best
                joined.append(out[k] + out[k + 1] if both else out[k])
                k += 1 + both
            out = joined
        return out

    def numbers(self, text: str | None, second: str | None = None, limit: int | None = None) -> list[int]:
        """[CLS] text [SEP], or [CLS] text [SEP] second [SEP]; texts are cut to limit numbers in all."""
        unknown, start, end = (self.number.get(self.special[k], self.number[self.special["unknown"]]) for k in ("unknown", "start", "separator"))
        of = lambda t: [self.number.get(x, unknown) for x in self.tokens(t)]
        a, b = of(text), None if second is None else of(second)
        if limit is not None:
            room = max(0, limit - (2 if b is None else 3))
            a = a[:room]
            b = None if b is None else b[: room - len(a)]
        return [start, *a, end, *([*b, end] if b is not None else [])]

    def text(self, numbers: list[int], skip_special: bool = True) -> str:
        names = [self.name.get(i, self.special["unknown"]) for i in numbers]
        return "".join(n for n in names if not (skip_special and n in self.special.values()))

    def special_mask(self, n_first: int, n_second: int | None = None) -> list[int]:
        return [1, *[0] * n_first, 1, *([*[0] * n_second, 1] if n_second is not None else [])]

    def segments(self, n_first: int, n_second: int | None = None) -> list[int]:
        return [0] * (n_first + 2) + ([1] * (n_second + 1) if n_second is not None else [])


def tokenize(df: DataFrame, column: str, tokenizer: Tokenizer, limit: int | None = None) -> DataFrame:
    """df with tokens and numbers of a text column, in Arrow batches; null texts have none but the start and the end."""

    @F.pandas_udf("tokens array<string>, numbers array<int>")
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"tokens": [tokenizer.tokens(t) for t in texts], "numbers": [tokenizer.numbers(t, limit=limit) for t in texts]})

    return df.withColumn("_t", run(column)).select("*", "_t.tokens", "_t.numbers").drop("_t")


def save_vocabulary(tokenizer: Tokenizer) -> str:
    """One token a line in order of number; numbers that leave gaps raise, as line numbers could not tell them."""
    order = sorted(tokenizer.name)
    if order != list(range(len(order))):
        raise ValueError("numbers of the vocabulary are not consecutive")
    return "\n".join(tokenizer.name[i] for i in order) + "\n"
