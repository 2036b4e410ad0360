"""License scans: an exact set-similarity join of text blocks with license templates.

Templates are whole license texts, standard headers and one-line notices.
Templates and blocks are token sets. Tokens are in the order of their frequency
over all documents, rarest first; an intersection only holds tokens of a
template, so their places in that order are all that the join needs, and only
they are counted. For a template of L words blocks have 2 L words and start
every L words, so every copy of the template lies within one block. A block that
holds at least alpha = threshold * |T| of a template's tokens

* has one of the template's |T| - alpha + 1 rarest (prefix filter),
* has at least alpha words (length filter, of the block),
* and once its tokens up to a rank are known, can still reach alpha with those
  after it (positional filter); a candidate is given up as soon as it cannot.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches
from .license_texts import templates as license_templates

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")

# Phrases with their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


def words(text: str | None) -> list[bytes]:
    """Words [0-9a-z and all beyond ASCII] of the text with A-Z lower-cased."""
    return _WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())


def token_counts(docs: DataFrame, tokens: set[bytes]) -> dict[bytes, int]:
    """How often each of the tokens stands in all texts. One small row a batch is summed."""

    def run(it):
        for batch in batches(it):
            c: Counter = Counter()
            for t in batch.column("text").to_pylist():
                c.update(filter(tokens.__contains__, words(t)))
            yield pa.RecordBatch.from_arrays([pa.array([k.decode() for k in c], pa.string()), pa.array(list(c.values()), pa.int64())], ["token", "n"])

    got = docs.select("text").mapInArrow(run, "token string, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    return {t: 0 for t in tokens} | {r["token"].encode(): r["n"] for r in got}


class Matcher:
    """Finds phrases and templates in a text's words; counts order the tokens."""

    def __init__(self, counts: dict[bytes, int], phrases: dict[str, str], templates: dict[str, list[str]], threshold: float):
        self.phrases = [([w.encode() for w in p.split()], label) for p, label in phrases.items()]
        self.templates = []
        seen = set()
        for label, texts in templates.items():
            for t in texts:
                w = words(t)
                tokens = sorted(set(w), key=lambda x: (counts.get(x, 0), x))
                if not tokens or (label, len(w), tuple(tokens)) in seen:
                    continue
                seen.add((label, len(w), tuple(tokens)))
                alpha = math.ceil(threshold * len(tokens) - 1e-9)
                self.templates.append((label, len(w), tokens, alpha))
        self.tokens = {x for _, _, tokens, _ in self.templates for x in tokens}
        # templates by the tokens of their prefixes
        self.index: dict[bytes, list[int]] = {}
        for k, (_, _, tokens, a) in enumerate(self.templates):
            for x in tokens[: len(tokens) - a + 1]:
                self.index.setdefault(x, []).append(k)
        self.hooks = {p[0] for p, _ in self.phrases} | self.index.keys()

    def __call__(self, w: list[bytes]) -> tuple[int, int | None, int | None, set[str], set[str], float]:
        """(base places, least start, greatest start, base labels, all labels, score)."""
        here = self.hooks.intersection(w)
        if not here:
            return 0, None, None, set(), set(), 0.0
        at: dict[bytes, list[int]] = {}
        for i, x in enumerate(w):
            if x in self.tokens or x in here:
                at.setdefault(x, []).append(i)
        starts, base = [], set()
        for phrase, label in self.phrases:
            found = [i for i in at.get(phrase[0], ()) if w[i : i + len(phrase)] == phrase]
            if found:
                starts += found
                base.add(label)
        labels, score = set(base), 1.0 if starts else 0.0
        for k in sorted({k for x in here for k in self.index.get(x, ())}):
            label, length, tokens, alpha = self.templates[k]
            last = max(1, -(-(len(w) - length) // length)) - 1  # the last block's number
            block_of: dict[bytes, set[int]] = {}

            def blocks(x):
                if x not in block_of:
                    block_of[x] = {b for i in at.get(x, ()) for b in (i // length, i // length - 1) if 0 <= b <= last}
                return block_of[x]

            for b in set().union(*(blocks(x) for x in tokens[: len(tokens) - alpha + 1])):
                if min(2 * length, len(w) - b * length) < alpha:
                    continue
                hits = 0
                for rank, x in enumerate(tokens):
                    hits += b in blocks(x)
                    if hits + len(tokens) - rank - 1 < alpha:
                        break
                else:
                    labels.add(label)
                    score = max(score, hits / len(tokens))
        return len(starts), min(starts, default=None), max(starts, default=None), base, labels, score


def license_scan(docs: DataFrame, phrases: dict[str, str] | None = None, templates: dict[str, list[str]] | None = None, threshold: float = 0.9) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of each row of docs (doc_id, text).

    Null and empty texts have no words, labels "" and score 0. score is 1 where
    a phrase stands, else the greatest containment that meets the threshold.
    Repeated rows, null and repeated doc_ids are rows of their own; tokens of
    equal frequency are in byte order; an empty table gives no rows; other
    columns take no part. Texts of any length are scanned whole.
    """
    phrases, templates = PHRASES if phrases is None else phrases, license_templates() if templates is None else templates
    tokens = {x for texts in templates.values() for t in texts for x in words(t)}
    matcher = Matcher(token_counts(docs, tokens), phrases, templates, threshold)

    def run(it):
        for batch in batches(it):
            rows = []
            for t in batch.column("text").to_pylist():
                w = words(t)
                n, first, last, base, labels, score = matcher(w)
                rows.append((len(w), n, first, last, ",".join(sorted(base)), ",".join(sorted(labels)), score))
            cols = list(zip(*rows))
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, types))], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
