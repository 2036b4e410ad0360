"""Assertions on DataFrames and a report of checks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class CheckError(ValueError):
    """A table breaks a rule that its consumers rely on."""


def require(df: DataFrame, condition: Column, name: str) -> DataFrame:
    """df if condition holds for all rows (null counts as not); else raises with the number of rows that break it."""
    n = df.where(~F.coalesce(condition, F.lit(False))).count()
    if n:
        raise CheckError(f"{name}: {n} rows break it")
    return df


def require_unique(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """df if no key stands twice; counts are partial sums, so a hot key costs one row a task."""
    n = df.groupBy(*keys).count().where("count > 1").count()
    if n:
        raise CheckError(f"{name}: {n} keys stand more than once")
    return df


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    if missing := [n for n in names if n not in df.columns]:
        raise CheckError(f"columns missing: {', '.join(missing)}")
    return df


@dataclass
class Section:
    """One part of a report: PASS, FLAGGED or FAIL, with lines of text."""

    title: str
    status: str = "PASS"
    lines: list[str] = field(default_factory=list)

    def flag(self, text: str) -> None:
        self.status = "FLAGGED" if self.status == "PASS" else self.status
        self.lines.append(text)

    def fail(self, text: str) -> None:
        self.status = "FAIL"
        self.lines.append(text)


def run_sections(sections: dict[str, Callable[[Section], None]]) -> list[Section]:
    """Runs each section by itself: one that raises is a FAIL and the others go on."""
    out = []
    for title, body in sections.items():
        s = Section(title)
        try:
            body(s)
        except Exception as e:  # noqa: BLE001
            s.fail(f"{type(e).__name__}: {e}")
        out.append(s)
    return out


def overall(sections: list[Section]) -> str:
    found = {s.status for s in sections}
    return next((x for x in ("FAIL", "FLAGGED") if x in found), "PASS")


def markdown_table(rows: list[dict], columns: list[str] | None = None) -> str:
    if not rows:
        return "(none)"
    columns = columns or list(rows[0])
    line = lambda cells: "| " + " | ".join(map(str, cells)) + " |"
    return "\n".join([line(columns), line(["---"] * len(columns)), *(line(r.get(c, "") for c in columns) for r in rows)])


def report(sections: list[Section]) -> str:
    parts = [f"# Report: {overall(sections)}", markdown_table([{"section": s.title, "status": s.status} for s in sections])]
    return "\n\n".join([*parts, *(f"## {s.title}: {s.status}\n\n" + "\n".join(f"- {x}" for x in s.lines) for s in sections)]) + "\n"


def key_summary(df: DataFrame, keys: list[str], positive: list[str]) -> DataFrame:
    """One row: rows, distinct keys, keys that repeat, and per numeric column its non-positive, infinite and null values."""
    per_key = df.groupBy(*keys).agg(F.count("*").alias("n"), *[F.count_if(F.col(c) <= 0).alias(f"{c}_low") for c in positive], *[F.count_if(F.abs(c) == float("inf")).alias(f"{c}_inf") for c in positive], *[F.count_if(F.col(c).isNull()).alias(f"{c}_null") for c in positive])
    sums = [F.sum(f"{c}_{k}").alias(f"{c}_{k}") for c in positive for k in ("low", "inf", "null")]
    return per_key.agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_keys"), F.count_if(F.col("n") > 1).alias("n_repeated"), *sums)


def disjoint_cover(items: DataFrame, parts: DataFrame, key: str, part: str) -> DataFrame:
    """One row: keys in several parts, keys of items in none, keys of parts that items don't have."""
    p = parts.groupBy(key).agg(F.countDistinct(part).alias("n_parts"))
    i = items.select(key).distinct().withColumn("is_item", F.lit(True))
    both = i.join(p, key, "full_outer")
    return both.agg(F.count_if(F.col("n_parts") > 1).alias("in_several"), F.count_if(F.col("n_parts").isNull()).alias("uncovered"), F.count_if(F.col("is_item").isNull()).alias("orphans"))


def leakage(df: DataFrame, keys: list[str], bucket: str) -> DataFrame:
    """(key_name, leaking): how many values of each key column are in more than one bucket; null values don't count."""
    out = None
    for k in keys:
        one = df.where(F.col(k).isNotNull()).groupBy(k).agg((F.min(bucket) < F.max(bucket)).alias("leaks")).agg(F.count_if("leaks").alias("leaking")).select(F.lit(k).alias("key_name"), "leaking")
        out = one if out is None else out.unionByName(one)
    return out


def expected_counts(found: DataFrame, expected: DataFrame, key: str, count: str = "n") -> DataFrame:
    """(key, found, expected, status) of two count tables: match, mismatch, unexpected or absent."""
    j = found.select(key, F.col(count).alias("found")).join(expected.select(key, F.col(count).alias("expected")), key, "full_outer")
    return j.withColumn("status", F.when(F.col("expected").isNull(), "unexpected").when(F.col("found").isNull(), "absent").when(F.col("found") == F.col("expected"), "match").otherwise("mismatch"))
