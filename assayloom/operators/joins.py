"""Joins with rules on matches: none may miss, exactly one may match, a coarser key may stand in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lookup(probe: DataFrame, build: DataFrame, keys: list[str], name: str) -> DataFrame:
    """probe with the columns of build; a repeated build key and a probe without match raise when they are read.

    One plan: the build side is folded to a row a key with its count, so neither
    side is read a second time for the checks.
    """
    rest = [c for c in build.columns if c not in keys]
    one = build.groupBy(*keys).agg(F.count("*").alias("_n"), F.first(F.struct(F.lit(True).alias("_found"), *rest)).alias("_row"))
    joined = probe.join(one, keys, "left")
    bad = lambda text: F.raise_error(F.lit(f"{name}: {text}")).cast("boolean")
    ok = F.when(F.col("_n").isNull(), bad("a row has no match")).when(F.col("_n") > 1, bad("a key stands more than once")).otherwise(True)
    return joined.where(ok).select(*probe.columns, *[F.col(f"_row.{c}").alias(c) for c in rest])


def lookup_columns(probe: DataFrame, build: DataFrame, keys: list[str]) -> DataFrame:
    """The lazy form of lookup: rows without match raise when they are read."""
    joined = probe.join(build.withColumn("_found", F.lit(True)), keys, "left")
    ok = F.when(F.col("_found").isNull(), F.raise_error(F.lit("a row has no match"))).otherwise(F.lit(True))
    return joined.withColumn("_found", ok).where("_found").drop("_found")


def by_level(probe: DataFrame, table: DataFrame, exact: Column, coarse: Column, values: list[str], default: dict[str, Column] | None = None, key: str = "match_key", level: str = "level") -> DataFrame:
    """probe with values from table's row of level species for the exact key, else of level genus for the coarse one.

    Adds matched: species, genus or none. default gives values for none.
    Table rows with a null value are as if they weren't there.
    """
    filled = table.where(" and ".join(f"`{v}` is not null" for v in values))
    side = lambda name, tag: filled.where(F.col(level) == name).select(F.col(key).alias(f"_{tag}"), *[F.col(v).alias(f"_{tag}_{v}") for v in values])
    p = probe.withColumn("_e", exact).withColumn("_c", coarse)
    p = p.join(side("species", "s"), F.col("_e") == F.col("_s"), "left").join(side("genus", "g"), F.col("_c") == F.col("_g"), "left")
    fallback = default or {}
    out = {v: F.when(F.col("_s").isNotNull(), F.col(f"_s_{v}")).when(F.col("_g").isNotNull(), F.col(f"_g_{v}")).otherwise(fallback.get(v, F.lit(None))) for v in values}
    matched = F.when(F.col("_s").isNotNull(), "species").when(F.col("_g").isNotNull(), "genus").otherwise("none")
    return p.withColumns({**out, "matched": matched}).select(*probe.columns, *values, "matched")


def matches(wanted: DataFrame, found: DataFrame, keys: list[str], values: list[str], default: dict[str, Column]) -> DataFrame:
    """Each wanted key with status and values of its only match; default if it has none or many (status zero_matches or many_matches)."""
    per = found.groupBy(*keys).agg(F.count("*").alias("_n"), *[F.min(v).alias(v) for v in values])
    j = wanted.select(*keys).distinct().join(per, keys, "left")
    one = F.coalesce(F.col("_n") == 1, F.lit(False))
    status = F.when(one, "matched").when(F.coalesce(F.col("_n"), F.lit(0)) == 0, "zero_matches").otherwise("many_matches")
    return j.select(*keys, status.alias("status"), *[F.when(one, F.col(v)).otherwise(default[v]).alias(v) for v in values])


def three_way(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side): both, left_only or right_only."""
    a, b = left.select(key).distinct().withColumn("_l", F.lit(1)), right.select(key).distinct().withColumn("_r", F.lit(1))
    return a.join(b, key, "full_outer").select(key, F.when(F.col("_r").isNull(), "left_only").when(F.col("_l").isNull(), "right_only").otherwise("both").alias("side"))


def refresh(kept: DataFrame, counts: DataFrame, keys: list[str], curated: list[str], count: str = "n") -> DataFrame:
    """A curated table with new counts: values stay, new keys come empty, keys without rows stay with 0. Adds change."""
    j = kept.select(*keys, *curated, F.lit(1).alias("_k")).join(counts.select(*keys, F.col(count).alias("_n")), keys, "full_outer")
    change = F.when(F.col("_k").isNull(), "new").when(F.col("_n").isNull(), "stale").otherwise("kept")
    return j.select(*keys, *curated, F.coalesce("_n", F.lit(0)).cast("long").alias(count), change.alias("change"))


def add_missing(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """table with those rows whose keys it lacks; other columns of new rows are null."""
    return table.unionByName(rows.join(table.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def single_source(rows: DataFrame, raw: DataFrame, keys: list[str]) -> DataFrame:
    """rows with those raw records that are the only one of their key."""
    only = raw.withColumn("_n", F.count("*").over(Window.partitionBy(*keys))).where("_n = 1").drop("_n")
    return rows.join(only, keys)


def first_rows(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key, by an aggregate that keeps one row a key and task instead of sorting groups."""
    rest = [c for c in df.columns if c not in keys]
    o = [c.alias(f"_o{i}") for i, c in enumerate(order)]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*o)).alias("_row")).select(*keys, "_row.*").select(*df.columns)


def moved_to(part: DataFrame, dropped: DataFrame, key: str, name: str, to: str) -> DataFrame:
    """part (key, bucket column name) with the dropped keys' bucket set to another one."""
    d = dropped.select(key).distinct().withColumn("_d", F.lit(True))
    return part.join(d, key, "left").withColumn(name, F.when(F.col("_d"), F.lit(to)).otherwise(F.col(name))).drop("_d")
