"""Column functions for free-text measurements, their bounds, units and labels."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

INF = float("inf")
_NUMBER = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)$"


def _number(text: Column) -> Column:
    """A plain decimal number, else null; only ASCII digits, no exponents or type suffixes."""
    t = F.trim(text)
    return F.when(t.rlike(_NUMBER), t.try_cast("double"))


def _strip(text: Column, *parts: str) -> Column:
    for p in parts:
        text = F.replace(text, F.lit(p), F.lit(""))
    return text


def parse_bounds(raw: Column, literal_repairs: dict[str, str] | None = None, compat: bool = False) -> Column:
    """struct<low, high, reason> of a measurement as people type it.

    Accepts "8", "4-8", "8±2", ">64", ">=64", "<0.5", "<=0.5", "up to 16", "NA"
    and "". A missing bound pair is (null, null); reason says why a text could not
    be read. Rules apply in a fixed order: repairs, range, lower bound, upper
    bound, spread, "up to", plain number. compat first deletes "±0.0" wherever it
    stands, as older tables did, by which "5±0.05" becomes 55.
    """
    repairs = {"4.5.5": "4.5-5", "16=128": "16-128"} if literal_repairs is None else literal_repairs
    t = raw
    for a, b in repairs.items():
        t = F.when(t == a, F.lit(b)).otherwise(t)
    t = _strip(F.replace(F.replace(_strip(t, "~"), F.lit("–"), F.lit("-")), F.lit("+"), F.lit("±")), "E6", "E")
    # a lambda's argument is evaluated once, which keeps the generated code small
    return F.transform(F.array(_strip(t, "±0.0") if compat else t), _read_bounds)[0]


def _read_bounds(t: Column) -> Column:
    bounds = lambda low, high: F.struct(low.cast("double").alias("low"), high.cast("double").alias("high"))
    both = lambda low, high: F.transform(F.array(bounds(low, high)), lambda b: F.when(b["low"].isNotNull() & b["high"].isNotNull(), b))[0]

    body = F.split(_strip(t, ">=", "=<", "=", " "), "-")
    left, right = F.element_at(body, 1), F.try_element_at(body, F.lit(2))
    low = F.when(left.startswith("<"), F.lit(0.0)).otherwise(_number(_strip(left, ">")))
    high = F.when(right.startswith(">"), F.lit(INF)).otherwise(_number(_strip(right, "<")))
    bare = _strip(F.regexp_replace(t, "±.*$", ""), ">", "<", "≥", "=", " ")
    err = F.replace(_strip(F.substring_index(t, "±", -1), " "), F.lit(","), F.lit("."))
    spread = lambda m, e: both(F.greatest(F.lit(0.0), m - e), m + e)
    number = lambda text: F.transform(F.array(text), _number)[0]
    read = (
        F.when(t.contains("-"), both(low, high))
        .when(t.rlike(">|≥"), both(number(bare), F.lit(INF)))
        .when(t.contains("<"), both(F.lit(0.0), number(bare)))
        .when(t == "NA", F.lit(None))
        .when(t.contains("±"), spread(number(bare), number(err)))
        .when(t.rlike("(?i)up to"), both(F.lit(0.0), number(_strip(F.regexp_replace(t, "(?i)up to", ""), " "))))
        .otherwise(F.transform(F.array(number(F.replace(_strip(t, " "), F.lit(","), F.lit(".")))), lambda x: both(x, x))[0])
    )
    missing = t.isNull() | (F.trim(t) == "") | (t == "NA")
    return F.transform(F.array(read), lambda b: F.struct(b["low"].alias("low"), b["high"].alias("high"), F.when(b.isNotNull(), F.lit("ok")).when(missing, F.lit("missing")).otherwise(F.lit("unreadable")).alias("reason")))[0]


def censoring(low: Column, high: Column) -> Column:
    """missing, censored, exact or ranged; open bounds are told before equal ones."""
    return F.when(low.isNull() | high.isNull(), F.lit("missing")).when((high == INF) | (low == 0), F.lit("censored")).when(low == high, F.lit("exact")).otherwise(F.lit("ranged"))


@lru_cache
def _significant(digits: int):
    form = f"%.{digits}g"

    @F.pandas_udf(T.DoubleType())
    def run(v: pd.Series) -> pd.Series:
        return v.map(lambda x: float(form % x), na_action="ignore")

    return run


def significant(value: Column, digits: int = 3) -> Column:
    """Rounded to 1 to 17 significant digits on the exact binary value, ties to even.

    Java's %g rounds the shortest decimal half up, so this one runs in Arrow batches.
    """
    if not 1 <= digits <= 17:
        raise ValueError("significant digits are 1 to 17")
    return _significant(digits)(value)


def to_micromolar(value: Column, weight: Column) -> Column:
    """µM from µg/mL, unrounded; null without a positive weight."""
    return F.when(weight > 0, value * 1000 / weight)


def micromolar(value: Column, unit: Column, weight: Column) -> Column:
    """µM from a value in µM or µg/ml, null for any other unit."""
    return F.when(unit == "µM", value).when(unit == "µg/ml", to_micromolar(value, weight))


def measurement_kind(n: Column, low: Column, high: Column) -> Column:
    """averaged for two measurements or more, else exact or censored."""
    return F.when(n >= 2, F.lit("averaged")).when(censoring(low, high).isin("censored", "ranged"), F.lit("censored")).otherwise(F.lit("exact"))


def label(kind: Column, value: Column, active_at: Column, inactive_at: Column, low: Column | None = None, high: Column | None = None) -> Column:
    """struct<label, reason>: active, inactive, uncertain or unlabeled.

    An interval is active if all of it is at or under the active breakpoint,
    which is tested first, and inactive if all of it is at or over the other.
    Censored measurements need bounds; an unknown kind raises.
    """
    low, high = F.lit(None).cast("double") if low is None else low, F.lit(None).cast("double") if high is None else high
    a = F.when(kind == "censored", low).otherwise(value)
    b = F.when(kind == "censored", high).otherwise(value)
    out = lambda name, why: F.struct(F.lit(name).alias("label"), F.lit(why).alias("reason"))
    fail = lambda text: F.struct(F.raise_error(F.lit(text)).cast("string").alias("label"), F.lit("").alias("reason"))
    return (
        F.when(active_at.isNull() | inactive_at.isNull(), out("unlabeled", "no_threshold"))
        .when(~kind.isin("exact", "averaged", "censored") | kind.isNull(), fail("unknown measurement kind"))
        .when(a.isNull() | b.isNull(), fail("a measurement without bounds"))
        .when(b <= active_at, out("active", "at_or_below_active"))
        .when(a >= inactive_at, out("inactive", "at_or_above_inactive"))
        .when(kind == "censored", out("uncertain", "interval_crosses"))
        .otherwise(out("uncertain", "between_breakpoints"))
    )


def close(a: Column, b: Column, relative: float, absolute: float = 0.0) -> Column:
    """Whether two numbers agree within a relative or an absolute tolerance."""
    return F.abs(a - b) <= F.greatest(F.lit(relative) * F.greatest(F.abs(a), F.abs(b)), F.lit(absolute))


def first_failure(*rules: tuple[Column, str], passed: str | None = None) -> Column:
    """Name of the first rule (condition that fails a row, name) that holds, in the order given."""
    out = None
    for condition, name in rules:
        hit = F.coalesce(condition, F.lit(False))
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out.otherwise(F.lit(passed))


def fold_number(text: Column) -> Column:
    """Fold ids as written by other tools ("0", "3.0", ""): an int or null."""
    return F.when(F.trim(text) != "", text.try_cast("double").cast("int"))


def flag(text: Column) -> Column:
    """"True"/"False" in any case as a boolean, null for anything else."""
    return F.lower(F.trim(text)).try_cast("boolean")


def plain_number(text: Column) -> Column:
    """Whether a text is digits with an optional fraction, white space around it allowed."""
    return F.coalesce(text.rlike(r"^\s*[0-9]+(\.[0-9]+)?\s*$"), F.lit(False))


def coerced(text: Column) -> Column:
    """A number written with or without exponent as a double, null for anything else."""
    t = F.trim(text)
    return F.when(t.rlike(r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"), t.try_cast("double"))


def thousands(value: Column) -> Column:
    """A whole number with commas."""
    return F.format_number(value.cast("long"), 0)


def recast(df, bools: list[str] = (), ints: list[str] = (), doubles: list[str] = ()):
    """df with text columns as booleans, integers (also "3.0") and doubles, as tables that a tracker logged come back."""
    cols = {c: flag(F.col(c)) for c in bools} | {c: coerced(F.col(c)).cast("long") for c in ints} | {c: coerced(F.col(c)) for c in doubles}
    return df.withColumns(cols)


def next_version(text: str, default: str = "0.1.0") -> str:
    """The version after the newest one in a changelog's headings ("## [1.2.3]"), its last part raised by one."""
    import re

    found = [tuple(map(int, m)) for m in re.findall(r"(?m)^#+\s*\[?v?([0-9]+)\.([0-9]+)\.([0-9]+)\]?", text)]
    return "{}.{}.{}".format(*max(found)[:2], max(found)[2] + 1) if found else default
