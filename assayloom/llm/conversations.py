"""Repair of conversations by weighted finite-state composition.

Method: a conversation is an acceptor, one arc a row; the edits keep, rerole,
delete and insert are a transducer with a weight each; the roles that may follow
each other are an acceptor. The three are composed lazily, state by state, and
the shortest path in topological order is the repair. Weights are pairs of cost
and labels (the edits' initials), compared as such, so that of cheapest paths
the one with the least labels counts.

A conversation of any length is dealt to runs of at most 256 rows. A run is
summed up as its shortest paths between the grammar's states, whose labels are
replaced by their ranks: paths over the same rows to different states never
have labels of which one starts the other (the last label is a row's, and equal
labels lead to equal states), so ranks are all that the next level needs. Runs'
sums are joined level by level, 256 at a time; on the way back each run gets the
states where the best path enters and leaves it, and finds its own labels. No
group is larger than 256 small rows. A repaired conversation's hash is taken as
its rows stream by in order, a batch at a time; nothing of them is held.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

RUN = 256
SOLID = r"[^\x20\x09-\x0D]"

# The weights of the edits, and what a truncated row costs if it stays.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3

#: The grammar of role initials s?(ua)+ or nothing: next state by state and initial.
START, SYSTEM, USER, ASSISTANT = range(4)
GRAMMAR = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
FINAL = (START, ASSISTANT)
STATES = range(4)
_FAR = 1 << 60

#: A row as the input acceptor sees it: its role's initial (others: "x") and its fault (n none, t truncated, d to be deleted).
ROLES, FAULTS = "suax", "ntd"


def edits(symbol: str | None):
    """Arcs (label, initial that comes out or "", weight) of the edit transducer: over a row, or over nothing (None)."""
    if symbol is None:
        return [("I", r, INSERT) for r in "ua"]
    role, fault = symbol
    out = [("D", "", DELETE)]
    if fault != "d":
        stays = TRUNCATED * (fault == "t")
        out += [("K", role, stays), *[("R", r, REROLE + stays) for r in "ua"]]
    return out


def arcs(state: int, symbol: str | None) -> list[tuple[str, int, int]]:
    """Arcs (label, next state, weight) that leave a composed state over a row's symbol, or over nothing."""
    return [(label, GRAMMAR[state, r] if r else state, w) for label, r, w in edits(symbol) if not r or (state, r) in GRAMMAR]


@lru_cache(maxsize=None)
def inserted(state: int) -> dict[int, tuple[int, str]]:
    """Weight and labels of the shortest insertions that lead from a state to each other one."""
    best, new = {state: (0, "")}, [state]
    while new:
        was, new = new, []
        for q in was:
            for label, p, w in arcs(q, None):
                if p not in best:
                    best[p] = (best[q][0] + w, best[q][1] + label)
                    new.append(p)
    return best


@lru_cache(maxsize=None)
def step(state: int, symbol: str) -> dict[int, tuple[int, str]]:
    """The best (weight, labels) from a state to each other one over insertions and then one row."""
    out: dict[int, tuple[int, str]] = {}
    for q, (w, labels) in inserted(state).items():
        for label, p, more in arcs(q, symbol):
            out[p] = min(out.get(p, (_FAR, "")), (w + more, labels + label))
    return out


def ends(state: int) -> tuple[int, str]:
    """The best insertions after the last row."""
    return min(got for q, got in inserted(state).items() if q in FINAL)


@lru_cache(maxsize=1 << 16)
def paths(symbols: str) -> tuple[tuple[tuple[int, str] | None, ...], ...]:
    """The best (weight, labels) from each state to each other one over a run's symbols, two letters a row."""
    # from the last row to the first: the best rest of a path stays the best behind any first part
    best = [[(0, "") if q == e else None for e in STATES] for q in STATES]
    for k in range(len(symbols) - 2, -1, -2):
        now = [[None] * len(STATES) for _ in STATES]
        for q in STATES:
            for p, (w, labels) in step(q, symbols[k : k + 2]).items():
                for e in STATES:
                    rest = best[p][e]
                    if rest is not None:
                        one = (w + rest[0], labels + rest[1])
                        if now[q][e] is None or one < now[q][e]:
                            now[q][e] = one
        best = now
    return tuple(map(tuple, best))


def summary(symbols: str) -> list[int]:
    """Costs of paths(), state by state, and then their labels' ranks among those that start in the same state; -1 where there is no path."""
    costs, ranks = [], []
    for row in paths(symbols):
        order = {s: r for r, s in enumerate(sorted(x[1] for x in row if x))}
        costs += [x[0] if x else -1 for x in row]
        ranks += [order[x[1]] if x else -1 for x in row]
    return costs + ranks


def joined(a: list[int], b: list[int]) -> list[int]:
    """The summary of two neighbouring runs."""
    costs, ranks = [], []
    for q in STATES:
        row = []
        for e in STATES:
            ways = [(a[4 * q + m] + b[4 * m + e], a[16 + 4 * q + m], b[16 + 4 * m + e]) for m in STATES if a[4 * q + m] >= 0 and b[4 * m + e] >= 0]
            row.append(min(ways, default=None))
        order = {x: r for r, x in enumerate(sorted({x[1:] for x in row if x}))}
        costs += [x[0] if x else -1 for x in row]
        ranks += [order[x[1:]] if x else -1 for x in row]
    return costs + ranks


def best_end(total: list[int]) -> tuple[int, int]:
    """(cost, last state) of the best path over a whole conversation, from the start."""
    cost, _, e = min((total[e] + ends(e)[0], total[16 + e], e) for e in STATES if total[e] >= 0 and any(q in FINAL for q in inserted(e)))
    return cost, e


def states_between(runs: list[list[int]], first: int, last: int) -> list[int]:
    """The states before, between and after neighbouring runs on the best path from first to last."""
    rest = [None] * (len(runs) + 1)  # costs to last, by state
    rest[-1] = [0 if q == last else None for q in STATES]
    for k in range(len(runs) - 1, -1, -1):
        a = runs[k]
        rest[k] = [min((a[4 * q + m] + rest[k + 1][m] for m in STATES if a[4 * q + m] >= 0 and rest[k + 1][m] is not None), default=None) for q in STATES]
    out = [first]
    for a, then in zip(runs, rest[1:]):
        q = out[-1]
        out.append(min((a[4 * q + m] + then[m], a[16 + 4 * q + m], m) for m in STATES if a[4 * q + m] >= 0 and then[m] is not None)[2])
    return out


def repaired_roles(labels: str, state: int, roles: list[str]) -> tuple[list[list[str]], list[str | None]]:
    """For each row, the roles inserted before it, and the role that it has in the end (None if deleted)."""
    before, own, now = [], [], []
    it = iter(roles)
    for label in labels:
        role = "ua"[state == USER] if label in "IR" else None
        if label == "I":
            now.append({"u": "user", "a": "assistant"}[role])
        else:
            was = next(it)
            own.append(None if label == "D" else was if label == "K" else {"u": "user", "a": "assistant"}[role])
            before.append(now)
            now = []
        if label != "D":
            state = GRAMMAR[state, role or own[-1][:1]]
    return before, own


def damaged(rows: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text) as a noisy channel leaves them; nulls in role and text are a space.

    The CRC-32 of "conv_id:turn" (null: a space) modulo 20 says what happens to a
    row: 0 drops it, 1 empties its text, 2 takes its marks [.!?] out, 3 repeats
    it, 4 makes it the user's.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    how = F.pmod(F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")), F.lit(20))
    d = rows.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), how.alias("how")).where("how <> 0")
    d = d.withColumn("text", F.when(F.col("how") == 1, "").when(F.col("how") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))).withColumn("role", F.when(F.col("how") == 4, "user").otherwise(F.col("role")))
    return d.select("conv_id", "turn", "role", "text", F.explode(F.when(F.col("how") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy")).drop("_copy")


_SUM = "first string, last string, low long, high long, first_turn long, last_turn long, turns long, blank long, duplicate long, truncated long, illegal long, m array<long>"
_NAMES = [x.split()[0] for x in _SUM.split(", ")]
_LEGAL = {"su", "ua", "au"}


def _plus(a: dict, b: dict) -> dict:
    """The sums of two neighbouring runs of one conversation."""
    some = lambda f, *v: f(v) if (v := [x for x in v if x is not None]) else None
    return {
        "first": a["first"], "last": b["last"], "low": some(min, a["low"], b["low"]), "high": some(max, a["high"], b["high"]), "first_turn": a["first_turn"], "last_turn": b["last_turn"],
        # rows come by turn: a turn that goes on in the next run is one
        "turns": a["turns"] + b["turns"] - (a["last_turn"] is not None and a["last_turn"] == b["first_turn"]),
        "illegal": a["illegal"] + b["illegal"] + (a["last"] + b["first"] not in _LEGAL), "m": joined(a["m"], b["m"]), **{k: a[k] + b[k] for k in ("blank", "duplicate", "truncated")},
    }


def _symbols(items: list[dict]) -> str:
    return "".join((x["r"] if x["r"] in ("s", "u", "a") else "x") + ("d" if x["f"] in (1, 2) else "t" if x["f"] == 3 else "n") for x in items)


def _of_run(items: list[dict]) -> dict:
    """The sums of a run's rows: items with r (role's initial), f (0 none, 1 blank, 2 duplicate, 3 truncated) and turn."""
    turns = [x["turn"] for x in items]
    known = [t for t in turns if t is not None]
    faults = [x["f"] for x in items]
    return {
        "first": items[0]["r"], "last": items[-1]["r"], "low": known[0] if known else None, "high": known[-1] if known else None, "first_turn": turns[0], "last_turn": turns[-1], "turns": len(set(known)),
        "blank": faults.count(1), "duplicate": faults.count(2), "truncated": faults.count(3), "illegal": sum(p["r"] + q["r"] not in _LEGAL for p, q in zip(items, items[1:])), "m": summary(_symbols(items)),
    }


def _map(df: DataFrame, make, out: str) -> DataFrame:
    """The rows that make(row) gives, dicts with the columns out, for each row as a dict."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(df.sparkSession.createDataFrame([], out).schema)

    def run(it):
        for batch in it:
            for a in range(0, batch.num_rows, 1024):
                rows = [x for r in batch.slice(a, 1024).to_pylist() for x in make(r)]
                yield pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in rows], f.type) for f in schema], schema=schema)

    return df.mapInArrow(run, out)


def _in_order(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text), written by conversation and turn, with h (the text's digest) and at, the place among all rows.

    Nulls come first; rows of one turn stand by role and digest, so that equal
    ones are neighbours.
    """
    # the number spreads rows that agree in everything over ranges
    d = materialize(rows.withColumn("h", F.sha2("text", 256)).withColumn("_row", F.monotonically_increasing_id()))
    by = ["conv_id", "turn", "role", "h", "_row"]
    d = materialize(d.repartitionByRange(*by).sortWithinPartitions(*by).drop("_row").withColumn("_at", F.monotonically_increasing_id())).withColumn("_p", F.shiftright("_at", 33))
    # one row a partition
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = d.groupBy("_p").agg(F.count("*").alias("_n"), F.min("_at").alias("_first")).select("_p", (before - F.col("_first")).alias("_shift"))
    return d.join(F.broadcast(starts), "_p").withColumn("at", F.col("_at") + F.col("_shift")).drop("_p", "_at", "_shift")


def _symbols_of(rows: DataFrame) -> DataFrame:
    """(conv_id, at, turn, r, f) of ordered rows: the role's initial and the first fault, 1 blank, 2 seen before, 3 truncated or 0."""
    solid = F.rtrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r"))
    own = rows.select("conv_id", "at", "turn", F.substring("role", 1, 1).alias("r"), (solid == "").alias("_blank"), F.substring(solid, -1, 1).isin(".", "!", "?").alias("_whole"))
    first = rows.groupBy("conv_id", "role", "h").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("_new"))
    fault = F.when(F.col("_blank"), 1).when(F.col("_new").isNull(), 2).when(~F.col("_whole"), 3).otherwise(0)
    return own.join(first, "at", "left").select("conv_id", "at", "turn", "r", fault.alias("f"))


def _sums(level: DataFrame, run: str) -> DataFrame:
    """The next level: (conv_id, run, parts) with the sums of up to RUN neighbouring runs, whose sums are kept as parts."""
    part = F.struct("run", *_NAMES)
    up = level.groupBy("conv_id", F.shiftright("run", 8).alias("up")).agg(F.array_sort(F.collect_list(part)).alias("parts"))

    def make(row):
        total = None
        for x in row["parts"]:
            total = x if total is None else _plus(total, x)
        return [{**total, "conv_id": row["conv_id"], "run": row["up"], "parts": [{"run": x["run"], "m": x["m"]} for x in row["parts"]]}]

    return materialize(_map(up, make, f"conv_id {run}, run long, parts array<struct<run: long, m: array<long>>>, {_SUM}"))


def align(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edited, totals) of conversations (conv_id, turn, role, text without nulls in role and text).

    edited: (conv_id, at, turn, text, role, before, after, labels) of every row in
    order: its role in the end (null: deleted), the roles inserted before it and
    after the last one, and its edits' initials. totals: (conv_id, cost, sums) of
    every conversation that has rows.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    ordered = materialize(_in_order(rows))
    small = F.array_sort(F.collect_list(F.struct("at", "turn", "r", "f")))
    runs = _symbols_of(ordered).groupBy("conv_id", F.shiftright("at", 8).alias("run")).agg(small.alias("items"))
    runs = materialize(_map(runs, lambda row: [{**row, **_of_run(row["items"])}], f"conv_id {kind}, run long, items array<struct<at: long, turn: long, r: string, f: int>>, {_SUM}"))
    n_runs = materialize(runs.groupBy("conv_id").agg(F.count("*").alias("_n")).withColumnRenamed("conv_id", "_c"))
    sized = runs.drop("items").join(n_runs, F.col("conv_id").eqNullSafe(F.col("_c"))).drop("_c")
    whole = sized.where("_n = 1").drop("_n")
    levels, level = [], sized.where("_n > 1").drop("_n")
    rest = ordered.agg(F.max("at")).first()[0] or 0
    # numbers of runs shrink to one digit of RUN after the other, until a conversation has one
    while (rest := rest >> 8) and not level.isEmpty():
        level = _sums(level, kind)
        levels.append(level)
    totals = whole.select("conv_id", "run", *_NAMES)
    if levels:
        totals = totals.unionByName(levels[-1].select("conv_id", "run", *_NAMES))
    end = lambda row: [{**row, **dict(zip(("cost", "exit"), best_end(row["m"]))), "enter": START, "tail": True}]
    totals = materialize(_map(totals, end, f"conv_id {kind}, run long, {_SUM}, cost long, enter int, exit int, tail boolean"))

    way = ["conv_id", "run", "enter", "exit", "tail"]
    known = totals.select(*way)

    def between(row):
        runs = [x["m"] for x in row["parts"]]
        q = states_between(runs, row["enter"], row["exit"])
        return [{"conv_id": row["conv_id"], "run": x["run"], "enter": a, "exit": b, "tail": row["tail"] and k == len(runs) - 1} for k, (x, a, b) in enumerate(zip(row["parts"], q, q[1:]))]

    met = lambda table, keys: table.join(keys.select(F.col("conv_id").alias("_c"), F.col("run").alias("_r"), "enter", "exit", "tail"), F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("run") == F.col("_r")))
    done = known
    if levels:
        several = known.join(n_runs.where("_n > 1"), F.col("conv_id").eqNullSafe(F.col("_c")), "left_semi")
        done = known.join(n_runs.where("_n > 1"), F.col("conv_id").eqNullSafe(F.col("_c")), "left_anti")
        for level in reversed(levels):
            several = materialize(_map(met(level.select("conv_id", "run", "parts"), several).select("conv_id", "parts", "enter", "exit", "tail"), between, f"conv_id {kind}, run long, enter int, exit int, tail boolean"))
        done = done.unionByName(several)

    def label(row):
        items = row["items"]
        labels = paths(_symbols(items))[row["enter"]][row["exit"]][1]
        before, own = repaired_roles(labels, row["enter"], [x["r"] for x in items])
        parts, now = [], ""
        for c in labels:
            now += c
            if c != "I":
                parts.append(now)
                now = ""
        after = ends(row["exit"])[1] if row["tail"] else ""
        last, q = [], row["exit"]
        for _ in after:
            q = USER if q != USER else ASSISTANT
            last.append("user" if q == USER else "assistant")
        parts[-1] += after
        return [{"at": x["at"], "kept": "K" in p, "new_role": o, "before": b, "after": last if j == len(items) - 1 else [], "labels": p} for j, (x, b, o, p) in enumerate(zip(items, before, own, parts))]

    edits_of = _map(met(runs.select("conv_id", "run", "items"), done).select("items", "enter", "exit", "tail"), label, "at long, kept boolean, new_role string, before array<string>, after array<string>, labels string")
    edited = ordered.join(edits_of, "at").select("conv_id", "at", "turn", "text", F.when(F.col("kept"), F.col("role")).otherwise(F.col("new_role")).alias("role"), "before", "after", "labels")
    return edited, totals


def repaired(edited: DataFrame) -> DataFrame:
    """(conv_id, at, part, turn, role, text) of the conversations after their repair, in order of (at, part); inserted rows have empty texts and no turn."""
    put = lambda names: F.transform(names, lambda r: F.struct(F.lit(None).cast("long").alias("turn"), r.alias("role"), F.lit("").alias("text")))
    own = F.when(F.col("role").isNotNull(), F.array(F.struct(F.col("turn").cast("long").alias("turn"), "role", "text"))).otherwise(F.expr("array()"))
    return edited.select("conv_id", "at", F.posexplode(F.concat(put("before"), own, put("after"))).alias("part", "x")).select("conv_id", "at", "part", "x.*")


def _digests(edited: DataFrame) -> DataFrame:
    """(conv_id, audit, repaired_sha256): rows stream by in order, so that of a conversation only its audit and its hash's state are held."""
    line = lambda names: F.transform(names, lambda r: F.concat(r, F.lit(":")))
    own = F.when(F.col("role").isNotNull(), F.array(F.concat("role", F.lit(":"), "text"))).otherwise(F.array().cast("array<string>"))
    lines = F.concat(line("before"), own, line("after"))
    piece = F.when(F.size(lines) > 0, F.array_join(lines, "\n"))
    d = edited.select("conv_id", "at", piece.alias("piece"), "labels").repartition("conv_id").sortWithinPartitions("conv_id", "at").drop("at")
    kind = edited.schema["conv_id"].dataType.simpleString()

    def run(it):
        schema, now, h, some, audit = None, None, None, False, []
        for batch in it:
            schema = schema or pa.schema([("conv_id", batch.schema.field("conv_id").type), ("audit", pa.string()), ("repaired_sha256", pa.string())])
            out = []
            for c, piece, labels in zip(*[batch.column(k).to_pylist() for k in ("conv_id", "piece", "labels")]):
                if h is None or c != now:
                    if h is not None:
                        out.append((now, "".join(audit), h.hexdigest()))
                    now, h, some, audit = c, hashlib.sha256(), False, []
                if piece is not None:
                    h.update((("\n" if some else "") + piece).encode("utf-8", "surrogatepass"))
                    some = True
                audit.append(labels)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], f.type) for k, f in enumerate(schema)], schema=schema)
        if h is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((now, "".join(audit), h.hexdigest()), schema)], schema=schema)

    return d.mapInArrow(run, f"conv_id {kind}, audit string, repaired_sha256 string")


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def report(rows: DataFrame, noisy: bool = True) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conv_id of rows (conv_id, turn, role, text, ...).

    With noisy, rows pass damaged() first. Rows of a conversation stand by turn
    (null first; within a turn by role and the text's digest); a null conv_id is
    a conversation like any other. Nulls in role and text are a space, repeated
    rows are duplicates; a conversation without rows after the damage has zeros,
    an empty audit and the hash of nothing, and an empty table gives no rows.
    Texts and conversations may be of any length; other columns take no part,
    whatever their names.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    d = damaged(rows) if noisy else rows.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"))
    edited, totals = align(d.withColumn("turn", F.col("turn").cast("long")))
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).alias("gaps")
    names = rows.select("conv_id").distinct()
    sums = totals.select(F.col("conv_id").alias("_c"), gaps, *_COUNTS[1:])
    ended = _digests(edited).withColumnRenamed("conv_id", "_d")
    j = names.join(sums, F.col("conv_id").eqNullSafe(F.col("_c")), "left").join(ended, F.col("conv_id").eqNullSafe(F.col("_d")), "left")
    none = {"audit": "", "repaired_sha256": hashlib.sha256().hexdigest()}
    return j.select("conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in _COUNTS], *[F.coalesce(c, F.lit(v)).alias(c) for c, v in none.items()])
