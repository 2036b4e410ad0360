"""Best-fit packing of token pieces into fixed-size sequences.

Method: hierarchical residual packing. Items are dealt over groups by a hash,
each group packs best-fit decreasing, and bins that are not nearly full go on
as items to a merge tree, where fan_in groups at a time pack them best-fit
again. At most one bin of a group is half empty or more, so a merge can only
place fan_in such bins; it needs no more than the fan_in emptiest bins of each
child to find room for them. Hence fan_in + 1 bins a group go on, whatever the
size of the table, and every other bin is final; carry_all sends every underfull
bin up instead, for comparison and for tables whose root fits one task.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, materialize
from .tokens import encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def tokenize_pieces(docs: DataFrame, path: str, kind: str, capacity: int, end_id: int, keep_ids: bool = False, keep: str | None = None, cache_size: int = 2_400_000) -> DataFrame:
    """Pieces of at most capacity ids of each document (doc_id, text), its end id included.

    A null or empty text is the end id alone; a null doc_id stays null; repeated
    doc_ids and repeated rows are documents of their own; an empty table has no
    pieces. Only documents over capacity are cut, and the remainder is their
    first piece. keep_ids adds the ids (little-endian 32-bit) of each piece; keep
    names a column of longs that is copied. Other columns take no part.
    cache_size bounds the entries that a worker's encoder remembers.
    """
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids, *[keep] * bool(keep)]
    types = [pa.int64(), pa.int32(), *[pa.int64()] * 3, *[pa.binary()] * keep_ids, *[pa.int64()] * bool(keep)]

    def run(it):
        enc = encoder(path, kind, cache_size=cache_size)
        for batch in batches(it):
            ids = enc.encode([t or "" for t in batch.column("text").to_pylist()])
            own = batch.column(keep).to_pylist() if keep else [None] * batch.num_rows
            rows = []
            for d, x, o in zip(batch.column("doc_id").to_pylist(), ids, own):
                x = np.append(x, np.uint32(end_id)).astype("<u4")
                first = len(x) % capacity or capacity
                cuts = [0, *range(first, len(x) + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    raw = x[a:b].tobytes()
                    rows.append((d, k, a, b - a, zlib.crc32(raw), *[raw] * keep_ids, *[o] * bool(keep)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    got = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *[keep] * bool(keep))
    return got.mapInArrow(run, PIECES + ", ids binary" * keep_ids + f", `{keep}` long" * bool(keep))


def best_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """Best-fit in the given order: each item's bin and offset, and each bin's fill."""
    by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, bins, offsets, fill = 0, [], [], []
    for n in lengths:
        fits = mask >> n
        if fits:
            free = n + (fits & -fits).bit_length() - 1
            at = by_free[free].pop()
            if not by_free[free]:
                mask &= ~(1 << free)
        else:
            free, at = capacity, len(fill)
            fill.append(0)
        bins.append(at)
        offsets.append(fill[at])
        fill[at] += n
        by_free[free - n].append(at)
        mask |= 1 << (free - n)
    return bins, offsets, fill


def _emptiest(fill: list[int], capacity: int, n: int | None, nearly_full: float) -> set[int]:
    under = sorted((f, i) for i, f in enumerate(fill) if f < nearly_full * capacity)
    return {i for _, i in under[:n]}


def pack(pieces: DataFrame, capacity: int, group_items: int = 1 << 15, fan_in: int = 8, nearly_full: float = 0.98, carry_all: bool = False) -> DataFrame:
    """pieces (doc_id, piece, length, ...) with sequence_id and offset; a length is 1 to capacity.

    Offsets in a sequence run gapless from 0. group_items: items a packing task
    takes on average. Other columns are kept, whatever their names, but for
    sequence_id and offset, which are replaced. Rows are dealt by numbers that are
    written with them, so null doc_ids, ties and repeated rows spread like any
    others, and a retried task packs the same items again. An empty table has no
    sequences.
    """
    own = {c: f"_c{i}" for i, c in enumerate(pieces.columns)}
    names, length = list(own.values()), own["length"]
    pieces = materialize(pieces.toDF(*names).withColumn("_row", F.monotonically_increasing_id()))
    total = pieces.count()
    groups = max(1, math.ceil(total / group_items))
    most = None if carry_all else fan_in + 1
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema if f.name != "_row") + ", sequence_id long, offset long, carried_fill long"

    def first(key, pdf):
        pdf = pdf.sort_values([length, "_row"], ascending=[False, True])
        bins, offsets, fill = best_fit(pdf[length].tolist(), capacity)
        on = _emptiest(fill, capacity, most, nearly_full) if groups > 1 else set()
        base = int(key[0]) << 32
        return pdf[names].assign(
            sequence_id=[base + b for b in bins],
            offset=offsets,
            carried_fill=pd.array([fill[b] if o == 0 and b in on else None for b, o in zip(bins, offsets)], dtype="Int64"),
        )

    dealt = pieces.withColumn("_g", F.pmod(F.xxhash64("_row"), F.lit(groups)))
    placed = materialize(dealt.groupBy("_g").applyInPandas(first, schema))
    back = [F.col(v).alias(c) for c, v in own.items() if c not in ("sequence_id", "offset")]
    if groups == 1:
        return placed.select(*back, "sequence_id", "offset")

    carried = placed.where("carried_fill is not null").select(
        F.shiftright("sequence_id", 32).alias("g"), F.col("sequence_id").alias("bin"), F.col("carried_fill").alias("fill"),
        F.array(F.struct(F.col("sequence_id").alias("bin"), F.lit(0).cast("long").alias("shift"))).alias("members"),
    )

    def merge(key, pdf):
        pdf = pdf.sort_values(["fill", "bin"], ascending=[False, True])
        bins, offsets, fill = best_fit(pdf["fill"].tolist(), capacity)
        on = _emptiest(fill, capacity, most, nearly_full)
        out: dict[int, list] = {}
        for b, o, name, members in zip(bins, offsets, pdf["bin"], pdf["members"]):
            row = out.setdefault(b, [int(key[0]), int(name), fill[b], [], b in on])
            row[3] += [{"bin": int(m["bin"]), "shift": int(m["shift"]) + o} for m in members]
        return pd.DataFrame(list(out.values()), columns=["g", "bin", "fill", "members", "up"])

    done = []
    while groups > 1:
        groups = math.ceil(groups / fan_in)
        up = F.floor(F.col("g") / fan_in).cast("long").alias("g")
        level = materialize(carried.select(up, "bin", "fill", "members").groupBy("g").applyInPandas(merge, "g long, bin long, fill long, members array<struct<bin: long, shift: long>>, up boolean"))
        done.append(level.where("not up") if groups > 1 else level)
        carried = level.where("up").drop("up")
    final = done[0]
    for x in done[1:]:
        final = final.union(x)
    moved = final.where("size(members) > 1").select(F.col("bin").alias("_to"), F.explode("members").alias("m")).select("_to", F.col("m.bin").alias("_bin"), F.col("m.shift").alias("_shift"))
    return (
        placed.join(moved, placed.sequence_id == moved._bin, "left")
        .select(*back, F.coalesce("_to", "sequence_id").alias("sequence_id"), (F.col("offset") + F.coalesce("_shift", F.lit(0))).alias("offset"))
    )
