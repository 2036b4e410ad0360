"""Shared helpers: intermediate tables, word hashing and connected components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
WORD_RE = re.compile(WORD)
_MASK = (1 << 64) - 1
_BASES = (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1)


_OWN = "spark.assayloom.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); one of our own only on a local master."""
    # a session cannot be given spark.checkpoint.dir later on
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(_OWN, None)
    if path:
        return path
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    path = "file://" + tempfile.mkdtemp(prefix="assayloom-")
    spark.conf.set(_OWN, path)
    return path


def tables_dir(spark: SparkSession) -> str:
    """Where this application's intermediate tables are."""
    return f"{shared_dir(spark)}/tables/{spark.sparkContext.applicationId}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back.

    This cuts the lineage with files that survive a lost executor. Spark removes
    the shuffle files of the write as soon as it is done, as nothing reads them again.
    """
    spark = df.sparkSession
    path = f"{tables_dir(spark)}/{uuid.uuid4().hex}"
    was = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, was)
    out = spark.read.schema(df.schema).parquet(path)
    out._assayloom_path = path
    made.append(path)
    return out


#: Paths of materialize()'s tables, in order, that have not been removed.
made: list[str] = []


def _remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def discard(*tables: DataFrame) -> None:
    """Removes materialize()'s tables that nothing reads any more."""
    for t in tables:
        remove_paths(t.sparkSession, [t._assayloom_path])


def remove_paths(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        _remove(spark, path)
        if path in made:
            made.remove(path)


def drop_tables(spark: SparkSession) -> None:
    """Removes all intermediate tables of this application. For callers that have written their results."""
    _remove(spark, tables_dir(spark))
    made.clear()


def parts_for(spark: SparkSession, n_bytes: int, per_part: int) -> int:
    """Number of partitions that hold about per_part bytes each, and at least the session's."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // per_part))


def batches(it: Iterable, max_bytes: int = 4 << 20, text: str = "text") -> Iterator:
    """Slices of Arrow batches that hold about max_bytes of text each (one row at least)."""
    import pyarrow.compute as pc

    for batch in it:
        if not batch.num_rows:
            continue
        size = np.nan_to_num(np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), dtype=np.int64))
        part = np.cumsum(size) // max_bytes
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def mix64(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser over uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def append(docs: DataFrame, make, new: list[tuple[str, str]], max_bytes: int = 1 << 20) -> DataFrame:
    """docs with the further columns new (name, type), made per batch as Arrow arrays by make(texts).

    docs has a column text (null: given as "") and any others, which pass
    through unchanged; those that clash with a new name are replaced.
    """
    import pyarrow as pa

    names, added = docs.columns, [n for n, _ in new]
    at = names.index("text")
    schema = ", ".join([f"`_{i}` {f.dataType.simpleString()}" for i, f in enumerate(docs.schema)] + [f"`_new_{n}` {t}" for n, t in new])

    def run(it):
        for batch in batches(it, max_bytes, f"_{at}"):
            out = make([t or "" for t in batch.column(at).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, *out], [*batch.schema.names, *[f"_new_{n}" for n in added]])

    out = docs.toDF(*[f"_{i}" for i in range(len(names))]).mapInArrow(run, schema)
    return out.select(*[F.col(f"_{i}").alias(n) for i, n in enumerate(names) if n not in added], *[F.col(f"_new_{n}").alias(n) for n in added])


_powers: dict[tuple[int, bool], np.ndarray] = {}


def _power(which: int, inverse: bool, n: int) -> np.ndarray:
    have = _powers.get((which, inverse))
    if have is None or len(have) < n:
        base = _BASES[which]
        base = pow(base, -1, 1 << 64) if inverse else base
        steps = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        steps[0] = 1
        have = _powers[which, inverse] = np.multiply.accumulate(steps)
    return have[:n]


class Words:
    """Words of many texts at once, as byte spans of one buffer.

    start, end: byte spans; first: index of each text's first word, with the
    number of all words at the end.
    """

    def __init__(self, texts: list[str | None], lower: bool = False):
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        joined = b" ".join(raw) + b" "
        self.data = joined.lower() if lower else joined
        b = self.bytes = np.frombuffer(self.data, dtype=np.uint8)
        solid = ~((b == 32) | ((b >= 9) & (b <= 13)))
        edge = np.flatnonzero(np.diff(solid, prepend=False))
        self.start, self.end = edge[::2], edge[1::2]
        at = np.cumsum([0, *(len(x) + 1 for x in raw)])
        self.first = np.searchsorted(self.start, at)
        self.first[-1] = len(self.start)

    def hashes(self, which: int = 0) -> np.ndarray:
        """A 64-bit polynomial hash of every word, the same wherever the word stands."""
        n = len(self.bytes)
        if not len(self.start):
            return np.zeros(0, np.uint64)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((self.bytes.astype(np.uint64) + np.uint64(1)) * _power(which, False, n), out=sums[1:])
        h = (sums[self.end] - sums[self.start]) * _power(which, True, n)[self.start]
        return mix64(h + (self.end - self.start).astype(np.uint64))

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def grams(words: np.ndarray, n: int, which: int = 0) -> np.ndarray:
    """Hash of each n consecutive entries; n-1 fewer than words."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    base = np.uint64(_BASES[1 - which])
    for j in range(n):
        out *= base
        out += words[j : j + m]
    return mix64(out)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component): the smallest id reachable over edges (src, dst); ids without edges are absent.

    Alternates large-star and small-star steps, each a grouped minimum, so a
    component of any size needs about log rounds. A vertex with very many
    neighbours never meets in one row: the minimum is aggregated map-side and
    joined back. Raises if it does not settle in max_rounds.
    """
    e = materialize(edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).where("u <> v").distinct())
    both = lambda d: d.select("u", "v").union(d.select(F.col("v").alias("u"), F.col("u").alias("v")))
    last = None
    for _ in range(max_rounds):
        near = both(e)
        low = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = near.join(low.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2.hint("merge"), "u").select(F.explode(F.array(F.struct(F.col("u").alias("a"), F.col("m").alias("b")), F.struct(F.col("v").alias("a"), F.col("m").alias("b")))).alias("p")).select(F.col("p.a").alias("u"), F.col("p.b").alias("v")).where("u <> v").distinct()
        was, e = e, materialize(small)
        discard(was)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last:
            return e.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component")).union(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
        last = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
