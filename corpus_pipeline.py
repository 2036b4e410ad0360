"""From raw documents to packed training sequences, one operator a stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it
as Parquet in the shared folder and reads it back as the next stage's docs. All
stages but the last return the columns of docs in their order, whatever these
are beside doc_id, text and source, also where names clash with an operator's.
Null texts count as empty ones; rows without doc_id stay unless the classifier
rejects them; an empty table passes every stage.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayloom.llm.common import made, materialize, remove_paths
from assayloom.llm.mixing import mix
from assayloom.llm.near_dup import near_duplicates
from assayloom.llm.packing import pack, tokenize_pieces
from assayloom.llm.pii import fit as fit_tagger
from assayloom.llm.pii import redact
from assayloom.llm.quality import fit as fit_quality
from assayloom.llm.quality import score
from assayloom.llm.queries import _table, _vocabulary


_earlier: list[str] = []  # tables of stages before, which their results were read from


def _stage(f):
    """Removes the tables that earlier stages left, but for those that docs still reads. A stage's result is to be written before the next stage is called."""

    @functools.wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if _earlier:
            read = docs.inputFiles()
            gone = [p for p in _earlier if not any(f"/{p.rsplit('/', 1)[1]}/" in x for x in read)]
            remove_paths(spark, gone)
            _earlier[:] = [p for p in _earlier if p not in gone]
        before = len(made)
        out = f(spark, docs, sf_dir)
        _earlier.extend(made[before:])
        return out

    return run


def _apart(docs: DataFrame) -> DataFrame:
    """docs with all columns but doc_id, text and source under names of their own."""
    return docs.toDF(*[c if c in ("doc_id", "text", "source") else f"_c{i}" for i, c in enumerate(docs.columns)])


def _back(df: DataFrame, docs: DataFrame, chars: bool = True) -> DataFrame:
    """The columns of docs from a frame that _apart named; n_chars follows the text if chars."""
    cols = []
    for i, c in enumerate(docs.columns):
        own = F.col(c if c in ("doc_id", "text", "source") else f"_c{i}")
        if chars and c == "n_chars":
            own = F.when(F.col("text").isNull(), own).otherwise(F.length("text")).cast(docs.schema[c].dataType)
        cols.append(own.alias(c))
    return df.select(*cols)


def _numbered(docs: DataFrame) -> DataFrame:
    """_apart's table with a number a row, written, so that each reader sees the same numbers."""
    return materialize(_apart(docs).withColumn("_row", F.monotonically_increasing_id()))


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier rejects (score under 0.3).

    Null and empty texts are scored like any others; rows that agree in their
    text share its fate. Without labels all scores are alike and nothing goes.
    """
    net = fit_quality(docs.select("doc_id", "text"), _table(spark, sf_dir, "labels"))
    return _back(score(_apart(docs), net).where("predicted = 1"), docs)


@_stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of near duplicates (five words, similarity 0.8).

    Rows are dropped one by one: of two rows with one doc_id and different texts
    only a duplicate goes. Rows that agree in doc_id and text stay together, as
    do all rows without doc_id, text or words.
    """
    d = _numbered(docs)
    drop = near_duplicates(d.select("doc_id", "text", "_row"), keep="_row").where("not kept").select("_row")
    return _back(d.join(drop.hint("shuffle_hash"), "_row", "left_anti"), docs, chars=False)


@_stage
def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind in angle brackets; n_chars follows.

    Every row stays; null texts stay null and empty ones empty.
    """
    return _back(redact(_apart(docs), fit_tagger(docs.select("text"))), docs)


@_stage
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and cuts documents so that each source gives its target of words, in the schedule's order.

    A document of which n times its words are taken comes n times, and one more
    time with its first words for the rest; one of which none are taken goes, as
    do those without words. Each time stands at its own slot: files hold runs of
    the order, and their names ascend with it. Columns of any type pass through.
    """
    d = _numbered(docs)
    shares = mix(d.select("doc_id", "text", "source", "_row"), keep=["_row"], slots=True).where("taken > 0").select("_row", "size", "taken", F.posexplode("slots").alias("_i", "_slot"))
    got = d.join(shares, "_row")
    # words with the white space before them, so that what is kept is a prefix of the text
    cut = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"), F.lit(1)), F.lit(1), F.expr("cast(taken % size as int)")), "")
    whole = (F.col("_i") + 1) * F.col("size") <= F.col("taken")
    got = got.withColumn("text", F.when(whole, F.col("text")).otherwise(cut))
    return _back(got.repartitionByRange("_slot", "_row").sortWithinPartitions("_slot", "_row"), docs)


@_stage
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(copy_id, doc_id, piece, start, length, ids_crc32, ids, sequence_id, offset): the documents' tokens in sequences of 2048.

    copy_id tells the rows of docs apart, which may share a doc_id; it ascends
    with the mix's order. A sequence is its pieces' ids (little-endian 32-bit)
    by offset. Null and empty texts are the end id alone.
    """
    pieces = materialize(tokenize_pieces(docs.withColumn("copy_id", F.monotonically_increasing_id()), _vocabulary("byte_bpe_50k.json"), "byte", 2048, 0, keep_ids=True, keep="copy_id", cache_size=700_000))
    # lengths are packed, and the ids join their places once
    places = pack(pieces.select("doc_id", "piece", "length", "copy_id"), 2048).select("copy_id", "piece", "sequence_id", "offset")
    return pieces.join(places, ["copy_id", "piece"]).select("copy_id", "doc_id", "piece", "start", "length", "ids_crc32", "ids", "sequence_id", "offset")


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("personal_data", personal_data), ("mixing", mixing), ("packing", packing)]

#: Trained networks and tokenizers decide the rows, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents, each written and read again. drop_tables() removes what they wrote once the result is."""
    docs = _table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs)
            _earlier.append(docs._assayloom_path)
    return docs
