"""Readers for record, sequence and annotation files, all as DataFrames."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def csv(spark: SparkSession, path: str, schema: T.StructType | str, optional: bool = False) -> DataFrame:
    """CSV with header and a fixed schema; "" is null, bad rows raise. A missing optional file is an empty table."""
    if optional and not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("header", True).option("nullValue", "").option("mode", "FAILFAST").csv(path)


def records(spark: SparkSession, path: str, schema: T.StructType | str, key: str | None = None, tolerant: bool = False) -> DataFrame:
    """JSON lines; the last line of a repeated key wins. tolerant drops lines that can't be read."""
    df = spark.read.schema(schema).option("mode", "DROPMALFORMED" if tolerant else "FAILFAST").json(path)
    if key is None:
        return df
    rest = [c for c in df.columns if c != key]
    df = df.withColumn("_at", F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()))
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), "_at").alias("r")).select(key, "r.*").select(key, *rest)


def fetched_ids(spark: SparkSession, path: str, key: str = "id") -> DataFrame:
    """Distinct ids of a JSON-lines file that a crawl may have left half written."""
    if not exists(spark, path):
        return spark.createDataFrame([], f"{key} long")
    return records(spark, path, f"{key} long", tolerant=True).where(F.col(key).isNotNull()).distinct()


def document(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One JSON document or an array of records over several lines."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def fasta(spark: SparkSession, path: str, keep_empty: bool = True) -> DataFrame:
    """(file, record, header, sequence, ordinal): sequences upper-cased without white space; record is the header's first word."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    parts = whole.select("file", F.posexplode(F.split(F.concat(F.lit("\n"), "value"), "\n>")).alias("ordinal", "body")).where("ordinal > 0")
    head = F.regexp_replace(F.substring_index("body", "\n", 1), "\r$", "")
    seq = F.upper(F.regexp_replace(F.when(F.instr("body", "\n") > 0, F.substr("body", F.instr("body", "\n") + 1)).otherwise(""), r"\s", ""))
    out = parts.select("file", F.substring_index(F.trim(head), " ", 1).alias("record"), F.trim(head).alias("header"), seq.alias("sequence"), "ordinal")
    return out if keep_empty else out.where("sequence <> ''")


def gff(spark: SparkSession, path: str, kind: str = "rRNA") -> DataFrame:
    """(file, record, start, end, strand, product, ordinal) of one feature type; comments and short rows are skipped."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value", F.monotonically_increasing_id().alias("ordinal"))
    f = F.split("value", "\t")
    rows = lines.where(~F.col("value").startswith("#")).where(F.size(f) >= 9).where(f[2] == kind)
    return rows.select("file", f[0].alias("record"), f[3].cast("int").alias("start"), f[4].cast("int").alias("end"), f[6].alias("strand"), F.try_element_at(F.str_to_map(f[8], F.lit(";"), F.lit("=")), F.lit("product")).alias("product"), "ordinal")


def vocabulary_file(spark: SparkSession, path: str) -> DataFrame:
    """(token, index): the line number of each line of one file, which is read whole."""
    return spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", "\r?\n$", ""), "\r?\n")).alias("index", "token")).select("token", "index")


def archive_members(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """(file, member, text) of zip archives' members with that suffix, one archive a row of an Arrow batch."""
    import io
    import zipfile

    def run(it):
        import pandas as pd

        for pdf in it:
            rows = []
            for p, raw in zip(pdf["path"], pdf["content"]):
                with zipfile.ZipFile(io.BytesIO(raw)) as z:
                    rows += [(p, n, z.read(n).decode()) for n in z.namelist() if n.endswith(suffix)]
            yield pd.DataFrame(rows, columns=["file", "member", "text"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, member string, text string")


def fetch(ids: DataFrame, get, tries: int = 3, pause: float = 0.5) -> DataFrame:
    """(id, status, payload) of get(id) -> (http status, text): ok for 200, not_found for 400, else error after all tries.

    get runs on the executors, one request a row; no pause outlasts tries * pause.
    """

    def run(it):
        import time

        import pandas as pd

        for pdf in it:
            rows = []
            for i in pdf["id"]:
                status, payload = "error", None
                for n in range(tries):
                    try:
                        code, text = get(int(i))
                    except OSError as e:
                        code, text = 0, str(e)
                    if code in (200, 400):
                        status, payload = ("ok", text) if code == 200 else ("not_found", None)
                        break
                    payload = text
                    time.sleep(pause * (n + 1))
                rows.append((int(i), status, payload))
            yield pd.DataFrame(rows, columns=["id", "status", "payload"])

    return ids.select("id").mapInPandas(run, "id long, status string, payload string")


def run_tables(spark: SparkSession, folder: str, runs: list[str], schema: T.StructType | str) -> DataFrame:
    """Tables folder/run.csv of several runs with a column run; a missing one raises."""
    out = None
    for r in runs:
        if not exists(spark, f"{folder}/{r}.csv"):
            raise FileNotFoundError(f"{folder}/{r}.csv")
        one = csv(spark, f"{folder}/{r}.csv", schema).withColumn("run", F.lit(r))
        out = one if out is None else out.unionByName(one)
    return out


def write_csv(df: DataFrame, path: str, columns: list[str], compress: bool = False) -> None:
    df.select(*columns).write.mode("overwrite").option("header", True).option("compression", "gzip" if compress else "none").csv(path)


def artifact(df: DataFrame, method: str, most: int = 100_000) -> str:
    """A small table's rows as one JSON document with its method, keys sorted; more than most rows raise."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows are no artifact; write them as a table")
    return json.dumps({"method": method, "rows": [r.asDict(recursive=True) for r in rows]}, sort_keys=True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small file with that text, by Spark's own file system."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).create(fs_path, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str, missing: str = "(not written yet)") -> str:
    """A small file's text, or a placeholder if it does not exist."""
    return spark.read.text(path, wholetext=True).first()[0] if exists(spark, path) else missing


def provenance(df: DataFrame, run: str) -> str:
    """Rows of each run and the list of runs as JSON, for the record beside a result."""
    rows = df.groupBy(run).count().orderBy(run).collect()
    return json.dumps({"rows_per_run": {r[0]: r["count"] for r in rows}, "runs": [r[0] for r in rows]}, sort_keys=True)


def latex_table(rows: list[dict], columns: list[str] | None = None, digits: int = 3) -> str:
    """A small table as LaTeX tabular lines; numbers with a fixed number of digits."""
    columns = columns or (list(rows[0]) if rows else [])
    mark = {"&": r"\&", "%": r"\%", "_": r"\_", "#": r"\#", "$": r"\$"}
    cell = lambda v: "--" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else "".join(mark.get(c, c) for c in str(v))
    line = lambda cells: " & ".join(cells) + r" \\"
    head = [r"\begin{tabular}{" + "l" + "r" * (len(columns) - 1) + "}", r"\toprule", line(map(cell, columns)), r"\midrule"]
    return "\n".join([*head, *(line(cell(r.get(c)) for c in columns) for r in rows), r"\bottomrule", r"\end{tabular}"]) + "\n"


def first_accession(reports: DataFrame, key: str = "taxon") -> DataFrame:
    """(key, accession): the first report of each key by its place, null accessions passed over; from (key, place, accession)."""
    return reports.groupBy(key).agg(F.min_by("accession", F.when(F.col("accession").isNotNull(), F.col("place"))).alias("accession"))


def archive_fasta(spark: SparkSession, path: str, suffix: str = ".fna") -> DataFrame:
    """(file, text): the members of each zip archive with that suffix, one after the other in order of their names."""
    m = archive_members(spark, path, suffix)
    return m.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("member", "text"))), lambda x: x["text"]), "").alias("text"))


def archive_first(spark: SparkSession, path: str, suffix: str = ".gff") -> DataFrame:
    """(file, text): the first member of each zip archive with that suffix, by name."""
    return archive_members(spark, path, suffix).groupBy("file").agg(F.min_by("text", "member").alias("text"))


def crawl(ids: DataFrame, get, out: str, tries: int = 3, pause: float = 0.5, key: str = "id") -> DataFrame:
    """Fetches the ids that the JSON-lines folder out does not have yet, appends them, and returns one row (fetched, not_found, failed, skipped).

    Ids that failed are not written, so that the next run tries them again.
    """
    spark = ids.sparkSession
    have = fetched_ids(spark, out, key) if exists(spark, out) else spark.createDataFrame([], f"{key} long")
    todo = ids.select(key).distinct().join(have, key, "left_anti")
    got = fetch(todo.withColumnRenamed(key, "id"), get, tries, pause).withColumnRenamed("id", key)
    # one read of the source: what it said is written before it is counted
    from .scratch import stored

    got = stored(got, "crawl")
    got.where("status <> 'error'").write.mode("append").json(out)
    tally = got.agg(F.count_if(F.col("status") == "ok").alias("fetched"), F.count_if(F.col("status") == "not_found").alias("not_found"), F.count_if(F.col("status") == "error").alias("failed"))
    skipped = ids.select(key).distinct().join(have, key, "left_semi").agg(F.count("*").alias("skipped"))
    return tally.crossJoin(skipped)


def fetch_missing(wanted: DataFrame, have: DataFrame, get, tries: int = 3, pause: float = 0.5) -> DataFrame:
    """(id, status, payload) of the wanted ids that have lacks; any that fails raises with the tally."""
    from .scratch import stored

    got = stored(fetch(wanted.select("id").join(have.select("id"), "id", "left_anti"), get, tries, pause), "crawl")
    tally = {r["status"]: r["count"] for r in got.groupBy("status").count().collect()}
    if tally.get("error"):
        raise RuntimeError(f"some files could not be fetched: {dict(sorted(tally.items()))}")
    return got


def save_model(model, path: str, facts: dict) -> None:
    """A fitted pyspark.ml model with the facts that are needed to use it."""
    from pyspark.sql import SparkSession as Session

    model.write().overwrite().save(f"{path}/model")
    write_text(Session.getActiveSession(), f"{path}/facts.json", json.dumps(facts, sort_keys=True))


def load_model(kind, path: str) -> tuple:
    """save_model()'s model of that class, and its facts."""
    from pyspark.sql import SparkSession as Session

    return kind.load(f"{path}/model"), json.loads(read_text(Session.getActiveSession(), f"{path}/facts.json"))


def with_ordinal(df: DataFrame, order: list) -> DataFrame:
    """df with ordinal 0.. in the given order, for inputs whose order has a meaning."""
    from ..operators.order import numbered

    return numbered(df, order, "ordinal")
