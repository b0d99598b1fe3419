"""Readers and writers of the stages, and calls of models."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in whatever store the session reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def first_existing(spark: SparkSession, *paths: str) -> str | None:
    return next((p for p in paths if exists(spark, p)), None)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str, missing_ok: bool = True) -> DataFrame:
    """Rows of a JSONL file; blank lines don't count, a malformed one fails, a missing file is empty if that is allowed."""
    if not exists(spark, path):
        if not missing_ok:
            raise FileNotFoundError(path)
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_json_map(spark: SparkSession, path: str, value: str) -> DataFrame:
    """(id, value) of a JSON object keyed by id."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", f"map<string,{value}>")).alias("id", "value"))


def read_markdown(spark: SparkSession, folders: dict[str, str], suffix: str = "*.md") -> DataFrame:
    """(domain, name, text) of the files of each domain's folder; folders that aren't there are skipped."""
    out = None
    for domain, folder in folders.items():
        if not exists(spark, folder):
            continue
        files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", suffix).text(folder, wholetext=True)
        own = files.select(F.lit(domain).alias("domain"), F.element_at(F.split(F.input_file_name(), "/"), -1).alias("name"), F.col("value").alias("text"))
        out = own if out is None else out.unionByName(own)
    return out if out is not None else spark.createDataFrame([], "domain string, name string, text string")


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    write_jsonl(df, path, "append")


def compact_jsonl(spark: SparkSession, path: str, schema: str, key: str, every: int = 5) -> bool:
    """Rewrites a folder that rows were appended to as one set of files, once it holds ``every`` appends; tells whether it did.

    Of rows that repeat a key the one with most fields set stays.  The new files are
    written beside the folder and take its place by a rename, so a crash leaves either
    the old rows or the new.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs
    folder = hadoop.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(folder):
        return False
    # Each write has files of its own id: part-00000-<id>-c000.json
    writes = {f.getPath().getName().split("-", 2)[2].rsplit("-", 1)[0] for f in system.listStatus(folder) if f.getPath().getName().startswith("part-")}
    if len(writes) < every:
        return False
    rows = read_jsonl(spark, path, schema)
    filled = sum((F.col(c).isNotNull().cast("int") for c in rows.columns), F.lit(0))
    best = rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), F.struct(filled, F.to_json(F.struct(*rows.columns)))).alias("_r")).select("_r.*")
    fresh, old = hadoop.Path(path.rstrip("/") + ".fresh"), hadoop.Path(path.rstrip("/") + ".old")
    write_jsonl(best, fresh.toString())
    system.delete(old, True)
    system.rename(folder, old)
    system.rename(fresh, folder)
    system.delete(old, True)
    return True


def write_by_domain(df: DataFrame, path: str, key: str = "domain") -> None:
    """A folder for each domain; readers of the parent see all of them."""
    df.write.mode("overwrite").partitionBy(key).option("ignoreNullFields", "false").json(path)


def write_csv_bom(df: DataFrame, path: str) -> None:
    """A small report table as one CSV file that spreadsheets open as UTF-8."""
    df.toPandas().to_csv(path, index=False, encoding="utf-8-sig")


def write_report_json(df: DataFrame, path: str) -> None:
    with open(path, "w", encoding="utf-8") as out:
        json.dump([r.asDict(True) for r in df.collect()], out, ensure_ascii=False, indent=2)


def markdown_table(df: DataFrame) -> str:
    rows = [[("" if v is None else str(v)) for v in r] for r in df.collect()]
    head = f"| {' | '.join(df.columns)} |\n|{'---|' * len(df.columns)}"
    return "\n".join([head, *[f"| {' | '.join(r)} |" for r in rows]])


def latex_table(df: DataFrame) -> str:
    def safe(v) -> str:
        text = "--" if v is None else str(v)
        for c in "&%_#":
            text = text.replace(c, f"\\{c}")
        return text

    body = " \\\\\n".join(" & ".join(safe(v) for v in r) for r in df.collect())
    return f"\\begin{{tabular}}{{{'l' * len(df.columns)}}}\n{' & '.join(map(safe, df.columns))} \\\\\n\\hline\n{body} \\\\\n\\end{{tabular}}"


Scorer = Callable[[dict], dict]


def score(items: DataFrame, make_scorer: Callable[[], Scorer], fields: str, parallelism: int | None = None, retries: int = 2, pause_s: float = 1.5) -> DataFrame:
    """Calls a model for every row: ``fields`` of its answers, ``error`` and ``latency_s`` are added.

    ``make_scorer`` runs once per partition and gives a function of a row; a call that fails is tried again after a
    pause that grows with the attempt.  ``parallelism`` bounds the calls at a time.
    """
    schema = T.StructType([*items.schema.fields, *T._parse_datatype_string(fields).fields, T.StructField("error", T.StringType()), T.StructField("latency_s", T.DoubleType())])
    names = T._parse_datatype_string(fields).names

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        call = make_scorer()
        for pdf in batches:
            rows = []
            for row in pdf.to_dict("records"):
                began, got, error = time.time(), {}, None
                for attempt in range(retries + 1):
                    try:
                        got, error = call(row), None
                        break
                    except Exception as e:  # whatever a client raises is the row's error
                        error = repr(e)
                        if attempt < retries:
                            time.sleep(pause_s * (attempt + 1))
                rows.append(row | {n: got.get(n) for n in names} | {"error": error, "latency_s": time.time() - began})
            yield pd.DataFrame(rows, columns=schema.names)

    rows = items.repartition(parallelism) if parallelism else items
    return rows.mapInPandas(run, schema)


def windows(tokens: Sequence, most: int = 450) -> list:
    """Consecutive windows of at most ``most`` tokens; a short sequence is one window."""
    return [tokens[i : i + most] for i in range(0, len(tokens), most)] or [tokens]
