"""A corpus made ready for training, in five stages.

Each stage is a function of (spark, docs, sf_dir); its result is written as Parquet
and read again as the next one's documents.  All but the last keep the columns of
``documents``.  Stages with Python workers lower the session's limit of bytes in a batch for these.

Defined results: a null or empty text has no letters and goes in stage 1; rows of null
id are kept like others (they are near copies of nothing); of rows that repeat id and
text one stays; rows of one id with different texts are one node in stage 3 and stay or
go together; extra columns pass through, whatever their names; an empty table goes
through all stages empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import bpe, decontam, exact_dedup, jaccard_join, langid, token_files
from textloom.llm.common import apart, named_back, small_batches, table

#: Names of columns that stages add on the way.
OWN = ("_lang", "_score", "_cut", *decontam.OWN)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters; a text of several languages stays, whatever the share of the largest."""
    small_batches(spark)
    labelled = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    docs, renamed = apart(docs, OWN)
    found = langid.predict(docs, langid.fit(labelled), out=("_lang", "_score"))
    return named_back(found.filter(F.col("_lang") != langid.UNKNOWN).select(*docs.columns), renamed)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each text."""
    return exact_dedup.survivors(docs, keep="max")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near copies: five words, similarity 0.8 or more."""
    small_batches(spark)
    found = jaccard_join.jaccard_join(docs.select("doc_id", "text"), width=5, num=80, den=100)
    gone = found.filter("component_id <> doc_id").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of the benchmark out of the texts; a document of nothing else goes."""
    small_batches(spark)
    docs, renamed = apart(docs, OWN)
    found = decontam.find(docs, table(spark, sf_dir, "benchmark"), cut_col="_cut")
    whole = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + (s[1] - s[0]).cast("long")) == F.col("n_words")
    found = found.filter(~(whole & (F.col("n_words") > 0)))
    cut = found.withColumn("text", F.col("_cut")).withColumn("n_chars", F.length("text").cast("long"))
    return named_back(cut.select(*docs.columns), renamed)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every text, and whether they decode to its bytes."""
    import public_tokenizers

    small_batches(spark)
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    coded = bpe.encode(docs.select("doc_id", "text"), path, pattern, decoded_col="decoded")
    exact = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), exact.alias("exact"), "ids")


STAGES = [
    ("language_id", language),
    ("exact_dedup", exact_copies),
    ("jaccard_join", near_copies),
    ("decontamination", benchmark_passages),
    ("bpe", tokens),
]

#: The language model and the tokenizer are not SQL; tests hold the run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        folder = token_files.new_folder(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return STAGES[-1][1](spark, docs, sf_dir)
