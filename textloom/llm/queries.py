"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, exact_dedup, html_text, jaccard_join, langid, maxent_lm, sharding, token_files, toxicity
from .common import remainder, table


def _tokenizer(name: str) -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def op1_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = maxent_lm.score(docs, docs.filter(remainder("doc_id", 10) != 0))
    return scored.withColumn("held_out", remainder("doc_id", 10) == 0).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = exact_dedup.exact_dedup(docs, keep="max")
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP2_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""


def op3_fm_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontam.digest(decontam.find(docs, table(spark, sf_dir, "benchmark")))


#: Windows of words as text, joined by equality.
OP3_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM benchmark),
s AS (SELECT item, ws, least(10, len(ws)) AS k FROM b WHERE len(ws) > 0),
w AS (SELECT DISTINCT item, k, array_to_string(ws[i : i + k - 1], ' ') AS g FROM (SELECT item, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM s)),
g AS (SELECT doc_id, k, i, array_to_string(ws[i : i + k - 1], ' ') AS g FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM w) WHERE len(ws) >= k)),
m AS (SELECT doc_id, k, i, item FROM g JOIN w USING (k, g)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, k, i FROM m)) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN n USING (doc_id)
"""


def op4_hash_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = sharding.shard_rows(docs, sharding.tree(24), sharding.tree(25))
    return found.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op5_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path, pattern = _tokenizer("byte_bpe_50k.tiktoken")
    return bpe.digest(bpe.encode(docs, path, pattern, decoded_col="decoded"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path, pattern = _tokenizer("byte_bpe_50k.json")
    folder = token_files.new_folder(spark, "tokens")
    token_files.write(docs, folder, path, pattern, end_id=2)
    return token_files.checksums(token_files.read(spark, folder))


def op6_weak_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").filter(remainder("doc_id", 3) != 1)
    scored = toxicity.score(docs, toxicity.fit(docs, labels))
    return scored.select(
        "doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )


def op7_crf_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.filter(remainder("doc_id", 4) != 2).select("doc_id", "text", "lang"))
    found = langid.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op9_pivot_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(table(spark, sf_dir, "documents"))


def op10_crf_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    found = html_text.extract(pages, html_text.fit(html_text.labelled_pages()))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_maxent_lm": op1_maxent_lm,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_fm_decontamination": op3_fm_decontamination,
    "op4_hash_tree_sharding": op4_hash_tree_sharding,
    "op5_prefix_bpe": op5_prefix_bpe,
    "op6_weak_toxicity": op6_weak_toxicity,
    "op7_crf_language": op7_crf_language,
    "op8_token_files": op8_token_files,
    "op9_pivot_jaccard": op9_pivot_jaccard,
    "op10_crf_main_text": op10_crf_main_text,
}

ORACLE_SQL: dict[str, str] = {"op2_exact_dedup": OP2_SQL, "op3_fm_decontamination": OP3_SQL}
