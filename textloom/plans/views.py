"""The tables that queries work on, as views of the driver's tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEVEL = "CASE {0} % 3 WHEN 0 THEN 'factual' WHEN 1 THEN 'conceitual' ELSE 'aplicado' END"

#: Question and answer items: a user's turn and the assistant's next one.
ITEMS_SQL = f"""items AS (
  SELECT u.conv_id * 1000 + u.turn AS id, u.conv_id * 1000 + u.turn AS ord, u.conv_id AS conv, 'd' || (u.conv_id % 4) AS dominio,
    {LEVEL.format('u.conv_id')} AS nivel_dificuldade, u.text AS pergunta, a.text AS resposta_referencia,
    CASE WHEN u.conv_id % 3 = 2 AND u.conv_id % 7 <> 0 THEN ['c' || (u.conv_id % 50), 'c' || (u.conv_id * 7 % 53)] ELSE ['c' || (u.conv_id % 50)] END AS chunk_ids
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant')"""
VERDICTS_SQL = """verdicts AS (
  SELECT id, 'phi' AS judge, CASE conv % 5 WHEN 0 THEN 'rejeitar' WHEN 1 THEN 'revisar' WHEN 4 THEN NULL ELSE 'aprovado' END AS veredito FROM items
  UNION ALL SELECT id, 'command', CASE conv % 7 WHEN 0 THEN 'rejeitar' WHEN 2 THEN 'revisar' WHEN 6 THEN NULL ELSE 'aprovado' END FROM items)"""
SCORED_COLS = f"""doc_id, 'm' || (doc_id % 5) AS model, CAST(floor(doc_id / 5) AS BIGINT) AS id, lang AS dominio, {LEVEL.format('CAST(floor(doc_id / 5) AS BIGINT)')} AS nivel_dificuldade,
    CAST(n_chars % 1000 AS DOUBLE) / 1e3 AS rouge_l, CAST(n_chars % 777 AS DOUBLE) / 777e0 AS token_f1,
    CASE WHEN n_chars % 11 = 0 THEN NULL ELSE CAST(n_chars % 500 AS DOUBLE) / 5e2 END AS bertscore_f1, n_chars > 1500 AS bertscore_chunked, n_chars,
    n_chars % 3 = 0 AS correto_command, CAST(1 + n_chars % 5 AS DOUBLE) AS nota_phi, n_chars % 4 = 0 AS aluc_phi,
    CASE WHEN n_chars % 9 = 0 THEN NULL ELSE CAST(1 + n_chars % 4 AS DOUBLE) END AS nota_command, CASE WHEN n_chars % 6 = 0 THEN NULL ELSE n_chars % 7 = 0 END AS aluc_command,
    CASE WHEN doc_id % 13 = 0 THEN '' WHEN doc_id % 17 = 0 THEN NULL ELSE text END AS resposta_gerada, CAST(doc_id % 100 AS DOUBLE) / 1e1 AS latency_s"""
SCORED_SQL = f"scored AS (SELECT {SCORED_COLS} FROM documents)"
JUDGED_SQL = "judged AS (SELECT s.*, l.quality = 1 AS correto_phi FROM scored s LEFT JOIN labels l USING (doc_id))"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    asked = turns.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("pergunta"))
    told = turns.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("resposta_referencia"))
    c = F.col("conv_id")
    name = lambda x: F.concat(F.lit("c"), x.cast("string"))
    two = F.array(name(c % 50), name(c * 7 % 53))
    return asked.join(told, ["conv_id", "turn"]).select(
        (c * 1000 + F.col("turn")).alias("id"),
        (c * 1000 + F.col("turn")).alias("ord"),
        c.alias("conv"),
        F.concat(F.lit("d"), (c % 4).cast("string")).alias("dominio"),
        F.expr(LEVEL.format("conv_id")).alias("nivel_dificuldade"),
        "pergunta",
        "resposta_referencia",
        F.when((c % 3 == 2) & (c % 7 != 0), two).otherwise(F.array(name(c % 50))).alias("chunk_ids"),
    )


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    phi = F.expr("CASE conv % 5 WHEN 0 THEN 'rejeitar' WHEN 1 THEN 'revisar' WHEN 4 THEN NULL ELSE 'aprovado' END")
    command = F.expr("CASE conv % 7 WHEN 0 THEN 'rejeitar' WHEN 2 THEN 'revisar' WHEN 6 THEN NULL ELSE 'aprovado' END")
    both = F.array(F.struct(F.lit("phi").alias("judge"), phi.alias("veredito")), F.struct(F.lit("command").alias("judge"), command.alias("veredito")))
    return items(spark, sf_dir).select("id", F.explode(both).alias("v")).select("id", "v.*")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    n, d = F.col("n_chars"), F.col("doc_id")
    id_ = F.floor(d / 5).cast("long")
    real = lambda x, y: x.cast("double") / F.lit(float(y))
    return docs.select(
        "doc_id", F.concat(F.lit("m"), (d % 5).cast("string")).alias("model"), id_.alias("id"), F.col("lang").alias("dominio"),
        F.when(id_ % 3 == 0, "factual").when(id_ % 3 == 1, "conceitual").otherwise("aplicado").alias("nivel_dificuldade"),
        real(n % 1000, 1000).alias("rouge_l"), real(n % 777, 777).alias("token_f1"), F.when(n % 11 != 0, real(n % 500, 500)).alias("bertscore_f1"),
        (n > 1500).alias("bertscore_chunked"), "n_chars", (n % 3 == 0).alias("correto_command"), (1 + n % 5).cast("double").alias("nota_phi"),
        (n % 4 == 0).alias("aluc_phi"), F.when(n % 9 != 0, (1 + n % 4).cast("double")).alias("nota_command"), F.when(n % 6 != 0, n % 7 == 0).alias("aluc_command"),
        F.when(d % 13 == 0, "").when(d % 17 != 0, F.col("text")).alias("resposta_gerada"), real(d % 100, 10).alias("latency_s"),
    )


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("correto_phi"))
    return scored(spark, sf_dir).join(labels, "doc_id", "left")
