"""Aggregations over scored predictions, and the explorer's counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def summary(scored: DataFrame, keys: list[str], judges: tuple[str, ...] = ()) -> DataFrame:
    """Counts, means of the metrics (nulls are left out), the share of windowed scores, and each judge's mean and hallucination rate."""
    aggs: list[Column] = [
        F.count(F.lit(1)).alias("n_itens"),
        F.round(F.avg("rouge_l"), 4).alias("rouge_l"),
        F.round(F.avg("token_f1"), 4).alias("token_f1"),
        F.round(F.avg("bertscore_f1"), 4).alias("bertscore_f1"),
        F.round(F.sum(F.when(F.col("bertscore_f1").isNotNull() & F.col("bertscore_chunked"), 1).otherwise(0)) / F.nullif(F.count("bertscore_f1"), F.lit(0)), 3).alias("windowed"),
    ]
    for j in judges:
        aggs += [F.round(F.avg(f"nota_{j}"), 2).alias(f"nota_media_{j}"), F.round(F.avg(F.col(f"aluc_{j}").cast("double")), 3).alias(f"taxa_alucinacao_{j}")]
    return scored.groupBy(*keys).agg(*aggs)


def empty_rate(predictions: DataFrame, survivors: DataFrame) -> DataFrame:
    """Share of null or empty responses before they are filtered, for models that have others."""
    empty = F.avg((F.coalesce("resposta_gerada", F.lit("")) == "").cast("double"))
    rates = predictions.groupBy("model").agg(F.round(empty, 4).alias("taxa_vazia"))
    return rates.join(survivors.select("model").distinct(), "model")


def scoreboard(stats: DataFrame, models: DataFrame, cols: list[str]) -> DataFrame:
    """All models in their fixed order; those without a row have zeros."""
    joined = models.join(stats, "model", "left")
    return joined.select("pos", "model", "label", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in cols])


def pivot_metric(scored: DataFrame, by: str, values: list[str], metric: str) -> DataFrame:
    return scored.groupBy("model").pivot(by, values).agg(F.round(F.avg(metric), 3))


def relative_gain(means: DataFrame, target: str, metric: str) -> DataFrame:
    """Gain of the target model over each other one in percent; null where that is zero."""
    own = F.broadcast(means.filter(F.col("model") == target).select(F.col(metric).alias("_t")))  # one row
    base = means.filter(F.col("model") != target).withColumn("_one", F.lit(1))
    joined = base.join(own.withColumn("_one", F.lit(1)), "_one")
    return joined.select("model", F.round(100 * (F.col("_t") - F.col(metric)) / F.nullif(F.col(metric), F.lit(0.0)), 1).alias("gain_pct"))


def facet_counts(df: DataFrame, col: str) -> DataFrame:
    counts = df.groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = F.broadcast(df.agg(F.count(F.lit(1)).alias("_t")).withColumn("_one", F.lit(1)))
    return counts.withColumn("_one", F.lit(1)).join(total, "_one").select("value", "n", F.round(100.0 * F.col("n") / F.col("_t"), 1).alias("pct"))


def log_summary(log: DataFrame) -> DataFrame:
    """Points, and the last and the smallest training and evaluation loss; nulls don't count."""
    last = lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("step")))
    return log.agg(
        F.count(F.lit(1)).alias("n_points"), last("loss").alias("final_train_loss"), F.min("loss").alias("min_train_loss"),
        last("eval_loss").alias("final_eval_loss"), F.min("eval_loss").alias("best_eval_loss"),
    )


def pilot_stats(results: DataFrame) -> DataFrame:
    ok = F.sum(F.col("parse_ok").cast("long"))
    return results.groupBy("model").agg(F.count(F.lit(1)).alias("n"), ok.alias("n_ok"), F.round(F.avg("latency_s"), 2).alias("latency"))


def verbosity_corr(scored: DataFrame, score: str, length: str = "n_chars") -> DataFrame:
    return scored.groupBy("model").agg(F.round(F.corr(length, score), 3).alias("corr"))


def window_max(pairs: DataFrame, keys: list[str], value: str, n: str | None = None) -> DataFrame:
    """Best window pair of each item, and whether there was more than one; ``n``: how many pairs a row stands for."""
    pairs_of = F.sum(n) if n else F.count(F.lit(1))
    return pairs.groupBy(*keys).agg(F.max(value).alias(value), (pairs_of > 1).alias("chunked"))


def only_wins(scored: DataFrame, correct: str, key: str = "id") -> DataFrame:
    """(model_a, model_b, only_a, only_b, both, neither) for pairs of models that answered the same items."""
    own = scored.select(key, "model", F.coalesce(F.col(correct), F.lit(False)).alias("_c"))
    a = own.select(key, F.col("model").alias("model_a"), F.col("_c").alias("_a"))
    b = own.select(key, F.col("model").alias("model_b"), F.col("_c").alias("_b"))
    count = lambda x: F.sum(x.cast("long"))
    pairs = a.join(b, key).filter("model_a < model_b").groupBy("model_a", "model_b")
    x, y = F.col("_a"), F.col("_b")
    return pairs.agg(count(x & ~y).alias("only_a"), count(y & ~x).alias("only_b"), count(x & y).alias("both"), count(~x & ~y).alias("neither"))


def windows(tokens: Column, most: int) -> Column:
    """Consecutive windows of at most ``most`` tokens; no tokens are one empty window."""
    starts = F.sequence(F.lit(0), F.greatest(F.size(tokens) - 1, F.lit(0)), F.lit(most))
    return F.transform(starts, lambda i: F.slice(tokens, i + 1, most))


def windowed_best(rows: DataFrame, id_col: str, a: str, b: str, similarity: Callable[[Column, Column], Column], most: int = 450) -> DataFrame:
    """(id, value, chunked): the best similarity of any window of ``a`` with any of ``b`` (token arrays).

    A long pair's windows meet as rows, so they spread over tasks.
    """
    left = rows.select(id_col, F.explode(windows(F.col(a), most)).alias("_x"), F.col(b).alias("_b"), (F.size(a) > most).alias("_l"))
    pairs = left.select(id_col, "_x", F.explode(windows(F.col("_b"), most)).alias("_y"), (F.col("_l") | (F.size("_b") > most)).alias("_long"))
    return pairs.groupBy(id_col).agg(F.max(similarity(F.col("_x"), F.col("_y"))).alias("value"), F.max("_long").alias("chunked"))
