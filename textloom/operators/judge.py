"""Verdicts of judges: review queue, agreement, consensus and votes.  Verdicts are long: (id, judge, veredito)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import extract_json


# Verdicts that count as an answer.
VERDICTS = ("aprovado", "revisar", "rejeitar")
# End of fixed values.


def normalised(raw: Column) -> Column:
    """What a judge's answer says: verdict, score, reason, and whether the verdict is one of the three.

    The answer is text with a JSON object somewhere in it; a verdict of another wording
    stays as it is, with ``parse_ok`` false, and a score that isn't a number is null.
    """
    found = extract_json(raw)
    said = lambda name: F.get_json_object(found, f"$.{name}")
    return F.struct(
        said("veredito").alias("veredito"),
        said("nota").try_cast("double").alias("nota"),
        said("justificativa").alias("justificativa"),
        F.coalesce(said("veredito").isin(*VERDICTS), F.lit(False)).alias("parse_ok"),
    )


def by_item(verdicts: DataFrame, n_judges: int) -> DataFrame:
    """(id, bad, answered, distinct): what the rules below look at; null verdicts count as not answered."""
    return verdicts.groupBy("id").agg(
        F.max(F.coalesce(F.col("veredito").isin("rejeitar", "revisar"), F.lit(False))).alias("bad"),
        (F.count("veredito") == n_judges).alias("answered"),
        F.count_distinct("veredito").alias("n_values"),
    )


def priority_queue(verdicts: DataFrame, n_judges: int = 2) -> DataFrame:
    """Items with a bad verdict, or answered by all judges differently."""
    return by_item(verdicts, n_judges).filter("bad OR (answered AND n_values > 1)").select("id")


def agreement(verdicts: DataFrame, n_judges: int = 2) -> DataFrame:
    full = by_item(verdicts, n_judges).filter("answered")
    agree = F.sum((F.col("n_values") == 1).cast("long"))
    return full.agg(F.count(F.lit(1)).alias("n_multi"), agree.alias("n_agree"), F.round(agree / F.count(F.lit(1)), 3).alias("rate"))


def verdict_dist(verdicts: DataFrame) -> DataFrame:
    return verdicts.filter("veredito IS NOT NULL").groupBy("judge", "veredito").agg(F.count(F.lit(1)).alias("n"))


def consensus_matrix(scored: DataFrame, a: str, b: str) -> DataFrame:
    """Per model: both correct, both wrong, and different; a missing verdict counts as wrong."""
    x, y = F.coalesce(F.col(a), F.lit(False)), F.coalesce(F.col(b), F.lit(False))
    count = lambda c: F.sum(c.cast("long"))
    return scored.groupBy("model").agg(count(x & y).alias("both_correct"), count(~x & ~y).alias("both_incorrect"), count(x != y).alias("disagree"))


def consensus_filter(scored: DataFrame, mode: str, a: str, b: str, hallucination: tuple[str, ...] = ()) -> DataFrame:
    x, y = F.coalesce(F.col(a), F.lit(False)), F.coalesce(F.col(b), F.lit(False))
    rule = {"both_correct": x & y, "both_incorrect": ~x & ~y, "disagree": x != y}.get(mode)
    if mode == "any_hallucination":
        rule = F.lit(False)
        for col in hallucination:
            rule = rule | F.coalesce(F.col(col), F.lit(False))
    return scored if rule is None else scored.filter(rule)


def approvals(verdicts: DataFrame) -> DataFrame:
    """(id, approvers sorted, approved): judges that approve, and whether two or more do."""
    yes = verdicts.filter("veredito = 'aprovado'").groupBy("id").agg(F.array_sort(F.collect_set("judge")).alias("approvers"))
    return yes.withColumn("approved", F.size("approvers") >= 2)


def fold_votes(events: DataFrame) -> DataFrame:
    """Votes from clicks (key, action, ts): a repeated click on the same choice takes it back.

    Runs of equal clicks are counted per key by windows over the key's own events.
    """
    from pyspark.sql import Window as W

    own = W.partitionBy("key").orderBy("ts", "seq")
    runs = events.withColumn("_new", (F.lag("action").over(own).isNull() | (F.lag("action").over(own) != F.col("action"))).cast("int"))
    runs = runs.withColumn("_run", F.sum("_new").over(own.rowsBetween(W.unboundedPreceding, 0)))
    last = runs.groupBy("key", "_run").agg(F.first("action").alias("action"), F.count(F.lit(1)).alias("n"))
    final = last.groupBy("key").agg(F.max_by(F.struct("action", "n"), "_run").alias("r"))
    return final.select("key", F.when(F.col("r.n") % 2 == 1, F.col("r.action")).alias("vote"))
