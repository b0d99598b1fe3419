"""Duplicates, removal reasons and ids of items."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from .sample import components, running_number


def dup_key(text: str | Column) -> Column:
    return F.lower(strip(F.col(text) if isinstance(text, str) else text))


def exact_dup_flags(items: DataFrame, text: str = "pergunta", order: str = "ord") -> DataFrame:
    """Adds ``n_flags``: the first of a group of copies has one flag for each later copy, a later copy has one.

    Groups are counted by a partial aggregation and joined back, so no task sorts a whole group.
    """
    keyed = items.withColumn("_key", dup_key(text))
    groups = keyed.groupBy("_key").agg(F.count(F.lit(1)).alias("_n"), F.min(order).alias("_first")).filter("_n > 1")
    flags = F.when(F.col("_n").isNull(), 0).when(F.col(order) == F.col("_first"), F.col("_n") - 1).otherwise(1)
    return keyed.join(groups, "_key", "left").withColumn("n_flags", flags.cast("long")).drop("_key", "_n", "_first")


def exact_dedup(items: DataFrame, text: str = "pergunta", order: str = "ord", id_col: str = "id") -> DataFrame:
    """Adds ``dup_of``: the id of the first copy, null for rows that stay."""
    keyed = items.withColumn("_key", dup_key(text))
    first = keyed.groupBy("_key").agg(F.min(F.struct(order, id_col)).alias("_f"))
    own = F.when(F.col("_f")[order] < F.col(order), F.col("_f")[id_col])
    return keyed.join(first, "_key").withColumn("dup_of", own).drop("_key", "_f")


def near_dedup(pairs: DataFrame, removed: DataFrame | None = None) -> DataFrame:
    """(id, because) from ordered pairs (ord, id_a, id_b): of a pair whose first member stays the second goes.

    ``removed`` has ids that are gone for other reasons; of a pair with such a first
    member, the first goes because of the second unless it has a reason already.  What
    happens to a pair depends only on earlier pairs that it is connected with, so each
    connected group of pairs is taken in order by itself.
    """
    kind = pairs.schema["id_a"].dataType.simpleString()
    own = pairs.select("ord", "id_a", "id_b")
    ends = F.explode(F.array("id_a", "id_b")).alias("node")
    groups = components(own.select(F.struct("ord", "id_a", "id_b").alias("item"), ends))
    own = own.withColumn("item", F.struct("ord", "id_a", "id_b")).join(groups, "item").drop("item")
    if removed is None:
        own = own.withColumn("out", F.lit(False))
    else:
        lost = removed.select(F.col(removed.columns[0]).alias("id_a")).distinct().withColumn("_r", F.lit(True))
        own = own.join(lost, "id_a", "left").withColumn("out", F.coalesce("_r", F.lit(False))).drop("_r")

    def take(pdf):
        reasons: dict = {}
        for _, first, second, out in sorted(zip(pdf["ord"], pdf["id_a"], pdf["id_b"], pdf["out"], strict=True)):
            if first in reasons:
                continue
            if out:
                reasons[first] = second
            else:
                reasons[second] = first
        return pd.DataFrame({"id": list(reasons), "because": list(reasons.values())})

    return own.groupBy("component").applyInPandas(take, f"id {kind}, because {kind}")


#: The order in which reasons win.
REASONS = ("single_source", "near_dup", "exact_dup", "reference_list", "table", "human")


def clean_partition(items: DataFrame) -> DataFrame:
    """Adds ``motivo_remocao`` from the boolean columns named in REASONS (null: the row stays)."""
    return items.withColumn("motivo_remocao", F.coalesce(*[F.when(F.col(r), F.lit(r)) for r in REASONS if r in items.columns]))


def kept_by_stratum(items: DataFrame) -> DataFrame:
    return items.filter("motivo_remocao IS NULL").groupBy("dominio", "nivel_dificuldade").agg(F.count(F.lit(1)).alias("n"))


def renumber(items: DataFrame, order: str = "ord", id_col: str = "id") -> DataFrame:
    """Adds ``new_id``: stratum and running number (of at least four digits) in file order."""
    numbered = running_number(items, ["dominio", "nivel_dificuldade"], [order, id_col], "_nth")
    return numbered.withColumn("new_id", F.concat_ws("_", "dominio", "nivel_dificuldade", F.format_string("%04d", "_nth"))).drop("_nth")


def validation_stamp(items: DataFrame, approvers: str = "validado_por") -> DataFrame:
    """Marks every item as validated, with the distinct approvers in order."""
    return items.withColumn(approvers, F.array_distinct(F.col(approvers))).withColumn("validado", F.lit(True))
