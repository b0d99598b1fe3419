"""Exact deduplication by content hash, with a comparison of the bytes.

Native: DataFrame functions only.

1. Rows are grouped by (128-bit hash, SHA-256, text).  The text is part of the
   grouping key, so bytes are compared inside every hash group, while partial
   aggregation leaves at most one row per task and distinct text for the
   shuffle: a group that holds a third of all rows costs no more than a rare one.
2. The groups, without texts, are checkpointed.
3. Every document gets its group back by its hashes.  Groups that hold at least
   one row in ``hot_parts`` are broadcast - there are at most ``hot_parts`` of
   them, by counting - and the rest, none of which can be large, are joined by a
   shuffle.  Should two texts ever share both hashes, their documents take a
   third way that joins on the text itself.

Defined results: a null text counts as the empty text; a null id is the smallest
id (it is kept only if its group has no other); rows repeated as a whole stay
separate rows of one group, each with the same ``keep_id``, and exactly the rows
that carry ``keep_id`` are kept (``kept``); for one survivor among repeats of one
id use :func:`survivors`.  An empty table gives an empty result.  Extra columns
pass through untouched, whatever their names; only the four result columns win over
columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import apart, cut, named_back

HOT_PARTS = 4096
#: Names of columns that stand beside those of the documents on the way.
_OWN = ("_h128", "_sha", "_keep", "_size", "_texts", "_hk", "_hs", "_key", "_csha", "_ck", "_cs", "_text", "_tk", "_ts", "_nth", "_id")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """One row per distinct text: hashes, id that stays, size, and whether another text shares both hashes."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    pick = {"min": F.min, "max": F.max}[keep]
    keyed = docs.select(F.col(id_col).alias("_id"), text.alias("_text"))
    hashed = keyed.select(
        "_id", "_text", F.md5(F.col("_text").cast("binary")).alias("_h128"), F.sha2(F.col("_text").cast("binary"), 256).alias("_sha")
    )
    return hashed.groupBy("_h128", "_sha", "_text").agg(pick("_id").alias("_keep"), F.count(F.lit(1)).alias("_size"))


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "min",
    hot_parts: int = HOT_PARTS,
) -> DataFrame:
    """Adds keep_id, group_size, kept and text_sha256 to every row of ``docs``."""
    docs, renamed = apart(docs, _OWN)
    id_col, text_col = renamed.get(id_col, id_col), renamed.get(text_col, text_col)
    found = groups(docs, id_col, text_col, keep)
    slim = cut(found.select("_h128", "_sha", "_keep", "_size"))
    total = slim.agg(F.sum("_size")).first()[0] or 0
    by_hash = slim.groupBy("_h128", "_sha").agg(F.count(F.lit(1)).alias("_texts"))
    clash = by_hash.filter("_texts > 1").limit(1).count() > 0

    own = ("keep_id", "group_size", "kept", "text_sha256")
    rest = [c for c in docs.columns if c.lower() not in own]
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        *rest, F.md5(text.cast("binary")).alias("_h128"), F.sha2(text.cast("binary"), 256).alias("_sha")
    )
    single = slim
    if clash:
        several = by_hash.filter("_texts > 1").select("_h128", "_sha")
        single = slim.join(several, ["_h128", "_sha"], "left_anti")
    floor = max(2, -(-total // hot_parts))
    hot = single.filter(F.col("_size") >= floor) if total >= hot_parts * 2 else None
    if hot is None:
        joined = rows.join(single, ["_h128", "_sha"], "left" if clash else "inner")
    else:
        cold = single.filter(F.col("_size") < floor)
        marked = rows.join(
            F.broadcast(hot.select("_h128", "_sha", F.col("_keep").alias("_hk"), F.col("_size").alias("_hs"))), ["_h128", "_sha"], "left"
        )
        # A hot row needs no partner: a key that no hash equals keeps it out of the match and spreads it by its id.
        spread = F.when(F.col("_hs").isNull(), F.col("_h128")).otherwise(F.concat(F.lit("!"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
        marked = marked.withColumn("_key", spread)
        cold = cold.select(F.col("_h128").alias("_key"), F.col("_sha").alias("_csha"), F.col("_keep").alias("_ck"), F.col("_size").alias("_cs"))
        joined = (
            marked.join(cold, (marked["_key"] == cold["_key"]) & (marked["_sha"] == cold["_csha"]), "left")
            .withColumn("_keep", F.when(F.col("_hs").isNotNull(), F.col("_hk")).otherwise(F.col("_ck")))
            .withColumn("_size", F.coalesce("_hs", "_cs"))
        )
    joined = joined.select(*rest, "_sha", "_keep", "_size")
    if clash:
        by_text = found.join(several, ["_h128", "_sha"], "left_semi").select(F.col("_text"), F.col("_keep").alias("_tk"), F.col("_size").alias("_ts"))
        lost = joined.filter(F.col("_size").isNull()).drop("_keep", "_size").withColumn("_text", F.coalesce(F.col(text_col), F.lit("")))
        exact = lost.join(by_text, "_text").select(*rest, "_sha", F.col("_tk").alias("_keep"), F.col("_ts").alias("_size"))
        joined = joined.filter(F.col("_size").isNotNull()).unionByName(exact)
    found = joined.select(
        *rest,
        F.col("_keep").alias("keep_id"),
        F.col("_size").alias("group_size"),
        F.col(id_col).eqNullSafe(F.col("_keep")).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )
    return named_back(found, renamed)


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """The documents that stay, one per distinct text, with the columns of ``docs``.

    The join is on id and hashes together, so a hot text spreads over all tasks by
    its ids.  Hashes stand for texts here once it is known that no two texts share both.
    """
    docs, renamed = apart(docs, (*_OWN, "keep_id", "group_size", "kept", "text_sha256", "count"))
    id_col, text_col = renamed.get(id_col, id_col), renamed.get(text_col, text_col)
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    hashes = [F.md5(text).alias("_h128"), F.sha2(text, 256).alias("_sha")]
    slim = cut(groups(docs, id_col, text_col, keep).select("_h128", "_sha", F.col("_keep").alias("_id")))
    if slim.groupBy("_h128", "_sha").count().filter("count > 1").limit(1).count():
        # Two texts share both hashes: the slower way, which joins these on the text.
        stay = exact_dedup(docs, id_col, text_col, keep).filter("kept").drop("keep_id", "group_size", "kept")
        stay = stay.withColumnRenamed("text_sha256", "_sha")
        repeats = stay.groupBy(id_col, text_col).count().filter("count > 1").limit(1).count()
    else:
        rows = docs.select(*docs.columns, *hashes)
        same = (rows["_h128"] == slim["_h128"]) & (rows["_sha"] == slim["_sha"]) & rows[id_col].eqNullSafe(slim["_id"])
        stay = rows.join(slim, same, "left_semi")
        repeats = docs.select(id_col, *hashes).groupBy(id_col, "_h128", "_sha").count().filter("count > 1").limit(1).count()
    if repeats:  # rows that repeat id and text: any one of them stays
        nth = F.row_number().over(W.partitionBy(id_col, "_sha", text_col).orderBy(*[F.col(c) for c in docs.columns if c not in (id_col, text_col)] or [F.lit(1)]))
        stay = stay.withColumn("_nth", nth).filter("_nth = 1")
    return named_back(stay.select(*docs.columns), renamed)
