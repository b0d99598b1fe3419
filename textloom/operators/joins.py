"""Joins, resumption and set operations on tables of items."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def last_wins(table: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key, the one of largest ``order``."""
    rest = [c for c in table.columns if c != key]
    return table.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(key, "_r.*")


def backfill(left: DataFrame, right: DataFrame, key: str, defaults: dict[str, Column]) -> DataFrame:
    """Left join that gives the named columns of ``right``, or their defaults, and ``matched``."""
    found = right.select(key, *defaults).withColumn("_hit", F.lit(True))
    joined = left.join(found, key, "left")
    for name, default in defaults.items():
        joined = joined.withColumn(name, F.coalesce(F.col(name), default))
    return joined.withColumn("matched", F.coalesce("_hit", F.lit(False))).drop("_hit")


def remap_ids(table: DataFrame, id_map: DataFrame, key: str = "id", new: str = "new_id") -> DataFrame:
    """Rows under their new ids; rows without one go."""
    return table.join(id_map.select(key, new), key).withColumn(key, F.col(new)).drop(new)


def fallback_join(items: DataFrame, by_id: DataFrame, by_text: DataFrame, key: str, text: Column, value: str) -> DataFrame:
    """``value`` by id or else by text; ``by_text`` has (text_key, value)."""
    one = items.join(by_id.select(key, F.col(value).alias("_a")), key, "left").withColumn("_t", text)
    two = one.join(by_text.select(F.col("text_key").alias("_t"), F.col(value).alias("_b")), "_t", "left")
    return two.withColumn(value, F.coalesce("_a", "_b")).drop("_t", "_a", "_b")


def pending(items: DataFrame, done: DataFrame, keys: list[str], retry_failed: bool = False) -> DataFrame:
    """Items without a finished row; with ``retry_failed`` a row with an error doesn't count as finished."""
    if retry_failed and "error" in done.columns:
        done = done.filter("error IS NULL")
    return items.join(done.select(*keys).distinct(), keys, "left_anti")


def pending_judges(items: DataFrame, verdicts: DataFrame, judges: list[str], key: str = "id") -> DataFrame:
    """Items that some judge hasn't answered; ``verdicts`` has (id, judge, veredito)."""
    full = verdicts.filter(F.col("judge").isin(judges)).groupBy(key).agg(F.count_distinct("judge").alias("n")).filter(F.col("n") == len(judges))
    return items.join(full, key, "left_anti")


def reuse_cached(rows: DataFrame, cache: DataFrame, keys: list[str], col: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose value the cache has, and those that still need one."""
    joined = rows.join(cache.select(*keys, col), keys, "left")
    return joined.filter(F.col(col).isNotNull()), joined.filter(F.col(col).isNull()).drop(col)


def exclude_used(chunks: DataFrame, items: DataFrame, key: str = "chunk_id", used: str = "chunk_ids") -> DataFrame:
    return chunks.join(items.select(F.explode(used).alias(key)).distinct(), key, "left_anti")


def label_split(items: DataFrame, train: DataFrame, test: DataFrame, key: str = "id") -> DataFrame:
    """Adds ``split``: train before test before geral."""
    one = items.join(train.select(key).distinct().withColumn("_a", F.lit(True)), key, "left")
    two = one.join(test.select(key).distinct().withColumn("_b", F.lit(True)), key, "left")
    return two.withColumn("split", F.when(F.col("_a"), "train").when(F.col("_b"), "test").otherwise("geral")).drop("_a", "_b")


def leaks(train: DataFrame, test: DataFrame, used: str = "chunk_ids") -> DataFrame:
    """Chunks on both sides of a split."""
    return train.select(F.explode(used).alias("chunk_id")).intersect(test.select(F.explode(used).alias("chunk_id")))


def assert_no_leak(train: DataFrame, test: DataFrame, used: str = "chunk_ids") -> None:
    if found := leaks(train, test, used).limit(5).collect():
        raise ValueError(f"chunks on both sides of the split: {[r[0] for r in found]}")


def replace_partitions(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``existing`` with all rows of the keys in ``new`` replaced."""
    return existing.join(new.select(key).distinct(), key, "left_anti").select(*existing.columns).unionByName(new)


def route_ok_fail(rows: DataFrame, ok: str = "parse_ok") -> tuple[DataFrame, DataFrame]:
    good = F.coalesce(F.col(ok), F.lit(False))
    return rows.filter(good), rows.filter(~good)


def union_ragged(*tables: DataFrame) -> DataFrame:
    """All rows, with the sorted union of the columns."""
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
    return out.select(*sorted(out.columns))


def head_to_head(scored: DataFrame, models: list[str], value: str, key: str = "id") -> DataFrame:
    """A row for each item with each model's value."""
    return scored.groupBy(key).pivot("model", models).agg(F.first(value))


def filter_in(df: DataFrame, col: str, values: str, trim: bool = False) -> DataFrame:
    """Rows whose value is in a comma-separated list; nothing given keeps all."""
    if not values:
        return df
    wanted = [v.strip() if trim else v for v in values.split(",")]
    return df.filter(F.col(col).isin(wanted))


def facet_search(df: DataFrame, facets: dict[str, str], text: str = "", text_cols: tuple[str, ...] = (), array_cols: tuple[str, ...] = ()) -> DataFrame:
    """Equality facets (an array column: membership) and a substring without regard to case in any column."""
    for col, value in facets.items():
        kind = df.schema[col].dataType.typeName()
        df = df.filter(F.array_contains(col, value) if kind == "array" else F.col(col) == value)
    if text:
        low = text.lower()
        hit = F.lit(False)
        for col in text_cols:
            hit = hit | F.lower(F.coalesce(F.col(col).cast("string"), F.lit(""))).contains(low)
        for col in array_cols:
            hit = hit | F.coalesce(F.exists(col, lambda x: F.lower(x).contains(low)), F.lit(False))
        df = df.filter(hit)
    return df


def page(df: DataFrame, number: int, size: int = 20) -> DataFrame:
    """A page of an ordered table, counted from 1."""
    return df.offset((number - 1) * size).limit(size)


def page_window(df: DataFrame, current: str, total: str) -> DataFrame:
    """Adds ``pages``: the numbers shown around the current page; none if there is only one."""
    around = F.sequence(F.greatest(F.lit(1), F.col(current) - 2), F.least(F.col(total), F.col(current) + 2))
    return df.withColumn("pages", F.when(F.col(total) > 1, around).otherwise(F.array().cast("array<int>")))
