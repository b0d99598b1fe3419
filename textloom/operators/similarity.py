"""TF-IDF vectors and cosine similarity inside blocks, by joins on terms; dense vectors by products of matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TOKEN = r"(?U)\b\w\w+\b"


def terms(df: DataFrame, text: str, ngram: int = 2, stopwords: tuple[str, ...] = (), token: str = TOKEN) -> DataFrame:
    """Adds ``_terms``: unigrams (without stopwords) and n-grams of what remains."""
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(token), F.lit(0))
    if stopwords:
        words = F.filter(words, lambda w: ~w.isin(list(stopwords)))
    out = df.withColumn("_w", words)
    return out.withColumn("_terms", F.concat(F.col("_w"), *[_grams(n) for n in range(2, ngram + 1)])).drop("_w")


def _grams(n: int) -> Column:
    last = F.size("_w") - (n - 1)
    runs = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.array_join(F.slice(F.col("_w"), i, n), " "))
    return F.when(last > 0, runs).otherwise(F.array().cast("array<string>"))


def tfidf(
    df: DataFrame, id_col: str, block: str, text: str, ngram: int = 2, max_features: int = 4096, stopwords: tuple[str, ...] = (), min_df: int = 1, token: str = TOKEN
) -> DataFrame:
    """(block, id, term, weight): raw counts times ln((1+n)/(1+df))+1, with unit length in each document.

    The ``max_features`` terms of most occurrences in a block count (ties by term); a block's vocabulary is
    ranked after partial aggregation, and only its head is kept.
    """
    long = terms(df, text, ngram, stopwords, token).select(F.col(block).alias("block"), F.col(id_col).alias("id"), F.explode("_terms").alias("term"))
    counts = long.groupBy("block", "id", "term").agg(F.count(F.lit(1)).alias("tf"))
    n_docs = df.groupBy(F.col(block).alias("block")).agg(F.count(F.lit(1)).alias("n"))
    vocabulary = counts.groupBy("block", "term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total")).filter(F.col("df") >= min_df)
    ranked = vocabulary.withColumn("_r", F.row_number().over(W.partitionBy("block").orderBy(F.col("total").desc(), "term"))).filter(F.col("_r") <= max_features)
    idf = ranked.join(n_docs, "block").select("block", "term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    raw = counts.join(idf, ["block", "term"]).select("block", "id", "term", (F.col("tf") * F.col("idf")).alias("w"))
    norm = raw.groupBy("block", "id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, ["block", "id"]).select("block", "id", "term", (F.col("w") / F.col("norm")).alias("weight"))


def cosine_pairs(vectors: DataFrame, min_sim: float, inclusive: bool = True) -> DataFrame:
    """(block, id_a, id_b, similarity) for pairs with a term in common, id_a < id_b.

    With terms in order of rarity, a vector's product with any other over its last terms
    is at most the length of these.  So vectors as near as ``min_sim`` meet in a term
    before the tail that is shorter than that: only such terms bring pairs together, and
    the frequent ones, which nearly all vectors share, don't.
    """
    rarity = vectors.groupBy("block", "term").agg(F.count(F.lit(1)).alias("_df"))
    tail = F.sum(F.col("weight") * F.col("weight")).over(W.partitionBy("block", "id").orderBy("_df", "term").rowsBetween(0, W.unboundedFollowing))
    head = vectors.join(rarity, ["block", "term"]).withColumn("_t", F.sqrt(tail)).filter(F.col("_t") >= min_sim - 1e-9)
    a = head.select("block", "term", F.col("id").alias("id_a"))
    b = head.select("block", "term", F.col("id").alias("id_b"))
    met = a.join(b, ["block", "term"]).filter("id_a < id_b").select("block", "id_a", "id_b").distinct()
    x = vectors.select("block", "term", F.col("id").alias("id_a"), F.col("weight").alias("_x"))
    y = vectors.select("block", "term", F.col("id").alias("id_b"), F.col("weight").alias("_y"))
    both = met.join(x, ["block", "id_a"]).join(y, ["block", "id_b", "term"])
    sims = both.groupBy("block", "id_a", "id_b").agg(F.sum(F.col("_x") * F.col("_y")).alias("similarity"))
    return sims.filter(F.col("similarity") >= min_sim if inclusive else F.col("similarity") > min_sim)


def neighbours(pairs: DataFrame, sources: DataFrame, k_cross: int = 2, k_same: int = 1) -> DataFrame:
    """Ranked partners of every id: up to ``k_cross`` of other documents, or else ``k_same`` of the same."""
    both = pairs.select("block", F.col("id_a").alias("id"), F.col("id_b").alias("other"), "similarity").union(
        pairs.select("block", F.col("id_b").alias("id"), F.col("id_a").alias("other"), "similarity")
    )
    src = sources.select("id", "source")
    joined = both.join(src, "id").join(src.select(F.col("id").alias("other"), F.col("source").alias("_o")), "other")
    joined = joined.withColumn("cross", F.col("source") != F.col("_o"))
    best = F.row_number().over(W.partitionBy("id", "cross").orderBy(F.col("similarity").desc(), "other"))
    any_cross = F.max(F.col("cross").cast("int")).over(W.partitionBy("id"))
    ranked = joined.withColumn("rank", best).withColumn("_c", any_cross)
    keep = (F.col("cross") & (F.col("rank") <= k_cross)) | (~F.col("cross") & (F.col("_c") == 0) & (F.col("rank") <= k_same))
    return ranked.filter(keep).select("block", "id", "other", "similarity", "cross", "rank")


#: Vectors of a group that one task compares with as many others, and rows of the product that it holds at once.
BLOCK, STRIP = 2048, 256


def _unit(vectors: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """The rows of each length and their vectors of length 1 (NaN for zeros); rows without a whole vector are in none."""
    lists = vectors.combine_chunks()
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    flat = lists.flatten()
    holes = np.repeat(np.arange(len(sizes)), sizes)[pc.is_null(flat).to_numpy(zero_copy_only=False)]
    whole = sizes > 0
    whole[holes] = False
    values, starts = flat.cast(pa.float64()).to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    out = {}
    for n in np.unique(sizes[whole]).tolist():
        at = np.flatnonzero(whole & (sizes == n))
        x = values[starts[at][:, None] + np.arange(n)]
        with np.errstate(divide="ignore", invalid="ignore"):
            out[n] = at, x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    return out


def _best(left: pa.Table, right: pa.Table, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """For each row of both the largest cosine with a row of the other (-inf: none); ``same``: within one, with rows of other ids."""
    one, two = np.full(left.num_rows, -np.inf), np.full(right.num_rows, -np.inf)
    ids, others = left["id"].to_numpy(), right["id"].to_numpy()
    columns = _unit(right["v"])
    for n, (at, x) in _unit(left["v"]).items():
        if n not in columns:
            continue
        to, y = columns[n]
        for k in range(0, len(at), STRIP):
            rows = at[k : k + STRIP]
            sims = x[k : k + STRIP] @ y.T
            if same:
                sims[ids[rows][:, None] == others[to]] = -np.inf
            one[rows] = np.maximum(one[rows], sims.max(axis=1))
            two[to] = np.maximum(two[to], sims.max(axis=0))
    return one, two


def nearest(df: DataFrame, id_col: str, group: str, vector: str) -> DataFrame:
    """(id, sim, n): rows of an id with its largest cosine in some blocks of its group, and the number of pairs there.

    All pairs of a group with different ids, exactly.  Members are dealt to blocks by id and blocks meet
    two by two, so the work of a large group is that of many tasks.  A pair counts, but has no similarity,
    if a vector is null, empty or has nulls in it or if lengths differ; that with a vector of zeros is NaN.
    """
    own = df.select(F.col(id_col).alias("id"), F.col(group).alias("group"), F.col(vector).alias("v")).filter("id IS NOT NULL AND group IS NOT NULL")
    sizes = own.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("int").alias("blocks"))
    dealt = own.join(sizes, "group").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("group", F.least("own", "with").alias("one"), F.greatest("own", "with").alias("two"), "own", "id", "v")

    def meet(table: pa.Table) -> pa.Table:
        one, two = table["one"][0].as_py(), table["two"][0].as_py()
        if one == two:
            sims, _ = _best(table, table, True)
            _, at, copies = np.unique(table["id"].to_numpy(), return_inverse=True, return_counts=True)
            ids, counts = table["id"], table.num_rows - copies[at]
        else:
            left, right = table.filter(pc.equal(table["own"], one)), table.filter(pc.equal(table["own"], two))
            sims = np.concatenate(_best(left, right, False))
            ids = pa.chunked_array([*left["id"].chunks, *right["id"].chunks], table["id"].type)
            counts = np.repeat([right.num_rows, left.num_rows], [left.num_rows, right.num_rows])
        found = pa.table({"id": ids, "sim": pa.array(sims, mask=np.isneginf(sims)), "n": pa.array(counts, pa.int64())})
        return found.filter(pc.greater(found["n"], 0))

    return dealt.groupBy("group", "one", "two").applyInArrow(meet, f"id {df.schema[id_col].dataType.simpleString()}, sim double, n long")
