"""Exact Jaccard self-join of documents by pivot regions, and its components.

The space is that of finite sets of word shingles under the Jaccard distance; two
documents link within the radius ``1 - num / den``.  Texts that aren't near copies
lie at a distance of about 1 from one another and from any document taken as a pivot,
so windows around document pivots hold everything (README has figures).  Therefore

* the first pivots are the single shingles.  A set lies within 1 of the pivots it
  holds, and pivots are ranked, rare ones first; two sets within the radius share a
  pivot among their ``n - ceil(t * n) + 1`` first ones, so a set is replicated to the
  regions of just these;
* inside a region a document pivot (the smallest id) is compared first; all members
  within the radius become one component with it;
* in a large group of copies of one text many are near to few of the others' pivots, so
  regions of many members and several components are compared with more pivots, in
  rounds, as long as each takes a share of the pairs that are left between components;
* what a region then holds of different components is joined by triangle-inequality
  windows: the distances of two near sets to a common point differ by no more than
  theirs.  The points are the empty set (sizes), the ``PARTS`` parts of the shingle
  space (counts, in the metric of symmetric differences).  Regions of many members
  are dealt to blocks, and blocks join two by two.  Two sets that aren't near can still
  meet in a hundred regions; regions of the same components are joined by one task,
  which counts how often a pair met in them and gives it out once;
* two near sets share so many of their first pivots that what lies beyond these can
  make up the rest; pairs that met in fewer regions go;
* the pairs that remain are decided by intersecting the whole sets.

Ranking uses a sketch of shingle frequencies over all documents (a fixed number of
counters); any ranking gives the exact result.  Documents of equal sets are one point.
Shingles are compared by 64-bit hashes.  Nothing is sampled, capped or dropped.

Defined results: words are split at ASCII white space after lower-casing A-Z; fewer
words than a shingle make one shingle of all; a null text or one without words has
an empty set, links with nothing and is its own component; ids that repeat are one
node, each row with its own set size; a row of null id can't be named by a link, so it
links with nothing and its component is null; an empty table gives an empty result;
columns other than the id and the text aren't read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint_root, cut, giving_back, mix64, release, remove_folder, text_slices

BUCKET_BITS = 21
PARTS = 256
#: Parts are also compared in sums of this many.
COARSE = 8
#: Members of a region that one task compares with one another.
BLOCK = 4096
#: Document pivots of a region in each further round, members of the regions that have these rounds, and the
#: pairs between components for each of their rows up to which the join of the regions follows at once.
PIVOTS, WIDE, PAIRS_A_ROW = 8, 32, 4
#: Rows of regions with the same lowest and highest component that one task joins together; of more, each part.
TOGETHER = 16_384
#: Rows of a join that one call handles.
FLUSH = 20_000
#: Rows of a few numbers that may be broadcast (about 16 MB of the driver); beyond, a shuffle joins.
BROADCAST_ROWS = 200_000
#: A node with one in HUB_PARTS of the rows of edges, and this many at least, is a hub; so is a cell with as many of the rows of cells.
HUB_PARTS, HUB_LEAST = 4096, 1000
#: Edges that one task settles; every round of ``components`` on more leaves some MB of plans and tasks in the driver.
FEW_EDGES = 50_000
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93], dtype=np.uint64)


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the shingles of each text."""
    index: dict[bytes, int] = {}
    number = index.setdefault
    rows = []
    for text in texts:
        words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
        if len(words) < width:
            rows.append(xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words)) if words else None)
        else:
            rows.append([number(w, len(index)) for w in words])
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, index), dtype=np.uint64, count=len(index))
    out = []
    for row in rows:
        if row is None:
            out.append(np.zeros(0, dtype=np.uint64))
        elif isinstance(row, int):
            out.append(np.array([row], dtype=np.uint64))
        else:
            h = hashes[row]
            n = len(h) - width + 1
            mixed = np.zeros(n, dtype=np.uint64)
            for k in range(width):
                mixed += h[k : k + n] * (_ODD[k % len(_ODD)] + np.uint64(2 * (k // len(_ODD))))
            out.append(np.unique(mix64(mixed)))
    return out


def _sketch(docs: DataFrame, width: int) -> np.ndarray:
    """Rank class of every bucket of shingles: twelfths of the logarithm of how often its shingles occur.

    Buckets hold many shingles in large tables, so their counts lie close together; classes of
    whole powers of two would rank a shingle of dozens of documents with those of one.
    """
    block = 1 << 14

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BUCKET_BITS, dtype=np.int64)
        for whole in batches:
            for batch in text_slices(whole, 0, 4 << 20):
                sets = shingle_sets(batch.column(0).to_pylist(), width)
                flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
                total += np.bincount((flat >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), minlength=len(total))
        few = np.minimum(total, 65535).astype("<u2").reshape(-1, block)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(few)), pa.int32()), pa.array([x.tobytes() for x in few], pa.binary())], names=["part", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(block, dtype=np.int64)
        for x in table["counts"].to_pylist():
            total += np.frombuffer(x, dtype="<i8") if len(x) == 8 * block else np.frombuffer(x, dtype="<u2")
        return pa.table({"part": table["part"].slice(0, 1), "counts": pa.array([total.astype("<i8").tobytes()], pa.binary())})

    parts = docs.mapInArrow(giving_back(count), "part int, counts binary")
    # Two rounds of sums: a task adds up 64 partial sketches at most times the number of parts over 64.
    salted = parts.withColumn("salt", F.pmod(F.xxhash64("counts"), F.lit(16)))
    first = salted.groupBy("part", "salt").applyInArrow(lambda t: add(t.select(["part", "counts"])), "part int, counts binary")
    total = np.zeros(1 << BUCKET_BITS, dtype=np.int64)
    for row in first.groupBy("part").applyInArrow(add, "part int, counts binary").toLocalIterator():
        total[row["part"] * block : (row["part"] + 1) * block] = np.frombuffer(row["counts"], dtype="<i8")
    return np.minimum(np.round(12 * np.log2(1 + total)), 255).astype(np.uint8)


def _spread(sets: np.ndarray) -> bytes:
    """How many shingles lie in each part; a count stops at 255, which can only make two sets look nearer."""
    return np.minimum(np.bincount((sets & np.uint64(PARTS - 1)).astype(np.int64), minlength=PARTS), 255).astype(np.uint8).tobytes()


def _spreads(column: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    fine = np.frombuffer(b"".join(column), np.uint8).reshape(-1, PARTS).astype(np.int16)
    return fine, fine.reshape(-1, PARTS // COARSE, COARSE).sum(axis=2, dtype=np.int16)


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.abs(x - y).sum(axis=1, dtype=np.int64)


def _pick(rows: DataFrame, keys: DataFrame, on: str, size: int) -> DataFrame:
    """An inner join with a table of known size."""
    return rows.join(F.broadcast(keys) if size <= BROADCAST_ROWS else keys, on)


def _pick_cells(rows: DataFrame, regions: DataFrame, size: int) -> DataFrame:
    """``rows`` of the cells of ``regions``, with the columns of these.

    Beyond ``BROADCAST_ROWS`` a shuffle joins, and only the hubs - at most ``HUB_PARTS`` -
    are broadcast, so the members of a large region don't meet in one task.
    """
    if size <= BROADCAST_ROWS:
        return _pick(rows, regions, "cell", size)
    total = regions.agg(F.sum("members")).first()[0]
    hub = F.col("members") >= max(HUB_LEAST, -(-total // HUB_PARTS))
    if regions.filter(hub).isEmpty():
        return rows.join(regions, "cell")
    hubs = F.broadcast(regions.filter(hub))
    rest = rows.join(F.broadcast(regions.filter(hub).select("cell")), "cell", "left_anti")
    return rows.join(hubs, "cell").unionByName(rest.join(regions.filter(~hub), "cell"))


def _decide(pairs: DataFrame, docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """Those pairs (a, b) of ids whose whole sets are near."""
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct().persist(StorageLevel.DISK_ONLY)
    size = ids.count()
    kind = docs.schema["id"].dataType.simpleString()

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole, 1, 4 << 20):
                own = [x.tobytes() for x in shingle_sets(batch.column(1).to_pylist(), width)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.binary())], names=["id", "set"])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                u, v = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(u, v, assume_unique=True))
                keep.append(den * both >= num * (len(u) + len(v) - both))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    chosen = _pick(docs, ids, "id", size).mapInArrow(giving_back(sets), f"id {kind}, set binary")
    left = chosen.select(F.col("id").alias("a"), F.col("set").alias("x"))
    right = chosen.select(F.col("id").alias("b"), F.col("set").alias("y"))
    found = cut(pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(giving_back(near), f"a {kind}, b {kind}"))
    ids.unpersist()
    return found


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``components`` of edges (u, v) that one task holds."""
    up: dict = {}

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    kind = None
    for batch in batches:
        kind = batch.column(0).type
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            p, q = root(up.setdefault(u, u)), root(up.setdefault(v, v))
            up[max(p, q)] = min(p, q)
    if up:
        yield pa.RecordBatch.from_arrays([pa.array(list(up), kind), pa.array([root(x) for x in up], kind)], names=["id", "component"])


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id that is reachable, for every id on an edge (a, b).

    Alternates two steps until nothing changes: neighbours larger than a node, then
    smaller ones, are tied to the smallest of its neighbourhood.  The minima of nodes
    that hold at least one row in ``HUB_PARTS`` - there are at most that many - go to
    the rows by a broadcast, so the middle of a large group isn't one task's work.
    ``FEW_EDGES`` edges or fewer are settled in one task.
    """
    now = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = (now.count(), None)
    if mark[0] <= FEW_EDGES:
        kind = now.schema["u"].dataType.simpleString()
        return now.coalesce(1).mapInArrow(giving_back(_settle), f"id {kind}, component {kind}")
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        hub = F.col("n") >= max(HUB_LEAST, -(-2 * mark[0] // HUB_PARTS))
        hubs = F.broadcast(least.filter(hub).select("u", "m"))
        wide = both.filter("v > u")
        told = wide.join(hubs, "u").unionByName(wide.join(hubs.select("u"), "u", "left_anti").join(least.filter(~hub).select("u", "m"), "u"))
        large = told.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        now = cut(small.filter("u <> v").distinct())
        new = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % F.lit(1 << 30))).first()
        release(now.sparkSession)
        if new == mark:
            break
        mark = new
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def _needed(n, m, num: int, den: int):
    """How many of their first pivots two near sets of these sizes must share, at least 1; numbers, arrays or columns."""
    most = F.greatest if isinstance(n, Column) else np.maximum
    beyond = lambda x: (x * num + den - 1) // den - 1 if not isinstance(x, Column) else F.floor((x * num + den - 1) / den) - 1
    over = (n + m) * num
    overlap = -(-over // (num + den)) if not isinstance(n, Column) else F.ceil(over / (num + den))
    one = F.lit(1) if isinstance(n, Column) else 1
    return most(one, overlap - most(beyond(n), beyond(m)))


def _windows(cells: np.ndarray, n: np.ndarray, comp: np.ndarray, spreads: tuple[np.ndarray, np.ndarray], side: np.ndarray, num: int, den: int):
    """Index pairs within runs of equal ``cells`` that pass every window; ``side`` -1 meets all, 0 meets only 1."""
    starts = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]]))
    sizes = np.diff(np.concatenate([starts, [len(cells)]]))
    ends = np.repeat(starts + sizes, sizes)
    later = ends - np.arange(len(cells)) - 1  # partners of each row: those behind it in its run
    out_i, out_j = [], []
    bounds = np.concatenate([[0], np.cumsum(later)])
    at = 0
    while at < len(cells):
        to = int(np.searchsorted(bounds, bounds[at] + 1_000_000, side="right")) - 1
        to = min(max(to, at + 1), len(cells))
        i = np.repeat(np.arange(at, to), later[at:to])
        j = np.arange(len(i)) - np.repeat(bounds[at:to] - bounds[at], later[at:to]) + i + 1
        total = n[i] + n[j]
        ok = (comp[i] != comp[j]) & ((den - num) * total >= (den + num) * np.abs(n[i] - n[j]))
        ok &= (side[i] < 0) | (side[i] != side[j])
        i, j, total = i[ok], j[ok], total[ok]
        for k in range(0, len(i), 50_000):
            a, b, t = i[k : k + 50_000], j[k : k + 50_000], total[k : k + 50_000]
            for vec in reversed(spreads):
                ok = (den - num) * t >= (den + num) * _apart(vec[a], vec[b])
                a, b, t = a[ok], b[ok], t[ok]
            out_i.append(a)
            out_j.append(b)
        at = to
    none = np.zeros(0, dtype=np.int64)
    return (np.concatenate(out_i), np.concatenate(out_j)) if out_i else (none, none)


def _once(ids: np.ndarray, i: np.ndarray, j: np.ndarray, needed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each pair of ids among those at ``i`` and ``j`` once, the smaller first: how often it is there, and the least that it needed."""
    own, place = np.unique(ids, return_inverse=True)
    p, q = place[i], place[j]
    code = np.minimum(p, q) * len(own) + np.maximum(p, q)
    order = np.argsort(code, kind="stable")
    code = code[order]
    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
    least = np.minimum.reduceat(needed[order], first) if len(code) else needed
    return own[code[first] // max(len(own), 1)], own[code[first] % max(len(own), 1)], np.diff(np.append(first, len(code))), least


def _groups(regions: DataFrame) -> DataFrame:
    """``regions`` (cell, members, lo, hi) as (cell, members, group): those of the same two components in groups of about ``TOGETHER`` rows."""
    regions = regions.select("cell", "members", F.xxhash64("lo", "hi").alias("key"))
    # There is at most one such key for every TOGETHER rows.
    heavy = regions.groupBy("key").agg(F.sum("members").alias("load")).filter(F.col("load") > TOGETHER)
    parts = F.ceil(F.col("load") / F.lit(TOGETHER))
    found = regions.join(F.broadcast(heavy), "key", "left")
    return found.select("cell", "members", F.when(F.col("load").isNull(), F.col("key")).otherwise(F.xxhash64("key", F.pmod(F.xxhash64("cell"), parts))).alias("group"))


def _pivots(rows: DataFrame, regions: DataFrame, size: int, number: int) -> DataFrame:
    """(id, pivot, shared) of the points in ``rows`` (id, cell) with the pivots of round ``number``, and in how many regions they met.

    Orders of ids by hashes give the pivots, the same order in all regions, so that
    regions of the same points tend to have the same pivots.
    """
    kind = rows.schema["id"].dataType.simpleString()
    ranked = [F.min_by("id", F.xxhash64("id", F.lit(number * PIVOTS + k))) for k in range(PIVOTS)]
    chosen = cut(rows.groupBy("cell").agg(F.array_distinct(F.array(*ranked)).alias("pivots")).join(regions.select("cell", "members"), "cell"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            own = np.repeat(np.arange(len(lists)), np.diff(np.asarray(lists.offsets)))
            coded = lists.flatten().dictionary_encode()
            most = max(len(coded.dictionary), 1)
            code, times = np.unique(own * most + np.asarray(coded.indices, dtype=np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(code // most)), coded.dictionary.take(pa.array(code % most)), pa.array(times, pa.int64())], names=["id", "pivot", "shared"]
            )

    held = _pick_cells(rows, chosen, size).groupBy("id").agg(F.flatten(F.collect_list("pivots")).alias("pivots"))
    return held.mapInArrow(giving_back(count), f"id {kind}, pivot {kind}, shared long").filter("id <> pivot")


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """id, n_shingles and component_id of every document; links are at a similarity of ``num / den`` or more."""
    spark = docs.sparkSession
    root = checkpoint_root(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    every = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    source = every.filter("id IS NOT NULL")
    classes = _sketch(source.select("text"), width)

    def points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole, 1, 4 << 20):
                sizes, keys, spreads, prefixes = [], [], [], []
                for s in shingle_sets(batch.column(1).to_pylist(), width):
                    first = len(s) - -(-num * len(s) // den) + 1 if len(s) else 0
                    rank = np.argsort(classes[(s >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)], kind="stable")[:first]
                    sizes.append(len(s))
                    keys.append(xxhash.xxh3_128_digest(s.tobytes()))
                    spreads.append(_spread(s))
                    prefixes.append(s[rank].view(np.int64))
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in prefixes])]).astype(np.int32)
                flat = np.concatenate(prefixes) if prefixes else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(sizes, pa.int32()), pa.array(keys, pa.binary()), pa.array(spreads, pa.binary()), pa.ListArray.from_arrays(offsets, pa.array(flat))],
                    names=["id", "n", "key", "vec", "prefix"],
                )

    folder = f"{root.rstrip('/')}/textloom-jaccard-{xxhash.xxh3_64_hexdigest(str(id(docs)) + str(np.random.default_rng().integers(1 << 62)))}"
    every.mapInArrow(giving_back(points), f"id {kind}, n int, key binary, vec binary, prefix array<long>").write.parquet(folder)
    stored = spark.read.parquet(folder)

    # One point for each distinct set: the smallest id of those that have it.  Groups of copies meet in partial sums.
    holders = cut(stored.filter("n > 0 AND id IS NOT NULL").groupBy("key").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies")))
    firsts = holders.select("key", "id")
    stored.join(firsts, ["key", "id"]).select("id", "n", "vec", "prefix").write.parquet(f"{folder}-points")
    sets = spark.read.parquet(f"{folder}-points")
    # From here on the table of all documents needs no prefixes.
    stored.select("id", "n", "key").write.parquet(f"{folder}-ids")
    stored = spark.read.parquet(f"{folder}-ids")
    remove_folder(spark, folder)
    release(spark)

    # Regions of more than one member, with their document pivot.
    regions = cut(
        sets.select("id", F.explode("prefix").alias("cell")).groupBy("cell").agg(F.min("id").alias("pivot"), F.count(F.lit(1)).alias("members")).filter("members > 1")
    )
    n_regions = regions.count()
    release(spark)
    stars = (
        _pick_cells(sets.select("id", F.explode("prefix").alias("cell")), regions, n_regions)
        .filter("id <> pivot")
        .groupBy("id", "pivot")
        .agg(F.count(F.lit(1)).alias("shared"))
    )
    thin = sets.select("id", "n", "vec")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (batch.column(k).to_numpy().astype(np.int64) for k in (2, 3))
            x, y = (_spreads(batch.column(k).to_pylist())[0] for k in (4, 5))
            keep = (den - num) * (n + m) >= (den + num) * _apart(x, y)
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(keep))

    other = thin.select(F.col("id").alias("pivot"), F.col("n").alias("m"), F.col("vec").alias("y"))

    def near_pivots(stars: DataFrame) -> DataFrame:
        """Links among (id, pivot, shared); pairs with little in common are left to the join of the regions."""
        spokes = stars.join(thin, "id").join(other, "pivot").filter(F.lit(den - num) * (F.col("n") + F.col("m")) >= F.lit(den + num) * F.abs(F.col("n") - F.col("m")))
        spokes = spokes.filter(F.col("shared") >= _needed(F.col("n"), F.col("m"), num, den))
        spokes = cut(spokes.select("id", "pivot", "n", "m", "vec", "y").mapInArrow(giving_back(close), f"a {kind}, b {kind}"))
        return _decide(spokes, source, width, num, den)

    links = near_pivots(stars)
    labels = components(links)
    release(spark)

    def labelled(points: DataFrame) -> DataFrame:
        return points.join(labels, "id", "left").withColumn("comp", F.coalesce("component", "id")).drop("component")

    def mixed() -> DataFrame:
        """What regions still hold of different components."""
        cells = labelled(sets.select("id", "prefix")).select("comp", F.explode("prefix").alias("cell"))
        found = cells.groupBy("cell").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("members"))
        return cut(found.filter("lo <> hi"))

    # Regions of many members meet more pivots first.
    still = mixed()
    wide = still.filter(F.col("members") >= WIDE).select("cell", "members")
    n_wide = wide.count()
    if n_wide:
        held = cut(_pick_cells(sets.select("id", F.explode("prefix").alias("cell")), wide, n_wide).select("id", "cell"))
        last, number, merged = None, 0, False
        while True:
            of = labelled(held).groupBy("cell", "comp").agg(F.count(F.lit(1)).alias("k"))
            left = cut(of.groupBy("cell").agg(F.sum("k").alias("members"), F.sum(F.col("k") * F.col("k")).alias("same")).filter("same < members * members"))
            n_left, rows, pairs = left.agg(F.count(F.lit(1)), F.sum("members"), F.sum((F.col("members") * F.col("members") - F.col("same")) / F.lit(2))).first()
            release(spark)
            # A round that leaves more than three quarters of the pairs is the last: these are of texts that aren't near.
            if not n_left or pairs <= PAIRS_A_ROW * rows or (last is not None and pairs > 0.75 * last):
                break
            own = _pick_cells(held, left.select("cell", "members"), n_left).select("id", "cell")
            told = labelled(_pivots(own, left, n_left, number)).withColumnRenamed("comp", "one")
            both = told.join(labels.select(F.col("id").alias("pivot"), "component"), "pivot", "left").filter(F.col("one") != F.coalesce("component", "pivot"))
            new = near_pivots(both.select("id", "pivot", "shared"))
            if new.isEmpty():
                break
            links, last, number, merged = links.union(new), pairs, number + 1, True
            labels = components(links)
            release(spark)
        if merged:
            still = mixed()

    tagged = labelled(sets.select("id", "n", "vec", "prefix"))
    open_regions = cut(_groups(still))
    n_open = open_regions.count()
    release(spark)
    if n_open <= BROADCAST_ROWS:
        rows = _pick_cells(tagged.select("id", "n", "vec", "comp", F.explode("prefix").alias("cell")), open_regions, n_open)
    else:  # points get their cells as one array, so that no row but an open one carries their parts through a shuffle
        held = _pick_cells(sets.select("id", F.explode("prefix").alias("cell")), open_regions, n_open)
        held = held.groupBy("id").agg(F.collect_list(F.struct("cell", "members", "group")).alias("held"))
        rows = tagged.select("id", "n", "vec", "comp").join(held, "id").select("id", "n", "vec", "comp", F.explode("held").alias("h")).select("id", "n", "vec", "comp", "h.*")
    blocks = F.ceil(F.col("members") / F.lit(BLOCK)).cast("int")
    rows = rows.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select(
        "group",
        "cell",
        F.least("own", "with").alias("one"),
        F.greatest("own", "with").alias("two"),
        F.when(F.col("own") == F.col("with"), F.lit(-1)).when(F.col("own") < F.col("with"), F.lit(0)).otherwise(F.lit(1)).alias("side"),
        "id", "n", "comp", "vec",
    )

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(table: pa.Table) -> pa.RecordBatch:
            col = lambda k: table[k].to_numpy()
            key = mix64(col("cell").view(np.uint64)) + mix64((col("one").astype(np.int64) << 32 | col("two")).view(np.uint64) + np.uint64(1))
            spreads = _spreads(table["vec"].to_pylist())
            n = col("n").astype(np.int64)
            i, j = _windows(key, n, col("comp"), spreads, col("side"), num, den)
            a, b, shared, needed = _once(col("id"), i, j, _needed(n[i], n[j], num, den))
            return pa.RecordBatch.from_arrays(
                [pa.array(a, table["id"].type), pa.array(b, table["id"].type), pa.array(shared, pa.int64()), pa.array(needed, pa.int64())], names=["a", "b", "shared", "needed"]
            )

        def ends(table: pa.Table, *by: str) -> np.ndarray:
            return np.flatnonzero(np.logical_or.reduce([np.diff(table[k].to_numpy()) != 0 for k in by]))

        for batch in batches:
            held.append(batch)
            if sum(x.num_rows for x in held) >= FLUSH:
                table = pa.Table.from_batches(held)
                # The last group may go on in the next batch; so may the last run, if all rows are of one group.
                last = ends(table, "group", "one", "two")
                if not len(last):
                    last = ends(table, "cell")
                if len(last):
                    yield flush(table.slice(0, int(last[-1]) + 1))
                    held = table.slice(int(last[-1]) + 1).to_batches()
        if held and (table := pa.Table.from_batches(held)).num_rows:
            yield flush(table)

    order = ("group", "one", "two", "cell")
    rest = rows.repartition(*order[:3]).sortWithinPartitions(*order).mapInArrow(giving_back(join), f"a {kind}, b {kind}, shared long, needed long")
    # Points of one id may need different numbers.
    met = rest.groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.min("needed").alias("needed"))
    rest = cut(met.filter("shared >= needed").select("a", "b"))
    del met, rows
    release(spark)
    more = _decide(rest, source, width, num, den)
    final = components(links.union(more))

    # Every document by its point.
    settled = firsts.join(final, "id", "left").select("key", F.coalesce("component", "id").alias("component_id"))
    large = cut(holders.filter(F.col("copies") >= 1000).select("key"))  # at most a thousandth of the rows
    out = stored.select("id", "n", "key")
    full = out.filter("n > 0 AND id IS NOT NULL")
    n_large = large.count()
    if n_large and n_large <= BROADCAST_ROWS:
        hot = F.broadcast(settled.join(F.broadcast(large), "key"))
        found = full.join(hot, "key").unionByName(full.join(F.broadcast(large), "key", "left_anti").join(settled, "key"))
    else:
        found = full.join(settled, "key")
    empty = out.filter("n = 0 OR id IS NULL").withColumn("component_id", F.col("id"))
    return found.select("id", "n", "component_id").unionByName(empty.select("id", "n", "component_id")).select(
        F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), "component_id"
    )
