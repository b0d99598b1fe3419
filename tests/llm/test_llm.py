"""Corpus operators against brute force, round trips and held-out rows, and their defined edge results."""

import collections
import hashlib
import html
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from textloom.llm import bpe, decontam, exact_dedup, html_text, jaccard_join, langid, maxent_lm, queries, sharding, token_files, toxicity

DATA = "/root/testdata/sf0.001"
TOKENIZERS = pytest.importorskip("public_tokenizers")
RANKS, PATTERN = TOKENIZERS.path("byte_bpe_50k.tiktoken"), TOKENIZERS.PATTERN

#: Null id and text, empty and very long texts, repeated rows, an extra column that clashes.
ODD = [(1, None, "x"), (2, "", "x"), (3, "the a", "x"), (3, "the a", "x"), (4, "long words " * 30000, "y"), (None, "null id here", "z"), (5, "The a", None)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string, score string")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def spark_rows(path):
    import pyarrow.parquet as pq

    return pq.read_table(path).to_pylist()


# --- exact copies


def test_exact_dedup_against_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    want = {tuple(r) for r in con.execute(queries.OP2_SQL).fetchall()}
    assert {tuple(r) for r in queries.op2_exact_dedup(spark, DATA).collect()} == want


def test_exact_dedup_edges(odd, none):
    rows = {(r["doc_id"], r["text"] and r["text"][:3]): r for r in exact_dedup.exact_dedup(odd, keep="max").collect()}
    assert rows[1, None]["keep_id"] == 2 and rows[1, None]["group_size"] == 2 and not rows[1, None]["kept"] and rows[2, ""]["kept"]
    assert rows[3, "the"]["group_size"] == 2 and rows[5, "The"]["group_size"] == 1 and rows[None, "nul"]["kept"]
    assert rows[1, None]["text_sha256"] == hashlib.sha256(b"").hexdigest() and rows[1, None]["score"] == "x"
    assert exact_dedup.exact_dedup(none).count() == 0
    assert exact_dedup.survivors(odd, keep="max").count() == 5
    assert exact_dedup.survivors(none).columns == none.columns


def test_exact_dedup_with_names_of_its_own(spark):
    names = ["_sha", "_H128", "_key", "_keep", "_size", "_text", "_id", "_hk", "count", "text_sha256", "kept"]
    docs = spark.createDataFrame([(i, "ab"[i % 2], *[i] * len(names)) for i in range(6)], ["doc_id", "text", *names])
    for hot_parts in (1, 4096):
        found = exact_dedup.exact_dedup(docs, hot_parts=hot_parts)
        assert found.columns == ["doc_id", "text", *names[:-2], "keep_id", "group_size", "kept", "text_sha256"]
        assert all(r["_sha"] == r["_key"] == r["doc_id"] and r["keep_id"] == r["doc_id"] % 2 for r in found.collect())
    left = exact_dedup.survivors(docs).collect()
    assert sorted(tuple(r) for r in left) == [(0, "a", *[0] * len(names)), (1, "b", *[1] * len(names))]
    by_other = docs.drop("_id", "_text").withColumnsRenamed({"doc_id": "_id", "text": "_text"})
    assert exact_dedup.exact_dedup(by_other, "_id", "_text").filter("kept").count() == 2


def test_exact_dedup_with_hot_group(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same").otherwise(F.col("id").cast("string")).alias("text"))
    found = exact_dedup.exact_dedup(docs, hot_parts=8)
    assert found.filter("kept").count() == 4000 - 1334 + 1
    assert found.filter("text = 'same' AND keep_id = 0 AND group_size = 1334").count() == 1334


# --- shards


def test_shards_hold_the_law_of_keys(spark, odd, none):
    rows = queries.op4_hash_tree_sharding(spark, DATA).collect()
    moved = [r for r in rows if r["grown_shard"] != r["shard"]]
    assert moved and all(r["grown_shard"] == 24 for r in moved) and {r["shard"] for r in rows} <= set(range(24))
    by = collections.defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    found = sharding.shard_rows(odd, sharding.tree(24)).collect()
    assert len(found) == len(ODD) and {r["size"] for r in found if r["doc_id"] == 1} == {8}
    assert sharding.shard_rows(none, sharding.tree(3)).count() == 0


def test_shard_weights(spark):
    leaves = sharding.tree(6, 2, 2, [1, 1, 2, 4, 1, 1])
    shares = spark.range(40000).select(sharding.place(F.col("id"), leaves).alias("s")).groupBy("s").count().collect()
    for r in shares:
        assert abs(r["count"] / 40000 - leaves[r["s"]][3] / 10) < 0.015
    # Only subtrees whose weight changes win or lose rows.
    heavier = sharding.tree(6, 2, 2, [1, 1, 2, 4, 1, 3])
    both = spark.range(5000).select(sharding.place(F.col("id"), leaves).alias("a"), sharding.place(F.col("id"), heavier).alias("b")).filter("a <> b")
    assert {r["b"] for r in both.distinct().collect()} <= {4, 5}


def test_shards_against_a_plain_descent(spark, docs):
    """Sizes, checksums and both shards of every document, drawn level by level in plain Python."""
    import math

    import xxhash

    def pick(key, children):
        def draw(label, weight):
            unit = ((xxhash.xxh64_intdigest(label, seed=xxhash.xxh64_intdigest(key, seed=42)) >> 11) + 0.5) / 2**53
            return -math.log(unit) / weight

        return min((draw(label, weight), child) for label, child, weight in children)[1]

    def descend(key, shards):
        racks = collections.Counter(s // 4 for s in range(shards))
        regions = collections.Counter(s // 12 for s in range(shards))
        region = pick(key, [(f"region/{r}", r, n) for r, n in regions.items()])
        rack = pick(key, [(f"rack/{region}/{k}", k, n) for k, n in racks.items() if k // 3 == region])
        return pick(key, [(f"shard/{region}/{rack}/{s}", s, 1) for s in range(shards) if s // 4 == rack])

    want = {}
    for r in docs.collect():
        raw, key = (r["text"] or "").encode(), str(r["doc_id"]).encode()
        want[r["doc_id"]] = (len(raw) + 8, zlib.crc32(raw), descend(key, 24), descend(key, 25))
    rows = queries.op4_hash_tree_sharding(spark, DATA).collect()
    assert {r["doc_id"]: (r["size"], r["text_crc32"], r["shard"], r["grown_shard"]) for r in rows} == want and len(rows) == docs.count()


# --- byte-level BPE


def test_bpe_equals_tiktoken():
    tiktoken = pytest.importorskip("tiktoken")
    vocabulary = bpe._tools(RANKS, PATTERN).vocabulary
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})
    rng = random.Random(5)
    texts = ["", " ", "  a  b", "<|endoftext|>"] + ["".join(rng.choice("abcdeo  th\n\t.,'s123é漢\x1c \x85🙂ñ") for _ in range(rng.randint(0, 70))) for _ in range(1500)]
    some = [t.decode("utf-8", "ignore") for t in rng.sample(vocabulary.tokens, 4000)]
    for sep in ("", " ", "\n", "  "):
        texts += [sep.join(some[i : i + 5]) for i in range(0, len(some), 5)]
    texts.append("x" * 300 + " " + "y-" * 300 + " " * 200)
    encoder = bpe._tools(RANKS, PATTERN)
    want = [library.encode_ordinary(text) for text in texts]
    for _ in range(2):  # the second time from memory
        ids, counts = encoder.encode(pa.array([*texts, None]))
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [*want, []]
        assert encoder.decode(ids, counts).to_pylist() == [*[t.encode() for t in texts], b""]
    assert all(bpe.encode_text(t, RANKS, PATTERN).tolist() == w for t, w in list(zip(texts, want, strict=True))[:300])
    assert all(vocabulary.encode_piece(t.encode()) == library.encode_ordinary(t) for t in some if len(regex.findall(PATTERN, t)) == 1)


def test_bpe_forgets_segments_in_bounds():
    from textloom.llm.segments import SegmentEncoder

    calls = []

    def lengths(pieces):
        calls.append(len(pieces))
        return np.arange(len(pieces), dtype=np.int32), np.ones(len(pieces), np.int64)

    encoder = SegmentEncoder(regex.compile(PATTERN), lengths, 3)
    for batch in (["a b b a a b", "c c"], ["d d e e f f", None], ["x x", " x x"], [""]):
        ids, counts = encoder.encode(pa.array(batch, pa.string()))
        assert counts.tolist() == [len(regex.findall(PATTERN, t or "")) for t in batch] and len(encoder.known) <= 3 and len(ids) == counts.sum()


def test_bpe_query_equals_tiktoken(spark, docs):
    tiktoken = pytest.importorskip("tiktoken")
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe._tools(RANKS, PATTERN).vocabulary.ranks, special_tokens={})
    want = {}
    for r in docs.collect():
        ids = library.encode_ordinary(r["text"] or "")
        want[r["doc_id"]] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest())
    assert {r[0]: tuple(r)[1:] for r in queries.op5_prefix_bpe(spark, DATA).collect()} == want


def test_pair_rule_and_tables():
    vocabulary = bpe._tools(RANKS, PATTERN).vocabulary
    rng = random.Random(6)
    for _ in range(3000):
        a, b = rng.randrange(256, 50256), rng.randrange(50256)
        assert vocabulary.pair(a, b) == (vocabulary.merged(vocabulary.tokens[a] + vocabulary.tokens[b]) == [a, b])
    for _ in range(200):
        piece = bytes(rng.choice(b"abcth e") for _ in range(rng.randint(0, 40)))
        table = bpe.PrefixTable(vocabulary)
        for i in range(len(piece)):
            table.append(piece[i : i + 1])
            assert table.ids() == vocabulary.merged(piece[: i + 1])


def test_edit_recomputes_near_it():
    vocabulary = bpe._tools(RANKS, PATTERN).vocabulary
    rng = random.Random(7)
    text = bytes(rng.choice(b"thenaoris ") for _ in range(4000))
    table = bpe.PrefixTable(vocabulary, text)
    done = table.replace(2000, 2003, b"xyzzy")
    fresh = bpe.PrefixTable(vocabulary, text[:2000] + b"xyzzy" + text[2003:])
    assert table.last == fresh.last and table.piece == fresh.piece and done < 1000


def test_bpe_edges(odd, none):
    rows = bpe.encode(odd, RANKS, PATTERN, decoded_col="decoded").collect()
    assert all(bytes(r["decoded"]) == (r["text"] or "").encode() for r in rows) and len(rows) == len(ODD)
    assert bpe.decode(bpe.encode(none, RANKS, PATTERN), RANKS).count() == 0
    with pytest.raises(ValueError):
        bpe._tools(RANKS, PATTERN).vocabulary.decode([99999999])
    with pytest.raises(ValueError):
        bpe._tools(RANKS, PATTERN).decode(np.array([99999999]), np.array([1]))


# --- token files


def test_token_files(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(TOKENIZERS.path("byte_bpe_50k.json"))
    texts = sorted((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{DATA}/documents.parquet").collect())
    start, want = 0, {}
    for i, t in texts:
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 2]
        want[i] = (start, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes()))
        start += len(ids)
    assert {r[0]: tuple(r)[1:] for r in queries.op8_token_files(spark, DATA).collect()} == want


def test_token_files_added_tokens_in_text():
    from tokenizers import Tokenizer

    path = TOKENIZERS.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    mark = next(t.content for t in tokenizer.get_added_tokens_decoder().values())
    texts = [f"a{mark}b", "plain words", f" {mark}  {mark} end ", "", mark, mark[:-1], f"x {mark[:3]}{mark}\n"]
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    for _ in range(2):  # the second time from memory
        ids, counts = token_files.encode_texts(pa.array([*texts, None]), path, PATTERN)
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [*want, []]


def test_token_file_format(spark, odd, none, tmp_path):
    import pyarrow.parquet as pq

    path = TOKENIZERS.path("byte_bpe_50k.json")
    token_files.write(odd, str(tmp_path / "t"), path, PATTERN, 2, parts=2)
    part = pq.ParquetFile(next(p for p in sorted((tmp_path / "t").iterdir()) if p.suffix == ".parquet" and pq.ParquetFile(p).metadata.num_rows))
    column = part.metadata.row_group(0).column(part.metadata.num_columns - 1)
    assert column.has_offset_index and "DELTA_BINARY_PACKED" in column.encodings and not any("DICT" in e for e in column.encodings)
    rows = token_files.read(spark, str(tmp_path / "t")).collect()
    assert len(rows) == len(ODD) and next(r for r in rows if r["doc_id"] == 1)["tokens"] == [2] and next(r for r in rows if r["doc_id"] is None)["start"] == 0
    token_files.write(none, str(tmp_path / "e"), path, PATTERN, 2, parts=2)
    assert token_files.read(spark, str(tmp_path / "e"), tokens=False).count() == 0


# --- benchmark passages


def brute_windows(items, size=10):
    out = {}
    for i, words in items:
        k = min(size, len(words))
        for j in range(len(words) - k + 1) if words else ():
            out.setdefault(tuple(words[j : j + k]), set()).add(i)
    return out


def test_fm_index_against_brute_force():
    rng = random.Random(8)
    for _ in range(60):
        symbols = np.array([rng.randrange(4) for _ in range(rng.randint(1, 60))] + [0])
        index = decontam.FMIndex(symbols, 4, sample=3)
        phrase = [rng.randint(1, 3) for _ in range(rng.randint(1, 3))]
        low, high = index.search(np.array([phrase]), np.array([len(phrase)]))
        got = sorted(index.locate(np.arange(low[0], high[0])).tolist())
        assert got == [i for i in range(len(symbols) - len(phrase) + 1) if symbols[i : i + len(phrase)].tolist() == phrase]


def test_decontamination_against_brute_force(spark):
    words = lambda x: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (x or "").translate({c: c + 32 for c in range(65, 91)}))
    items = [(str(r["item_id"]), words(r["text"])) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    windows = brute_windows(items)
    want = {}
    for r in spark.read.parquet(f"{DATA}/documents.parquet").collect():
        own = words(r["text"])
        hit, ids = set(), set()
        for k in {len(w) for w in windows}:
            for j in range(len(own) - k + 1):
                if found := windows.get(tuple(own[j : j + k])):
                    hit.update(range(j, j + k))
                    ids |= found
        want[r["doc_id"]] = (len(own), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit))
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op3_fm_decontamination(spark, DATA).collect()}
    assert got == want and any(v[-1] for v in want.values())


def test_decontamination_against_sql(spark):
    import duckdb

    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    want = sorted(tuple(r) for r in con.execute(queries.OP3_SQL).fetchall())
    assert sorted(tuple(r) for r in queries.op3_fm_decontamination(spark, DATA).collect()) == want and any(r[-1] for r in want)


def test_decontamination_edges(spark, odd, none):
    items = spark.createDataFrame([(1, "THE A"), (1, "null id"), (2, None), (3, "..."), (None, "long words long")], "item_id long, text string")
    for block_bytes in (1 << 20, 4):  # in one pass, and an item a pass
        rows = {r["doc_id"]: r for r in decontam.find(odd, items, block_bytes=block_bytes).collect()}
        assert rows[3]["items"] == ["1"] and rows[3]["spans"] == [[0, 2]] and rows[None]["items"] == ["1"] and rows[4]["items"] == [""] and rows[4]["spans"] == [[0, 59999]]
        assert rows[1]["n_words"] == 0 and rows[2]["spans"] == []
        cut = {r["doc_id"]: r["cut"] for r in decontam.find(odd, items, block_bytes=block_bytes, cut_col="cut").collect()}
        assert cut[None] == "\n here" and cut[3] == "\n" and cut[1] is None and cut[2] == ""
    left = {r["doc_id"]: r["text"] for r in decontam.remove(decontam.find(odd, items)).collect()}
    assert left[None] == "\n here" and left[3] == "\n" and left[1] is None
    assert decontam.find(none, items).count() == 0
    assert decontam.find(odd, items.limit(0)).filter("size(spans) > 0").count() == 0


# --- near copies


def brute_components(rows, width, num, den):
    sets = {}
    for i, text in rows:
        w = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(sets)
    for x in range(len(ids)):
        for y in range(x):
            a, b = sets[ids[x]], sets[ids[y]]
            both = len(a & b)
            if a and den * both >= num * (len(a) + len(b) - both):
                p, q = sorted((root(ids[x]), root(ids[y])))
                label[q] = p
    return {i: (len(sets[i]), root(i)) for i in sets}


@pytest.mark.parametrize("block", [4096, 3])
def test_jaccard_join_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rng = random.Random(9)
    rows = [(1, None), (2, ""), (3, "one two"), (4, "ONE two"), (5, "two one")]
    for base in range(6):
        words = [rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(30, 90))]
        for _ in range(8):
            words = [rng.choice("xyz") if rng.random() < 0.01 else w for w in words]
            rows.append((10 + len(rows), " ".join(words)))
    rng.shuffle(rows)
    want = brute_components(rows, 3, 80, 100)
    found = jaccard_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), width=3, num=80)
    assert {r[0]: (r[1], r[2]) for r in found.collect()} == want


def test_jaccard_join_without_broadcasts(spark, monkeypatch):
    """What may be broadcast is small, and shuffles with hubs apart give the same."""
    assert jaccard_join.BROADCAST_ROWS * 80 <= 16 << 20
    monkeypatch.setattr(jaccard_join, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(jaccard_join, "HUB_LEAST", 6)
    monkeypatch.setattr(jaccard_join, "FEW_EDGES", 0)
    rng = random.Random(5)
    # Pairs inside a base are near or not; the bases share a beginning, so regions stay open.
    begin, rows = [rng.choice("abcd") for _ in range(12)], [(1, None), (2, "one two")]
    for base in range(5):
        words = begin + [rng.choice("efghijkl") for _ in range(40)]
        for _ in range(9):
            words = [rng.choice("xyz") if rng.random() < 0.02 else w for w in words]
            rows.append((10 + len(rows), " ".join(words)))
    want = brute_components(rows, 3, 80, 100)
    found = jaccard_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), width=3, num=80)
    assert {r[0]: (r[1], r[2]) for r in found.collect()} == want


@pytest.mark.parametrize("least", [1000, 3])
def test_components_with_hubs(spark, monkeypatch, least):
    monkeypatch.setattr(jaccard_join, "HUB_LEAST", least)
    monkeypatch.setattr(jaccard_join, "HUB_PARTS", 8)
    rng = random.Random(6)
    edges = [(0, i) for i in range(1, 40)] + [(i, i + 1) for i in range(100, 130)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    label = {i: i for e in edges for i in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {r["id"]: r["component"] for r in jaccard_join.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: k for i, k in label.items() if any(a != b and i in (a, b) for a, b in edges)}


@pytest.mark.parametrize("few", [0, 50_000])
def test_components_of_few_and_many_edges(spark, monkeypatch, few):
    monkeypatch.setattr(jaccard_join, "FEW_EDGES", few)
    monkeypatch.setattr(jaccard_join, "HUB_LEAST", 3)
    edges = [(1, 7), (7, 9), (4, 3), (3, 4), (5, 5), (20, 9), (30, 31)]
    got = {r["id"]: r["component"] for r in jaccard_join.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 7: 1, 9: 1, 20: 1, 3: 3, 4: 3, 30: 30, 31: 30}


def test_jaccard_query(spark, docs, none):
    want = brute_components([(r["doc_id"], r["text"]) for r in docs.collect()], 4, 85, 100)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.op9_pivot_jaccard(spark, DATA).collect()} == want
    assert jaccard_join.jaccard_join(none).count() == 0


def test_jaccard_join_gives_a_pair_out_once(spark, monkeypatch):
    """Sets of similarity 0.5 to 0.8 share many regions; they meet in these, and are one row, or a few, and not one for each region."""
    rng = random.Random(11)
    rows = []
    for base in range(4):
        words = [rng.choice("abcdefghijkl") * rng.randint(1, 3) for _ in range(600)]
        for _ in range(6):
            rows.append((len(rows), " ".join(rng.choice("xyz") if rng.random() < 0.025 else w for w in words)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    counts = []
    group_by = type(frame).groupBy

    def spied(self, *cols):
        if cols == ("a", "b"):
            counts.append((self.count(), self.select("a", "b").distinct().count()))
        return group_by(self, *cols)

    monkeypatch.setattr(type(frame), "groupBy", spied)
    found = {r[0]: (r[1], r[2]) for r in jaccard_join.jaccard_join(frame, width=3, num=80).collect()}
    assert found == brute_components(rows, 3, 80, 100)
    (made, pairs), *_ = counts
    assert pairs >= 10 and made <= 4 * pairs, counts


@pytest.mark.parametrize("broadcast", [200_000, 0])
def test_jaccard_join_of_a_large_group_of_near_copies(spark, monkeypatch, broadcast):
    """Most copies are near to few of the others, so one pivot ties few of them; pairs that meet don't grow with the square of the group."""
    monkeypatch.setattr(jaccard_join, "BROADCAST_ROWS", broadcast)
    monkeypatch.setattr(jaccard_join, "HUB_LEAST", 100)
    rng = random.Random(13)
    words = [rng.choice("abcdefghijkl") * rng.randint(1, 6) for _ in range(150)]
    rows = [(7 * i, " ".join(rng.choice("uvwxyz") * 3 + str(rng.randrange(99)) if rng.random() < 0.02 else w for w in words)) for i in range(300)]
    rows += [(10_000 + i, f"{i} other words {i * i} of no copy {i} at all") for i in range(20)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    counts = []
    group_by = type(frame).groupBy

    def spied(self, *cols):
        if cols == ("a", "b"):
            counts.append(self.count())
        return group_by(self, *cols)

    monkeypatch.setattr(type(frame), "groupBy", spied)
    found = {r[0]: (r[1], r[2]) for r in jaccard_join.jaccard_join(frame, width=5, num=80).collect()}
    assert found == brute_components(rows, 5, 80, 100)
    assert counts[0] <= 10 * len(rows), counts


@pytest.mark.parametrize(("flush", "together"), [(7, 5), (20_000, 5), (7, 16_384)])
def test_jaccard_join_in_parts(spark, monkeypatch, flush, together):
    """Groups of regions that go on over calls, or are dealt to several tasks, give the same."""
    monkeypatch.setattr(jaccard_join, "FLUSH", flush)
    monkeypatch.setattr(jaccard_join, "TOGETHER", together)
    rng = random.Random(12)
    rows = []
    for base in range(4):
        words = [rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(60)]
        for _ in range(8):
            rows.append((len(rows), " ".join(rng.choice("xyz") if rng.random() < 0.03 else w for w in words)))
    found = jaccard_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), width=3, num=80)
    assert {r[0]: (r[1], r[2]) for r in found.collect()} == brute_components(rows, 3, 80, 100)


def test_jaccard_ranks_in_full_buckets(spark, monkeypatch):
    """A shingle of many documents ranks behind those of one also where every bucket holds some."""
    monkeypatch.setattr(jaccard_join, "BUCKET_BITS", 14)
    rng = random.Random(13)
    texts = [" ".join(["this", "stands", "in", "many", *(str(rng.randrange(10**9)) for _ in range(400))]) for _ in range(400)]
    common = jaccard_join.shingle_sets(["this stands in many"], 4)[0][0]
    texts += ["this stands in many"] * 20
    texts = texts[:12] + [t.partition("many ")[2] for t in texts[12:400]] + texts[400:]
    classes = jaccard_join._sketch(spark.createDataFrame([(t,) for t in texts], "text string"), 4)
    assert classes[int(common) >> 50] > np.median(classes)


def test_jaccard_null_and_repeated_ids(odd):
    rows = jaccard_join.jaccard_join(odd).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in rows if r["doc_id"]) == [(1, 1), (2, 2), (3, 3), (3, 3), (4, 4), (5, 3)]
    assert [tuple(r) for r in rows if r["doc_id"] is None] == [(None, 1, None)]


# --- language model


def test_lm_base_and_gain(spark, docs, none, odd):
    rows = {r["doc_id"]: r for r in queries.op1_maxent_lm(spark, DATA).collect()}
    tokens = {r["doc_id"]: [*(r["text"] or "").translate({c: c + 32 for c in range(65, 91)}).encode().split(), b""] for r in docs.collect()}
    counts = collections.Counter(w for i, own in tokens.items() if zlib.crc32(str(i).encode()) % 10 for w in own)
    n, v = sum(counts.values()), len(counts)
    for i, own in tokens.items():
        r = rows[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(w in counts for w in own), n)
        assert r["base_score"] == pytest.approx(sum(np.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own))
    held = [r for r in rows.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert maxent_lm.score(none, none).count() == 0
    assert {r["n_tokens"] for r in maxent_lm.score(odd, none).collect() if r["doc_id"] == 1} == {1}
    assert maxent_lm.score(odd, odd).count() == len(ODD)


def test_lm_learns_from_every_document(spark):
    """A word pair that only documents outside the former draw of 6000 hold counts."""
    ids = spark.range(9000).select(F.col("id").alias("doc_id"), (F.pmod(F.xxhash64("id", F.lit("fit")), F.lit(1 << 30)) / F.lit(float(1 << 30)) < 6000 / 9000).alias("drawn"))
    train = ids.select("doc_id", F.when(F.col("drawn"), F.lit("a b a b a b a b")).otherwise(F.lit("c d c d c d c d")).alias("text"))
    asked = spark.createDataFrame([(1, "a b a b a b a b"), (2, "c d c d c d c d")], "doc_id long, text string")
    found = {r["doc_id"]: r["score"] for r in maxent_lm.score(asked, train).collect()}
    assert found[2] > 9 * np.log10(0.5)
    assert found[1] > 9 * np.log10(0.5)


def test_lm_grows_with_tokens():
    assert [maxent_lm.table_bits(n) for n in (0, 1 << 22, 1 << 24, 1 << 26, 1 << 32)] == [19, 19, 20, 21, 24]
    assert [maxent_lm.leaves_of(n) for n in (0, 1 << 22, 1 << 25, 1 << 31)] == [1 << 16, 1 << 16, 1 << 17, 1 << 19]
    assert [maxent_lm.nodes_of(n) for n in (0, 1 << 25, 1 << 31)] == [256, 512, 2048]


def small_lexicon(weighted=1000):
    classes = ["ab", "cd", "xy", "", None]
    near = np.array([[9, 8, 0, 1, 0], [8, 9, 1, 1, 0], [0, 1, 9, 1, 3], [1, 1, 1, 0, 0], [0, 0, 3, 0, 1]], float)
    words = [("ab", 0, 40), ("zab", 0, 7), ("cd", 1, 30), ("xy", 2, 20), ("qxy", 2, 9), ("", 3, 12), ("other", 4, 5)]
    return maxent_lm.build(classes, near, [(6, 3), (0, 0), (2, 2), (0, 0), (11, 9)], words, weighted)


@pytest.mark.parametrize("weighted", [1000, 4, 0])
def test_lm_probabilities_sum_to_one(weighted):
    lexicon = small_lexicon(weighted)
    model = maxent_lm.Weights(12)
    texts = pa.array(["ab cd xy qxy rab", "other cd ab new", None, "  xy  ab\n"])
    types, ids, lengths = maxent_lm.tokens_of(texts)
    assert lengths.tolist() == [6, 5, 1, 3] and [types[i] for i in ids[-3:]] == ["xy", "ab", ""]
    codes = maxent_lm.features(ids, maxent_lm._places(lengths), types)
    start = model.log_probs(lexicon, codes, lexicon.leaves(types)[ids])
    # Before training a leaf of one word has its share of the counts.
    total = 40 + 7 + 30 + 20 + 9 + 12 + 5 + 7 * 0.1 + 6 + 0.4 + 0.1 + 2 + 0.3 + 0.1 + 11 + 1.0
    at = [types[i] for i in ids].index("qxy")
    assert start[at] == pytest.approx(np.log(9.1 / total))
    for _ in range(20):
        model.learn(lexicon, codes, lexicon.leaves(types)[ids], np.random.default_rng(0))
    leaves = np.arange(len(lexicon.size))
    # A leaf of rarer words holds its words' smoothed counts, which its constant divides by its mass.
    inner = {0: 6 + 0.4, 1: 0.1, 2: 2 + 0.3, 3: 0.1, 4: 11 + 1.0}
    mass = np.array([inner.get(k, 1.0) for k in leaves])
    total = sum(np.exp(model.log_probs(lexicon, codes, np.full(len(ids), k))) * mass[k] for k in leaves)
    assert np.allclose(total, 1, atol=1e-5)
    learned = model.log_probs(lexicon, codes, lexicon.leaves(types)[ids])
    assert learned.sum() > start.sum() if weighted else np.allclose(learned, start)


def test_lm_weights_against_plain_sums():
    """Log probabilities from the definition: a product over the path of one logistic model for each node."""
    lexicon, rng = small_lexicon(), np.random.default_rng(4)
    model = maxent_lm.Weights(12, rng.normal(size=1 << 12).astype(np.float32))
    types, ids, lengths = maxent_lm.tokens_of(pa.array(["ab cd xy qxy rab other", "cd ab new"]))
    leaf = lexicon.leaves(types)[ids]
    codes = maxent_lm.features(ids, maxent_lm._places(lengths), types)
    got = model.log_probs(lexicon, codes, leaf)
    for t, k in enumerate(leaf.tolist()):
        want = lexicon.constant[k]
        for s in range(lexicon.at[k], lexicon.at[k] + lexicon.size[k]):
            node = int(lexicon.nodes[s])
            z = float(lexicon.bias[node])
            for code in codes[:, t].tolist():
                slot = ((code + node * 0x9E3779B97F4A7C15) * 0xD6E8FEB86659FD93 % 2**64) >> 52
                z += float(model.weights[slot])
            want -= np.log1p(np.exp(-z if lexicon.right[s] else z))
        assert got[t] == pytest.approx(want, rel=1e-5)


def token_by_token(model, lexicon, codes, leaf):
    """Log probabilities by the nodes of 4096 tokens at once, in the order of the text."""
    out = lexicon.constant[leaf]
    for at in range(0, len(leaf), 4096):
        own = slice(at, at + 4096)
        size = lexicon.size[leaf[own]]
        step = np.repeat(lexicon.at[leaf[own]] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        z = lexicon.bias[lexicon.nodes[step]]
        for code in codes[:, own]:
            slot = (lexicon.nodes[step].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.repeat(code, size)) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - model.bits)
            z += model.weights[slot.view(np.int64)]
        np.negative(z, out=z, where=lexicon.right[step])
        out[own] -= np.add.reduceat(np.logaddexp(0, z.astype(np.float64)), np.cumsum(size) - size)
    return out


@pytest.fixture(scope="module")
def large_lexicon():
    rng = np.random.default_rng(6)
    classes = [f"{k:02x}" for k in range(255)] + [None]
    words = [(f"{k * 7919:x}", k % 255, 100_000 // (k + 1) + 1) for k in range(20_000)]
    lexicon = maxent_lm.build(classes, rng.random((256, 256)), [(10, 5)] * 256, words, 256)
    leaf = 256 + np.minimum(rng.zipf(1.2, 200_000) - 1, 19_999)
    codes = maxent_lm.mix64(np.stack([np.minimum(rng.zipf(1.2, 200_000), 1 << most) * 4 + k for k, most in enumerate((16, 17, 10, 10))]))
    return lexicon, codes, leaf


def test_lm_scores_with_less_work_than_token_by_token(large_lexicon):
    lexicon, codes, leaf = large_lexicon
    model = maxent_lm.Weights(21, np.random.default_rng(7).normal(size=1 << 21).astype(np.float32))

    def seconds(run):
        began = time.process_time()
        run()
        return time.process_time() - began

    def looked_up():
        """Only the slots and weights of all tokens in the order of the text, without their probabilities."""
        for at in range(0, len(leaf), 4096):
            own = slice(at, at + 4096)
            size = lexicon.size[leaf[own]]
            step = np.repeat(lexicon.at[leaf[own]] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            node = lexicon.nodes[step].astype(np.uint64)
            z = lexicon.bias[lexicon.nodes[step]]
            for code in codes[:, own]:
                z += model.weights[model_slots(code, size, node)]

    def model_slots(code, size, node):
        mixed = node * np.uint64(0x9E3779B97F4A7C15)
        mixed += np.repeat(code, size)
        mixed *= np.uint64(0xD6E8FEB86659FD93)
        mixed >>= np.uint64(43)
        return mixed.view(np.int64)

    model.log_probs(lexicon, codes, leaf)
    pairs = [(seconds(lambda: model.log_probs(lexicon, codes, leaf)), seconds(looked_up)) for _ in range(5)]
    assert min(a for a, _ in pairs) < 0.95 * min(b for _, b in pairs)


@pytest.mark.parametrize("scale", [1, 60])
def test_lm_large_model_against_token_by_token(large_lexicon, scale):
    """Also where a product of 1 + e^z is too large a number, and after learning."""
    lexicon, codes, leaf = large_lexicon
    model = maxent_lm.Weights(21, (np.random.default_rng(7).normal(size=1 << 21) * scale).astype(np.float32))
    assert np.allclose(model.log_probs(lexicon, codes, leaf), token_by_token(model, lexicon, codes, leaf), rtol=1e-4)
    model.learn(lexicon, codes[:, :10_000], leaf[:10_000], np.random.default_rng(0))
    assert np.allclose(model.log_probs(lexicon, codes, leaf), token_by_token(model, lexicon, codes, leaf), rtol=1e-4)


def test_lm_codes_and_counts_of_odd_words(spark):
    texts = ["  ab  CD\x0b é日本 x", None, "", " ", "aé日本𝄞 𝄞 é q" + "w" * 100 + " Ä\u3000b\n", "ab"]
    types, ids, lengths = maxent_lm.tokens_of(pa.array(texts))
    raw = [w.encode() for w in types]
    codes = maxent_lm.features(ids, maxent_lm._places(lengths), types)
    place = maxent_lm._places(lengths)
    for t, i in enumerate(place.tolist()):
        one, two, three = ([raw[ids[t - k]]] if i >= k else [] for k in (1, 2, 3))
        word = zlib.crc32(one[0]) if one else 1
        tails = [zlib.crc32(x[0][-3:], 7) if x else 2 for x in (one, two, three)]
        want = [word * 8 + 1, (tails[0] * 0x9E3779B1 + tails[1]) * 8 + 2, tails[1] * 8 + 3, tails[2] * 8 + 4]
        assert codes[:, t].tolist() == maxent_lm.mix64(np.array([x % 2**64 for x in want], np.uint64)).tolist()
    kinds, of, sizes = maxent_lm.endings_of(pa.array(texts))
    assert [kinds[i] for i in of] == [types[i][-2:] for i in ids] and sizes.tolist() == lengths.tolist()
    rows = maxent_lm.count_words(spark.createDataFrame([(x,) for x in texts], "text string"), "text").collect()
    assert {r["word"]: r["c"] for r in rows} == collections.Counter(types[i] for i in ids)


def test_lm_average_weighs_by_curvature():
    parts = [maxent_lm._chunk(0, np.array(w, np.float32), np.array(m, np.float32)) for w, m in (([1, 2, 5], [1, 0, 4]), ([3, 4, 1], [3, 0, 0]))]
    found = maxent_lm._average(pa.Table.from_batches(parts))
    assert np.frombuffer(found["weights"][0].as_py(), "<f2").tolist() == [2.5, 0, 5]
    assert np.allclose(np.square(np.frombuffer(found["met"][0].as_py(), "<f2")), [2, 0, 2], rtol=1e-2)


def test_lm_score_against_parts(spark, docs):
    """The whole score recomputed on the driver from the trained tree and weights."""
    kept = docs.select("doc_id", "text")
    train = kept.filter("doc_id % 3 > 0")
    seen = {}
    build, fit = maxent_lm.learn_tree, maxent_lm.fit
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(maxent_lm, "learn_tree", lambda *a: seen.setdefault("lexicon", build(*a)))
        patch.setattr(maxent_lm, "fit", lambda *a: seen.setdefault("model", fit(*a)))
        patch.setattr(maxent_lm, "LEAF_BITS", 6)
        rows = {r["doc_id"]: r for r in maxent_lm.score(kept, train).collect()}
    words = lambda x: [*(x or "").translate({c: c + 32 for c in range(65, 91)}).encode().split(), b""]
    counts = collections.Counter(w.decode() for r in train.collect() for w in words(r["text"]))
    lexicon, model = seen["lexicon"], seen["model"]
    assert 33 < len(lexicon.words) <= 65 and model.weights.any()
    # Leaves are the most frequent words.
    assert min(counts[w] for w in lexicon.words if w) > max(counts[w] for w in counts if w not in lexicon.words)
    for r in kept.collect():
        own = [w.decode() for w in words(r["text"])]
        leaf = lexicon.leaves(own)
        codes = maxent_lm.features(np.arange(len(own)), np.arange(len(own)), own)
        want = model.log_probs(lexicon, codes, leaf).sum() + sum(np.log(counts[w] + 0.1) for w, k in zip(own, leaf.tolist(), strict=True) if lexicon.rare[k])
        assert rows[r["doc_id"]]["score"] == pytest.approx(want / np.log(10), rel=1e-4)


# --- classifiers


def test_language_held_out(spark, docs, odd, none):
    rows = {r["doc_id"]: r for r in queries.op7_crf_language(spark, "/root/testdata/sf0.01").collect()}
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    held = [i for i, r in rows.items() if r["held_out"]]
    assert sum(rows[i]["lang_pred"] == truth[i] for i in held) > 0.97 * len(held)
    model = langid.fit(docs)
    got = {r["doc_id"]: r for r in langid.predict(odd, model, words_col="words").collect()}
    assert got[1]["lang_pred"] == got[2]["lang_pred"] == "und" and got[3]["lang_pred"] == "en" and 0 <= got[4]["score"] <= 1 and len(got[4]["words"]) == 60000
    assert langid.predict(none, langid.fit(none)).count() == 0
    assert {r["lang_pred"] for r in langid.predict(odd, langid.fit(none)).collect()} == {"und"}


def test_forward_backward_against_enumeration():
    import itertools

    rng = np.random.default_rng(1)
    emit, move, start = rng.normal(size=(7, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    post, *_ = langid.marginals(emit, np.array([4, 3]), move, start)
    for a, b in ((0, 4), (4, 7)):
        want = np.zeros((b - a, 3))
        for path in itertools.product(range(3), repeat=b - a):
            p = np.exp(start[path[0]] + sum(emit[a + t, y] for t, y in enumerate(path)) + sum(move[x, y] for x, y in zip(path, path[1:], strict=False)))
            for t, y in enumerate(path):
                want[t, y] += p
        assert np.allclose(post[a:b], want / want.sum(axis=1, keepdims=True))


def test_blocks_of_long_texts_give_the_same_posteriors():
    rng = np.random.default_rng(3)
    lengths = np.array([1, 70, 3, 16, 17, 200, 5])
    emit, move, start = rng.normal(size=(lengths.sum(), 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    assert np.allclose(langid.posteriors(emit, lengths, move, start, block=16), langid.marginals(emit, lengths, move, start)[0])


def test_several_switches_in_a_text(docs):
    model = langid.fit(docs)
    rng, by = random.Random(3), collections.defaultdict(list)
    for r in spark_rows("/root/testdata/sf0.01/documents.parquet"):
        if r["lang"] and r["doc_id"] % 7 == 3:
            by[r["lang"]] += langid.words_of(r["text"] or "")[:200]
    for run, least in ((2, 0.9), (4, 0.93), (8, 0.95)):
        words, gold = [], []
        for _ in range(1200 // run):
            lang = rng.choice(model.languages)
            at = rng.randrange(len(by[lang]) - run)
            words += by[lang][at : at + run]
            gold += [lang] * run
        _, post, _ = langid.label_texts([" ".join(words)], model)
        assert np.mean([model.languages[k] == y for k, y in zip(post.argmax(axis=1), gold, strict=True)]) > least


def test_code_switched_words(docs):
    model = langid.fit(docs)
    by = {r["lang"]: r["text"] for r in docs.filter("n_chars > 1500 AND n_chars < 4000").collect()}
    words = {k: langid.words_of(v)[:80] for k, v in by.items()}
    (_,), post, _ = langid.label_texts([" ".join(words["en"] + words["de"])], model)
    labels = [model.languages[k] for k in post.argmax(axis=1)]
    assert labels[:80].count("en") > 70 and labels[80:].count("de") > 70


def test_toxicity_held_out(spark, odd, none):
    rows = {r["doc_id"]: r for r in queries.op6_weak_toxicity(spark, "/root/testdata/sf0.01").collect()}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    told = [(labels[i], r["predicted"]) for i, r in rows.items() if r["held_out"] and i in labels]
    assert sum(y == 0 and p == 1 for y, p in told) <= 0.02 * len(told)
    assert sum(y == 1 and p == 1 for y, p in told) >= 0.4 * sum(y for y, _ in told)
    labelled = spark.createDataFrame([], "doc_id long, toxic int")
    assert {round(r["score"], 6) for r in toxicity.score(odd, toxicity.fit(odd, labelled)).collect()} == {0.5}
    assert toxicity.score(none, toxicity.Model()).count() == 0


def test_label_model_discounts_copies_of_a_voter():
    rng = np.random.default_rng(2)
    y = (rng.random(3000) < 0.4).astype(float)
    vote = lambda right: np.where(rng.random(3000) < right, y, 1 - y)
    weak = vote(0.6)
    fired = np.column_stack([vote(0.85), vote(0.85), vote(0.85), *[weak] * 8])
    post, rates, divisor = toxicity.label_model(fired, y, np.arange(3000) < 600)
    assert ((post > 0.5) == y).mean() > 0.9 and divisor[3:].min() > 4 > divisor[:3].max() and rates[0, 1] == pytest.approx(0.85, abs=0.05)


# --- main text


def test_main_text_of_generated_pages():
    model = html_text.fit(html_text.labelled_pages(250))
    right = total = 0
    for page, main in html_text.labelled_pages(80, seed=99):
        blocks = html_text.blocks_of(page)
        kept = {id(b) for b in model.main_blocks(blocks)}
        right += sum((id(b) in kept) == (b.text in main) for b in blocks)
        total += len(blocks)
    assert right / total > 0.97


def test_main_text_query(spark):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    for r in queries.op10_crf_main_text(spark, DATA).collect():
        inner = re.search(r"<article>(.*)</article>", pages[r["page_id"]], re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1|h2|div|ul|li)\b[^>]*>", inner)]
        assert r["text"] == "\n".join(x for x in parts if x) and r["n_chars"] == len(r["text"])


def test_blocks_of_broken_pages():
    texts = lambda x: [b.text for b in html_text.blocks_of(x)]
    assert texts("<p>a<p><b>b<br>c<p>d &amp; &eacute;&nbsp;x</p>") == ["a", "b c", "d & é x"]
    assert texts("<ul><li>a<li>b<ul><li>c</ul></ul><script>x < y</script>t<!-- q > --> u") == ["a", "b", "c", "t u"]
    assert texts("plain 1 < 2 text") == ["plain 1 < 2 text"] and texts("<p title='a>b'>c</p") == ["c</p"]
    assert texts("") == [] and texts("<script>never closed <p>x</p>") == []


def test_blocks_of_is_linear_on_hostile_pages():
    import time

    pages = [
        "<a" * 500_000,
        "<div>x" * 100_000,
        "<b>" * 50_000 + "x<h1>t</h1>" * 50_000,
        "<p><div>" + "<b>" * 50_000 + "<h1>x</h1></i>" * 50_000,
        '<a "' * 200_000 + ">",
        "<b>" * 50_000 + "</i>" * 50_000,
    ]
    for page in pages:
        began = time.process_time()
        html_text.blocks_of(page)
        assert time.process_time() - began < 20, page[:20]


@pytest.fixture(scope="module")
def page_model():
    return html_text.fit(html_text.labelled_pages())


def test_main_text_of_pages_from_elsewhere(page_model):
    said = "The committee met on Tuesday to discuss the plan for the harbour. Nobody was surprised by the outcome, and few had read the report."
    texts = [f"{said} Part {i}." for i in range(4)]
    article = "".join(f"<p>{p}</p>" for p in texts)
    menu = '<ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li><li><a href="/c">About us</a></li></ul>'
    title = "<h1>Harbour plan</h1>"
    pages = [
        f"<html><body><div>{menu}</div><div>{title}{article}</div><div>© 2020 Harbour News</div></body></html>",
        f'<html><body><div class=topnav>{menu}</div><div role="main">{title}{article}</div><footer>© 2020</footer></body></html>',
        f'<html><body><nav>{menu}</nav><main class="sidebar-layout">{title}{article}</main><footer>© 2020</footer></body></html>',
        f'<article>{title}{article}<section id="responses"><h2>3 responses</h2><p>I think this is a very bad plan indeed, said nobody ever.</p></section></article>',
        f"<html><body><table><tr><td>{menu}</td><td>{title}{article}</td></tr></table></body></html>",
        f"<body><div id=header><a href=/>Site</a></div><div id=content>{title}{article}</div><div id=sidebar><h3>Popular</h3>{menu}</div>",
        f"<body><div class='cookie-banner'><p>We use cookies to improve your experience.</p><button>OK</button></div><div class='post'>{title}{article}</div>",
    ]
    for page in pages:
        assert [b.text for b in page_model.main_blocks(html_text.blocks_of(page))] == ["Harbour plan", *texts], page[:120]


def test_viterbi_against_enumeration(page_model):
    import itertools

    blocks = html_text.blocks_of("<nav><a href=x>Menu</a></nav><article><h1>Title</h1><p>Some words stand here.</p><div class=ad>Buy it</div><p>x</p></article><footer>© x</footer>")
    scores = [[float(page_model.weights[html_text.hashed(html_text.features(b)), y].sum()) for y in (0, 1)] for b in blocks]
    best = max(
        itertools.product((0, 1), repeat=len(blocks)),
        key=lambda ys: sum(s[y] for s, y in zip(scores, ys, strict=True)) + sum(page_model.transitions[a, b] for a, b in zip(ys, ys[1:], strict=False)),
    )
    kept = {id(b) for b in page_model.main_blocks(blocks)}
    assert [int(id(b) in kept) for b in blocks] == list(best)


def test_main_text_edges(spark):
    pages = spark.createDataFrame([(1, None, "t"), (2, "", "t"), (3, "<nav><a href=x>m</a></nav>", "t"), (4, "<article>" + "<p>word word word.</p>" * 20000, "t")], "page_id long, html string, text string")
    model = html_text.fit(html_text.labelled_pages(250))
    rows = {r["page_id"]: r["text"] for r in html_text.extract(pages, model).collect()}
    assert rows[1] == rows[2] == rows[3] == "" and rows[4].count("\n") == 19999
    assert html_text.extract(pages.limit(0), model).count() == 0


# --- pipeline


def test_pipeline_against_its_parts(spark, tmp_path):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == before.columns
        rows, old = {r["doc_id"]: r for r in docs.collect()}, {r["doc_id"]: r["text"] for r in before.collect()}
        if name == "exact_dedup":
            assert sorted(r["text"] for r in rows.values()) == sorted(set(old.values()))
        if name == "jaccard_join":
            want = brute_components(list(old.items()), 5, 80, 100)
            assert set(rows) == {i for i, (_, root) in want.items() if i == root}
        if name == "decontamination":
            assert decontam.find(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).filter("size(spans) > 0").count() == 0
            assert all(r["n_chars"] == len(r["text"]) for r in rows.values())
    last = {r["doc_id"]: r for r in corpus_pipeline.run(spark, sf).collect()}
    assert set(last) == set(rows) and all(r["exact"] for r in last.values())


def test_pipeline_keeps_mixed_and_short_texts(spark, docs):
    import corpus_pipeline

    by_lang = {}
    for r in docs.filter("text is not null and lang is not null").orderBy("doc_id").collect():
        by_lang.setdefault(r["lang"], []).append(r["text"].split()[:40])
    mixed = [" ".join(w for own in part for w in own) for part in zip(*by_lang.values(), strict=False)]
    words = sorted({w for own in by_lang.values() for text in own[:5] for w in text if w.isalpha()})
    rows = [(i, text, None, None, len(text)) for i, text in enumerate([*mixed, *words, "123 456"])]
    asked = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"] for r in corpus_pipeline.language(spark, asked, DATA).collect()}
    assert kept == set(range(len(rows) - 1))


def test_pipeline_stages_on_odd_rows(spark):
    import corpus_pipeline

    words = "the of and is to "
    rows = [(1, None, "en", "a", 0), (2, "", "en", "a", 0), (None, words, None, None, None), (4, words * 5000, "en", "a", 1), (5, "123 456", "en", "b", 7), (6, "one", "en", "b", 3), (6, "one", "en", "b", 3)]
    names = ["_lang", "_score", "n_words", "spans", "items", "_sha", "_key", "keep_id", "id", "component_id"]
    odd = spark.createDataFrame([(*r, *["x"] * len(names)) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names))
    want = [{None, 4, 6}, {None, 4, 6}, {None, 4, 6}, {None, 4, 6}, {None, 4, 6}]
    counts = [4, 3, 3, 3, 3]
    docs = odd
    for (name, stage), ids, n in zip(corpus_pipeline.STAGES, want, counts, strict=True):
        found = stage(spark, docs, "/root/testdata/sf0.001")
        got = found.collect()
        assert {r["doc_id"] for r in got} == ids and len(got) == n, name
        empty = stage(spark, odd.limit(0), "/root/testdata/sf0.001")
        assert empty.count() == 0, name
        if name != "bpe":
            assert found.columns == odd.columns and all(r[x] == "x" for r in got for x in names), name
            docs = spark.createDataFrame(got, odd.schema)


def test_pipeline_hands_small_batches_to_workers(spark):
    """Spark's limit is 10000 rows, whatever their length; the stages' limit is in bytes, and a smaller one stays."""
    import corpus_pipeline

    key = "spark.sql.execution.arrow.maxBytesPerBatch"

    def largest(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    try:
        docs = spark.createDataFrame([(i, "word " * 1000) for i in range(4000)], "doc_id long, text string").coalesce(1)
        corpus_pipeline.tokens(spark, docs, DATA)
        sizes = [r["n"] for r in docs.mapInArrow(largest, "n long").collect()]
        assert len(sizes) > 1 and max(sizes) <= (4 << 20) + 10_000
        spark.conf.set(key, "100000")
        corpus_pipeline.tokens(spark, docs, DATA)
        assert spark.conf.get(key) == "100000"
    finally:
        spark.conf.unset(key)
