"""Edge rows of the operators, and values known from published results."""

import math
import os
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from textloom.functions import text as tx
from textloom.operators import chunk, clean, joins, judge, report, sample, similarity
from textloom.plans import queries
from textloom.sources import io


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("content", "expected"),
    [
        ("Art. 5 (Revogado)", "revoked_or_vetoed"),
        ("um dois três quatro cinco", "too_short"),
        ("a b c\nd e f\ng h i\nj k l", "fragmented_table"),
        ("Fonte: " + "x " * 19, "table_artifact_or_short"),
        ("Fonte: " + "x " * 39, "ok"),
    ],
)
def test_quality_flag(spark, content, expected):
    assert one(spark, tx.quality_flag(F.lit(content))) == expected


def test_pure_content(spark):
    assert not one(spark, tx.is_pure_content(F.lit("palavra " * 44)))
    assert one(spark, tx.is_pure_content(F.lit("palavra " * 45)))
    assert not one(spark, tx.is_pure_content(F.lit("palavra " * 45 + "Tabela 3")))


def test_table_artifact_reason_takes_null_excerpts(spark):
    none = F.lit(None).cast("array<string>")
    assert one(spark, tx.table_artifact_reason(F.lit("Veja a tabela 2.1 acima"), F.lit("r"), none, none)) == "Citação explícita na pergunta: 'tabela 2.1'"
    assert one(spark, tx.table_artifact_reason(F.lit("q"), F.lit("r"), none, F.array(F.lit("Fonte: x")))).startswith("Micro-chunk")


@pytest.mark.parametrize(("p", "r", "f1"), [("a a b", "a b b", 2 / 3), ("", "a", 0.0), (None, "a", 0.0), ("x y", "x y", 1.0)])
def test_token_f1(spark, p, r, f1):
    lit = lambda x: F.lit(x).cast("string")
    assert one(spark, tx.token_f1(lit(p), lit(r))) == pytest.approx(f1)
    assert one(spark, tx.token_f1(lit(r), lit(p))) == pytest.approx(f1)


def test_rouge_l_against_brute_force(spark):
    import random
    import re

    rng = random.Random(3)
    rows = [(" ".join(rng.choice("abcd") for _ in range(rng.randint(0, 9))), " ".join(rng.choice("abcd") for _ in range(rng.randint(0, 9)))) for _ in range(60)]

    def brute(p, r):
        p, r = (re.sub("[^a-z0-9]+", " ", x.lower()).split() for x in (p, r))
        best = [[0] * (len(r) + 1) for _ in range(len(p) + 1)]
        for i, x in enumerate(p):
            for j, y in enumerate(r):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        return 2 * best[-1][-1] / (len(p) + len(r)) if best[-1][-1] else 0.0

    found = spark.createDataFrame(rows, "p string, r string").select("p", "r", tx.rouge_l(F.col("p"), F.col("r")).alias("f")).collect()
    assert all(x["f"] == pytest.approx(brute(x["p"], x["r"])) for x in found)


@pytest.mark.parametrize(
    ("raw", "clear"),
    [("<think>x</think> y", "y"), ("<think>x", "x"), (None, ""), ("Thinking Process: a\n\nResposta: sim", "sim"), ("The user is asking\n\n**Final Answer:** z", "z"), (" plain ", "plain")],
)
def test_strip_reasoning(spark, raw, clear):
    assert one(spark, tx.strip_reasoning(F.lit(raw).cast("string"))) == clear


def test_extract_json(spark):
    assert one(spark, tx.extract_json(F.lit('x ```json\n{"a": 1}\n``` {y}'))) == '{"a": 1}'
    assert one(spark, tx.extract_json(F.lit('x {"a": {"b": 1}} y'))) == '{"a": {"b": 1}}'


@pytest.mark.parametrize(("n", "size"), [(70, 35), (100, 41), (48, 29), (1, 1), (0, 1)])
def test_cochran(spark, n, size):
    assert one(spark, tx.cochran(F.lit(n))) == size


def test_quotas_under_cap():
    given = sample.quotas_of({"a": 30, "b": 30, "c": 30}, 76)
    assert given == {"a": 25, "b": 25, "c": 25}
    assert sample.quotas_of({}, 5) == {}
    # Worked by hand: cap 5; first round 5, then round(10 * 12 / 60) = 2 and so on; the rest in further rounds.
    assert sample.quotas_of({"a": 40, "b": 10, "c": 5, "d": 5}, 20) == {"a": 5, "b": 5, "c": 5, "d": 5}
    # Round 1: b round(3 / 12 * 6) = 2, c round(9 / 12 * 4) = 3; round 2: b max(1, round(1 / 7 * 1)) = 1.
    assert sample.quotas_of({"a": 0, "b": 3, "c": 9}, 6, 0.9) == {"a": 0, "b": 3, "c": 3}
    assert sample.quotas_of({"a": 2, "b": 1}, 10) == {"a": 2, "b": 1}
    many = {f"d{i}": i + 1 for i in range(20)}
    got = sample.quotas_of(many, 60)
    assert sum(got.values()) <= 60 and all(got[k] <= many[k] and got[k] <= 15 for k in many)


def test_exact_dup_flags(spark):
    items = spark.createDataFrame([(1, "Q "), (2, "q"), (3, "\tq"), (4, "r")], "ord long, pergunta string")
    assert {r["ord"]: r["n_flags"] for r in clean.exact_dup_flags(items).collect()} == {1: 2, 2: 1, 3: 1, 4: 0}


def test_near_dedup_chain(spark):
    pairs = spark.createDataFrame([(1, "a", "b", 0.9), (2, "b", "c", 0.9)], "ord long, id_a string, id_b string, similarity double")
    assert [tuple(r) for r in clean.near_dedup(pairs).collect()] == [("b", "a")]
    lost = spark.createDataFrame([("a",)], "id string")
    assert sorted(tuple(r) for r in clean.near_dedup(pairs, lost).collect()) == [("a", "b"), ("c", "b")]


def test_near_dedup_takes_pairs_in_order(spark):
    import random

    rng = random.Random(8)
    rows = [(k, f"i{rng.randrange(30)}", f"i{rng.randrange(30)}") for k in range(60)]
    gone = {}
    for _, a, b in rows:
        if a not in gone:
            gone[b] = a
    got = clean.near_dedup(spark.createDataFrame(rows, "ord long, id_a string, id_b string"))
    assert {r["id"]: r["because"] for r in got.collect()} == gone


def test_running_numbers_over_ranges(spark):
    rows = spark.range(5000).select(F.col("id"), F.when(F.col("id") % 5 > 0, "a").when(F.col("id") % 5 == 0, F.lit(None)).alias("s"), F.lit("x").alias("t"), (-F.col("id")).alias("o"))
    got = {r["id"]: r["n"] for r in sample.running_number(rows.repartition(7), ["s", "t"], ["o"], "n").collect()}
    for keep in (lambda i: i % 5 > 0, lambda i: i % 5 == 0):
        ids = sorted(filter(keep, range(5000)), reverse=True)
        assert [got[i] for i in ids] == list(range(1, len(ids) + 1))


def test_cosine_pairs_against_all_pairs(spark):
    import random

    rng = random.Random(4)
    vectors = []
    for i in range(40):
        own = {t: rng.random() for t in rng.sample("abcdefghijklmnop", rng.randint(1, 9))}
        size = sum(x * x for x in own.values()) ** 0.5
        vectors += [("b", i, t, x / size) for t, x in own.items()]
    frame = spark.createDataFrame(vectors, "block string, id long, term string, weight double")
    by = {}
    for _, i, t, x in vectors:
        by.setdefault(i, {})[t] = x
    dots = {(i, j): sum(x * by[j].get(t, 0) for t, x in by[i].items()) for i in by for j in by if i < j}
    for least in (0.2, 0.6, 0.9):
        got = {(r["id_a"], r["id_b"]): r["similarity"] for r in similarity.cosine_pairs(frame, least).collect()}
        want = {k: v for k, v in dots.items() if v >= least}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_clean_partition_precedence(spark):
    row = spark.createDataFrame([(1, True, True, True)], "id long, single_source boolean, exact_dup boolean, table boolean")
    assert clean.clean_partition(row).first()["motivo_remocao"] == "single_source"


def test_components_and_split(spark):
    edges = spark.createDataFrame([(1, "a"), (2, "a"), (2, "b"), (3, "b"), (4, "c")], "item long, node string")
    labels = sample.components(edges)
    assert {r["item"]: r["component"] for r in labels.collect()} == {1: 1, 2: 1, 3: 1, 4: 4}
    keyed = sample.component_keys(labels).withColumn("stratum", F.lit("s")).withColumn("n", F.col("members"))
    first = spark.createDataFrame([(9, "k", "s", 1)], "component long, component_key string, stratum string, n long")
    assert sample.split_components(spark, first).first()["side"] == "train"
    assert sample.split_components(spark, keyed).count() == 2


def test_components_of_string_ids(spark):
    edges = [(f"legis_fac_{i:04d}", f"n{(i + k) % 40}") for i in range(40) for k in (0, 20)] + [(f"x{i}", "hub") for i in range(50)]
    found = sample.components(spark.createDataFrame(edges, "item string, node string"), hot_parts=4)
    want = {f"legis_fac_{i:04d}": f"legis_fac_{i % 20:04d}" for i in range(40)} | {f"x{i}": "x0" for i in range(50)}
    assert {r["item"]: r["component"] for r in found.collect()} == want
    keyed = sample.component_keys(found).withColumns({"stratum": F.lit("s"), "n": F.col("members")})
    assert {r["side"] for r in sample.split_components(spark, keyed).collect()} == {"train", "test"}
    assert sample.components(spark.createDataFrame([], "item string, node string")).count() == 0


def test_split_stays_near_the_ratio(spark):
    """Against the squared distances themselves, side by side."""
    import random

    rng = random.Random(5)
    rows = [(i, f"{i:03d}", s, rng.randint(1, 9)) for i in range(60) for s in "abc" if rng.random() < 0.6]
    sides = {r["component"]: r["side"] for r in sample.split_components(spark, spark.createDataFrame(rows, "component long, component_key string, stratum string, n long"), 0.7, 3).collect()}
    own = {}
    for i, k, s, n in rows:
        own.setdefault((k, i), {})[s] = n
    order = sorted(own)
    random.Random(3).shuffle(order)
    seen, train = dict.fromkeys("abc", 0), dict.fromkeys("abc", 0)
    for key in order:
        cost = [sum(n * ((train[s] + n * x) / (seen[s] + n) - 0.7) ** 2 for s, n in own[key].items()) for x in (1, 0)]
        assert sides[key[1]] == ("train" if cost[0] <= cost[1] else "test")
        for s, n in own[key].items():
            seen[s] += n
            train[s] += n * (sides[key[1]] == "train")


def test_long_chain_of_components(spark):
    edges = spark.createDataFrame([(i, f"n{i + k}") for i in range(60) for k in (0, 1)], "item long, node string")
    assert {r["component"] for r in sample.components(edges).collect()} == {0}


def test_leak_is_refused(spark):
    both = spark.createDataFrame([(["c1"],)], "chunk_ids array<string>")
    with pytest.raises(ValueError, match="c1"):
        joins.assert_no_leak(both, both)


def test_pending_and_failures(spark):
    items = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    done = spark.createDataFrame([(1, None), (2, "boom")], "id long, error string")
    assert {r[0] for r in joins.pending(items, done, ["id"]).collect()} == {3}
    assert {r[0] for r in joins.pending(items, done, ["id"], retry_failed=True).collect()} == {2, 3}


def test_review_reasons(spark):
    def reason(a, b):
        pair = F.create_map(F.lit("command"), F.lit(a).cast("string"), F.lit("phi"), F.lit(b).cast("string"))
        return one(spark, tx.verdict_reason(pair))

    assert reason("rejeitar", "rejeitar") == "ambos_rejeitar"
    assert reason("rejeitar", "aprovado") == "discordancia"
    assert reason("revisar", "revisar") == "rejeitado_command"
    assert reason("aprovado", "aprovado") == "outros"


def test_priority_queue(spark):
    rows = [(1, "a", "aprovado"), (1, "b", None), (2, "a", "aprovado"), (2, "b", "rejeitar"), (3, "a", "revisar"), (3, "b", "revisar")]
    v = spark.createDataFrame(rows, "id long, judge string, veredito string")
    assert {r[0] for r in judge.priority_queue(v).collect()} == {2, 3}


def test_vote_is_taken_back(spark):
    rows = [("k", "up", 1, 1), ("k", "up", 2, 2), ("m", "up", 1, 3), ("m", "down", 2, 4)]
    events = spark.createDataFrame(rows, "key string, action string, ts long, seq long")
    assert {r["key"]: r["vote"] for r in judge.fold_votes(events).collect()} == {"k": None, "m": "down"}


def test_missing_scores_do_not_count(spark):
    rows = [("m", 1.0, 1.0, None, None, 1.0), ("m", 0.0, 0.0, None, None, None), ("m", 0.5, 0.5, None, None, 2.0)]
    scored = spark.createDataFrame(rows, "model string, rouge_l double, token_f1 double, bertscore_f1 double, bertscore_chunked boolean, nota_j double")
    got = report.summary(scored.withColumn("aluc_j", F.lit(None).cast("boolean")), ["model"], ("j",)).first()
    assert (got["nota_media_j"], got["windowed"], got["bertscore_f1"], got["n_itens"]) == (1.5, None, None, 3)


def test_published_gains(spark):
    means = spark.createDataFrame([("ft", 0.3499), ("base", 0.1218), ("mistral", 0.2130), ("zero", 0.0)], "model string, r double")
    gains = {r["model"]: r["gain_pct"] for r in report.relative_gain(means, "ft", "r").collect()}
    assert gains == {"base": 187.3, "mistral": 64.3, "zero": None}


def chunked(spark, text, normative, compat=True, name="lei.md"):
    docs = spark.createDataFrame([("d", name, text)], "domain string, name string, text string")
    return sorted(chunk.chunk_documents(docs, F.lit(normative), compat).collect(), key=lambda r: r["chunk_index"])


def test_article_chunks(spark):
    rows = chunked(spark, "Lei\nCAPÍTULO I\nArt. 1 x\n\n\nmais\nCAPÍTULO II\nArt. 2 y", True)
    assert [r["hierarchy"] for r in rows] == [["CAPÍTULO II"], ["CAPÍTULO II"]]
    assert rows[0]["content"] == "Art. 1 x\n\nmais" and rows[0]["section_title"] == "Lei" and rows[0]["chunk_id"] == "d_lei_chunk_0001"
    strict = chunked(spark, "CAPÍTULO I\nArt. 1 x\nCAPÍTULO II\nArt. 2 y", True, compat=False)
    assert [r["hierarchy"] for r in strict] == [["CAPÍTULO I"], ["CAPÍTULO II"]]


def test_heading_paths(spark):
    text = "\n".join(
        ["Preâmbulo", "§ 1 não", "LIVRO I", "TÍTULO I", "Art. 1", "CAPÍTULO I", "Art. 2º - a", "Seção I", "Art. 3", "SUBSEÇÃO II", "Art. 4", "", "CAPÍTULO II", "", "fim", "Art. 5", "PARTE GERAL", "Art. 6"]
    )
    rows = chunked(spark, text, True, compat=False)
    assert [r["hierarchy"] for r in rows] == [
        ["LIVRO I", "TÍTULO I"],
        ["LIVRO I", "TÍTULO I", "CAPÍTULO I"],
        ["TÍTULO I", "CAPÍTULO I", "Seção I"],  # a section drops the book
        ["TÍTULO I", "CAPÍTULO I", "SUBSEÇÃO II"],  # and a section in small letters isn't known again
        ["TÍTULO I", "CAPÍTULO II"],
        ["PARTE GERAL"],
    ]
    assert [r["section_title"] for r in rows] == ["Preâmbulo", *[""] * 5] and [r["article_ref"] for r in rows][:2] == ["Art. 1", "Art. 2º -"]
    assert rows[3]["content"] == "Art. 4\n\nfim" and rows[0]["chunk_type"] == "normative_article"
    late = chunked(spark, text, True)
    assert [r["hierarchy"] for r in late] == [r["hierarchy"] for r in rows][1:] + [["PARTE GERAL"]]


def test_items_stand_in_for_articles(spark):
    rows = chunked(spark, "Edital\n1.1 Do objeto\nlinha\n1.2 do prazo\n1.2.1 Da vigência", True)
    assert [(r["chunk_type"], r["article_ref"], r["content"]) for r in rows] == [
        ("normative_item", "1.1 Do objeto", "1.1 Do objeto\nlinha\n1.2 do prazo"),
        ("normative_item", "1.2.1 Da vigência", "1.2.1 Da vigência"),
    ]
    assert chunked(spark, "nothing\nopens", True) == []


def test_documents_are_told_by_name(spark):
    docs = spark.createDataFrame([("d", "x/lgpd.md", "Art. 1 x"), ("d", "y.md", "Art. 1 x")], "domain string, name string, text string")
    assert sorted(r["chunk_type"] for r in chunk.chunk_documents(docs).collect()) == ["normative_article", "text"]


def test_section_chunks_and_packing(spark):
    rows = chunked(spark, "# Um\ntexto\n| a | b |\n|-|-|\n## Página 3\nfim", False)
    assert [(r["chunk_type"], r["section_title"]) for r in rows] == [("text", "Um"), ("table", "Um"), ("text", "Um")] and rows[1]["has_table"]
    doc = spark.createDataFrame([(1, "\n".join(["x" * 1000] * 3)), (2, None), (3, "")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["content"].count("x")) for r in chunk.pack_lines(doc).collect()) == [(1, 1000), (1, 2000)]


def test_sections_tables_and_packs(spark):
    text = "antes\n\n| a | b |\n| c | d |\n\n| e | f |\nx\n## Dois\n# Três\n" + "\n".join(["y" * 1000] * 3) + "\n|z|\n|sem"
    rows = chunked(spark, text, False)
    assert [(r["chunk_type"], r["section_title"], r["content"][:9], r["char_count"]) for r in rows] == [
        ("text", None, "antes", 5),
        ("table", None, "| a | b |", 19),
        ("table", None, "| e | f |", 9),
        ("text", None, "x", 1),
        ("text", "Três", "y" * 9, 2002),
        ("text", "Três", "y" * 9, 1000),
        ("table", "Três", "|z|", 3),
        ("text", "Três", "|sem", 4),
    ]
    assert [r["hierarchy"] for r in rows][3:5] == [[], ["Três"]]


def test_failing_document_is_its_own_row(spark):
    docs = spark.createDataFrame([("d", "a.md", "Art. 1 x"), ("d", "b.md", None)], "domain string, name string, text string")
    rows = chunk.chunk_documents(docs, F.lit(True)).collect()
    assert [bool(r["error"]) for r in sorted(rows, key=lambda r: r["source_document"])] == [False, True]


def test_jsonl_and_map(spark, tmp_path):
    path = str(tmp_path / "x")
    io.write_jsonl(spark.createDataFrame([(1, None), (2, "é")], "id long, t string").coalesce(1), path)
    part = next(p for p in os.listdir(path) if p.endswith(".json"))
    assert open(os.path.join(path, part), encoding="utf-8").read() == '{"id":1,"t":null}\n{"id":2,"t":"é"}\n'
    assert io.read_jsonl(spark, path, "id long, t string").count() == 2
    assert io.read_jsonl(spark, str(tmp_path / "none"), "id long").count() == 0
    (tmp_path / "m.json").write_text('{"a": {"action": "drop"}}')
    assert io.read_json_map(spark, str(tmp_path / "m.json"), "struct<action:string>").first()["value"]["action"] == "drop"
    (tmp_path / "bad.jsonl").write_text('{"id": 1}\n{oops\n')
    with pytest.raises(Exception):  # noqa: B017
        io.read_jsonl(spark, str(tmp_path / "bad.jsonl"), "id long").collect()


def test_compaction_of_appends(spark, tmp_path):
    path, schema = str(tmp_path / "rows"), "id long, v string"
    for k in range(5):
        assert io.compact_jsonl(spark, path, schema, "id") is False
        io.append_jsonl(spark.createDataFrame([(k, "x"), (0, None if k else "first")], schema).coalesce(1), path)
    assert io.compact_jsonl(spark, path, schema, "id") is True
    assert sorted(tuple(r) for r in io.read_jsonl(spark, path, schema).collect()) == [(0, "x"), (1, "x"), (2, "x"), (3, "x"), (4, "x")]
    assert io.compact_jsonl(spark, path, schema, "id") is False and sorted(os.listdir(tmp_path)) == ["rows"]


def test_markdown_reports(spark, tmp_path):
    (tmp_path / "leis").mkdir()
    (tmp_path / "leis" / "a.md").write_text("Art. 1 x")
    docs = io.read_markdown(spark, {"leis": str(tmp_path / "leis"), "nada": str(tmp_path / "nada")})
    assert [tuple(r) for r in docs.collect()] == [("leis", "a.md", "Art. 1 x")]
    df = spark.createDataFrame([("a_b", 1.5)], "m string, v double")
    assert "| a_b | 1.5 |" in io.markdown_table(df) and "a\\_b & 1.5" in io.latex_table(df)
    io.write_csv_bom(df, str(tmp_path / "r.csv"))
    assert open(tmp_path / "r.csv", "rb").read().startswith(b"\xef\xbb\xbf")


def test_scorer_retries(spark):
    def make():
        seen = {}

        def call(row):
            seen[row["id"]] = seen.get(row["id"], 0) + 1
            if row["id"] == 2 or seen[row["id"]] < 2:
                raise RuntimeError("busy")
            return {"answer": "ok"}

        return call

    rows = io.score(spark.createDataFrame([(1,), (2,)], "id long"), make, "answer string", retries=2, pause_s=0.0).collect()
    assert {r["id"]: (r["answer"], bool(r["error"])) for r in rows} == {1: ("ok", False), 2: (None, True)}


def test_resume_stream(spark, tmp_path):
    from textloom.streaming.resume import resume_stream

    (tmp_path / "in").mkdir()
    args = (spark, str(tmp_path / "in"), "id long", str(tmp_path / "out"), "id long, y long", ["id"], lambda df: df.withColumn("y", F.col("id") * 2), str(tmp_path / "cp"))
    (tmp_path / "in" / "1.json").write_text('{"id": 1}\n{"id": 2}\n')
    resume_stream(*args).awaitTermination()
    (tmp_path / "in" / "2.json").write_text('{"id": 2}\n{"id": 3}\n')
    resume_stream(*args).awaitTermination()
    assert sorted(r["id"] for r in io.read_jsonl(spark, str(tmp_path / "out"), "id long, y long").collect()) == [1, 2, 3]


def test_windows():
    assert [len(w) for w in io.windows(list(range(1000)))] == [450, 450, 100] and io.windows([]) == [[]]
    assert math.isclose(sum(map(len, io.windows("x" * 451))), 451)


def test_renumber_beyond_four_digits(spark):
    items = spark.range(12346).select("id", F.col("id").alias("ord"), F.lit("d").alias("dominio"), F.lit("n").alias("nivel_dificuldade"))
    found = {r["id"]: r["new_id"] for r in clean.renumber(items).collect()}
    assert (found[0], found[1233], found[12344]) == ("d_n_0001", "d_n_1234", "d_n_12345")
    assert len(set(found.values())) == 12346


def test_near_dedup_over_the_whole_vocabulary(spark):
    """Against brute force; the smallest table has fewer than 4096 terms, so all of them count."""
    data, counts = "/root/testdata/sf0.001", {}
    for r in spark.read.parquet(f"{data}/benchmark.parquet").collect():
        words = re.findall(queries.TOKEN, r["text"].lower())
        counts[r["item_id"]] = Counter([*words, *map(" ".join, zip(words, words[1:], strict=False))])
    df = Counter(t for own in counts.values() for t in own)
    assert 400 < len(df) <= 4096
    vectors = {}
    for i, own in counts.items():
        raw = {t: n * (math.log((1 + len(counts)) / (1 + df[t])) + 1) for t, n in own.items()}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        vectors[i] = {t: x / norm for t, x in raw.items()}
    gone = {}
    for a in sorted(vectors):
        for b in sorted(vectors):
            if a < b and sum(x * vectors[b].get(t, 0) for t, x in vectors[a].items()) >= 0.2:
                if a not in gone:
                    gone[b] = a
                else:
                    gone.setdefault(a, b)
    assert {r["id"]: r["because"] for r in queries.QUERIES["near_dedup"](spark, data).collect()} == gone


@pytest.mark.parametrize("block", [2048, 4])
def test_window_max_cosine_against_all_pairs(spark, monkeypatch, tmp_path, block):
    """Odd rows too: zeros, nulls, other lengths, repeated ids, a group of one; zeros were a division by zero before."""
    monkeypatch.setattr(similarity, "BLOCK", block)
    rng = random.Random(3)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(5)], i % 2) for i in range(23)]
    rows += [(4, [1.0, 0.0, 0.0, 0.0, 0.0], 0), (30, None, 0), (31, [], 0), (32, [1.0, None, 0.0, 0.0, 0.0], 0), (33, [1.0, 2.0], 0), (33, [3.0], 0), (34, [1.0, 2.0], 0)]
    rows += [(40, [0.0, 0.0], 3), (41, [1.0, 0.0], 3), (42, [1.0], 4), (None, [1.0, 2.0], 0), (43, [1.0, 2.0], None)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")

    def cosine(x, y):
        if not x or not y or None in x or None in y or len(x) != len(y):
            return None
        norm = math.sqrt(sum(p * p for p in x) * sum(q * q for q in y))
        return sum(p * q for p, q in zip(x, y, strict=True)) / norm if norm else math.nan

    want = {}
    for i, x, k in rows:
        sims = [cosine(x, y) for j, y, m in rows if k == m and k is not None and i is not None and j is not None and i != j]
        if sims:
            want.setdefault(i, []).extend(sims)
    found = {r["id"]: (r["sim"], r["chunked"]) for r in queries.window_max_cosine(spark, str(tmp_path)).collect()}
    assert found.keys() == want.keys()
    for i, sims in want.items():
        real = [s for s in sims if s is not None]
        sim, chunked = found[i]
        assert chunked == (len(sims) > 1)
        if any(map(math.isnan, real)):
            assert math.isnan(sim)
        else:
            assert (sim is None) if not real else abs(sim - max(real)) < 6e-5
