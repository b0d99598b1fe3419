"""Every operator as a query on the driver's tables, with the same in SQL where SQL has it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import chunk, clean, joins, judge, report, sample, similarity
from . import views
from .views import ITEMS_SQL, JUDGED_SQL, SCORED_SQL, VERDICTS_SQL, items, judged, scored, table, verdicts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: White space as both engines' patterns take it, and a word in it.
S = r"[ \t\n\x0B\f\r]"
NS = r"[^ \t\n\x0B\f\r]+"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


# --- Predicates on texts ---------------------------------------------------------------------------------------------

STRIP_SQL = r"trim({0}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
WORDS_SQL = rf"len(regexp_extract_all(text, '{NS}'))"
LINES_SQL = f"len(list_filter(string_split(text, chr(10)), lambda x: {STRIP_SQL.format('x')} <> ''))"
FLAG_SQL = rf"""CASE WHEN regexp_matches(text, '(?i)\b(vetado|revogad[ao]s?)\b') AND {WORDS_SQL} < 15 THEN 'revoked_or_vetoed'
  WHEN {WORDS_SQL} < 6 THEN 'too_short' WHEN {LINES_SQL} >= 4 AND {WORDS_SQL} < 4 * {LINES_SQL} THEN 'fragmented_table'
  WHEN {WORDS_SQL} < 40 AND (contains(text, 'Licensed') OR contains(text, '|')) THEN 'table_artifact_or_short' ELSE 'ok' END"""
#: The driver's texts have these marks where the original corpus has captions.
MARKERS = ("Licensed", "|")


def _flag():
    return tx.quality_flag(F.col("text"), markers=MARKERS)


@query(f"SELECT doc_id, {FLAG_SQL} AS quality_flag FROM documents")
def quality_flag(spark, d):
    return docs(spark, d).select("doc_id", _flag().alias("quality_flag"))


@query(f"SELECT lang, {FLAG_SQL} AS quality_flag, count(*) AS n FROM documents GROUP BY ALL")
def quality_counts(spark, d):
    return docs(spark, d).groupBy("lang", _flag().alias("quality_flag")).agg(F.count(F.lit(1)).alias("n"))


@query(
    rf"""WITH t AS (SELECT doc_id, text, list_filter(list_transform(string_split(substr(text, 1, 350), chr(10)), lambda x: {STRIP_SQL.format('x')}), lambda x: x <> '') AS ls FROM documents)
SELECT doc_id, {WORDS_SQL} >= 45 AND NOT contains(text, '|---|') AND NOT contains(text, '| --- |') AND len(text) - len(replace(text, '|', '')) <= 3
  AND NOT contains(text, '...') AND NOT contains(text, 'rights') AND len(text) - len(replace(text, '@', '')) < 2
  AND NOT (len(ls) >= 6 AND len(list_filter(ls, lambda x: len(x) < 12)) > 0.6 * len(ls)) AS pure FROM t"""
)
def pure_content(spark, d):
    return docs(spark, d).select("doc_id", tx.is_pure_content(F.col("text"), ("...", "rights")).alias("pure"))


@query(
    f"""WITH {ITEMS_SQL}, x AS (SELECT id, regexp_extract(pergunta, '(?i)(what|explain) [a-z]+', 0) AS q, regexp_extract(resposta_referencia, '(?i)(what|explain) [a-z]+', 0) AS r FROM items)
SELECT id, CASE WHEN q <> '' THEN 'Citação explícita na pergunta: ''' || q || '''' WHEN r <> '' THEN 'Citação explícita na resposta: ''' || r || '''' END AS reason FROM x"""
)
def table_artifact_reason(spark, d):
    none = F.array().cast("array<string>")
    reason = tx.table_artifact_reason(F.col("pergunta"), F.col("resposta_referencia"), none, none, "(what|explain) [a-z]+")
    return items(spark, d).select("id", reason.alias("reason"))


@query(r"SELECT doc_id, len(regexp_extract_all(text, '[0-9]{3}-[0-9]{4}')) >= 2 OR len(regexp_extract_all(text, '(?m)^[A-Z][a-z]+\.$')) >= 3 AS ref_list FROM documents")
def reference_list(spark, d):
    return docs(spark, d).select("doc_id", tx.is_reference_list(F.col("text"), "[0-9]{3}-[0-9]{4}", r"(?m)^[A-Z][a-z]+\.$").alias("ref_list"))


@query(f"WITH {ITEMS_SQL} SELECT id, regexp_matches(pergunta, '(?i)(the|this) (and|of|is)') AS vague FROM items")
def vague_question(spark, d):
    return items(spark, d).select("id", tx.is_vague(F.col("pergunta"), "(the|this) (and|of|is)").alias("vague"))


@query(f"WITH {ITEMS_SQL} SELECT id, CASE WHEN nivel_dificuldade = 'aplicado' THEN len(chunk_ids) < 2 ELSE len(chunk_ids) <> 1 END AS mismatch FROM items")
def chunk_count_mismatch(spark, d):
    return items(spark, d).select("id", tx.chunk_count_mismatch(F.col("nivel_dificuldade"), F.col("chunk_ids")).alias("mismatch"))


@query(f"WITH {ITEMS_SQL} SELECT id, dominio, nivel_dificuldade FROM items WHERE dominio IN ('d0', 'd2') AND nivel_dificuldade IN ('factual', 'aplicado')")
def filter_in(spark, d):
    out = joins.filter_in(joins.filter_in(items(spark, d), "dominio", "d0, d2", trim=True), "nivel_dificuldade", "factual,aplicado")
    return out.select("id", "dominio", "nivel_dificuldade")


@query(f"WITH {SCORED_SQL} SELECT doc_id, model FROM scored WHERE coalesce(resposta_gerada, '') <> ''")
def nonempty(spark, d):
    return scored(spark, d).filter(F.coalesce("resposta_gerada", F.lit("")) != "").select("doc_id", "model")


@query("SELECT conv_id, list(text ORDER BY turn) AS contents, list(role ORDER BY turn) AS roles FROM conversations GROUP BY conv_id")
def project_nested(spark, d):
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    nested = table(spark, d, "conversations").groupBy("conv_id").agg(turns.alias("chunks"))
    return nested.select("conv_id", F.col("chunks.text").alias("contents"), F.col("chunks.role").alias("roles"))


@query(
    f"""WITH {ITEMS_SQL} SELECT id FROM items WHERE dominio = 'd1' AND list_contains(chunk_ids, 'c5')
  AND (contains(lower(pergunta), 'th') OR contains(lower(resposta_referencia), 'th') OR len(list_filter(chunk_ids, lambda c: contains(lower(c), 'th'))) > 0)"""
)
def facet_search(spark, d):
    return joins.facet_search(items(spark, d), {"dominio": "d1", "chunk_ids": "c5"}, "TH", ("pergunta", "resposta_referencia"), ("chunk_ids",)).select("id")


@query(f"WITH {SCORED_SQL}, {JUDGED_SQL} SELECT doc_id FROM judged WHERE coalesce(correto_phi, false) <> correto_command")
def consensus_filter(spark, d):
    return judge.consensus_filter(judged(spark, d), "disagree", "correto_phi", "correto_command").select("doc_id")


@query(
    f"""WITH {SCORED_SQL} SELECT doc_id, CASE WHEN rouge_l >= 0.3 THEN 'high' WHEN rouge_l >= 0.15 THEN 'mid' WHEN rouge_l IS NOT NULL THEN 'low' END AS rouge_band,
  CASE WHEN bertscore_f1 >= 0.65 THEN 'high' WHEN bertscore_f1 >= 0.5 THEN 'mid' WHEN bertscore_f1 IS NOT NULL THEN 'low' END AS bert_band FROM scored"""
)
def score_band(spark, d):
    return scored(spark, d).select("doc_id", tx.score_band(F.col("rouge_l"), "rouge").alias("rouge_band"), tx.score_band(F.col("bertscore_f1"), "bert").alias("bert_band"))


# --- Chunks ----------------------------------------------------------------------------------------------------------

LINE_SQL = f"""lines AS (SELECT doc_id, pos, {STRIP_SQL.format('line')} AS line
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents))"""
MARK = "^(The|Of|De|Der|La) "


@query(
    f"""WITH {LINE_SQL}, m AS (SELECT *, sum(CAST(regexp_matches(line, '{MARK}') AS INT)) OVER (PARTITION BY doc_id ORDER BY pos) AS part FROM lines WHERE line <> '')
SELECT doc_id, CAST(part AS BIGINT) AS part, string_agg(line, chr(10) ORDER BY pos) AS content FROM m WHERE part > 0 GROUP BY doc_id, part"""
)
def chunk_by_marker(spark, d):
    return chunk.chunk_by_marker(docs(spark, d), MARK)


@query(
    f"""WITH {LINE_SQL}, h AS (SELECT *, regexp_matches(line, '{MARK}') AS hd FROM lines WHERE line <> '' AND NOT regexp_matches(line, '^All ')),
m AS (SELECT *, sum(CAST(hd AS INT)) OVER (PARTITION BY doc_id ORDER BY pos) AS part FROM h)
SELECT m.doc_id, CAST(m.part AS BIGINT) AS part, any_value(s.line) AS section, string_agg(m.line, chr(10) || chr(10) ORDER BY m.pos) AS content
FROM m LEFT JOIN m s ON s.hd AND s.doc_id = m.doc_id AND s.part = m.part WHERE NOT m.hd GROUP BY m.doc_id, m.part"""
)
def chunk_by_header(spark, d):
    return chunk.chunk_by_header(docs(spark, d), MARK, "^All ")


@query(
    f"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '{NS}')) AS line, generate_subscripts(regexp_extract_all(text, '{NS}'), 1) AS pos FROM documents),
lines AS (SELECT doc_id, pos, CASE WHEN pos % 7 < 3 THEN '|' || line || '|' ELSE line END AS line FROM w),
t AS (SELECT *, starts_with(line, '|') AND contains(substr(line, 2), '|') AS tb FROM lines),
f AS (SELECT *, tb AND NOT coalesce(lag(tb) OVER (PARTITION BY doc_id ORDER BY pos), false) AS first FROM t),
m AS (SELECT *, sum(CAST(first AS INT)) OVER (PARTITION BY doc_id ORDER BY pos) AS block FROM f)
SELECT doc_id, CAST(block AS BIGINT) AS block, count(*) AS n_lines, string_agg(line, chr(10) ORDER BY pos) AS content FROM m WHERE tb GROUP BY doc_id, block"""
)
def table_blocks(spark, d):
    words = F.regexp_extract_all("text", F.lit(NS), F.lit(0))
    barred = F.transform(words, lambda w, i: F.when((i + 1) % 7 < 3, F.concat(F.lit("|"), w, F.lit("|"))).otherwise(w))
    return chunk.table_blocks(docs(spark, d).select("doc_id", F.array_join(barred, "\n").alias("text"))).select("doc_id", "block", "n_lines", "content")


@query(
    f"""SELECT doc_id, len(text) AS char_count, {WORDS_SQL} AS word_count, contains(text, '|') AND contains(text, '-|-') AS has_table,
  source || '_' || lang || '_chunk_' || lpad(CAST(doc_id % 10000 AS VARCHAR), 4, '0') AS chunk_id FROM documents"""
)
def chunk_stats(spark, d):
    out = chunk.with_chunk_stats(docs(spark, d), "text")
    name = F.concat(F.col("source"), F.lit("_"), F.col("lang"), F.lit("_chunk_"), F.lpad((F.col("doc_id") % 10000).cast("string"), 4, "0"))
    return out.select("doc_id", F.col("char_count").cast("long").alias("char_count"), F.col("word_count").cast("long").alias("word_count"), "has_table", name.alias("chunk_id"))


@query(
    f"""WITH c AS (SELECT source, len(text) AS a, {WORDS_SQL} AS b FROM documents)
SELECT f.source, count(c.source) AS n_chunks, round(coalesce(avg(a), 0), 2) AS avg_chars, round(coalesce(avg(b), 0), 2) AS avg_words
FROM (SELECT DISTINCT source FROM documents) f LEFT JOIN c USING (source) GROUP BY f.source"""
)
def chunk_report(spark, d):
    chunks = chunk.with_chunk_stats(docs(spark, d), "text")
    return chunk.chunk_report(docs(spark, d), chunks, "source")


#: Lines of documents with headings and article marks in set places.
HEADED_SQL = f"""{LINE_SQL}, x AS (SELECT doc_id, pos, CASE WHEN pos % 8 = 2 THEN 'TÍTULO I' WHEN pos % 8 = 4 THEN 'CAPÍTULO II' WHEN pos % 16 = 6 THEN 'SEÇÃO III'
  WHEN pos % 16 = 14 THEN 'SUBSEÇÃO I' WHEN pos % 32 = 0 THEN 'LIVRO I' WHEN pos % 32 = 16 THEN 'PARTE GERAL' WHEN pos % 8 = 3 OR pos % 8 = 5 THEN trim('Art. ' || pos || ' ' || line) ELSE line END AS x FROM lines),
k AS (SELECT *, CASE WHEN pos % 8 = 2 THEN 1 WHEN pos % 8 = 4 THEN 2 WHEN pos % 8 = 6 THEN 3 WHEN pos % 16 = 0 THEN 0 END AS rank, pos % 8 = 3 OR pos % 8 = 5 AS opens FROM x)"""


@query(
    f"""WITH {HEADED_SQL}, n AS (SELECT doc_id, max(pos) + 1 AS last FROM k GROUP BY doc_id),
h AS (SELECT a.doc_id, a.pos, a.x, coalesce(min(b.pos) FILTER (WHERE NOT CASE b.rank WHEN 0 THEN false WHEN 1 THEN a.rank = 0 WHEN 2 THEN a.rank < 2 ELSE a.rank = 2 OR a.rank = 1 OR a.x = 'PARTE GERAL' END), 1 << 30) AS until
  FROM k a LEFT JOIN k b ON b.doc_id = a.doc_id AND b.rank IS NOT NULL AND b.pos > a.pos WHERE a.rank IS NOT NULL GROUP BY ALL),
s AS (SELECT doc_id, pos, x, coalesce(lead(pos) OVER w, last) AS next, row_number() OVER w AS nth FROM k JOIN n USING (doc_id) WHERE opens WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
c AS (SELECT s.doc_id, s.nth, trim(regexp_replace(string_agg(k.x, chr(10) ORDER BY k.pos), '\n{{3,}}', chr(10) || chr(10), 'g'), chr(10)) AS content
  FROM s JOIN k ON k.doc_id = s.doc_id AND k.rank IS NULL AND k.pos >= s.pos AND k.pos < s.next GROUP BY ALL),
p AS (SELECT s.doc_id, s.nth, coalesce(list(h.x ORDER BY h.pos) FILTER (WHERE h.x IS NOT NULL), []) AS hierarchy FROM s LEFT JOIN h ON h.doc_id = s.doc_id AND h.pos < s.next AND h.until > s.next GROUP BY ALL),
t AS (SELECT doc_id, arg_max(x, pos) AS title FROM k WHERE pos = 1 AND x <> '' AND len(x) < 100 AND NOT regexp_matches(x, '^(§|[(]|I )') GROUP BY doc_id)
SELECT printf('d_%d_chunk_%04d', doc_id, nth) AS chunk_id, {STRIP_SQL.format("regexp_extract(x, '^Art[.] [0-9]+[A-Za-z0-9.ºª°-]*[ ]*[-–—.]?')")} AS article_ref, hierarchy,
  CASE WHEN nth = 1 THEN coalesce(title, '') ELSE '' END AS section_title, content FROM s JOIN c USING (doc_id, nth) JOIN p USING (doc_id, nth) LEFT JOIN t USING (doc_id)"""
)
def heading_hierarchy(spark, d):
    def headed(line, i):
        pos = i + 1
        article = F.trim(F.concat(F.lit("Art. "), pos.cast("string"), F.lit(" "), tx.strip(line)))
        return (
            F.when(pos % 8 == 2, "TÍTULO I").when(pos % 8 == 4, "CAPÍTULO II").when(pos % 16 == 6, "SEÇÃO III").when(pos % 16 == 14, "SUBSEÇÃO I")
            .when(pos % 32 == 0, "LIVRO I").when(pos % 32 == 16, "PARTE GERAL").when((pos % 8 == 3) | (pos % 8 == 5), article).otherwise(line)
        )

    text = F.array_join(F.transform(F.split("text", "\n"), headed), "\n")
    named = docs(spark, d).select(F.lit("d").alias("domain"), F.concat(F.col("doc_id").cast("string"), F.lit(".md")).alias("name"), text.alias("text"))
    return chunk.chunk_documents(named, F.lit(True)).select("chunk_id", "article_ref", "hierarchy", "section_title", "content")


@query(
    f"""WITH RECURSIVE {LINE_SQL}, l AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n, len(line) + 2 AS k FROM lines WHERE line <> ''),
p AS (SELECT doc_id, n, 0 AS part, k AS size, k FROM l WHERE n = 1 UNION ALL SELECT l.doc_id, l.n, p.part + CAST(p.size >= 1800 AS INT), CASE WHEN p.size >= 1800 THEN l.k ELSE p.size + l.k END, l.k
  FROM p JOIN l ON l.doc_id = p.doc_id AND l.n = p.n + 1)
SELECT doc_id, CAST(part AS BIGINT) AS part, CAST(sum(k) - 2 AS BIGINT) AS n FROM p GROUP BY doc_id, part"""
)
def pack_lines(spark, d):
    return chunk.pack_lines(docs(spark, d)).select("doc_id", F.col("part").cast("long").alias("part"), F.length("content").cast("long").alias("n"))


# --- Joins -----------------------------------------------------------------------------------------------------------


@query(f"WITH {ITEMS_SQL} SELECT i.id, coalesce(l.n, 0) AS n, l.n IS NOT NULL AS matched FROM items i LEFT JOIN (SELECT conv_id * 1000 AS id, max(turn) AS n FROM conversations GROUP BY conv_id) l ON l.id = i.id")
def left_backfill(spark, d):
    full = joins.last_wins(table(spark, d, "conversations").select((F.col("conv_id") * 1000).alias("id"), F.col("turn").alias("n"), "turn"), "id", "turn")
    return joins.backfill(items(spark, d).select("id"), full, "id", {"n": F.lit(0)}).select("id", "n", "matched")


@query("SELECT d.doc_id, coalesce(l.quality, -1) AS quality, coalesce(l.toxic, 0) AS toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def left_defaults(spark, d):
    out = joins.backfill(docs(spark, d).select("doc_id"), table(spark, d, "labels"), "doc_id", {"quality": F.lit(-1), "toxic": F.lit(0)})
    return out.select("doc_id", "quality", "toxic")


RENUMBER_SQL = "ids AS (SELECT id, dominio || '_' || nivel_dificuldade || '_' || lpad(CAST(row_number() OVER (PARTITION BY dominio, nivel_dificuldade ORDER BY ord) AS VARCHAR), 4, '0') AS new_id FROM items)"


@query(f"WITH {ITEMS_SQL}, {RENUMBER_SQL} SELECT id AS old_id, new_id FROM ids")
def renumber_ids(spark, d):
    return clean.renumber(items(spark, d)).select(F.col("id").alias("old_id"), "new_id")


@query(f"WITH {ITEMS_SQL}, {VERDICTS_SQL}, {RENUMBER_SQL} SELECT new_id AS id, judge, veredito FROM verdicts JOIN ids USING (id)")
def inner_remap(spark, d):
    ids = clean.renumber(items(spark, d)).select("id", "new_id")
    return joins.remap_ids(verdicts(spark, d), ids).select("id", "judge", "veredito")


@query(
    f"""WITH {ITEMS_SQL}, a AS (SELECT id, 'by_id' AS src FROM items WHERE conv % 2 = 0), b AS (SELECT DISTINCT lower({STRIP_SQL.format('pergunta')}) AS k, 'by_text' AS src FROM items WHERE conv % 3 = 0)
SELECT i.id, coalesce(a.src, b.src) AS src FROM items i LEFT JOIN a USING (id) LEFT JOIN b ON b.k = lower({STRIP_SQL.format('i.pergunta')})"""
)
def fallback_join(spark, d):
    its = items(spark, d)
    by_id = its.filter("conv % 2 = 0").select("id", F.lit("by_id").alias("src"))
    by_text = its.filter("conv % 3 = 0").select(clean.dup_key("pergunta").alias("text_key"), F.lit("by_text").alias("src")).distinct()
    return joins.fallback_join(its.select("id", "pergunta"), by_id, by_text, "id", clean.dup_key("pergunta"), "src").select("id", "src")


@query("SELECT d.doc_id FROM documents d ANTI JOIN labels l USING (doc_id)")
def resume_anti(spark, d):
    return joins.pending(docs(spark, d).select("doc_id"), table(spark, d, "labels"), ["doc_id"])


@query(f"WITH {ITEMS_SQL}, {VERDICTS_SQL} SELECT id FROM items WHERE id NOT IN (SELECT id FROM verdicts WHERE veredito IS NOT NULL GROUP BY id HAVING count(DISTINCT judge) = 2)")
def resume_all_judges(spark, d):
    return joins.pending_judges(items(spark, d).select("id"), verdicts(spark, d).filter("veredito IS NOT NULL"), ["phi", "command"])


@query("SELECT d.doc_id, l.quality, l.quality IS NOT NULL AS cached FROM documents d LEFT JOIN labels l USING (doc_id)")
def cache_reuse(spark, d):
    hit, miss = joins.reuse_cached(docs(spark, d).select("doc_id"), table(spark, d, "labels"), ["doc_id"], "quality")
    return hit.withColumn("cached", F.lit(True)).unionByName(miss.withColumns({"quality": F.lit(None).cast("int"), "cached": F.lit(False)}))


@query(f"WITH {ITEMS_SQL} SELECT DISTINCT 'c' || (doc_id % 97) AS chunk_id FROM documents WHERE 'c' || (doc_id % 97) NOT IN (SELECT unnest(chunk_ids) FROM items)")
def anti_exploded(spark, d):
    chunks = docs(spark, d).select(F.concat(F.lit("c"), (F.col("doc_id") % 97).cast("string")).alias("chunk_id")).distinct()
    return joins.exclude_used(chunks, items(spark, d))


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'train' WHEN doc_id % 6 = 0 THEN 'test' ELSE 'geral' END AS split FROM documents")
def split_label(spark, d):
    own = docs(spark, d).select("doc_id")
    return joins.label_split(own, own.filter("doc_id % 4 = 0"), own.filter("doc_id % 6 = 0"), "doc_id")


@query(f"WITH {ITEMS_SQL} SELECT unnest(chunk_ids) AS chunk_id FROM items WHERE conv % 5 <> 0 INTERSECT SELECT unnest(chunk_ids) FROM items WHERE conv % 5 = 0")
def leak_check(spark, d):
    its = items(spark, d)
    return joins.leaks(its.filter("conv % 5 <> 0"), its.filter("conv % 5 = 0"))


@query(f"WITH {SCORED_SQL} PIVOT (SELECT id, model, rouge_l FROM scored) ON model IN ('m0', 'm1', 'm2', 'm3', 'm4') USING first(rouge_l) GROUP BY id")
def head_to_head(spark, d):
    return joins.head_to_head(scored(spark, d), ["m0", "m1", "m2", "m3", "m4"], "rouge_l")


@query("SELECT doc_id, 'old' AS v, lang FROM documents WHERE lang NOT IN ('fr', 'de') UNION ALL SELECT doc_id, 'new', lang FROM documents WHERE lang IN ('fr', 'de') AND doc_id % 2 = 0")
def overwrite_partitions(spark, d):
    own = docs(spark, d)
    new = own.filter("lang IN ('fr', 'de') AND doc_id % 2 = 0").select("doc_id", F.lit("new").alias("v"), "lang")
    return joins.replace_partitions(own.select("doc_id", F.lit("old").alias("v"), "lang"), new, "lang")


@query(f"WITH {SCORED_SQL}, {JUDGED_SQL} SELECT CASE WHEN coalesce(correto_phi, false) THEN 'ok' ELSE 'failed' END AS sink, count(*) AS n FROM judged GROUP BY 1")
def ok_fail_split(spark, d):
    ok, failed = joins.route_ok_fail(judged(spark, d), "correto_phi")
    return ok.select(F.lit("ok").alias("sink")).unionByName(failed.select(F.lit("failed").alias("sink"))).groupBy("sink").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT NULL AS eval_loss, value AS loss, event_id AS step FROM events WHERE event_id % 2 = 0 UNION ALL SELECT value, NULL, event_id FROM events WHERE event_id % 2 = 1")
def union_ragged(spark, d):
    ev = table(spark, d, "events")
    train = ev.filter("event_id % 2 = 0").select(F.col("event_id").alias("step"), F.col("value").alias("loss"))
    return joins.union_ragged(train, ev.filter("event_id % 2 = 1").select(F.col("event_id").alias("step"), F.col("value").alias("eval_loss")))


@query("SELECT item_id AS id, text FROM benchmark UNION ALL SELECT doc_id, text FROM documents")
def union_all(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text").unionByName(docs(spark, d).select(F.col("doc_id").alias("id"), "text"))


# --- Duplicates and cleaning -----------------------------------------------------------------------------------------

KEY_SQL = f"lower({STRIP_SQL.format('text')})"


@query(
    f"""SELECT doc_id, CASE WHEN n = 1 THEN 0 WHEN doc_id = f THEN n - 1 ELSE 1 END AS n_flags
FROM (SELECT doc_id, count(*) OVER k AS n, min(doc_id) OVER k AS f FROM documents WINDOW k AS (PARTITION BY {KEY_SQL}))"""
)
def exact_dup_flags(spark, d):
    return clean.exact_dup_flags(docs(spark, d).select("doc_id", "text"), "text", "doc_id").select("doc_id", "n_flags")


@query(f"SELECT doc_id, CASE WHEN f < doc_id THEN f END AS dup_of FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY {KEY_SQL}) AS f FROM documents)")
def exact_dedup(spark, d):
    return clean.exact_dedup(docs(spark, d).select("doc_id", F.col("doc_id").alias("ord"), "text"), "text", "ord", "doc_id").select("doc_id", "dup_of")


CLEAN_SQL = f"""clean AS (SELECT id, dominio, nivel_dificuldade, CASE WHEN conv % 3 = 2 AND conv % 4 = 1 THEN 'single_source' WHEN dup THEN 'exact_dup'
  WHEN conv % 11 = 0 THEN 'reference_list' WHEN contains(pergunta, 'what') THEN 'table' WHEN conv % 13 = 0 THEN 'human' END AS motivo_remocao
  FROM (SELECT *, ord > min(ord) OVER (PARTITION BY lower({STRIP_SQL.format('pergunta')})) AS dup FROM items))"""


def _clean(spark, d):
    marked = clean.exact_dedup(items(spark, d))
    c = F.col("conv")
    reasons = {
        "single_source": (c % 3 == 2) & (c % 4 == 1),
        "exact_dup": F.col("dup_of").isNotNull(),
        "reference_list": c % 11 == 0,
        "table": F.col("pergunta").contains("what"),
        "human": c % 13 == 0,
    }
    return clean.clean_partition(marked.withColumns(reasons))


@query(f"WITH {ITEMS_SQL}, {CLEAN_SQL} SELECT id, motivo_remocao FROM clean")
def clean_partition(spark, d):
    return _clean(spark, d).select("id", "motivo_remocao")


@query(f"WITH {ITEMS_SQL}, {CLEAN_SQL} SELECT dominio, nivel_dificuldade, count(*) AS n FROM clean WHERE motivo_remocao IS NULL GROUP BY ALL")
def kept_by_stratum(spark, d):
    return clean.kept_by_stratum(_clean(spark, d))


@query("SELECT conv_id, list_filter(['user', 'assistant', 'system'], lambda r: list_contains(list(role), r)) AS roles FROM conversations GROUP BY conv_id")
def array_distinct(spark, d):
    rank = F.when(F.col("role") == "user", 0).when(F.col("role") == "assistant", 1).otherwise(2)
    own = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(rank.alias("k"), "role"))).alias("r"))
    return own.select("conv_id", F.array_distinct(F.col("r.role")).alias("roles"))


@query(f"WITH {ITEMS_SQL} SELECT id, list_distinct_ordered AS validado_por, true AS validado FROM (SELECT id, CASE WHEN conv % 2 = 0 THEN ['ana', 'rui'] ELSE ['rui'] END AS list_distinct_ordered FROM items)")
def validation_stamp(spark, d):
    names = F.when(F.col("conv") % 2 == 0, F.array(F.lit("ana"), F.lit("rui"), F.lit("ana"))).otherwise(F.array(F.lit("rui"), F.lit("rui")))
    return clean.validation_stamp(items(spark, d).withColumn("validado_por", names)).select("id", "validado_por", "validado")


# --- Words, similarity and grounding ---------------------------------------------------------------------------------

def _wordset(x: str) -> str:
    return f"list_distinct(regexp_extract_all(lower({x}), '[a-zà-ú]{{4,}}'))"


@query(f"SELECT doc_id, list_sort({_wordset('text')}) AS words FROM documents")
def word_set(spark, d):
    return docs(spark, d).select("doc_id", F.array_sort(tx.word_set(F.col("text"))).alias("words"))


def _ground(x: str, y: str) -> str:
    own = _wordset(x)
    return f"CASE WHEN len({own}) = 0 THEN 0.0 ELSE CAST(len(list_intersect({own}, {_wordset(y)})) AS DOUBLE) / len({own}) END"


@query(f"WITH {ITEMS_SQL}, g AS (SELECT id, {_ground('resposta_referencia', 'pergunta')} AS g FROM items) SELECT id, round(g, 3) AS overlap, g < 0.35 AS low FROM g")
def grounding(spark, d):
    g = tx.grounding(F.col("resposta_referencia"), F.col("pergunta"))
    return items(spark, d).select("id", F.round(g, 3).alias("overlap"), (g < 0.35).alias("low"))


@query(
    f"""WITH {ITEMS_SQL}, c AS (SELECT id, resposta_referencia AS a, [pergunta, resposta_referencia] AS cs FROM items),
e AS (SELECT id, a, unnest(cs) AS ch FROM c) SELECT id, count(*) FILTER (WHERE {_ground('a', 'ch')} > 0.15) <= 1 AS single FROM e GROUP BY id"""
)
def single_source(spark, d):
    chunks = F.array("pergunta", "resposta_referencia")
    return items(spark, d).select("id", tx.single_source(F.col("resposta_referencia"), chunks).alias("single"))


@query(
    f"""WITH {ITEMS_SQL}, t AS (SELECT count(*) AS total FROM items),
f AS (SELECT unnest(list_concat(CASE WHEN contains(pergunta, 'the') THEN ['vague'] ELSE [] END, CASE WHEN len(chunk_ids) < 2 THEN ['few', 'few'] ELSE [] END)) AS flag FROM items)
SELECT flag, count(*) AS n, round(100.0 * count(*) / any_value(total), 1) AS pct FROM f, t GROUP BY flag"""
)
def audit_summary(spark, d):
    none = F.array().cast("array<string>")
    flags = F.concat(
        F.when(F.col("pergunta").contains("the"), F.array(F.lit("vague"))).otherwise(none),
        F.when(F.size("chunk_ids") < 2, F.array(F.lit("few"), F.lit("few"))).otherwise(none),
    )
    its = items(spark, d)
    total = its.count()
    found = its.select(F.explode(flags).alias("flag")).groupBy("flag").agg(F.count(F.lit(1)).alias("n"))
    return found.withColumn("pct", F.round(100.0 * F.col("n") / F.lit(total), 1))


TOKEN = "[a-z]{4,}"


def _vectors(spark, d):
    pool = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.lit("b").alias("block"), "text", F.concat(F.lit("s"), (F.col("item_id") % 3).cast("string")).alias("source"))
    return pool, similarity.tfidf(pool, "id", "block", "text", ngram=2, max_features=4096, token=TOKEN)


VECTORS_SQL = f"""w AS (SELECT item_id AS id, regexp_extract_all(lower(text), '{TOKEN}') AS ws FROM benchmark),
grams AS (SELECT id, unnest(ws) AS term FROM w UNION ALL SELECT id, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) FROM w),
counts AS (SELECT id, term, count(*) AS tf FROM grams GROUP BY ALL),
vocab AS (SELECT term, count(*) AS df, sum(tf) AS total FROM counts GROUP BY term ORDER BY total DESC, term LIMIT 4096),
raw AS (SELECT id, term, tf * (ln((1.0 + (SELECT count(*) FROM benchmark)) / (1.0 + df)) + 1) AS x FROM counts JOIN vocab USING (term)),
vectors AS (SELECT id, term, x / sqrt(sum(x * x) OVER (PARTITION BY id)) AS weight FROM raw),
pairs AS (SELECT a.id AS id_a, b.id AS id_b, sum(a.weight * b.weight) AS similarity FROM vectors a JOIN vectors b ON a.term = b.term AND a.id < b.id GROUP BY ALL)"""


@query(f"WITH {VECTORS_SQL} SELECT id, term, round(weight, 6) AS weight FROM vectors")
def tfidf_weights(spark, d):
    return _vectors(spark, d)[1].select("id", "term", F.round("weight", 6).alias("weight"))


@query(f"WITH {VECTORS_SQL} SELECT id_a, id_b, round(similarity, 4) AS similarity FROM pairs WHERE similarity >= 0.05")
def cosine_pairs(spark, d):
    return similarity.cosine_pairs(_vectors(spark, d)[1], 0.05).select("id_a", "id_b", F.round("similarity", 4).alias("similarity"))


@query(f"WITH {VECTORS_SQL} SELECT id_a, id_b, round(similarity, 3) AS similarity FROM pairs WHERE similarity > 0.2")
def near_dup_pairs(spark, d):
    return similarity.cosine_pairs(_vectors(spark, d)[1], 0.2, inclusive=False).select("id_a", "id_b", F.round("similarity", 3).alias("similarity"))


@query(
    f"""WITH {VECTORS_SQL}, both_ways AS (SELECT id_a AS id, id_b AS other, similarity FROM pairs WHERE similarity >= 0.05 UNION ALL SELECT id_b, id_a, similarity FROM pairs WHERE similarity >= 0.05),
x AS (SELECT *, id % 3 <> other % 3 AS crosses FROM both_ways),
r AS (SELECT *, row_number() OVER (PARTITION BY id, crosses ORDER BY similarity DESC, other) AS rank, max(CAST(crosses AS INT)) OVER (PARTITION BY id) AS c FROM x)
SELECT id, other, crosses, CAST(rank AS BIGINT) AS rank FROM r WHERE (crosses AND rank <= 2) OR (NOT crosses AND c = 0 AND rank <= 1)"""
)
def similar_neighbours(spark, d):
    pool, vectors = _vectors(spark, d)
    out = similarity.neighbours(similarity.cosine_pairs(vectors, 0.05), pool)
    return out.select("id", "other", F.col("cross").alias("crosses"), F.col("rank").cast("long").alias("rank"))


@query(
    f"""WITH RECURSIVE {VECTORS_SQL}, p AS (SELECT id_a AS a, id_b AS b, row_number() OVER (ORDER BY id_a * 1000000 + id_b) AS k FROM pairs WHERE similarity >= 0.2),
f AS (SELECT CAST(0 AS BIGINT) AS k, MAP([]::BIGINT[], []::BIGINT[]) AS gone
  UNION ALL SELECT p.k, CASE WHEN map_contains(gone, p.a) THEN gone ELSE map_concat(gone, MAP([CAST(p.b AS BIGINT)], [CAST(p.a AS BIGINT)])) END FROM f JOIN p ON p.k = f.k + 1),
e AS (SELECT unnest(map_entries(gone)) AS x FROM f WHERE k = (SELECT max(k) FROM f)) SELECT x.key AS id, x.value AS because FROM e"""
)
def near_dedup(spark, d):
    pairs = similarity.cosine_pairs(_vectors(spark, d)[1], 0.2)
    gone = clean.near_dedup(pairs.withColumn("ord", F.col("id_a") * 1_000_000 + F.col("id_b")))
    return gone.select(F.col("id").cast("long").alias("id"), F.col("because").cast("long").alias("because"))


@query()
def similar_groups(spark, d):
    pool, _ = _vectors(spark, d)
    return sample.similar_groups(pool, 10, min_sim=0.05)


TOK_SQL = "list_filter(string_split_regex(lower({0}), '[ \\t\\n\\x0B\\f\\r]+'), lambda t: t <> '')"


@query(
    f"""WITH {ITEMS_SQL}, p AS (SELECT id, unnest({TOK_SQL.format('resposta_referencia')}) AS t FROM items), r AS (SELECT id, unnest({TOK_SQL.format('pergunta')}) AS t FROM items),
pc AS (SELECT id, t, count(*) AS n FROM p GROUP BY ALL), rc AS (SELECT id, t, count(*) AS n FROM r GROUP BY ALL),
c AS (SELECT id, sum(least(pc.n, rc.n)) AS common FROM pc JOIN rc USING (id, t) GROUP BY id)
SELECT i.id, round(coalesce(2e0 * common / (len({TOK_SQL.format('resposta_referencia')}) + len({TOK_SQL.format('pergunta')})), 0), 4) AS f1 FROM items i LEFT JOIN c USING (id)"""
)
def token_f1(spark, d):
    found = tx.token_f1_rows(items(spark, d), "id", "resposta_referencia", "pergunta")
    return found.select("id", F.round("f1", 4).alias("f1"))


@query()
def rouge_l(spark, d):
    return items(spark, d).select("id", F.round(tx.rouge_l(F.col("resposta_referencia"), F.col("pergunta")), 4).alias("rouge_l"))


@query(
    """WITH e AS (SELECT vec_id, label, embedding FROM embeddings), p AS (SELECT a.vec_id AS id, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS sim
FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id) SELECT id, round(max(sim), 4) AS sim, count(*) > 1 AS chunked FROM p GROUP BY id"""
)
def window_max_cosine(spark, d):
    sims = similarity.nearest(table(spark, d, "embeddings"), "vec_id", "label", "embedding")
    return report.window_max(sims, ["id"], "sim", "n").withColumn("sim", F.round("sim", 4))


@query(f"SELECT doc_id, {STRIP_SQL.format('text')} AS answer FROM documents")
def strip_think(spark, d):
    thought = F.concat(F.lit("<think>x</think> y </think>\n"), F.col("text"))
    text = F.when(F.col("doc_id") % 2 == 0, thought).otherwise(F.concat(F.lit("<think>"), F.col("text")))
    return docs(spark, d).select("doc_id", tx.strip_reasoning(text).alias("answer"))


@query("SELECT event_id, props AS found FROM events")
def extract_json(spark, d):
    fenced = F.concat(F.lit("Sure:\n```json\n"), F.col("props"), F.lit("\n``` {x}"))
    plain = F.concat(F.lit("Sure: "), F.col("props"), F.lit(" done"))
    return table(spark, d, "events").select("event_id", tx.extract_json(F.when(F.col("event_id") % 2 == 0, fenced).otherwise(plain)).alias("found"))


@query(
    f"""WITH {ITEMS_SQL} SELECT id, '--- Trecho 1 (fonte: ' || dominio || ' | ' || CASE WHEN conv % 2 = 0 THEN 'Art. 1' ELSE chunk_ids[1] END || ') ---' || chr(10) || pergunta || chr(10) || chr(10)
|| '--- Trecho 2 (fonte: ' || dominio || ' | sec) ---' || chr(10) || resposta_referencia || chr(10) AS prompt FROM items"""
)
def render_prompt(spark, d):
    none, empty = F.lit(None).cast("string"), F.lit("")
    one = F.struct(F.col("dominio").alias("source_document"), F.when(F.col("conv") % 2 == 0, "Art. 1").otherwise("").alias("article_ref"), none.alias("section_title"), F.col("chunk_ids")[0].alias("chunk_id"), F.col("pergunta").alias("content"))
    two = F.struct(F.col("dominio").alias("source_document"), empty.alias("article_ref"), F.lit("sec").alias("section_title"), F.lit("c").alias("chunk_id"), F.col("resposta_referencia").alias("content"))
    return items(spark, d).select("id", tx.render_excerpts(F.array(one, two)).alias("prompt"))


@query(
    f"""WITH {ITEMS_SQL} SELECT id, 'rag' AS format, 'Contexto:' || chr(10) || '[Trecho 1]: ' || chunk_ids[1] || CASE WHEN len(chunk_ids) > 1 THEN chr(10) || chr(10) || '[Trecho 2]: ' || chunk_ids[2] ELSE '' END
|| chr(10) || chr(10) || 'Pergunta:' || chr(10) || pergunta AS text FROM items UNION ALL SELECT id, 'closed_book', pergunta FROM items"""
)
def format_samples(spark, d):
    parts = F.transform("chunk_ids", lambda c, i: F.concat(F.lit("[Trecho "), (i + 1).cast("string"), F.lit("]: "), c))
    rag = F.concat(F.lit("Contexto:\n"), F.array_join(parts, "\n\n"), F.lit("\n\nPergunta:\n"), F.col("pergunta"))
    modes = F.array(F.struct(F.lit("rag").alias("format"), rag.alias("text")), F.struct(F.lit("closed_book").alias("format"), F.col("pergunta").alias("text")))
    return items(spark, d).select("id", F.explode(modes).alias("m")).select("id", "m.*")


@query("SELECT doc_id, regexp_replace(text, '(?i)(the)', '<mark>\\1</mark>', 'g') AS marked FROM documents")
def highlight(spark, d):
    return docs(spark, d).select("doc_id", tx.highlight(F.col("text"), "the").alias("marked"))


@query("SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#039;') AS safe FROM pages")
def html_escape(spark, d):
    return table(spark, d, "pages").select("page_id", tx.html_escape(F.col("html")).alias("safe"))


@query("SELECT page_id, replace(replace(url, '/', '_'), ':', '_') AS name FROM pages")
def safe_filename(spark, d):
    return table(spark, d, "pages").select("page_id", tx.safe_name(F.col("url")).alias("name"))


# --- Samples, components and splits ----------------------------------------------------------------------------------


@query()
def doc_quotas(spark, d):
    return sample.doc_quotas(docs(spark, d), 100)


@query(
    """WITH q AS (SELECT source, count(*) % 7 + 1 AS quota FROM documents GROUP BY source),
r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('42:' || doc_id), doc_id) AS n FROM documents)
SELECT doc_id, source FROM r JOIN q USING (source) WHERE n <= quota"""
)
def quota_sample(spark, d):
    own = docs(spark, d).select("doc_id", "source")
    quotas = own.groupBy("source").agg((F.count(F.lit(1)) % 7 + 1).alias("quota"))
    return sample.quota_sample(own, quotas, 1 << 30, 42, "source", "doc_id").select("doc_id", "source")


@query(
    """WITH q AS (SELECT source, count(*) AS quota FROM documents GROUP BY source), t AS (SELECT *, CAST(round_even(quota * 1.4, 0) AS BIGINT) AS total FROM q),
l AS (SELECT *, CAST(round_even(total * 0.36, 0) AS BIGINT) AS factual, CAST(round_even(total * 0.34, 0) AS BIGINT) AS conceitual FROM t)
SELECT *, total - factual - conceitual AS aplicado FROM l"""
)
def level_targets(spark, d):
    return sample.level_targets(docs(spark, d).groupBy("source").agg(F.count(F.lit(1)).alias("quota")))


@query(
    """WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id), doc_id) AS n FROM documents)
SELECT doc_id, lang, CASE WHEN n <= 3 THEN 'factual' WHEN n <= 7 THEN 'conceitual' ELSE 'aplicado' END AS level FROM r WHERE n <= 9"""
)
def disjoint_samples(spark, d):
    own = docs(spark, d).select("doc_id", "lang")
    return sample.disjoint_levels(own, {"factual": 3, "conceitual": 4, "aplicado": 2}, 42, "lang", "doc_id").select("doc_id", "lang", "level")


@query(f"WITH {ITEMS_SQL} SELECT id, row_number() OVER (ORDER BY ord) - 1 AS task_no FROM items")
def task_ids(spark, d):
    return sample.task_ids(items(spark, d).select("id", "ord")).select("id", "task_no")


@query(
    """SELECT lang, count(*) AS pool, count(DISTINCT source) AS documents, count(*) FILTER (WHERE n_chars > 1000) AS long_chunks,
  count(DISTINCT source) FILTER (WHERE n_chars > 1000) AS covered FROM documents GROUP BY lang"""
)
def sampling_report(spark, d):
    large = F.col("n_chars") > 1000
    return docs(spark, d).groupBy("lang").agg(
        F.count(F.lit(1)).alias("pool"), F.count_distinct("source").alias("documents"), F.sum(large.cast("long")).alias("long_chunks"),
        F.count_distinct(F.when(large, F.col("source"))).alias("covered"),
    )


@query(
    """WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id), doc_id) - 1 AS n FROM documents),
p AS (SELECT lang, CAST(floor(n / 2) AS BIGINT) AS pair_no, arg_min(doc_id, n) AS first, arg_max(doc_id, n) AS second, count(*) AS s FROM r WHERE n < 20 GROUP BY ALL)
SELECT lang, pair_no, first, second FROM p WHERE s = 2"""
)
def pair_consecutive(spark, d):
    return sample.pair_consecutive(docs(spark, d).select("doc_id", "lang"), 10, 42, "lang", "doc_id")


@query(
    f"""WITH {ITEMS_SQL}, r AS (SELECT id, nivel_dificuldade, row_number() OVER (PARTITION BY nivel_dificuldade ORDER BY ord) AS n FROM items)
SELECT id, nivel_dificuldade FROM r WHERE n <= CASE WHEN nivel_dificuldade = 'aplicado' THEN 4 ELSE 3 END"""
)
def balanced_head(spark, d):
    return sample.balanced_head(items(spark, d), 10).select("id", "nivel_dificuldade")


COCHRAN_SQL = "greatest(1, least(n, CAST(ceil(67.650625 / (1 + 66.650625 / n)) AS BIGINT)))"


@query(f"SELECT source, n, {COCHRAN_SQL} AS sample FROM (SELECT source, count(*) AS n FROM documents GROUP BY source)")
def cochran(spark, d):
    return docs(spark, d).groupBy("source").agg(F.count(F.lit(1)).alias("n")).withColumn("sample", tx.cochran(F.col("n")))


@query(
    f"""WITH x AS (SELECT doc_id, lang, doc_id % 9 = 0 AS flagged FROM documents), s AS (SELECT lang, count(*) AS n, count(*) FILTER (WHERE flagged) AS f FROM x GROUP BY lang),
r AS (SELECT x.*, row_number() OVER (PARTITION BY lang, flagged ORDER BY md5('42:' || doc_id), doc_id) AS k FROM x)
SELECT doc_id, lang, CASE WHEN flagged THEN 'flagged' ELSE 'random' END AS reason FROM r JOIN s USING (lang) WHERE flagged OR k <= greatest(0, {COCHRAN_SQL} - f)"""
)
def review_sample(spark, d):
    own = docs(spark, d).select("doc_id", "lang", (F.col("doc_id") % 9 == 0).alias("flagged"))
    sizes = own.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).select("lang", tx.cochran(F.col("n")).alias("sample"))
    return sample.review_sample(own, sizes, ["lang"], 42, "doc_id").select("doc_id", "lang", "reason")


#: Suppliers of a nation and account band share a node; small enough for a recursive oracle.
EDGES_SQL = """edges AS (SELECT s_suppkey AS item, 'n' || (s_suppkey % 37) AS node FROM supplier UNION ALL SELECT s_suppkey, 'm' || (s_suppkey * 7 % 41) FROM supplier WHERE s_suppkey % 3 = 0)"""
COMPONENTS_SQL = f"""{EDGES_SQL}, links AS (SELECT DISTINCT a.item AS x, b.item AS y FROM edges a JOIN edges b USING (node)),
reach AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y), labels AS (SELECT x AS item, min(y) AS component FROM reach GROUP BY x)"""


def _edges(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias("item"))
    one = s.withColumn("node", F.concat(F.lit("n"), (F.col("item") % 37).cast("string")))
    return one.unionByName(s.filter("item % 3 = 0").withColumn("node", F.concat(F.lit("m"), (F.col("item") * 7 % 41).cast("string"))))


@query(f"WITH RECURSIVE {COMPONENTS_SQL} SELECT item, component FROM labels")
def components(spark, d):
    return sample.components(_edges(spark, d))


@query(f"WITH RECURSIVE {COMPONENTS_SQL} SELECT component, md5(string_agg(CAST(item AS VARCHAR), ',' ORDER BY CAST(item AS VARCHAR))) AS component_key, count(*) AS members FROM labels GROUP BY component")
def component_key(spark, d):
    return sample.component_keys(sample.components(_edges(spark, d)))


def _split(spark, d):
    its = items(spark, d)
    labels = sample.components(its.select(F.col("id").alias("item"), F.explode("chunk_ids").alias("node")))
    strata = its.join(labels, its["id"] == labels["item"]).withColumn("stratum", F.concat_ws("/", "dominio", "nivel_dificuldade"))
    keyed = strata.groupBy("component", "stratum").agg(F.count(F.lit(1)).alias("n")).join(sample.component_keys(labels), "component")
    sides = sample.split_components(spark, keyed)
    return strata.join(sides, "component").select("id", "stratum", "component", "side", "chunk_ids")


@query()
def component_split(spark, d):
    found = _split(spark, d)
    joins.assert_no_leak(found.filter("side = 'train'"), found.filter("side = 'test'"))
    return found.select("id", "stratum", "component", "side")


@query(
    """SELECT lang AS stratum, count(*) FILTER (WHERE doc_id % 5 < 4) AS train, count(*) FILTER (WHERE doc_id % 5 >= 4) AS test,
  round(100.0 * count(*) FILTER (WHERE doc_id % 5 < 4) / count(*), 1) AS train_pct FROM documents GROUP BY lang"""
)
def split_report(spark, d):
    side = F.when(F.col("doc_id") % 5 < 4, "train").otherwise("test")
    return sample.split_report(docs(spark, d).select(F.col("lang").alias("stratum"), side.alias("side")))


@query("SELECT doc_id, CAST('0x' || substr(md5('3407:' || doc_id), 1, 8) AS BIGINT) < 429496729 AS held FROM documents")
def holdout(spark, d):
    return sample.holdout(docs(spark, d).select("doc_id"), 0.1, 3407, "doc_id")


@query("SELECT doc_id FROM documents ORDER BY doc_id LIMIT 25")
def limit_ordered(spark, d):
    return docs(spark, d).select("doc_id").orderBy("doc_id").limit(25)


# --- Judges ----------------------------------------------------------------------------------------------------------

BY_ITEM_SQL = """by_item AS (SELECT id, bool_or(coalesce(veredito IN ('rejeitar', 'revisar'), false)) AS bad, count(veredito) = 2 AS answered, count(DISTINCT veredito) AS n_values FROM verdicts GROUP BY id)"""


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, try_cast(json_extract_string(props, '$.k') AS BIGINT) IS NOT NULL AS parse_ok FROM events")
def parse_verdict(spark, d):
    k = F.get_json_object(tx.extract_json(F.col("props")), "$.k")
    return table(spark, d, "events").select("event_id", k.alias("k"), k.try_cast("long").isNotNull().alias("parse_ok"))


@query(f"WITH {ITEMS_SQL}, {VERDICTS_SQL}, {BY_ITEM_SQL} SELECT id FROM by_item WHERE bad OR (answered AND n_values > 1)")
def priority_queue(spark, d):
    return judge.priority_queue(verdicts(spark, d))


@query(f"WITH {ITEMS_SQL}, {VERDICTS_SQL}, {BY_ITEM_SQL} SELECT count(*) AS n_multi, count(*) FILTER (WHERE n_values = 1) AS n_agree, round(count(*) FILTER (WHERE n_values = 1) / count(*), 3) AS rate FROM by_item WHERE answered")
def agreement_rate(spark, d):
    return judge.agreement(verdicts(spark, d))


@query(f"WITH {ITEMS_SQL}, {VERDICTS_SQL} SELECT judge, veredito, count(*) AS n FROM verdicts WHERE veredito IS NOT NULL GROUP BY ALL")
def verdict_dist(spark, d):
    return judge.verdict_dist(verdicts(spark, d))


@query(
    f"""WITH {ITEMS_SQL}, {VERDICTS_SQL}, p AS (SELECT id, any_value(veredito) FILTER (WHERE judge = 'phi') AS p, any_value(veredito) FILTER (WHERE judge = 'command') AS c FROM verdicts GROUP BY id)
SELECT id, CASE WHEN p = 'rejeitar' AND c = 'rejeitar' THEN 'ambos_rejeitar' WHEN p IS DISTINCT FROM c THEN 'discordancia' WHEN c = 'revisar' THEN 'rejeitado_command' ELSE 'outros' END AS reason FROM p"""
)
def review_reason(spark, d):
    own = verdicts(spark, d).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("judge", "veredito"))).alias("v"))
    return own.select("id", tx.verdict_reason(F.col("v")).alias("reason"))


@query(
    f"""WITH {ITEMS_SQL}, {VERDICTS_SQL} SELECT judge, count(*) FILTER (WHERE veredito = 'rejeitar') AS rejected, count(*) FILTER (WHERE veredito = 'revisar') AS to_review,
  count(*) FILTER (WHERE veredito IS NULL) AS missing FROM verdicts GROUP BY judge"""
)
def review_kpis(spark, d):
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    v = F.col("veredito")
    return verdicts(spark, d).groupBy("judge").agg(n(v == "rejeitar").alias("rejected"), n(v == "revisar").alias("to_review"), n(v.isNull()).alias("missing"))


@query(
    f"""WITH {SCORED_SQL}, {JUDGED_SQL}, x AS (SELECT model, coalesce(correto_phi, false) AS a, coalesce(correto_command, false) AS b FROM judged)
SELECT model, count(*) FILTER (WHERE a AND b) AS both_correct, count(*) FILTER (WHERE NOT a AND NOT b) AS both_incorrect, count(*) FILTER (WHERE a <> b) AS disagree FROM x GROUP BY model"""
)
def consensus_matrix(spark, d):
    return judge.consensus_matrix(judged(spark, d), "correto_phi", "correto_command")


@query(f"WITH {ITEMS_SQL}, {VERDICTS_SQL} SELECT id, list(judge ORDER BY judge) AS approvers, count(*) >= 2 AS approved FROM verdicts WHERE veredito = 'aprovado' GROUP BY id")
def approvals(spark, d):
    return judge.approvals(verdicts(spark, d))


@query()
def vote_fold(spark, d):
    return judge.fold_votes(table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_type").alias("action"), "ts", F.col("event_id").alias("seq")))


# --- Reports and explorer --------------------------------------------------------------------------------------------

SUMMARY_SQL = """count(*) AS n_itens, round(avg(rouge_l), 4) AS rouge_l, round(avg(token_f1), 4) AS token_f1, round(avg(bertscore_f1), 4) AS bertscore_f1,
  round(count(*) FILTER (WHERE bertscore_f1 IS NOT NULL AND bertscore_chunked) / nullif(count(bertscore_f1), 0), 3) AS windowed, round(avg(nota_phi), 2) AS nota_media_phi,
  round(avg(CAST(aluc_phi AS DOUBLE)), 3) AS taxa_alucinacao_phi, round(avg(nota_command), 2) AS nota_media_command, round(avg(CAST(aluc_command AS DOUBLE)), 3) AS taxa_alucinacao_command"""


@query(f"WITH {SCORED_SQL} SELECT model, {SUMMARY_SQL} FROM scored GROUP BY model")
def summary_by_model(spark, d):
    return report.summary(scored(spark, d), ["model"], ("phi", "command"))


@query(f"WITH {SCORED_SQL} SELECT model, dominio, nivel_dificuldade, {SUMMARY_SQL} FROM scored GROUP BY ALL")
def summary_by_strata(spark, d):
    return report.summary(scored(spark, d), ["model", "dominio", "nivel_dificuldade"], ("phi", "command"))


@query(f"WITH {SCORED_SQL} SELECT model, round(avg(CAST(coalesce(resposta_gerada, '') = '' AS INT)), 4) AS taxa_vazia FROM scored GROUP BY model")
def empty_rate(spark, d):
    own = scored(spark, d)
    return report.empty_rate(own, own.filter(F.coalesce("resposta_gerada", F.lit("")) != ""))


@query(f"WITH {SCORED_SQL} SELECT model, count(*) AS n, round(avg(latency_s), 2) AS latency, round(avg(rouge_l) FILTER (WHERE dominio = 'en'), 4) AS rouge_en FROM scored GROUP BY model")
def model_stats(spark, d):
    return scored(spark, d).groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("latency_s"), 2).alias("latency"), F.round(F.avg(F.when(F.col("dominio") == "en", F.col("rouge_l"))), 4).alias("rouge_en"))


@query(
    f"""WITH {SCORED_SQL}, m(pos, model, label) AS (VALUES (1, 'm3', 'Three'), (2, 'm0', 'Zero'), (3, 'mx', 'None')),
s AS (SELECT model, round(avg(rouge_l), 4) AS rouge_l, round(avg(token_f1), 4) AS token_f1 FROM scored GROUP BY model)
SELECT pos, model, label, coalesce(rouge_l, 0) AS rouge_l, coalesce(token_f1, 0) AS token_f1 FROM m LEFT JOIN s USING (model)"""
)
def scoreboard(spark, d):
    models = spark.createDataFrame([(1, "m3", "Three"), (2, "m0", "Zero"), (3, "mx", "None")], "pos int, model string, label string")
    return report.scoreboard(report.summary(scored(spark, d), ["model"]), models, ["rouge_l", "token_f1"])


@query(f"WITH {SCORED_SQL} PIVOT (SELECT model, dominio, rouge_l FROM scored) ON dominio IN ('de', 'en', 'es', 'fr') USING round(avg(rouge_l), 3) GROUP BY model")
def pivot_domain(spark, d):
    return report.pivot_metric(scored(spark, d), "dominio", ["de", "en", "es", "fr"], "rouge_l")


@query(f"WITH {SCORED_SQL} PIVOT (SELECT model, nivel_dificuldade, bertscore_f1 FROM scored) ON nivel_dificuldade IN ('factual', 'conceitual', 'aplicado') USING round(avg(bertscore_f1), 3) GROUP BY model")
def pivot_level(spark, d):
    return report.pivot_metric(scored(spark, d), "nivel_dificuldade", ["factual", "conceitual", "aplicado"], "bertscore_f1")


@query(f"WITH {SCORED_SQL}, s AS (SELECT model, avg(rouge_l) AS r FROM scored GROUP BY model) SELECT b.model, round(100 * (t.r - b.r) / nullif(b.r, 0), 1) AS gain_pct FROM s t, s b WHERE t.model = 'm0' AND b.model <> 'm0'")
def relative_gain(spark, d):
    return report.relative_gain(scored(spark, d).groupBy("model").agg(F.avg("rouge_l").alias("r")), "m0", "r")


@query("SELECT lang AS value, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM documents), 1) AS pct FROM documents GROUP BY lang")
def facet_counts(spark, d):
    return report.facet_counts(docs(spark, d), "lang")


@query(f"WITH {ITEMS_SQL} SELECT DISTINCT unnest(chunk_ids) AS source FROM items")
def distinct_sources(spark, d):
    return items(spark, d).select(F.explode("chunk_ids").alias("source")).distinct()


LOG_SQL = "log AS (SELECT event_id AS step, CASE WHEN event_id % 2 = 0 THEN value END AS loss, CASE WHEN event_id % 5 = 0 THEN value + 1 END AS eval_loss FROM events)"


@query(
    f"""WITH {LOG_SQL} SELECT count(*) AS n_points, max_by(loss, step) FILTER (WHERE loss IS NOT NULL) AS final_train_loss, min(loss) AS min_train_loss,
  max_by(eval_loss, step) FILTER (WHERE eval_loss IS NOT NULL) AS final_eval_loss, min(eval_loss) AS best_eval_loss FROM log"""
)
def log_summary(spark, d):
    step, value = F.col("event_id"), F.col("value")
    log = table(spark, d, "events").select(step.alias("step"), F.when(step % 2 == 0, value).alias("loss"), F.when(step % 5 == 0, value + 1).alias("eval_loss"))
    return report.log_summary(log)


@query(f"WITH {SCORED_SQL} SELECT model, count(*) AS n, count(*) FILTER (WHERE correto_command) AS n_ok, round(avg(latency_s), 2) AS latency FROM scored GROUP BY model")
def pilot_stats(spark, d):
    return report.pilot_stats(scored(spark, d).withColumnRenamed("correto_command", "parse_ok"))


@query(f"WITH {SCORED_SQL} SELECT model, round(corr(n_chars, nota_phi), 3) AS corr FROM scored GROUP BY model")
def verbosity_corr(spark, d):
    return report.verbosity_corr(scored(spark, d), "nota_phi")


@query(f"WITH {ITEMS_SQL} SELECT id, len(pergunta) AS n FROM items ORDER BY len(pergunta) DESC, id LIMIT 50")
def sort_modes(spark, d):
    return items(spark, d).select("id", F.length("pergunta").cast("long").alias("n")).orderBy(F.col("n").desc(), "id").limit(50)


@query(f"WITH {SCORED_SQL} SELECT doc_id, coalesce(nota_command, 0) AS nota FROM scored ORDER BY coalesce(nota_command, 0) DESC, doc_id LIMIT 50")
def sort_judge(spark, d):
    return scored(spark, d).select("doc_id", F.coalesce("nota_command", F.lit(0.0)).alias("nota")).orderBy(F.col("nota").desc(), "doc_id").limit(50)


@query("SELECT doc_id FROM documents ORDER BY n_chars DESC, doc_id LIMIT 20 OFFSET 40")
def page(spark, d):
    return joins.page(docs(spark, d).orderBy(F.col("n_chars").desc(), "doc_id").select("doc_id"), 3)


@query("SELECT s_suppkey % 9 + 1 AS p, CASE WHEN 9 > 1 THEN range(greatest(1, s_suppkey % 9 - 1), least(9, s_suppkey % 9 + 3) + 1) END AS pages FROM supplier")
def page_window(spark, d):
    own = table(spark, d, "supplier").select((F.col("s_suppkey") % 9 + 1).cast("int").alias("p"), F.lit(9).alias("t"))
    return joins.page_window(own, "p", "t").select("p", "pages")


def _answer(n: str) -> str:
    verdict = f"CASE {n} % 5 WHEN 0 THEN 'aprovado' WHEN 1 THEN 'revisar' WHEN 2 THEN 'rejeitar' WHEN 3 THEN 'talvez' END"
    return f"concat('Claro: {{\"veredito\": \"', {verdict}, '\", \"nota\": ', CASE {n} % 4 WHEN 0 THEN '\"x\"' ELSE CAST({n} % 10 AS STRING) END, ', \"justificativa\": \"', lang, '\"}} fim')"


@query(
    """WITH v AS (SELECT doc_id, lang, CASE doc_id % 5 WHEN 0 THEN 'aprovado' WHEN 1 THEN 'revisar' WHEN 2 THEN 'rejeitar' WHEN 3 THEN 'talvez' END AS v FROM documents)
SELECT doc_id, v AS veredito, CASE WHEN v IS NOT NULL AND doc_id % 4 <> 0 THEN CAST(doc_id % 10 AS DOUBLE) END AS nota, CASE WHEN v IS NOT NULL THEN lang END AS justificativa,
  coalesce(v IN ('aprovado', 'revisar', 'rejeitar'), false) AS parse_ok FROM v"""
)
def judge_normalised(spark, d):
    """A null verdict makes the whole answer null, as no answer would be."""
    raw = docs(spark, d).select("doc_id", F.expr(_answer("doc_id")).alias("raw"))
    return raw.select("doc_id", judge.normalised(F.col("raw")).alias("r")).select("doc_id", "r.*")


@query(
    f"""WITH {SCORED_SQL}, x AS (SELECT id, model, coalesce(correto_command, false) AS c FROM scored)
SELECT a.model AS model_a, b.model AS model_b, count(*) FILTER (WHERE a.c AND NOT b.c) AS only_a, count(*) FILTER (WHERE b.c AND NOT a.c) AS only_b,
  count(*) FILTER (WHERE a.c AND b.c) AS both, count(*) FILTER (WHERE NOT a.c AND NOT b.c) AS neither FROM x a JOIN x b ON a.id = b.id AND a.model < b.model GROUP BY ALL"""
)
def only_wins(spark, d):
    return report.only_wins(scored(spark, d), "correto_command")


@query(
    f"""WITH {ITEMS_SQL}, t AS (SELECT id, list_sort({_wordset('resposta_referencia')}) AS a, list_sort({_wordset('pergunta')}) AS b FROM items),
x AS (SELECT id, a, b, len(a) > 8 OR len(b) > 8 AS long, unnest(range(0, greatest(len(a) - 1, 0) + 1, 8)) AS i FROM t), y AS (SELECT *, unnest(range(0, greatest(len(b) - 1, 0) + 1, 8)) AS j FROM x),
s AS (SELECT id, long, a[i + 1 : i + 8] AS p, b[j + 1 : j + 8] AS q FROM y)
SELECT id, round(max(len(list_intersect(p, q)) / greatest(len(p), len(q), 1)), 4) AS value, bool_or(long) AS chunked FROM s GROUP BY id"""
)
def windowed_best(spark, d):
    own = items(spark, d).select("id", F.array_sort(tx.word_set(F.col("resposta_referencia"))).alias("a"), F.array_sort(tx.word_set(F.col("pergunta"))).alias("b"))
    share = lambda p, q: F.size(F.array_intersect(p, q)) / F.greatest(F.size(p), F.size(q), F.lit(1))
    return report.windowed_best(own, "id", "a", "b", share, 8).withColumn("value", F.round("value", 4))


@query(
    f"""WITH {ITEMS_SQL}, {VERDICTS_SQL}, p AS (SELECT id, any_value(veredito) FILTER (WHERE judge = 'phi') AS p, any_value(veredito) FILTER (WHERE judge = 'command') AS c FROM verdicts GROUP BY id),
r AS (SELECT id, CASE WHEN p = 'rejeitar' AND c = 'rejeitar' THEN 'ambos_rejeitar' WHEN p IS DISTINCT FROM c THEN 'discordancia' WHEN c = 'revisar' THEN 'rejeitado_command' ELSE 'outros' END AS reason FROM p)
SELECT id, reason FROM items JOIN r USING (id) WHERE dominio = 'd2' AND reason = 'discordancia' AND contains(lower(pergunta), 'an')"""
)
def review_queue_filter(spark, d):
    own = items(spark, d).join(review_reason(spark, d), "id")
    return joins.facet_search(own, {"dominio": "d2", "reason": "discordancia"}, "AN", ("pergunta",)).select("id", "reason")


# --- Model calls and resumption --------------------------------------------------------------------------------------


@query("SELECT *, coalesce(text, '') AS resposta_gerada, coalesce(text, '') <> '' AS parse_ok, CAST(NULL AS VARCHAR) AS error FROM benchmark")
def score_stub(spark, d):
    from ..sources.io import score

    def make():
        return lambda row: {"resposta_gerada": row["text"] or "", "parse_ok": bool(row["text"])}

    return score(table(spark, d, "benchmark"), make, "resposta_gerada string, parse_ok boolean").drop("latency_s")
