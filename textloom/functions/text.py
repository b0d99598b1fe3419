"""Text predicates, measures and rewrites as Column functions; all run in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Thresholds, word lists and patterns that results depend on.
REVOKED = r"\b(vetado|revogad[ao]s?)\b"
TABLE_HEADER = r"^\s*(Tabela|Quadro|Gráfico|Grafico|Figura)\s*\d+(\.\d+)?"
TABLE_MENTION = r"\b(Tabela|Quadro|Gráfico|Grafico|Figura)\s*\d+(\.\d+)?\b"
TABLE_MARKERS = ("Tabela", "Fonte:", "Sumário", "CID", "TABELA")
NARRATIVE_EXCLUSIONS = ("|Col1|", "Col1", "Col2", "Fonte: SIM", "Fonte: IBGE", "Fonte: MS", "CID 10", "...", "Sumário", "SUMÁRIO", "Como referenciar:", "CDD 364", "ISBN")
CITATION = r"\d{4};\s*\d+\(\d+\):\s*\d+"
NUMBERED_REFERENCE = r"(?m)^\s*\d{1,3}\.\s+[A-ZÀ-Ú]"
VAGUE = (
    r"\b(segundo o trecho|de acordo com o trecho|conforme o trecho|no trecho acima|conforme mencionado acima"
    r"|de acordo com o texto acima|com base no trecho fornecido)\b"
)
WORD = "[a-zà-ú]{4,}"
REASONING_STARTS = ("Thinking Process:", "Here's a thinking process", "The user is asking", "To answer this question")
ANSWER_MARKERS = (
    r"\n\n(?=[A-ZÀ-Ú][a-zà-ú]+.*(?:De acordo|A |O |Em |Com base|Para |No |Segundo |Conforme |O Art|A Lei|As |Os |Quanto ))",
    r"\n\n\*\*Resposta:?\*\*\s*",
    r"\n\nResposta:?\s*",
    r"\n\n\*\*Final Answer:?\*\*\s*",
    r"\n\nFinal Answer:?\s*",
)
LEVELS = ("factual", "conceitual", "aplicado")
# End of fixed values.

WHITE = " \t\n\x0b\f\r"


def strip(text: Column) -> Column:
    """Without white space at either end."""
    return F.btrim(text, F.lit(WHITE))


def word_count(text: Column) -> Column:
    """Runs of characters other than white space."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^ \t\n\x0B\f\r]+"))


def count_of(text: Column, part: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / F.lit(len(part))).cast("int")


def has_any(text: Column, parts: Sequence[str]) -> Column:
    out = F.lit(False)
    for part in parts:
        out = out | text.contains(part)
    return out


def matches(text: Column, pattern: str) -> Column:
    """Search without regard to case, with Unicode letters as word characters."""
    return text.rlike("(?iuU)" + pattern)


def quality_flag(content: Column, words: Column | None = None, revoked: str = REVOKED, markers: Sequence[str] = TABLE_MARKERS) -> Column:
    """Five-way quality of a chunk; the first rule that holds decides."""
    words = word_count(content) if words is None else words
    lines = F.size(F.filter(F.split(content, "\n"), lambda x: strip(x) != ""))
    return (
        F.when(matches(content, revoked) & (words < 15), "revoked_or_vetoed")
        .when(words < 6, "too_short")
        .when((lines >= 4) & (words < 4 * lines), "fragmented_table")
        .when((words < 40) & (has_any(content, markers) | matches(content, TABLE_HEADER)), "table_artifact_or_short")
        .otherwise("ok")
    )


def is_pure_content(content: Column, exclusions: Sequence[str] = NARRATIVE_EXCLUSIONS) -> Column:
    """Narrative text: long enough, no tables, table mentions, sources, indexes, credits or axis labels."""
    lines = F.filter(F.transform(F.split(F.substring(content, 1, 350), "\n"), strip), lambda x: x != "")
    short = F.size(F.filter(lines, lambda x: F.length(x) < 12))
    axis = (F.size(lines) >= 6) & (short > 0.6 * F.size(lines))
    table = has_any(content, ("|---|", "| --- |")) | (count_of(content, "|") > 3)
    return (word_count(content) >= 45) & ~table & ~matches(content, TABLE_MENTION) & ~has_any(content, exclusions) & (count_of(content, "@") < 2) & ~axis


def table_artifact_reason(question: Column, answer: Column, excerpts: Column, chunks: Column, mention: str = TABLE_MENTION) -> Column:
    """Why an item depends on a table, or null; ``excerpts`` and ``chunks`` are arrays, null is empty."""
    joined = lambda a: F.array_join(F.coalesce(a, F.array().cast("array<string>")), " ")
    body = joined(chunks)
    found = lambda where, text: F.when(
        matches(text, mention), F.concat(F.lit(f"{where}: '"), F.regexp_extract(text, "(?iuU)" + mention, 0), F.lit("'"))
    )
    small = F.when(
        (word_count(body) < 35) & has_any(body, TABLE_MARKERS),
        F.concat(F.lit("Micro-chunk tabular/nota ("), word_count(body).cast("string"), F.lit(" palavras) sem narrativa")),
    )
    return F.coalesce(
        found("Citação explícita na pergunta", F.coalesce(question, F.lit(""))),
        found("Citação explícita na resposta", F.coalesce(answer, F.lit(""))),
        found("Citação explícita nos trechos usados", joined(excerpts)),
        small,
    )


def is_reference_list(text: Column, citation: str = CITATION, numbered: str = NUMBERED_REFERENCE) -> Column:
    return (F.regexp_count(text, F.lit(citation)) >= 2) | (F.regexp_count(text, F.lit(numbered)) >= 3)


def is_vague(question: Column, pattern: str = VAGUE) -> Column:
    return matches(question, pattern)


def chunk_count_mismatch(level: Column, ids: Column) -> Column:
    """An applied item needs two chunks or more, any other exactly one."""
    return F.when(level == "aplicado", F.size(ids) < 2).otherwise(F.size(ids) != 1)


def word_set(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0)))


def grounding(answer: Column, source: Column) -> Column:
    """Share of the answer's words that the source has; 0 without words."""
    own = word_set(answer)
    return F.when(F.size(own) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(own, word_set(source))) / F.size(own))


def single_source(answer: Column, chunks: Column, threshold: float = 0.15) -> Column:
    """Whether at most one of the chunks holds more than ``threshold`` of the answer's words."""
    return F.size(F.filter(F.transform(chunks, lambda c: grounding(answer, c)), lambda x: x > threshold)) <= 1


def _tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(strip(F.coalesce(text, F.lit("")))), r"[ \t\n\x0B\f\r]+"), lambda t: t != "")


def token_f1(prediction: Column, reference: Column) -> Column:
    """Harmonic mean of precision and recall over the multisets of lower-case tokens; 0 if either is empty.

    For short texts: it counts each token by a pass over both.  :func:`token_f1_rows` takes long ones.
    """
    p, r = _tokens(prediction), _tokens(reference)
    many = lambda a, t: F.size(F.filter(a, lambda x: x == t))
    common = F.aggregate(F.array_distinct(p), F.lit(0), lambda acc, t: acc + F.least(many(p, t), many(r, t)))
    return F.when((F.size(p) == 0) | (F.size(r) == 0) | (common == 0), F.lit(0.0)).otherwise(2.0 * common / (F.size(p) + F.size(r)))


def token_f1_rows(df: DataFrame, id_col: str, prediction: str, reference: str) -> DataFrame:
    """(id, f1): counts of (id, token), added up on the map side, then of ids."""
    side = lambda c, is_p: F.transform(_tokens(F.col(c)), lambda t: F.struct(t.alias("t"), F.lit(is_p).alias("p")))
    long = df.select(id_col, F.explode(F.concat(side(prediction, 1), side(reference, 0))).alias("x")).select(id_col, "x.t", "x.p")
    counts = long.groupBy(id_col, "t").agg(F.sum("p").alias("n"), F.count(F.lit(1)).alias("all"))
    sums = counts.groupBy(id_col).agg(F.sum(F.least("n", F.col("all") - F.col("n"))).alias("common"), F.sum("all").alias("total"))
    return df.select(id_col).join(sums, id_col, "left").select(id_col, F.coalesce(2.0 * F.col("common") / F.col("total"), F.lit(0.0)).alias("f1"))


def common_subsequence(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence; the table's rows are bits of one number."""
    where: dict[str, int] = {}
    for i, token in enumerate(b):
        where[token] = where.get(token, 0) | 1 << i
    full = (1 << len(b)) - 1
    row = full
    for token in a:
        hit = row & where.get(token, 0)
        row = (row + hit | row - hit) & full
    return len(b) - row.bit_count()


def _rouge_l(prediction: pd.Series, reference: pd.Series) -> pd.Series:
    import re

    cut = re.compile("[a-z0-9]+").findall
    out = []
    for x, y in zip(prediction, reference, strict=True):
        p, r = cut((x or "").lower()), cut((y or "").lower())
        n = common_subsequence(p, r) if p and r else 0
        out.append(2.0 * n / (len(p) + len(r)) if n else 0.0)
    return pd.Series(out, dtype="float64")


def rouge_l(prediction: Column, reference: Column) -> Column:
    """F-measure of the longest common subsequence of lower-case ASCII tokens; 0 if either is empty (Arrow batches)."""
    return F.pandas_udf(_rouge_l, T.DoubleType())(prediction, reference)


def strip_reasoning(text: Column) -> Column:
    """The answer behind a model's reasoning."""
    body = strip(F.coalesce(text, F.lit("")))
    opened = F.when(body.startswith("<think>"), strip(F.substring(body, 8, 1 << 30))).otherwise(body)
    started = F.lit(False)
    for start in REASONING_STARTS:
        started = started | opened.startswith(start)
    answer = opened
    for marker in reversed(ANSWER_MARKERS):
        parts = F.split(opened, marker)
        answer = F.when(F.size(parts) > 1, F.element_at(parts, -1)).otherwise(answer)
    return F.when(body.contains("</think>"), strip(F.substring_index(body, "</think>", -1))).otherwise(strip(F.when(started, answer).otherwise(opened)))


def extract_json(text: Column) -> Column:
    """The JSON text in a reply: of a fenced block, else from the first brace to the last, else all."""
    body = strip(F.coalesce(text, F.lit("")))
    fenced = F.regexp_extract(body, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    braces = F.regexp_extract(body, r"(?s)\{.*\}", 0)
    return F.coalesce(F.nullif(fenced, F.lit("")), F.nullif(braces, F.lit("")), body)


def render_excerpts(chunks: Column) -> Column:
    """Numbered excerpts; the label is the first non-empty of article, section and id."""
    filled = lambda x: F.nullif(x, F.lit(""))
    one = lambda c, i: F.concat(
        F.lit("--- Trecho "), (i + 1).cast("string"), F.lit(" (fonte: "), c["source_document"], F.lit(" | "),
        F.coalesce(filled(c["article_ref"]), filled(c["section_title"]), c["chunk_id"]), F.lit(") ---\n"), c["content"], F.lit("\n"),
    )
    return F.array_join(F.transform(chunks, one), "\n")


def highlight(text: Column, query: str) -> Column:
    """Marks the query wherever it occurs, without regard to case."""
    quoted = "".join("\\" + c if c in r"\.[]{}()*+?^$|-" else c for c in query)
    return F.regexp_replace(text, f"(?iu)({quoted})", "<mark>$1</mark>") if query else text


def html_escape(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def safe_name(name: Column) -> Column:
    return F.translate(name, "/:", "__")


def score_band(metric: Column, kind: str) -> Column:
    high, mid = {"rouge": (0.3, 0.15), "f1": (0.3, 0.15), "bert": (0.65, 0.5)}[kind]
    return F.when(metric >= high, "high").when(metric >= mid, "mid").when(metric.isNotNull(), "low")


def cochran(n: Column, confidence: float = 0.90, margin: float = 0.10) -> Column:
    """Sample size of a proportion with finite correction, from 1 to n."""
    z = {0.90: 1.645, 0.95: 1.96, 0.99: 2.576}.get(confidence, 1.645)
    n0 = z * z * 0.25 / (margin * margin)
    size = F.when(n > 0, F.ceil(F.lit(n0) / (1 + (F.lit(n0) - 1) / F.greatest(n, F.lit(1))))).otherwise(0)
    return F.greatest(F.lit(1), F.least(n, size)).cast("long")


def verdict_reason(verdicts: Column, labels: Sequence[tuple[str, str]] = (("command", "rejeitado_command"), ("phi", "rejeitado_phi4"))) -> Column:
    """Why an item goes to review; ``verdicts`` maps a judge to a verdict, ``labels`` a part of a judge's name to a reason."""
    values = F.map_values(verdicts)
    out = F.when((F.size(values) > 0) & F.forall(values, lambda v: F.coalesce(v, F.lit("")) == "rejeitar"), "ambos_rejeitar").when(
        F.size(F.array_distinct(values)) > 1, "discordancia"
    )
    for part, label in labels:
        against = F.map_filter(verdicts, lambda j, v: F.lower(j).contains(part) & v.isin("rejeitar", "revisar"))  # noqa: B023
        out = out.when(F.size(against) > 0, label)
    return out.otherwise("outros")
