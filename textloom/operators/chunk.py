"""Documents into chunks, each by expressions on its own row: no text is shuffled, and a hot source costs no task more than its documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip, word_count

# Line patterns of the chunkers.
ARTICLE = r"^\s*(?:Art\.|Artigo)\s*(\d+[A-Z0-9\.\-ºª°]*)\s*[-–—\.]?\s*"
ITEM = r"^\s*(\d+\.\d+(?:\.\d+)?)\s+([A-Z\xc0-\xff].*)"
HEADING = (
    r"^\s*(PARTE\s+[A-Z]+|TÍTULO\s+[IVXLCDM]+|CAPÍTULO\s+[IVXLCDM]+|SEÇÃO\s+[IVXLCDM]+|SUBSEÇÃO\s+[IVXLCDM]+|LIVRO\s+[IVXLCDM]+)\b"
)
SECTION = r"^(?:#{1,6}\s+|(?:\d+\.|\d+\)\s+)[A-Z\xc0-\xff]{2,}|Quadro\s+\d+|Tabela\s+\d+)"
PAGE = r"^##\s+Página\s+\d+"
MAX_CHARS = 1800
#: Headings by rank, and the headings before it that each keeps.
LEVELS = (
    (("PARTE", "LIVRO"), ()),
    (("TÍTULO",), ("PARTE", "LIVRO")),
    (("CAPÍTULO",), ("PARTE", "LIVRO", "TÍTULO")),
    (("SEÇÃO",), ("CAPÍTULO", "TÍTULO", "PARTE")),
)
NORMATIVE_FILES = ("constituicao_federal.md", "del2848.md", "lgpd.md", "lei9394-1996.md", "lei13005--2014.md", "edital_enem.md", "susp.md")
# End of fixed values.

def _lines(text: Column) -> Column:
    """The lines of a text, stripped."""
    return F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|\r|\n"), strip)


def _parts(lines: Column, opens) -> Column:
    """Lines that aren't empty, joined and cut before those that ``opens`` holds for.

    A cut is an empty line, which nothing else leaves in the text.  The first part is
    what stands before the first cut, behind an empty line if there is anything.
    """
    marked = F.transform(lines, lambda x: F.when(opens(x), F.concat(F.lit("\n"), x)).otherwise(x))
    return F.split(F.concat(F.lit("\n"), F.array_join(marked, "\n")), "\n\n")


def chunk_by_marker(docs: DataFrame, marker: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, part, content): a line that matches opens a chunk; lines before the first are left out."""
    lines = F.filter(_lines(F.col(text_col)), lambda x: x != "")
    parts = docs.select(id_col, F.posexplode(_parts(lines, lambda x: x.rlike(marker))).alias("part", "content"))
    return parts.filter("part > 0").withColumn("part", F.col("part").cast("long"))


def chunk_by_header(docs: DataFrame, header: str, page: str = PAGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, part, section, content): a header line starts and names a section and isn't content; page markers go."""
    lines = F.filter(_lines(F.col(text_col)), lambda x: (x != "") & ~x.rlike(page))
    parts = docs.select(id_col, F.posexplode(_parts(lines, lambda x: x.rlike(header))).alias("part", "_t")).withColumn("_l", F.split("_t", "\n"))
    section = F.when(F.col("part") > 0, F.regexp_replace(F.get("_l", F.lit(0)), r"^#+\s*", ""))
    body = F.array_join(F.slice("_l", 2, F.greatest(F.size("_l") - 1, F.lit(0))), "\n\n")
    return parts.filter(F.size("_l") > 1).select(id_col, F.col("part").cast("long").alias("part"), section.alias("section"), body.alias("content"))


def _is_table(line: Column) -> Column:
    return line.startswith("|") & F.substring(line, 2, 1 << 30).contains("|")


def table_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, block, n_lines, content): maximal runs of lines that begin with a bar and have another."""
    bars = F.array_join(F.transform(_lines(F.col(text_col)), lambda x: F.when(_is_table(x), x).otherwise("")), "\n")
    runs = F.filter(F.split(bars, "\n{2,}"), lambda x: F.trim(x, F.lit("\n")) != "")
    found = docs.select(id_col, F.posexplode(runs).alias("_b", "_t")).withColumn("content", F.trim("_t", F.lit("\n")))
    return found.select(id_col, (F.col("_b") + 1).cast("long").alias("block"), F.size(F.split("content", "\n")).cast("long").alias("n_lines"), "content")


def _packed(lines: Column, max_chars: int) -> Column:
    """Lines in packs whose lengths, plus two for each line, reach ``max_chars``; the last may be short.

    The running size starts anew with each pack, so a fold over the lengths finds where packs end.
    """
    start = F.struct(F.array().cast("array<int>").alias("ends"), F.lit(0).alias("at"), F.lit(0).alias("size"))

    def step(acc: Column, length: Column) -> Column:
        at, size = acc["at"] + 1, acc["size"] + length + 2
        full = size >= max_chars
        return F.struct(
            F.when(full, F.concat(acc["ends"], F.array(at))).otherwise(acc["ends"]).alias("ends"), at.alias("at"), F.when(full, F.lit(0)).otherwise(size).alias("size")
        )

    def spans(acc: Column) -> Column:
        ends = F.when(acc["size"] > 0, F.concat(acc["ends"], F.array(acc["at"]))).otherwise(acc["ends"])
        return F.arrays_zip(F.concat(F.array(F.lit(0)), ends).alias("a"), ends.alias("b"))

    found = F.aggregate(F.transform(lines, F.length), start, step, spans)
    return F.transform(F.filter(found, lambda x: x["b"].isNotNull()), lambda x: F.slice(lines, x["a"] + 1, x["b"] - x["a"]))


def pack_lines(docs: DataFrame, max_chars: int = MAX_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, part, content): lines packed until their lengths, plus two each, reach ``max_chars``."""
    own = docs.select(id_col, F.filter(_lines(F.col(text_col)), lambda x: x != "").alias("_l"))
    return own.select(id_col, F.posexplode(_packed(F.col("_l"), max_chars)).alias("part", "_p")).select(id_col, "part", F.array_join("_p", "\n\n").alias("content"))


def with_chunk_stats(chunks: DataFrame, content: str = "content") -> DataFrame:
    """Adds char_count, word_count and has_table."""
    col = F.col(content)
    return chunks.withColumns({"char_count": F.length(col), "word_count": word_count(col), "has_table": col.contains("|") & col.contains("-|-")})


def chunk_report(files: DataFrame, chunks: DataFrame, key: str) -> DataFrame:
    """Chunks and mean sizes of every file, zero for files without chunks."""
    sums = chunks.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.avg("char_count").alias("c"), F.avg("word_count").alias("w"))
    zero = lambda c: F.round(F.coalesce(F.col(c), F.lit(0.0)), 2)
    return files.select(key).distinct().join(sums, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n_chunks"), zero("c").alias("avg_chars"), zero("w").alias("avg_words"))


def is_normative(name: Column) -> Column:
    """Whether a file is one of the normative documents."""
    return F.element_at(F.split(name, "/"), -1).isin(*NORMATIVE_FILES)


def _where(items: Column, holds) -> Column:
    """The places, from 0, of the items that ``holds`` is true for."""
    return F.filter(F.transform(items, lambda x, i: F.when(holds(x, i), i)), lambda i: i.isNotNull())


def normative_chunks(docs: DataFrame, compat: bool = True) -> DataFrame:
    """(domain, name, nth, chunk_type, article_ref, hierarchy, section_title, content) of (domain, name, text) documents.

    A line that begins an article (in a text without any, a numbered item) opens a
    chunk.  Heading lines aren't content.  A heading stands above all that follows it,
    up to the next heading that doesn't keep it: so each has a range of lines, and the
    hierarchy of a chunk is the headings whose range holds its place.  That place is
    where the chunk begins; with ``compat`` it is where the next one begins, so the last
    article before a heading already has that heading.  The first chunk's title is the
    last short line before it.
    """
    lines = docs.select("domain", "name", _lines(F.col("text")).alias("_l"))
    article = lambda x: x.rlike("(?iuU)" + ARTICLE)
    lines = lines.withColumns({"_article": F.exists("_l", article), "_n": F.size("_l")})
    opens = lambda x: F.when(F.col("_article"), article(x)).otherwise(x.rlike("(?U)" + ITEM))
    tagged = F.transform("_l", lambda x, i: F.struct(i.alias("i"), x.alias("x"), x.rlike("(?iuU)" + HEADING).alias("h"), opens(x).alias("s")))
    rows = lines.select("domain", "name", "_article", "_n", tagged.alias("_t"))

    def rank(x: Column) -> Column:
        mark = F.upper(F.regexp_extract(x, "(?iuU)" + HEADING, 1))
        found = F.lit(None).cast("int")
        for k, (names, _) in reversed(list(enumerate(LEVELS))):
            found = F.when(mark.rlike("|".join(names)), k).otherwise(found)
        return found

    heads = F.transform(F.filter("_t", lambda t: t["h"]), lambda t: F.struct(t["i"].alias("i"), t["x"].alias("x"), rank(t["x"]).alias("k")))
    rows = rows.withColumns({"_h": heads, "_b": F.filter("_t", lambda t: ~t["h"])}).drop("_t")

    def keeps(k: Column, x: Column) -> Column:
        """Whether a heading of rank ``k`` keeps the heading ``x`` above it."""
        return F.coalesce(*[F.when(k == n, x.rlike("|".join(kept)) if kept else F.lit(False)) for n, (_, kept) in enumerate(LEVELS)])

    ends = lambda t: F.array_min(F.transform(F.filter("_h", lambda u: (u["i"] > t["i"]) & ~keeps(u["k"], t["x"])), lambda u: u["i"]))
    ranged = F.transform("_h", lambda t: F.struct(t["i"].alias("i"), t["x"].alias("x"), F.coalesce(ends(t), F.col("_n") + 1).alias("end")))
    rows = rows.select("domain", "name", "_article", "_n", "_b", ranged.alias("_r"), _where(F.col("_b"), lambda t, i: t["s"]).alias("_s"))

    def chunk(s: Column, k: Column) -> Column:
        after = F.get("_s", k + 1)
        own = F.slice("_b", s + 1, F.coalesce(after, F.size("_b")) - s)
        place = F.coalesce(F.get("_b", after)["i"], F.col("_n")) if compat else F.get("_b", s)["i"]
        above = F.transform(F.filter("_r", lambda r: (r["i"] < place) & (r["end"] > place)), lambda r: r["x"])
        body = F.regexp_replace(F.array_join(F.transform(own, lambda t: t["x"]), "\n"), "\n{3,}", "\n\n")
        return F.struct(F.trim(body, F.lit("\n")).alias("content"), above.alias("hierarchy"))

    short = F.filter(
        F.slice("_b", 1, F.get("_s", F.lit(0))), lambda t: (t["x"] != "") & (F.length(t["x"]) < 100) & ~t["x"].startswith("§") & ~t["x"].startswith("(") & ~t["x"].startswith("I ")
    )
    title = F.coalesce(F.try_element_at(F.transform(short, lambda t: t["x"]), F.lit(-1)), F.lit(""))
    out = rows.filter(F.size("_s") > 0).select("domain", "name", "_article", title.alias("_title"), F.posexplode(F.transform("_s", chunk)).alias("_k", "_c"))
    first = F.get(F.split("_c.content", "\n"), F.lit(0))
    ref = F.when(F.col("_article"), F.regexp_extract(first, "(?iuU)" + ARTICLE, 0)).otherwise(F.regexp_extract(first, "(?U)" + ITEM, 0))
    return out.select(
        "domain",
        "name",
        (F.col("_k") + 1).alias("nth"),
        F.when(F.col("_article"), "normative_article").otherwise("normative_item").alias("chunk_type"),
        strip(ref).alias("article_ref"),
        F.col("_c.hierarchy").alias("hierarchy"),
        F.when(F.col("_k") == 0, F.col("_title")).otherwise("").alias("section_title"),
        F.col("_c.content").alias("content"),
    )


def section_chunks(docs: DataFrame, max_chars: int = MAX_CHARS) -> DataFrame:
    """(domain, name, nth, chunk_type, article_ref, hierarchy, section_title, content) of (domain, name, text) documents.

    A run of table lines is a chunk; other lines are packed, anew behind each table and
    each header line.  The last header line before a chunk names its section.
    """
    kind = lambda x: F.when(_is_table(x), "T").when((x == "") | x.rlike("(?iuU)" + PAGE), "S").when(x.rlike("(?iuU)" + SECTION), "H").otherwise("X")
    rows = docs.select("domain", "name", _lines(F.col("text")).alias("_l")).withColumn("_k", F.transform("_l", kind))
    tagged = F.transform("_l", lambda x, i: F.struct(x.alias("x"), F.get("_k", i).alias("k"), F.get("_k", i - 1).alias("before")))
    rows = rows.select("domain", "name", F.filter(tagged, lambda t: t["k"] != "S").alias("_t"))
    new = lambda t, i: (t["k"] == "H") | ~F.get("_t", i - 1)["k"].eqNullSafe(t["k"]) | ((t["k"] == "T") & ~t["before"].eqNullSafe(F.lit("T")))
    rows = rows.withColumn("_s", _where(F.col("_t"), new))
    runs = F.transform(
        "_s", lambda s, i: F.struct(s.alias("at"), F.get("_t", s)["k"].alias("k"), F.transform(F.slice("_t", s + 1, F.coalesce(F.get("_s", i + 1), F.size("_t")) - s), lambda t: t["x"]).alias("l"))
    )
    rows = rows.select("domain", "name", runs.alias("_r"))
    rows = rows.withColumn("_h", F.filter("_r", lambda r: r["k"] == "H"))

    def made(r: Column) -> Column:
        name = F.try_element_at(F.filter("_h", lambda h: h["at"] < r["at"]), F.lit(-1))["l"]
        section = strip(F.regexp_replace(F.get(name, F.lit(0)), r"^#+\s*", ""))
        one = lambda kind, content: F.struct(F.lit(kind).alias("kind"), section.alias("section"), content.alias("content"))
        texts = F.transform(_packed(r["l"], max_chars), lambda p: one("text", F.array_join(p, "\n\n")))
        return F.when(r["k"] == "T", F.array(one("table", F.array_join(r["l"], "\n")))).otherwise(texts)

    chunks = F.flatten(F.transform(F.filter("_r", lambda r: r["k"] != "H"), made))
    out = rows.select("domain", "name", F.posexplode(chunks).alias("_n", "_c"))
    section = F.col("_c.section")
    return out.select(
        "domain",
        "name",
        (F.col("_n") + 1).alias("nth"),
        F.col("_c.kind").alias("chunk_type"),
        F.lit(None).cast("string").alias("article_ref"),
        F.when(section != "", F.array(section)).otherwise(F.array().cast("array<string>")).alias("hierarchy"),
        section.alias("section_title"),
        F.col("_c.content").alias("content"),
    )


def chunk_documents(docs: DataFrame, normative: Column | None = None, compat: bool = True) -> DataFrame:
    """Chunks of (domain, name, text) documents; one without a text gives a row with ``error``, and no others are touched.

    ``normative`` tells the documents of articles from the others, by default by name.
    """
    own = docs.select("domain", "name", "text", F.coalesce(is_normative(F.col("name")) if normative is None else normative, F.lit(False)).alias("_normative"))
    read = own.filter("text IS NOT NULL")
    made = normative_chunks(read.filter("_normative"), compat).unionByName(section_chunks(read.filter("NOT _normative")))
    stem = F.regexp_replace("name", r"(?s)^(.*)\.[^.]*$", "$1")
    made = with_chunk_stats(made).select(
        F.format_string("%s_%s_chunk_%04d", "domain", stem, "nth").alias("chunk_id"),
        "domain",
        F.col("name").alias("source_document"),
        F.col("nth").alias("chunk_index"),
        "chunk_type",
        "article_ref",
        "hierarchy",
        "section_title",
        "content",
        "char_count",
        "word_count",
        "has_table",
        F.lit(None).cast("string").alias("error"),
    )
    failed = own.filter("text IS NULL").select("domain", F.col("name").alias("source_document"), F.lit("the document has no text").alias("error"))
    return made.unionByName(failed, allowMissingColumns=True)
