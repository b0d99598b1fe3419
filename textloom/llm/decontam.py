"""Benchmark passages in documents, found by an FM-index over each shard of texts.

A shard is what a worker handles at once (about ``SHARD_BYTES`` of text, a longer
text alone).  Its words become numbers: those of the benchmark's vocabulary their
own, all others one separator; stretches between separators that are shorter than
the shortest phrase can't hold one and are left out of the index.  Of the rest the
suffix array is built by prefix doubling (each separator counts as a symbol of its
own, so no comparison runs on past one), from it the Burrows-Wheeler transform, and
on that a wavelet matrix.  All phrases are searched backward together, by ranks in
the matrix.  Occurrences are located by walking back to the next sampled suffix
position; every ``SAMPLE``-th position and every start of a stretch is sampled.
Spans of hits are merged for each document.

The benchmark is read in blocks of at most ``BLOCK_BYTES`` of text; each block goes to
the executors with the function and is one pass over the documents without a
shuffle, and a later pass adds its hits to those of the passes before.

Defined results: a null or empty text has no words and no hits; an item without
words has no phrase and never occurs; an item with fewer words than a window is one
phrase; items of one id count once; ids are compared as strings, a null id is the
empty string; repeated rows stay; empty tables give no rows or no hits; columns
named as the operator's own are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import giving_back, text_slices

WINDOW = 10
SAMPLE = 8
BLOCK_BYTES = 8 << 20
SHARD_BYTES = 4 << 20
#: UTF-8 bytes of words, after lower-casing A-Z: digits, a-z and all of any other character.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
OWN = ("n_words", "spans", "items")


def words_of(text: str | None) -> list[bytes]:
    return WORD.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []


class WaveletMatrix:
    """Ranks of symbols in a sequence: a bit vector with running counts for each bit of the symbols."""

    def __init__(self, symbols: np.ndarray, size: int):
        self.depth = max(1, int(size - 1).bit_length())
        self.zeros: list[np.ndarray] = []
        self.bits: list[np.ndarray] = []
        current = symbols
        for level in range(self.depth - 1, -1, -1):
            bit = (current >> level) & 1
            count = np.zeros(len(current) + 1, dtype=np.int32)
            np.cumsum(1 - bit, out=count[1:])
            self.zeros.append(count)
            self.bits.append(bit.astype(bool))
            current = np.concatenate([current[bit == 0], current[bit == 1]])
        self.first = self._down(np.arange(size), np.zeros(size, dtype=np.int64))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k, count in enumerate(self.zeros):
            bit = (symbol >> (self.depth - 1 - k)) & 1
            left = count[at]
            at = np.where(bit == 1, count[-1] + at - left, left)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often the symbol occurs before the position."""
        return self._down(symbol, at) - self.first[symbol]

    def read(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at a position and its rank there."""
        symbol = np.zeros(len(at), dtype=np.int64)
        for count, bits in zip(self.zeros, self.bits, strict=True):
            bit = bits[at]
            left = count[at]
            symbol = symbol * 2 + bit
            at = np.where(bit, count[-1] + at - left, left)
        return symbol, at - self.first[symbol]


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Order of the suffixes; zeros are separators, each less than all that follow it and than any word."""
    n = len(symbols)
    gaps = np.flatnonzero(symbols == 0)
    rank = symbols.astype(np.int64) + len(gaps)
    rank[gaps] = np.arange(len(gaps))
    width, top = 1, int(rank.max()) + 2
    while True:
        after = np.zeros(n, dtype=np.int64)
        if width < n:
            after[:-width] = rank[width:] + 1
        key = rank * top + after
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        fresh = np.empty(n, dtype=np.int64)
        step = np.empty(n, dtype=bool)
        step[0] = False
        np.not_equal(ordered[1:], ordered[:-1], out=step[1:])
        fresh[order] = np.cumsum(step)
        rank = fresh
        last = int(rank[order[-1]])
        if last == n - 1:
            return order
        width, top = width * 2, last + 2


class FMIndex:
    """Backward search and location in a sequence of words (from 1) and separators (0), which must end in one."""

    def __init__(self, symbols: np.ndarray, size: int, sample: int = SAMPLE):
        order = suffix_array(symbols)
        self.matrix = WaveletMatrix(symbols[order - 1], size)
        self.less = np.zeros(size + 1, dtype=np.int64)
        np.cumsum(np.bincount(symbols, minlength=size), out=self.less[1:])
        starts = np.zeros(len(symbols), dtype=bool)
        starts[0] = True
        starts[1:] = symbols[:-1] == 0
        self.marked = ((order % sample) == 0) | starts[order]
        self.place = np.cumsum(self.marked) - 1
        self.sampled = order[self.marked]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of the suffixes that begin with each phrase; rows of ``phrases`` are padded at the right."""
        low = np.zeros(len(phrases), dtype=np.int64)
        high = np.full(len(phrases), self.less[-1], dtype=np.int64)
        live = np.arange(len(phrases))
        for back in range(1, int(lengths.max(initial=0)) + 1):
            live = live[(high[live] > low[live])]
            on = live[lengths[live] >= back]
            if not len(on):
                break
            symbol = phrases[on, lengths[on] - back]
            low[on] = self.less[symbol] + self.matrix.rank(symbol, low[on])
            high[on] = self.less[symbol] + self.matrix.rank(symbol, high[on])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of the suffixes in these rows."""
        at, steps = rows.copy(), np.zeros(len(rows), dtype=np.int64)
        live = np.flatnonzero(~self.marked[at])
        while len(live):
            symbol, rank = self.matrix.read(at[live])
            at[live] = self.less[symbol] + rank
            steps[live] += 1
            live = live[~self.marked[at[live]]]
        return self.sampled[self.place[at]] + steps


class Phrases:
    """The windows of a block of items, each once, with the items that have it."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        index: dict[tuple[int, ...], int] = {}
        self.items: list[set[str]] = []
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            size = min(window, len(ids))
            for i in range(len(ids) - size + 1) if ids else ():
                at = index.setdefault(tuple(ids[i : i + size]), len(index))
                if at == len(self.items):
                    self.items.append(set())
                self.items[at].add(item)
        self.lengths = np.array([len(p) for p in index], dtype=np.int64)
        self.table = np.zeros((len(index), int(self.lengths.max(initial=1))), dtype=np.int64)
        for row, phrase in enumerate(index):
            self.table[row, : len(phrase)] = phrase
        self.shortest = int(self.lengths.min(initial=window)) if len(index) else window

    def find(self, words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, first word and phrase of every occurrence."""
        none = np.zeros(0, dtype=np.int64)
        get = self.vocabulary.get
        sizes = np.array([len(own) + 1 for own in words], dtype=np.int64)
        flat = np.zeros(int(sizes.sum()) + 1, dtype=np.int64)
        at = 1
        for own, size in zip(words, sizes.tolist(), strict=True):
            flat[at : at + size - 1] = [get(w, 0) for w in own]
            at += size
        begins = np.concatenate([[1], 1 + np.cumsum(sizes[:-1])]) if len(sizes) else none
        # Stretches of known words that are long enough, each with the separator behind it.
        known = np.concatenate([flat != 0, [False]])
        edges = np.flatnonzero(known[1:] != known[:-1]) + 1
        first, end = edges[0::2], edges[1::2]
        fits = end - first >= self.shortest
        first, end = first[fits], end[fits]
        if not len(first) or not len(self.items):
            return none, none, none
        spans = end - first + 1
        offsets = np.cumsum(spans) - spans
        origin = np.arange(int(spans.sum())) + np.repeat(first - offsets, spans)
        padded = np.concatenate([flat, [0]])
        symbols = padded[origin]
        symbols[offsets + spans - 1] = 0
        index = FMIndex(symbols, len(self.vocabulary) + 1)
        low, high = index.search(self.table, self.lengths)
        counts = np.maximum(high - low, 0)
        phrase = np.repeat(np.arange(len(counts)), counts)
        rows = np.arange(int(counts.sum())) + np.repeat(low - (np.cumsum(counts) - counts), counts)
        place = origin[index.locate(rows)]
        doc = np.searchsorted(begins, place, side="right") - 1
        return doc, place - begins[doc], phrase


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans that overlap or touch, joined."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def blocks(items: DataFrame, id_col: str, text_col: str, most: int = BLOCK_BYTES) -> Iterator[list[tuple[str, str]]]:
    """The items in blocks of bounded size."""
    block, held = [], 0
    rows = items.filter(F.col(text_col).isNotNull()).select(F.coalesce(F.col(id_col).cast("string"), F.lit("")), text_col)
    for item, text in rows.toLocalIterator():
        if block and held + len(text) > most:
            yield block
            block, held = [], 0
        block.append((item, text))
        held += len(text)
    yield block


def find(
    docs: DataFrame,
    items: DataFrame,
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
    cut_col: str | None = None,
) -> DataFrame:
    """``docs`` with n_words, spans (merged, of words: from, to) and items (ids as sorted strings).

    With ``cut_col`` also the text without its spans, as :func:`remove` leaves it, in the same pass.
    """
    rest = [f for f in docs.schema.fields if f.name.lower() not in (*OWN, (cut_col or OWN[0]).lower())]
    names = [f.name for f in rest]
    at = names.index(text_col)
    span = pa.list_(pa.list_(pa.int32()))
    schema = T.StructType(
        [
            *rest,
            T.StructField("n_words", T.LongType(), False),
            T.StructField("spans", T.ArrayType(T.ArrayType(T.IntegerType())), False),
            T.StructField("items", T.ArrayType(T.StringType()), False),
        ]
    )

    def a_pass(frame: DataFrame, block: list[tuple[str, str]], first: bool, cut: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            phrases = Phrases(block, window)
            for whole in batches:
                for batch in text_slices(whole, at, SHARD_BYTES):
                    words = [words_of(x) for x in batch.column(at).to_pylist()]
                    doc, start, phrase = phrases.find(words)
                    spans: dict[int, list[tuple[int, int]]] = {}
                    items: dict[int, set[str]] = {}
                    for d, s, p in zip(doc.tolist(), start.tolist(), phrase.tolist(), strict=True):
                        spans.setdefault(d, []).append((s, s + int(phrases.lengths[p])))
                        items.setdefault(d, set()).update(phrases.items[p])
                    if not first:
                        for d, (old, ids) in enumerate(zip(batch.column(len(names) + 1).to_pylist(), batch.column(len(names) + 2).to_pylist(), strict=True)):
                            if old:
                                spans.setdefault(d, []).extend(map(tuple, old))
                                items.setdefault(d, set()).update(ids)
                    merged = [merge(spans.get(d, [])) for d in range(len(words))]
                    columns = [
                        *batch.columns[: len(names)],
                        pa.array([len(own) for own in words], pa.int64()),
                        pa.array(merged, span),
                        pa.array([sorted(items.get(d, ())) for d in range(len(words))], pa.list_(pa.string())),
                    ]
                    if cut:
                        columns.append(pa.array([cut_spans(x, s) if s else x for x, s in zip(batch.column(at).to_pylist(), merged, strict=True)], pa.string()))
                    yield pa.RecordBatch.from_arrays(columns, names=[*names, *OWN, *([cut_col] if cut else [])])

        return frame.mapInArrow(giving_back(run), T.StructType([*schema.fields, T.StructField(cut_col, T.StringType())]) if cut else schema)

    found, first = docs.select(*names), True
    held = None
    for block in blocks(items, item_id_col, item_text_col, block_bytes):
        if held is not None:
            found, first = a_pass(found, held, first, False), False
        held = block
    return a_pass(found, held, first, cut_col is not None)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + (s[1] - s[0]).cast("long"))
    return found.select(
        id_col,
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def cut_spans(text: str, spans: list) -> str:
    """The text without the words of these spans and what lies between them; a line feed stands for each."""
    raw = text.encode("utf-8", "surrogatepass")
    at = [m.span() for m in WORD.finditer(raw.lower())]
    out, done = [], 0
    for a, b in spans:
        out += [raw[done : at[a][0]], b"\n"]
        done = at[b - 1][1]
    out.append(raw[done:])
    return b"".join(out).decode("utf-8", "surrogatepass")


def remove(found: DataFrame, text_col: str = "text") -> DataFrame:
    """Documents as :func:`find` gives them, with the hit spans cut out of their texts and without its columns."""
    rest = [f for f in found.schema.fields if f.name not in OWN]
    names = [f.name for f in rest]
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column(len(names)).to_pylist()
            texts = [cut_spans(x, s) if s else x for x, s in zip(batch.column(at).to_pylist(), spans, strict=True)]
            columns = batch.columns[: len(names)]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return found.select(*names, "spans").mapInArrow(run, T.StructType(rest))
