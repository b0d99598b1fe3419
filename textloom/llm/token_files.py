"""Token ids as Parquet files: list columns, delta encoding, small row groups and page indexes.

Documents are dealt to files by ranges of their id and sorted inside, so that the
files in order of ``part``, and the rows in each, are in ascending order of id.
Ids are encoded on the writing side, after the sort: texts are shuffled once and
ids never.  Columns: id, ``part`` (number of the file's range), ``local_start``
(ids before the document in its file), ``n_tokens``, ``tokens`` (list<int>).  The
files are Parquet format v2 without dictionaries, so integers are stored as
DELTA_BINARY_PACKED; row groups and pages have set sizes; the writer adds column
and offset indexes, by which a reader that wants a few documents, or only the
lengths, skips the pages of tokens it doesn't need.

The global start of a document is its local start plus the sizes of the parts
before; those are summed from the two small columns alone, and there is one sum
per part, a number that the writer sets.

Defined results: a null or empty text has only the end id; strings of added tokens
in a text become their ids, as by the library's default; a null id sorts first; repeated ids keep all their rows
in one part, ordered by text; an empty table writes an empty file; extra columns
aren't stored.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpoint_root, text_slices
from .segments import PLAIN, SegmentEncoder, gather, spans

#: A space and a word of letters alone.
SPACED = PLAIN.replace("^", "^ ", 1)
ROW_GROUP_BYTES = 16 << 20
PAGE_BYTES = 256 << 10
#: Segments that a worker remembers, and new pieces that the tokenizer gets as one text.
CACHE_SEGMENTS = 500_000
JOINED = 100


@lru_cache(maxsize=2)
def _tools(path: str, pattern: str) -> tuple:
    """The memory of segments, the tokenizer itself and the strings of its added tokens."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    # In a byte-level vocabulary every character of a token stands for one byte.
    vocabulary = tokenizer.get_vocab()
    width = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
    for token, rank in vocabulary.items():
        width[rank] = len(token)

    def joined(pieces: list[str]) -> list[int]:
        """Ids of pieces that each begin with the only space in them, so that the tokenizer cuts them apart itself."""
        texts = ["".join(pieces[at : at + JOINED]) for at in range(0, len(pieces), JOINED)]
        return [i for part in tokenizer.encode_batch_fast(texts, add_special_tokens=False) for i in part.ids]

    def alone(pieces: list[str]) -> list[int]:
        return tokenizer.encode(pieces, is_pretokenized=True, add_special_tokens=False).ids

    def encode_pieces(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        listed = pa.array(pieces, pa.string())
        size = np.asarray(pc.binary_length(listed), dtype=np.int64)
        plain = np.asarray(pc.match_substring_regex(listed, SPACED), dtype=bool)
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        out = []
        for way, own in ((joined, order[: int(plain.sum())]), (alone, order[int(plain.sum()) :])):
            for at in range(0, len(own), 50_000):
                out.append(np.array(way([pieces[i] for i in own[at : at + 50_000].tolist()]), dtype=np.int32))
        ids = np.concatenate([np.zeros(0, np.int32), *out])
        # No token reaches beyond its piece, so the bytes tell where each piece ends.
        held = np.diff(np.searchsorted(np.cumsum(width[ids]), np.cumsum(size[order]), side="right"), prepend=0)
        counts, starts = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
        counts[order], starts[order] = held, np.cumsum(held) - held
        return gather(ids, starts, counts), counts

    return SegmentEncoder(regex.compile(pattern), encode_pieces, CACHE_SEGMENTS), tokenizer, added


def encode_texts(texts: pa.Array, path: str, pattern: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts one after another, and how many each has.

    The tokenizer cuts texts by ``pattern`` and encodes each piece alone, so it
    is given every piece that this worker doesn't remember, once for a batch.  Texts
    that hold an added token it cuts and encodes as a whole.
    """
    encoder, tokenizer, added = _tools(path, pattern)
    special = np.zeros(len(texts), bool)
    for token in added:
        special |= np.asarray(pc.fill_null(pc.match_substring(texts, token), False))
    if not special.any():
        return encoder.encode(texts)
    flat, rest = encoder.encode(texts.filter(pa.array(~special)))
    whole = [np.array(tokenizer.encode(x, add_special_tokens=False).ids, dtype=np.int32) for x in texts.filter(pa.array(special)).to_pylist()]
    counts = np.zeros(len(texts), np.int64)
    counts[~special], counts[special] = rest, [len(x) for x in whole]
    starts = np.zeros(len(texts), np.int64)
    starts[~special] = np.cumsum(rest) - rest
    starts[special] = len(flat) + np.cumsum(counts[special]) - counts[special]
    return gather(np.concatenate([flat, *whole]), starts, counts), counts


def write(
    docs: DataFrame,
    folder: str,
    path: str,
    pattern: str,
    end_id: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    parts: int | None = None,
    row_group_bytes: int = ROW_GROUP_BYTES,
    page_bytes: int = PAGE_BYTES,
) -> None:
    """Writes the token files of ``docs`` to ``folder``."""
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = (
        docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        .repartitionByRange(parts, "id")
        .sortWithinPartitions("id", "text")
        .select("id", F.spark_partition_id().alias("part"), "text")
    )
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = 0
        item = pa.field("element", pa.int32(), False)
        for whole in batches:
            for batch in text_slices(whole, 2, 4 << 20):
                ids, counts = encode_texts(batch.column(2), path, pattern)
                sizes = counts + 1
                offsets = np.concatenate([[0], np.cumsum(sizes)])
                flat = np.full(int(offsets[-1]), end_id, np.int32)
                flat[spans(offsets[:-1], counts)] = ids
                tokens = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat), type=pa.list_(item))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(offsets[:-1] + start), pa.array(sizes), tokens],
                    names=["id", "part", "local_start", "n_tokens", "tokens"],
                )
                start += int(offsets[-1])

    rows = ordered.mapInArrow(run, f"id {kind}, part int, local_start long, n_tokens long, tokens array<int>")
    (
        rows.write.mode("overwrite")
        .option("compression", "zstd")
        .option("parquet.writer.version", "PARQUET_2_0")
        .option("parquet.enable.dictionary", "false")
        .option("parquet.block.size", str(row_group_bytes))
        .option("parquet.page.size", str(page_bytes))
        .parquet(folder)
    )


def read(spark: SparkSession, folder: str, id_col: str = "doc_id", tokens: bool = True) -> DataFrame:
    """id, start, n_tokens and, if asked for, tokens, from the files."""
    files = spark.read.parquet(folder)
    sums = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    bases = sums.select(F.col("part"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    rows = files.join(F.broadcast(bases), "part")
    out = [F.col("id").alias(id_col), (F.col("base") + F.col("local_start")).alias("start"), "n_tokens"]
    return rows.select(*out, *(["tokens"] if tokens else []))


def checksums(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Replaces ``tokens`` by the unsigned CRC-32 of the ids as little-endian 32-bit integers."""
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = batch.column(3)
            flat = np.ascontiguousarray(tokens.values.to_numpy(zero_copy_only=False), dtype="<i4")
            raw, offsets = memoryview(flat).cast("B"), tokens.offsets.to_numpy().tolist()
            sums = [zlib.crc32(raw[a * 4 : b * 4]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sums, pa.int64())], names=[id_col, "start", "n_tokens", "ids_crc32"])

    return rows.select(id_col, "start", "n_tokens", "tokens").mapInArrow(run, f"{id_col} {kind}, start long, n_tokens long, ids_crc32 long")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_root(spark).rstrip('/')}/textloom-{name}-{uuid.uuid4().hex}"
