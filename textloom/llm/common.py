"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only where nothing is set and the master is local (tests) a temporary
    folder stands in; on a cluster without the setting this raises.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not root:
        root = sc._jsc.sc().getCheckpointDir()
        root = root.get() if root.isDefined() else None
    if not root:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="textloom-checkpoint-")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(root)
    return root


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: lineage ends in the shared folder."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of plans that nothing holds any more; else they stay until the driver happens to collect garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def remove_folder(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def apart(docs: DataFrame, own: Iterable[str]) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with columns renamed whose names are among an operator's ``own`` (letter case aside), and the new names by the old.

    ``withColumnsRenamed`` by the reverse of it gives a result its names back.
    """
    reserved = {x.lower() for x in own}
    taken, renamed = reserved | {c.lower() for c in docs.columns}, {}
    for c in docs.columns:
        if c.lower() in reserved:
            new = c
            while new.lower() in taken:
                new += "_"
            taken.add(new.lower())
            renamed[c] = new
    return (docs.withColumnsRenamed(renamed) if renamed else docs), renamed


def named_back(found: DataFrame, renamed: dict[str, str]) -> DataFrame:
    return found.withColumnsRenamed({new: old for old, new in renamed.items()}) if renamed else found


def remainder(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus`` (a null id hashes as the empty text)."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def strings(column: pa.Array) -> list[str]:
    """Texts of an Arrow column; null reads as the empty text."""
    return ["" if x is None else x for x in column.to_pylist()]


def crc32_text(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass"))


#: ASCII A-Z to a-z and nothing else.
ASCII_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}

ASCII_UPPER_TEXT = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(col: Column) -> Column:
    return F.translate(col, ASCII_UPPER_TEXT, ASCII_UPPER_TEXT.lower())


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers (multiply and xor-shift)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Bytes of a batch that Spark hands to a Python worker; it and the JVM hold some at once.
ARROW_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Batches of at most about ``ARROW_BYTES`` for Python workers of this session; a smaller setting stays.

    Spark's own limit is a number of rows, 10000, which is 30 MB of ordinary documents.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jsparkSession.sessionState().conf().getConfString(key)
    if not now.isdigit() or int(now) > ARROW_BYTES:
        spark.conf.set(key, str(ARROW_BYTES))


def give_back() -> None:
    """Memory that this process has freed goes back to the system; else an idle worker keeps that of its largest batch."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def giving_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for ``mapInArrow`` that ends with :func:`give_back`."""

    @wraps(run)
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


#: Bytes of text that a worker handles before it hands a batch on.
BATCH_BYTES = 8 << 20


def text_slices(batch: pa.RecordBatch, column: int, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``most`` bytes of text each; a longer text is a part of its own."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0))
    ends, held = [], 0
    for i, n in enumerate(sizes.tolist()):
        held += n
        if held >= most:
            ends.append(i + 1)
            held = 0
    start = 0
    for end in [*ends, len(sizes)]:
        if end > start:
            yield batch.slice(start, end - start)
        start = end
