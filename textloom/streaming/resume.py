"""New files taken up as they come; items that are done are left out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.joins import pending
from ..sources.io import append_jsonl, read_jsonl


def resume_stream(
    spark: SparkSession, source: str, schema: T.StructType | str, out: str, out_schema: T.StructType | str, keys: list[str], work: Callable[[DataFrame], DataFrame], checkpoint: str
) -> StreamingQuery:
    """Runs ``work`` on the rows of new JSONL files whose keys ``out`` doesn't have, and appends the results.

    A batch that is repeated after a failure finds its finished rows in ``out``.
    """

    def batch(rows: DataFrame, _: int) -> None:
        append_jsonl(work(pending(rows.dropDuplicates(keys), read_jsonl(spark, out, out_schema), keys)), out)

    stream = spark.readStream.schema(schema).json(source)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
