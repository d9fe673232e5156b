"""Structured Streaming jobs: incremental ingest, key dedup, question stream.

The reference adds one uploaded file at a time to a live collection and answers
questions one at a time.  Here both are streams over a file source:

* the stateless stages (clean, chunk, embed) run on the streaming DataFrame;
* the keyed insert runs in ``foreachBatch`` against the stored table, which is the
  truth: an anti-join drops keys already written, so a replayed micro-batch
  (after a lost executor or a restart) adds nothing;
* ranked cuts (top-k) are not allowed on a stream outside ``foreachBatch``, so
  retrieval for a batch of questions runs there too.

There is no event time in this domain, so no watermark: ``dropDuplicates`` state
would grow for ever, which is why dedup uses the target table instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import collection as CO


def file_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet", glob: str | None = None,
                max_files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.format(fmt).schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return reader.load(path)


def table_stream(spark: SparkSession, path: str, schema, max_files_per_trigger: int | None = None) -> DataFrame:
    """A Parquet table as a stream of its files, whether ``path`` is one file or a folder of part files.

    A stream takes a plain path for a folder and refuses a file; a pattern (the last letter in brackets) finds either.
    """
    path = path.rstrip("/")
    return file_stream(spark, f"{path[:-1]}[{path[-1]}]", schema, max_files_per_trigger=max_files_per_trigger)


def _run(stream: DataFrame, fn: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True) -> StreamingQuery:
    w = stream.writeStream.foreachBatch(fn).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def ingest_stream(spark: SparkSession, stream: DataFrame, prepare: Callable[[DataFrame], DataFrame],
                  collection_path: str, checkpoint: str, order=CO.ORDER, available_now: bool = True,
                  finish: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """New documents -> ``prepare`` (clean, chunk, embed, records) -> insert-if-absent into the collection.

    The later steps (embed, records) may be given as ``finish``: then only rows that are stored go through them.

    The stream is spread round-robin before the per-document work: a micro-batch
    of a few large files would otherwise be chunked and embedded by few tasks.
    """
    records = prepare(stream.repartition(spark.sparkContext.defaultParallelism * 2))

    def insert(batch: DataFrame, epoch_id: int) -> None:
        CO.insert_if_absent(spark, collection_path, batch, order=order, finish=finish)

    return _run(records, insert, checkpoint, available_now)


def append_new_keys(spark: SparkSession, path: str, batch: DataFrame, key: str, order: list[str]) -> None:
    """Append the first row of every key not yet stored at ``path`` (replay-safe)."""
    first = CO.first_per_key(batch, key, tuple(order))
    stored = CO.open_table(spark, path)  # only a missing folder is empty; any other fault stops the batch
    if stored is not None:
        first = first.join(stored.select(key), key, "left_anti")
    first.write.mode("append").parquet(path)


def dedup_stream(spark: SparkSession, stream: DataFrame, key: str, order: list[str], target: str, checkpoint: str,
                 available_now: bool = True) -> StreamingQuery:
    """Keep the first row per ``key`` ever seen; the target table remembers the keys."""
    def step(batch: DataFrame, epoch_id: int) -> None:
        append_new_keys(spark, target, batch, key, order)

    return _run(stream, step, checkpoint, available_now)


def query_stream(spark: SparkSession, questions: DataFrame, answer: Callable[[DataFrame], DataFrame], target: str,
                 checkpoint: str, key: str = "query_id", available_now: bool = True) -> StreamingQuery:
    """Every micro-batch of questions -> ``answer`` (retrieve + prompt) -> appended results.

    Results are keyed by question id and appended only when absent, so a replayed
    batch writes nothing twice.
    """
    def step(batch: DataFrame, epoch_id: int) -> None:
        out = answer(batch).withColumn("_epoch", F.lit(epoch_id).cast("bigint"))
        append_new_keys(spark, target, out, key, ["_epoch"])

    return _run(questions, step, checkpoint, available_now)
