"""The chunk collection: records, defaults, validation, insert-if-absent, lookups.

Layout: Parquet below one folder, partitioned by ``bucket = pmod(xxhash64(chunk_id), B)``
and sorted by title inside each file.  The bucket column lets an insert read
only the buckets its batch touches (the semi-join on ``bucket`` is pruned by
dynamic partition pruning), and the title sort gives row-group statistics
something to skip on for title lookups.

Record: ``chunk_id STRING, embedding ARRAY<FLOAT>, metadata STRUCT<title, source,
token_length, embedding_model>, document STRING`` plus ``year`` and ``chunk_index``
(the order keys of first-wins) and ``bucket``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.text import chunk_id as chunk_id_expr
from ..functions.text import token_length

#: bucket count is fixed when a collection is created; pick about (collection size / 1 GB)
DEFAULT_BUCKETS = 64
ORDER = ("year", "source", "chunk_index")


def default_metadata(df: DataFrame) -> DataFrame:
    """``metadata`` struct with the reference's defaults for missing fields."""
    def col_or_null(name, typ):
        return F.col(name) if name in df.columns else F.lit(None).cast(typ)

    meta = F.struct(
        F.coalesce(col_or_null("title", "string"), F.lit(P.DEFAULT_TITLE)).alias("title"),
        F.coalesce(col_or_null("source_file", "string"), F.lit(P.DEFAULT_SOURCE)).alias("source"),
        F.coalesce(col_or_null("token_length", "bigint").cast("bigint"), F.lit(P.DEFAULT_TOKEN_LENGTH).cast("bigint")).alias("token_length"),
        F.coalesce(col_or_null("embedding_model", "string"), F.lit(P.DEFAULT_MODEL)).alias("embedding_model"),
    )
    doc = F.coalesce(col_or_null("chunk_content", "string"), F.lit(""))
    return df.withColumn("metadata", meta).withColumn("document", doc)


def is_valid_embedding(col="embedding") -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return c.isNotNull() & (F.size(c) > 0)


def valid_embedding(df: DataFrame, col: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """``(valid, skipped)``: rows with a non-empty vector, and the rest (reported, not stored)."""
    ok = is_valid_embedding(col)
    return df.where(ok), df.where(~ok | ok.isNull())


def to_records(embedded: DataFrame, buckets: int = DEFAULT_BUCKETS) -> DataFrame:
    """Embedded chunks -> collection records (invalid vectors removed)."""
    df = embedded
    if "token_length" not in df.columns:
        df = df.withColumn("token_length", token_length("chunk_content"))
    if "source_file" not in df.columns:
        df = df.withColumn("source_file", F.col("title"))
    if "chunk_id" not in df.columns:
        df = df.withColumn("chunk_id", chunk_id_expr("title", "chunk_index"))
    df = default_metadata(df)
    df, _ = valid_embedding(df)
    keep = ["chunk_id", "embedding", "metadata", "document"] + [c for c in ("year", "source", "chunk_index", "doc_id") if c in df.columns]
    return df.select(*keep).withColumn("bucket", F.pmod(F.xxhash64("chunk_id"), F.lit(buckets)).cast("int"))


def first_per_key(df: DataFrame, key: str = "chunk_id", order: tuple[str, ...] = ORDER,
                  also: tuple[str, ...] = ()) -> DataFrame:
    """One row per key, the smallest by ``order``.

    ``min_by`` is a partial aggregate: each map task already reduces a hot key to
    one row, so a key holding a third of all rows never lands whole in one task.
    ``also`` names columns that are functions of the key (e.g. its bucket) to group
    by as well, so a later join on ``also + key`` reuses this shuffle.
    """
    order = [c for c in order if c in df.columns] + [key]
    group = list(also) + [key]
    cols = [c for c in df.columns if c not in group]
    best = F.min_by(F.struct(*cols), F.struct(*order))
    return df.groupBy(*group).agg(best.alias("_r")).select(*group, "_r.*")


def open_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The stored table, None where nothing is stored; any other fault is raised."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


open_collection = open_table


def _layout_path(path: str) -> str:
    return path.rstrip("/") + ".layout"


def stored_buckets(spark: SparkSession, path: str) -> int | None:
    """The bucket count that the collection was created with."""
    layout = open_table(spark, _layout_path(path))
    return None if layout is None else layout.first()["buckets"]


def in_buckets(df: DataFrame, buckets: int, key: str = "chunk_id") -> DataFrame:
    return df.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))


def insert_if_absent(spark: SparkSession, path: str, batch: DataFrame, key: str = "chunk_id",
                     order: tuple[str, ...] = ORDER, buckets: int = DEFAULT_BUCKETS,
                     finish: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Append the records whose key is not yet in the collection at ``path``.

    The bucket of every record follows from the count stored with the collection, not
    from the batch, so two batches can't place one key in two buckets; ``buckets`` is
    used for a collection that does not exist yet.

    Repeated keys in the batch keep the first by ``order``; keys already stored are
    left unchanged (the reference's behaviour).  Replaying the
    same batch writes nothing, which makes a retried micro-batch harmless.

    ``finish`` makes records of the batch's rows (embeds them, say) where they are written: rows that are not stored are not
    embedded, and no vector is shuffled.  It keeps every row and the key; mark functions of its own that are dear
    ``asNondeterministic``, or Spark calls them for a filter on their results before the shuffle too.
    """
    existing = open_table(spark, path)
    stored = stored_buckets(spark, path)
    if existing is not None and stored is None:
        raise ValueError(f"{path} holds a collection without a stored bucket count")
    if stored is None:
        stored = buckets
        _write_layout(spark, path, buckets)
    batch = first_per_key(in_buckets(batch, stored, key), key, order, also=("bucket",))  # as the anti-join needs
    if existing is not None:
        # Only the buckets the batch touches are read (dynamic partition pruning).
        touched = batch.select("bucket").distinct()
        keys = existing.select("bucket", key).join(touched, "bucket", "left_semi")
        # Stored keys that the batch repeats: a semi-join whose right side (the
        # batch's keys) AQE broadcasts when it is small, so a small upload never
        # shuffles the collection's keys; the result is at most the batch's size.
        present = keys.join(batch.select("bucket", key), ["bucket", key], "left_semi")
        batch = batch.join(present, ["bucket", key], "left_anti")
    _write(batch, path, "append", stored, key, finish)


def rebuild_collection(spark: SparkSession, path: str, batch: DataFrame, key: str = "chunk_id",
                       order: tuple[str, ...] = ORDER, buckets: int = DEFAULT_BUCKETS, unique: bool = False,
                       finish: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Clear the collection and load ``batch`` (first per key wins) in ``buckets`` buckets.

    ``unique`` says that the batch holds every key once (winners picked before embedding, say); ``finish`` as in
    ``insert_if_absent``.
    """
    _write_layout(spark, path, buckets)
    rows = in_buckets(batch, buckets, key)
    _write(rows if unique else first_per_key(rows, key, order, also=("bucket",)), path, "overwrite", buckets, key, finish)


def _write_layout(spark: SparkSession, path: str, buckets: int) -> None:
    spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.mode("overwrite").parquet(_layout_path(path))


def _write(df: DataFrame, path: str, mode: str, buckets: int = DEFAULT_BUCKETS, key: str = "chunk_id",
           finish: Callable[[DataFrame], DataFrame] | None = None) -> None:
    out = placed(df, buckets, key, finish).sortWithinPartitions("bucket", "metadata.title", "chunk_id")
    out.write.mode(mode).partitionBy("bucket").parquet(path)


def placed(df: DataFrame, buckets: int, key: str, finish: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The rows dealt out by bucket, then finished."""
    # REBALANCE on the bucket keeps a bucket's rows together in few files, and AQE
    # splits a large (or skewed) bucket into advisory-sized tasks instead of one
    # task per bucket.  The sort starts with the partition column, which the
    # partitioned writer requires (otherwise it re-sorts by bucket alone), so rows
    # stay ordered by title inside each file.
    out = df.hint("rebalance", "bucket")
    return out if finish is None else in_buckets(finish(out.drop("bucket")), buckets, key)


def list_titles(collection: DataFrame) -> DataFrame:
    """Distinct titles; a missing title reads as ``Unknown``."""
    return collection.select(F.coalesce(F.col("metadata.title"), F.lit(P.DEFAULT_TITLE)).alias("title")).distinct()


def get_by_title(collection: DataFrame, title: str, fields: tuple[str, ...] = ("chunk_id", "document", "metadata")) -> DataFrame:
    """Equality lookup on ``metadata.title`` (pushed to the Parquet scan)."""
    return collection.where(F.col("metadata.title") == F.lit(title)).select(*fields)
