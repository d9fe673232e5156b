"""A chunk collection in versions: readers pin one, writers publish the next in one step.

``<path>/write=<id>/bucket=<b>`` holds the rows that one write gave a bucket; nothing there is ever changed.
``<path>.versions`` is a small Parquet table ``version, bucket, folder``: the folder of every bucket that holds rows, for
each version.  A version's rows are one file, so a reader sees the whole version or none of it, and a write that ends half
way leaves only a folder that no version names.  A version without rows has one row with a null bucket.

``upsert`` replaces stored records by the batch's records of the same key and adds the others.  It rewrites the buckets
that the batch touches and names the old folders for the rest, so its work follows the touched buckets, not the collection.
Records of keys that the batch does not hold stay, other chunks of the same title included.

One writer at a time: of two that publish the same version, the one with the larger write id is read.  Folders of old
versions stay, as readers may have pinned them.

Defined cases: repeated keys of a batch keep the first by ``order``; a null key is a key; an empty batch publishes nothing;
a batch may lack nullable columns of the collection and bring new ones (each side's missing columns are null).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from . import collection as CO

_VERSION = "version long, bucket int, folder string, write string, buckets int"


def _table(path: str) -> str:
    return path.rstrip("/") + ".versions"


def _folders(spark: SparkSession, path: str, version: int | None = None) -> tuple[int | None, int | None, dict[int, str]]:
    """(version, bucket count, bucket -> folder) of a version, the newest if none is named."""
    table = CO.open_table(spark, _table(path))
    if table is None:
        if version is not None:
            raise ValueError(f"{path} has no version {version}")
        return None, None, {}
    if version is None:
        version = table.agg(F.max("version")).first()[0]
    # At most one row for each bucket and writer of the version.
    rows = table.where(F.col("version") == version).collect()
    if not rows:
        raise ValueError(f"{path} has no version {version}")
    last = max(r["write"] for r in rows)
    return version, rows[0]["buckets"], {r["bucket"]: r["folder"] for r in rows if r["write"] == last and r["bucket"] is not None}


def newest_version(spark: SparkSession, path: str) -> int | None:
    return _folders(spark, path)[0]


def _read(spark: SparkSession, path: str, folders: dict[int, str]) -> DataFrame | None:
    if not folders:
        return None
    return spark.read.option("basePath", path).option("mergeSchema", "true").parquet(*sorted(folders.values())).drop("write")


def read_version(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """The collection at a version (the newest by default); None if it holds no rows.

    The files are named when this is called, so the frame stays the same whatever is published later.
    """
    return _read(spark, path, _folders(spark, path, version)[2])


def _write_rows(spark: SparkSession, path: str, rows: DataFrame) -> tuple[str, dict[int, str]]:
    """``rows`` are dealt out by bucket already."""
    write = uuid.uuid4().hex
    folder = f"{path.rstrip('/')}/write={write}"
    rows.sortWithinPartitions("bucket", "metadata.title", "chunk_id").write.partitionBy("bucket").parquet(folder)
    # Folder names only: a scan of the partition column reads no file's rows beyond its footer.
    held = spark.read.parquet(folder).select("bucket").distinct().collect()
    return write, {r["bucket"]: f"{folder}/bucket={r['bucket']}" for r in held}


def _publish(spark: SparkSession, path: str, version: int, write: str, buckets: int, folders: dict[int, str]) -> int:
    rows = [(version, b, f, write, buckets) for b, f in sorted(folders.items())] or [(version, None, None, write, buckets)]
    spark.createDataFrame(rows, _VERSION).coalesce(1).write.mode("append").parquet(_table(path))
    return version


def reset(spark: SparkSession, path: str, buckets: int = CO.DEFAULT_BUCKETS) -> int:
    """Publish a version without rows; earlier versions stay readable."""
    return _publish(spark, path, (newest_version(spark, path) or 0) + 1, uuid.uuid4().hex, buckets, {})


def rebuild(spark: SparkSession, path: str, batch: DataFrame, key: str = "chunk_id", order: tuple[str, ...] = CO.ORDER,
            buckets: int = CO.DEFAULT_BUCKETS, finish: Callable[[DataFrame], DataFrame] | None = None) -> int:
    """Publish a version that holds ``batch`` alone (first per key); readers see the old one until it is whole.

    ``finish`` makes records of the batch's rows where they are written, as in ``collection.insert_if_absent``.
    """
    version = newest_version(spark, path) or 0
    rows = CO.first_per_key(CO.in_buckets(batch, buckets, key), key, order, also=("bucket",))
    if batch.isEmpty():  # not the rows picked from it: that would shuffle the batch twice
        return reset(spark, path, buckets)
    write, folders = _write_rows(spark, path, CO.placed(rows, buckets, key, finish))
    return _publish(spark, path, version + 1, write, buckets, folders)


def upsert(spark: SparkSession, path: str, batch: DataFrame, key: str = "chunk_id", order: tuple[str, ...] = CO.ORDER,
           buckets: int = CO.DEFAULT_BUCKETS, finish: Callable[[DataFrame], DataFrame] | None = None) -> int | None:
    """Replace or add the batch's records and publish the next version; the version that then holds.

    ``finish`` as in ``rebuild``.
    ``buckets`` is used for a collection that does not exist yet.
    """
    version, stored, folders = _folders(spark, path)
    buckets = stored or buckets
    stage = scratch_path(spark, "upsert-batch")  # read for its buckets, its keys and its rows
    CO.first_per_key(CO.in_buckets(batch, buckets, key), key, order, also=("bucket",)).write.parquet(stage)
    new = spark.read.parquet(stage)
    touched = {r["bucket"] for r in new.select("bucket").distinct().collect()}  # at most the bucket count
    if not touched:
        return version
    old = _read(spark, path, {b: f for b, f in folders.items() if b in touched})
    rows = CO.placed(new, buckets, key, finish)
    if old is not None:
        given = new.select("bucket", F.col(key).alias("_given"))
        same = (old["bucket"] == given["bucket"]) & old[key].eqNullSafe(given["_given"])
        kept = CO.placed(old.join(given, same, "left_anti"), buckets, key)
        rows = rows.unionByName(kept, allowMissingColumns=True)
    write, written = _write_rows(spark, path, rows)
    return _publish(spark, path, (version or 0) + 1, write, buckets, {**folders, **written})
