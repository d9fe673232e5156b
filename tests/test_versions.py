"""Versions of a collection: whole or unseen, pinned readers, copy on write of touched buckets."""

import pytest
from pyspark.sql import functions as F

from lodestar.operators import versions as VE
from lodestar.session import scratch_path

SCHEMA = "chunk_id string, year int, source string, chunk_index int, document string, metadata struct<title: string>"


def records(spark, rows):
    return spark.createDataFrame([(k, y, "s", 0, d, ("t",)) for k, y, d in rows], SCHEMA)


def held(df):
    return sorted(((r["chunk_id"], r["document"]) for r in df.collect()), key=str) if df is not None else []


def test_upsert_replaces_and_adds(spark):
    path = scratch_path(spark, "versions")
    assert VE.newest_version(spark, path) is None and VE.read_version(spark, path) is None
    assert VE.rebuild(spark, path, records(spark, [("a", 1, "a1"), ("a", 2, "a2"), ("b", 1, "b1"), (None, 1, "n1")])) == 1
    first = VE.read_version(spark, path)
    assert VE.upsert(spark, path, records(spark, [("b", 3, "late"), ("b", 2, "b2"), ("c", 1, "c1"), (None, 5, "n2")])) == 2
    assert held(VE.read_version(spark, path)) == sorted([("a", "a1"), ("b", "b2"), ("c", "c1"), (None, "n2")], key=str)
    old = sorted([("a", "a1"), ("b", "b1"), (None, "n1")], key=str)
    assert held(first) == old and held(VE.read_version(spark, path, 1)) == old
    assert VE.upsert(spark, path, records(spark, [])) == 2
    assert VE.reset(spark, path) == 3 and VE.read_version(spark, path) is None
    assert held(VE.read_version(spark, path, 1)) == old
    with pytest.raises(ValueError, match="no version 9"):
        VE.read_version(spark, path, 9)


def test_upsert_starts_a_collection_and_keeps_its_buckets(spark):
    path = scratch_path(spark, "versions")
    assert VE.upsert(spark, path, records(spark, [("a", 1, "x")]), buckets=4) == 1
    assert VE.upsert(spark, path, records(spark, [("a", 1, "y")]), buckets=64) == 2
    assert held(VE.read_version(spark, path)) == [("a", "y")]


def test_only_touched_buckets_are_written(spark):
    path = scratch_path(spark, "versions")
    VE.rebuild(spark, path, records(spark, [(f"k{n}", 1, "old") for n in range(200)]), buckets=16)
    before = VE._folders(spark, path)[2]
    VE.upsert(spark, path, records(spark, [("k7", 1, "new")]))
    after = VE._folders(spark, path)[2]
    assert len(before) == 16 and sum(before[b] != after[b] for b in before) == 1
    now = dict(held(VE.read_version(spark, path)))
    assert len(now) == 200 and {k for k, d in now.items() if d == "new"} == {"k7"}


def test_a_write_that_ends_half_way_is_not_seen(spark, monkeypatch):
    path = scratch_path(spark, "versions")
    VE.rebuild(spark, path, records(spark, [("a", 1, "a1"), ("b", 1, "b1")]))
    bad = records(spark, [("a", 1, "a2"), ("z", 1, "z")]).withColumn(
        "document", F.when(F.col("chunk_id") == "z", F.raise_error(F.lit("lost")).cast("string")).otherwise(F.col("document")))
    with pytest.raises(Exception, match="lost"):
        VE.upsert(spark, path, bad)
    assert held(VE.read_version(spark, path)) == [("a", "a1"), ("b", "b1")]

    def lost(*args):
        raise RuntimeError("driver lost before the version was published")

    with monkeypatch.context() as m:
        m.setattr(VE, "_publish", lost)
        for write in (VE.upsert, VE.rebuild):
            with pytest.raises(RuntimeError, match="driver lost"):
                write(spark, path, records(spark, [("a", 1, "a2"), ("c", 1, "c2")]))
    assert VE.newest_version(spark, path) == 1
    assert held(VE.read_version(spark, path)) == [("a", "a1"), ("b", "b1")]
    assert VE.upsert(spark, path, records(spark, [("a", 1, "a3")])) == 2
    assert held(VE.read_version(spark, path)) == [("a", "a3"), ("b", "b1")]


def test_a_batch_with_other_columns(spark):
    path = scratch_path(spark, "versions")
    VE.rebuild(spark, path, records(spark, [("a", 1, "a1"), ("b", 1, "b1")]).withColumn("note", F.lit("n")), buckets=1)
    VE.upsert(spark, path, records(spark, [("b", 1, "b2")]).withColumn("_given", F.lit(1)))
    got = {r["chunk_id"]: (r["document"], r["note"], r["_given"]) for r in VE.read_version(spark, path).collect()}
    assert got == {"a": ("a1", "n", None), "b": ("b2", None, 1)}


def test_only_stored_rows_are_finished(spark, tmp_path):
    """Losers of a key and keys that are stored already never reach ``finish``."""
    from pyspark.sql import functions as F
    from lodestar.operators import collection as CO
    from lodestar.operators import versions as VE

    @F.udf("array<float>")
    def embed(text):
        if text == "loser":
            raise ValueError(text)
        return [float(len(text))]

    def finish(rows):
        return CO.to_records(rows.withColumn("embedding", embed.asNondeterministic()("chunk_content")))

    rows = [(f"c{k}", f"t{k % 3}", 2022 + late, "s", k, "loser" if late else f"text {k}") for k in range(30) for late in (0, 1)]
    batch = spark.createDataFrame(rows, "chunk_id string, title string, year int, source string, chunk_index int, chunk_content string")
    read = lambda df: sorted((r["chunk_id"], r["document"], r["embedding"][0], r["metadata"]["title"]) for r in df.collect())
    want = sorted((f"c{k}", f"text {k}", float(len(f"text {k}")), f"t{k % 3}") for k in range(30))
    path = str(tmp_path / "coll")
    CO.rebuild_collection(spark, path, batch.where("chunk_index < 10"), finish=finish)
    CO.insert_if_absent(spark, path, batch, finish=finish)
    again = batch.withColumn("chunk_content", F.lit("loser"))  # every key is stored: nothing is embedded
    CO.insert_if_absent(spark, path, again, finish=finish)
    assert read(spark.read.parquet(path)) == want
    versions = str(tmp_path / "versions")
    VE.rebuild(spark, versions, batch.where("chunk_index < 10"), finish=finish, buckets=8)
    VE.upsert(spark, versions, batch.where("chunk_index >= 5"), finish=finish)
    assert read(VE.read_version(spark, versions)) == want
    assert {r[0] for r in VE.read_version(spark, versions).select("bucket").distinct().collect()} <= set(range(8))
