"""Streams: result equals batch, a restart from the checkpoint adds nothing, new files add only themselves."""

from pyspark.sql import functions as F

from conftest import SMALL
from lodestar import streaming as ST
from lodestar.plans import catalog, fixtures as FX


def test_ingest_restart_and_new_file(spark, tmp_path):
    src = tmp_path / "incoming"
    docs = FX.table(spark, SMALL, "documents")
    docs.where("doc_id < 100").coalesce(1).write.mode("append").parquet(str(src))
    schema = docs.schema
    coll, ckpt = str(tmp_path / "coll"), str(tmp_path / "ckpt")

    def run():
        stream = ST.file_stream(spark, str(src), schema, glob="*.parquet")
        ST.ingest_stream(spark, stream, catalog._prepare_shared, coll, ckpt, order=catalog.COLL_ORDER).awaitTermination()
        return spark.read.parquet(coll)

    first = run().select("chunk_id", "doc_id").collect()
    again = run().select("chunk_id", "doc_id").collect()  # same checkpoint, no new file
    assert sorted(first) == sorted(again)
    docs.where("doc_id >= 100").coalesce(1).write.mode("append").parquet(str(src))
    third = run()
    ids = [r["chunk_id"] for r in third.select("chunk_id").collect()]
    assert len(ids) == len(set(ids))  # insert-if-absent: no id twice
    batch = catalog.shared_collection(spark, SMALL).select("chunk_id")
    assert {r[0] for r in batch.collect()} == set(ids)  # same ids as the batch rebuild


def test_table_stream_reads_a_file_or_a_folder(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"text {k % 7}") for k in range(40)], "doc_id long, text string")
    folder = tmp_path / "many" / "documents.parquet"
    docs.repartition(4).write.parquet(str(folder))
    one = tmp_path / "one"
    docs.coalesce(1).write.parquet(str(tmp_path / "staged"))
    one.mkdir()
    (one / "documents.parquet").write_bytes(next((tmp_path / "staged").glob("part-*.parquet")).read_bytes())
    for name, sf_dir in (("many", tmp_path / "many"), ("one", one)):
        stream = ST.table_stream(spark, FX.table_path(str(sf_dir), "documents"), docs.schema)
        target = str(tmp_path / f"dedup-{name}")
        ST.dedup_stream(spark, stream, "text", ["doc_id"], target, str(tmp_path / f"ckpt-{name}")).awaitTermination()
        assert sorted(tuple(r) for r in spark.read.parquet(target).select("text", "doc_id").collect()) == \
            [(f"text {k}", k) for k in range(7)]
