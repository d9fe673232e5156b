"""Physical plan properties that matter at scale."""

from pyspark.sql import functions as F

from conftest import SMALL
from lodestar.operators import collection as CO
from lodestar.plans import catalog


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_knn_group_limit_and_no_collection_shuffle(spark):
    df = catalog.QUERIES["knn_exact"](spark, SMALL)
    p = plan(df)
    assert "WindowGroupLimit" in p
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_text_operators_stay_native(spark):
    for name in ("clean_text", "drop_blank", "token_length", "tokenize_counts", "chunk_tokens", "redact_lines"):
        p = plan(catalog.QUERIES[name](spark, SMALL))
        assert "PythonUDF" not in p and "ArrowEvalPython" not in p, name


def test_title_lookup_pushed_down(spark, tmp_path):
    path = str(tmp_path / "coll")
    CO.rebuild_collection(spark, path, catalog.shared_collection(spark, SMALL), order=catalog.COLL_ORDER)
    df = CO.get_by_title(spark.read.parquet(path), "t3", ("chunk_id", "document"))
    p = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in p and "metadata.title" in p


def test_scan_prunes_years(spark, tmp_path):
    from lodestar.plans import fixtures as FX
    from lodestar.sources import corpus as SC
    path = str(tmp_path / "corpus")
    FX.corpus(spark, SMALL).write.partitionBy("year").parquet(path)
    p = plan(SC.scan_corpus(spark, path, years=(2023,)).select("doc_id"))
    assert "PartitionFilters" in p and "2023" in p


def test_bleu_shuffles_pairs_once(spark):
    p = plan(catalog.QUERIES["bleu4"](spark, SMALL))
    # the pair join and one repartition of the pair texts; n-gram aggregates reuse it
    assert p.count("Exchange hashpartitioning") <= 4


def test_collection_files_sorted_by_title(spark, tmp_path):
    import glob

    import pyarrow.parquet as pq

    path = str(tmp_path / "coll")
    CO.rebuild_collection(spark, path, catalog.shared_collection(spark, SMALL), order=catalog.COLL_ORDER)
    files = glob.glob(path + "/bucket=*/*.parquet")
    assert files
    for f in files:
        titles = [m["title"] for m in pq.read_table(f, columns=["metadata"]).column("metadata").to_pylist()]
        assert titles == sorted(titles)


def test_no_pairwise_joins_anywhere(spark):
    for name in ("fuzzy_title_match", "hybrid_retrieve", "retrieve_benchmark", "knn_approx", "evaluate",
                 "title_missing", "insert_if_absent", "cosine_mean"):
        p = plan(catalog.QUERIES[name](spark, SMALL))
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, name
