"""The pivot join against the exact search."""

import math

import numpy as np
from pyspark.sql import functions as F

from lodestar.operators import knn as KNN
from lodestar.operators import pivots as PV


def table(spark, x, name="item_id"):
    rows = [(k, None if v is None else [float(a) for a in v]) for k, v in enumerate(x)]
    return spark.createDataFrame(rows, f"{name} long, embedding array<double>")


def asked(items):
    return items.select(F.col("item_id").alias("query_id"), "embedding")


def rows(df):
    return sorted((r["query_id"], r["rank"], r["item_id"], round(r["distance"], 8)) for r in df.collect())


def clustered(n, centres, dim, spread, seed):
    rng = np.random.default_rng(seed)
    at = rng.normal(size=(centres, dim)) * 10
    return at[rng.integers(0, centres, n)] + rng.normal(size=(n, dim)) * spread


def test_equals_exact_search(spark):
    for x in (clustered(600, 12, 8, 0.3, 1), np.random.default_rng(2).normal(size=(500, 6))):
        items = table(spark, x)
        want = rows(KNN.knn_exact(asked(items), items, k=7, item_id="item_id"))
        for pivots, queries_a_block, items_a_block in ((1, 40, 70), (16, 50, 1000), (64, 1000, 90)):
            got = PV.knn_join(asked(items), items, k=7, item_id="item_id", n_pivots=pivots, query_block_rows=queries_a_block,
                              item_block_rows=items_a_block)
            assert rows(got) == want


def test_ties_copies_and_carried_columns(spark):
    x = np.repeat(np.random.default_rng(3).integers(0, 3, size=(40, 3)).astype(float), 8, axis=0)
    items = table(spark, x).withColumn("_tag", F.concat(F.lit("t"), "item_id"))
    got = PV.knn_join(asked(items), items, k=5, item_id="item_id", carry=["_tag"], n_pivots=8, query_block_rows=30,
                      item_block_rows=50)
    want = KNN.knn_exact(asked(items), items, k=5, item_id="item_id", carry=["_tag"])
    assert rows(got) == rows(want)
    assert all(r["_tag"] == f"t{r['item_id']}" for r in got.collect())


def test_odd_vectors_few_items_and_empty_tables(spark):
    x = [[0.0, 1.0], None, [float("nan"), 1.0], [float("inf"), 0.0], [2.0, 2.0], [0.0, 0.0], [0.0, 1.0]]
    items = table(spark, x)
    got = rows(PV.knn_join(asked(items), items, k=10, item_id="item_id", n_pivots=4, query_block_rows=2))
    fine = table(spark, x).where(F.col("item_id").isin(0, 4, 5, 6))
    assert got == rows(KNN.knn_exact(asked(fine), fine, k=10, item_id="item_id"))
    assert {r[0] for r in got} == {0, 4, 5, 6} and len(got) == 16
    none = items.limit(0)
    for q, c in ((asked(items), none), (asked(none), items), (asked(none), none)):
        out = PV.knn_join(q, c, k=3, item_id="item_id")
        assert out.collect() == [] and out.columns == ["query_id", "item_id", "distance", "rank"]


def sent_share(spark, items, k, n_pivots, block_rows):
    """Item copies sent, over item copies that the blocked search sends with as many query blocks."""
    p = PV.choose_pivots(items, "item_id", "embedding", n_pivots)
    near = PV.nearest_to_pivots(items, "embedding", p, k)
    groups = PV.query_groups(PV.with_bounds(asked(items), "embedding", p, near), "embedding", p, block_rows)
    n = items.count()
    return PV.reached_groups(items, "embedding", p, groups).count() / (n * math.ceil(n / block_rows)), groups


def test_items_go_only_where_they_can_matter(spark):
    share, groups = sent_share(spark, table(spark, clustered(3000, 30, 16, 0.5, 5)), 10, 96, 150)
    assert len(groups.blocks) >= 20 and share < 0.35


def test_groups_hold_bounded_blocks(spark):
    # Half of the queries are one vector: its group is cut by a hash of the id.
    x = np.concatenate([np.ones((400, 3)), np.random.default_rng(1).normal(size=(400, 3))])
    _, groups = sent_share(spark, table(spark, x), 5, 16, 100)
    assert groups.blocks.max() >= 4 and groups.blocks.sum() <= 8 + 2 * len(groups.blocks)
