"""Exact top-k: bounds, ties, odd vectors."""

import duckdb
import numpy as np
from pyspark.sql import functions as F

from lodestar.llm import topk
from lodestar.llm.common import table

SMALL = "/root/testdata/sf0.01"


def test_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SMALL}/embeddings.parquet'")
    want = con.execute(topk.top_k_sql()).fetchall()
    got = topk.top_k(table(spark, SMALL, "embeddings"), F.col("vec_id") % 50 == 0).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_bounds_hold_at_every_level():
    rng = np.random.default_rng(1)
    q, c = np.floor(256 * rng.normal(size=(20, 50))), np.floor(256 * rng.normal(size=(30, 50)))
    exact = q @ c.T
    last = None
    for segments in topk.LEVELS:
        bound = topk.statistics(q, segments) @ topk.statistics(c, segments).T
        assert (bound >= exact - 1e-6 * np.abs(exact).max()).all()
        if last is not None:
            assert bound.mean() < last
        last = bound.mean()


def test_blocks_and_ties(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 40)
    monkeypatch.setattr(topk, "FIRST_SLICE", 4)
    rng = np.random.default_rng(2)
    rows = [(k, [float(x) for x in rng.integers(-2, 3, 6)]) for k in range(200)]
    v = np.floor(256 * np.array([r[1] for r in rows]))
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 10 == 0).collect()
    want = set()
    for k in range(0, 200, 10):
        s = v @ v[k]
        best = sorted((x for x in range(200) if x != k), key=lambda x: (-s[x], x))[:5]
        want |= {(k, n + 1, x, int(s[x])) for n, x in enumerate(best)}
    assert set(map(tuple, got)) == want


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.5], "x"), (1, None, "x"), (2, [None, 1.0], "x"), (3, [float("nan"), 1.0], "x"),
            (4, [float("inf"), 1.0], "x"), (5, [], "x"), (6, [0.25, 0.25], "x"), (6, [0.25, 0.25], "x"), (None, [1.0, 1.0], "x"),
            (7, [1.0, 2.0, 3.0], "x")]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    got = topk.top_k(docs, F.col("vec_id") % 50 == 0).collect()
    assert sorted(map(tuple, got)) == [(0, 1, 6, 96 * 256), (0, 2, 6, 96 * 256)]
    assert topk.top_k(docs.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert topk.top_k(docs.where("vec_id = 6"), F.col("vec_id") % 50 == 0).count() == 0
