"""Paths beyond the broadcast bound, on as many shuffle partitions as the session asks for."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestar.operators import fuzzy as FZ
from lodestar.operators import knn as KNN
from lodestar.operators import quantize as PQ
from test_metrics import py_ratio


@pytest.fixture()
def partitioned(spark):
    """No coalescing: blocks of both sides have to be dealt to the same partition by their keys alone."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    yield spark
    spark.conf.set(name, before)


def pairs(df):
    return sorted((r["query_id"], r["rank"], r["item_id"]) for r in df.collect())


def test_knn_blocks_meet(partitioned, monkeypatch):
    monkeypatch.setattr(KNN, "QUERY_BLOCK_ROWS", 60)
    monkeypatch.setattr(KNN, "ITEM_BLOCK_ROWS", 70)
    x = np.random.default_rng(4).normal(size=(400, 6))
    items = partitioned.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "item_id long, embedding array<double>")
    asked = items.select(F.col("item_id").alias("query_id"), "embedding")
    want = pairs(KNN.knn_exact(asked, items, k=5, item_id="item_id"))
    assert len(want) == 2000
    assert pairs(KNN.knn_exact(asked, items, k=5, item_id="item_id", broadcast_rows=0)) == want
    cents = KNN.train_cells(items, n_cells=3)
    cells = KNN.assign_cells(items, cents)
    assert pairs(KNN.knn_approx(asked, cells, cents, k=5, nprobe=3, item_id="item_id", broadcast_rows=0)) == want
    books = PQ.train_codebooks(items, "item_id")
    coded = PQ.with_codes(items, books)
    assert pairs(PQ.knn_quantized(asked, coded, books, k=5, list_length=400, item_id="item_id", broadcast_rows=0)) == want


def test_fuzzy_title_blocks_meet(partitioned, monkeypatch):
    monkeypatch.setattr(FZ, "NAME_BLOCK_ROWS", 20)
    monkeypatch.setattr(FZ, "TITLE_BLOCK_ROWS", 20)
    titles = partitioned.createDataFrame([(f"report number {k:04d} of the year",) for k in range(120)], "title string")
    names = partitioned.createDataFrame([(k, f"report number {k:04d} of the yeaR") for k in range(0, 120, 2)], "name_id long, name string")
    rows = lambda bound: sorted((r["name_id"], r["title"]) for r in FZ.fuzzy_title_match(
        names, titles, broadcast_names=bound).collect())
    assert rows(0) == rows(1000) == [(k, f"report number {k:04d} of the year") for k in range(0, 120, 2)]


def test_a_loose_bound_lets_few_rows_in(monkeypatch):
    rng = np.random.default_rng(8)
    q, x = rng.normal(size=(40, 6)), np.repeat(rng.normal(size=(1500, 6)), 2, axis=0)
    items = pd.DataFrame({"item_id": rng.permutation(len(x)), "embedding": list(x)})
    merged = []
    merge = KNN._TopK._merge
    monkeypatch.setattr(KNN._TopK, "_merge", lambda self, *a: (merged.append(len(a[2])), merge(self, *a)))

    def best(bound):
        top = KNN._TopK(5, np.arange(40), q, "query_id", "item_id", bound=bound)
        top.add(items, "embedding", [])
        return top.result(["query_id", "item_id", "distance"]).sort_values(["query_id", "item_id"]).reset_index(drop=True)

    want = best(None)
    pd.testing.assert_frame_equal(best(np.full(40, 1e3)), want)
    assert len(want) == 200 and max(merged) <= 2 * 5 * 40
    copies = items.assign(embedding=[x[0]] * len(x))  # all distances equal: the smallest ids, and no more rows than that
    top = KNN._TopK(5, np.arange(40), q, "query_id", "item_id")
    top.add(copies, "embedding", [])
    assert set(top.best["item_id"]) == set(range(5)) and merged[-1] == 200


def test_an_item_block_is_not_held_as_rows_of_objects(partitioned):
    x = np.random.default_rng(9).normal(size=(90, 4))
    items = partitioned.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "item_id long, embedding array<double>")
    asked = items.select(F.col("item_id").alias("query_id"), "embedding")
    plan = KNN.knn_exact(asked, items, k=3, item_id="item_id", broadcast_rows=0)._jdf.queryExecution().toString()
    assert "FlatMapCoGroupsInArrow" in plan


def _random_titles(n, seed):
    rng = np.random.default_rng(seed)
    letters = "abé1_"
    return ["".join(rng.choice(list(letters), rng.integers(0, 14))) for _ in range(n)]


def test_fuzzy_titles_by_deletions_equal_every_pair_compared(partitioned, monkeypatch):
    # Short lengths may be deleted from, longer ones not: both sides of the bounds meet in one table.
    for one, two in ((64, 32), (9, 7)):
        monkeypatch.setattr(FZ, "DELETE_ONE", one)
        monkeypatch.setattr(FZ, "DELETE_TWO", two)
        titles = [*_random_titles(150, 1), "AB1a", "ab1A", None, "long title " * 4 + "x", "long title " * 4 + "yz"]
        asked = [*_random_titles(120, 2), "ab1a", "", None, "long title " * 4, "long title " * 8 + "and on"]
        names = partitioned.createDataFrame([(k % 115, t) for k, t in enumerate(asked)] + [(None, "ab1a")], "name_id long, name string")
        table = partitioned.createDataFrame([(t,) for t in titles], "title string")
        want = {}
        for k, t in enumerate(asked):
            for title in {x for x in titles if x}:
                r = py_ratio((t or "").lower(), title.lower())
                if t and r > 0.85 and (-r, title) < want.get(k % 115, (0, "")):
                    want[k % 115] = (-r, title)
        for bound in (1000, 0):
            got = FZ.fuzzy_title_match(names, table, broadcast_names=bound).collect()
            assert len(got) == len(asked) + 1
            for r in got:
                best = want.get(r["name_id"]) if r["name_id"] is not None else None
                assert (r["title"], r["ratio"]) == ((best[1], -best[0]) if best else (None, None)), r


def test_near_names_are_not_compared_with_all_titles(partitioned, monkeypatch):
    rest = []
    compared = FZ._compared
    monkeypatch.setattr(FZ, "_compared", lambda n, *a: (rest.append(n.count()), compared(n, *a))[1])
    titles = partitioned.createDataFrame([(f"report {k:05d}",) for k in range(300)], "title string")
    names = partitioned.createDataFrame([(k, (f"report {k:05d}", f"rport {k:05d}", f"report {k:05d}"[:-1] + "x")[k % 3])
                                         for k in range(300)] + [(-1, "nothing like it")], "name_id long, name string")
    assert sum(r["title"] is not None for r in FZ.fuzzy_title_match(names, titles).collect()) == 300
    assert rest == [1]


def test_many_query_blocks_do_not_copy_the_items(partitioned, monkeypatch):
    """Copies of the items for each block of queries would grow with the square of the tables: beyond a size no item is shuffled."""
    monkeypatch.setattr(KNN, "QUERY_BLOCK_ROWS", 40)
    x = np.random.default_rng(14).normal(size=(500, 6))
    x[100:140] = x[7]  # equal distances
    items = partitioned.createDataFrame([(k, v.tolist(), f"t{k}") for k, v in enumerate(x)],
                                        "item_id long, embedding array<double>, tag string")
    asked = items.select(F.col("item_id").alias("query_id"), "embedding")
    books = PQ.train_codebooks(items, "item_id", m=3)
    coded = PQ.with_codes(items, books)
    carried = lambda df: sorted((r["query_id"], r["rank"], r["item_id"], r["tag"]) for r in df.collect())
    searches = (lambda **b: carried(KNN.knn_exact(asked, items, k=5, item_id="item_id", carry=["tag"], **b)),
                lambda **b: pairs(PQ.knn_quantized(asked, coded, books, k=5, list_length=500, item_id="item_id", **b)),
                lambda **b: pairs(PQ.nearest_by_code(asked, coded, books, 20, item_id="item_id", **b)))
    want = [search() for search in searches]
    copied = []
    cogroup = KNN.score_blocks
    monkeypatch.setattr(KNN, "score_blocks", lambda q, c, *a: (copied.append(c.count()), cogroup(q, c, *a))[1])
    assert [search(broadcast_rows=0) for search in searches] == want and min(copied) > 500
    copied.clear()
    monkeypatch.setattr(KNN, "COPIES_BYTES", 100_000)  # 500 items of 48 bytes, 13 blocks or more
    assert [search(broadcast_rows=0) for search in searches] == want and not copied


def test_odd_vectors_in_scanned_blocks(partitioned, monkeypatch):
    monkeypatch.setattr(KNN, "QUERY_BLOCK_ROWS", 2)
    monkeypatch.setattr(KNN, "COPIES_BYTES", 0)
    x = [[0.0, 1.0], None, [float("nan"), 1.0], [2.0, 2.0], [0.0, 0.0], [0.0, 1.0], [1e20, 0.0], [3.0, None]]
    items = partitioned.createDataFrame([(k, v) for k, v in enumerate(x)], "item_id long, embedding array<double>")
    asked = items.select(F.col("item_id").alias("query_id"), "embedding")
    fine = items.where(F.col("item_id").isin(0, 3, 4, 5, 6))
    want = pairs(KNN.knn_exact(fine.withColumnRenamed("item_id", "query_id"), fine, k=4, item_id="item_id"))
    assert pairs(KNN.knn_exact(asked, items, k=4, item_id="item_id", broadcast_rows=0)) == want and len(want) == 20
    assert KNN.knn_exact(asked, items.limit(0), k=4, item_id="item_id", broadcast_rows=0).collect() == []


@pytest.mark.parametrize("scale, shift", [(1.0, 0.0), (1e-6, 0.0), (1e6, 0.0), (1.0, 100.0)])
def test_screened_pairs_equal_all_pairs(monkeypatch, scale, shift):
    """float32 only screens: ties, tiny, large and far vectors get the same rows, with a bound or none, in steps of any size."""
    rng = np.random.default_rng(3)
    x = (np.round(rng.normal(size=(900, 4)), 1) * scale + shift).astype(np.float32)
    q, ids = x[:60].astype(float), rng.permutation(900)
    key = np.round(((q[:, None] - x[None].astype(float)) ** 2).sum(axis=2), KNN.KEY_DIGITS)
    want = {(i, ids[j]) for i in range(60) for j in np.lexsort((ids, key[i]))[:5]}
    books = PQ.fit_codebooks(x, 2)
    code = [{"code": c.tobytes(), "x": v} for c, v in zip(PQ.codes_of(x, books), x.astype(float))]
    monkeypatch.setattr(KNN, "FIRST_ITEMS", 50)
    for bound in (None, np.sort(key, axis=1)[:, 12], np.sort(key, axis=1)[:, 4]):
        for kernel, vectors in ((KNN._TopK, list(x.astype(float))), (lambda *a, **b: PQ._ListedTopK(*a, books=books, **b), code)):
            for step in (10_000, 130):
                monkeypatch.setattr(KNN, "ITEMS_PER_STEP", step)
                top = kernel(5, np.arange(60), q, "query_id", "item_id", bound=bound)
                top.add(pd.DataFrame({"item_id": ids, "v": vectors}), "v", [])
                assert {(r.query_id, r.item_id) for r in top.best.itertuples()} == want


def test_far_pairs_get_no_float64_distance(monkeypatch):
    """Once a query has a bound, float64 work is done for the few pairs that can enter."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(8000, 32))
    worked = []
    near = KNN._TopK._near
    monkeypatch.setattr(KNN._TopK, "_near", lambda self, qs, rows, *a: (worked.append(len(qs) * len(rows)), near(self, qs, rows, *a))[1])
    top = KNN._TopK(10, np.arange(200), x[:200], "query_id", "item_id")
    top.add(pd.DataFrame({"item_id": np.arange(8000), "v": list(x)}), "v", [])
    assert len(top.best) == 2000 and sum(worked) <= 200 * 8000 / 4
