"""Exact k-nearest-neighbour join of two large tables, by pivots and the triangle inequality.

The blocked search sends every item to every block of queries.  Here queries that lie near each other share a group,
and an item is sent only to the groups it can matter to:

1. ``n_pivots`` items (smallest hashes of their ids) are the pivots.  A pass over the items keeps, for each pivot, the
   ``k`` smallest distances among the items nearest to it: ``n_pivots x k`` numbers.
2. Each query gets an upper bound of its k-th distance: the k-th smallest ``d(q, p) + d(p, item)`` over those.  A group
   is the queries of one pivot (or of neighbouring pivots, if they are few; a large group is cut by a hash of the id).
   It keeps, for each pivot, the interval ``[min(d(q, p) - bound), max(d(q, p) + bound)]``.
3. An item within the bound of any query of a group has its distance to *every* pivot inside the group's intervals, so
   an item outside one of them is not scored there.  Few groups meet item blocks in a cogroup; many are broadcast one after
   another and the items scanned where they lie, as copies of the items for each group would grow with the square of the
   tables.  Both score with the exact search's kernel, started at the queries' bounds.

What is collected or broadcast is bounded by ``n_pivots`` and ``k`` (128 pivots and k = 50: 0.3 MB); a task of the cogroup
gets one query block and one item block, whatever the keys are.  Items are read twice, so pass a stored table.  Vectors
without clusters exclude nothing: an item then goes to every group, which is what the blocked search does.

Defined cases: null vectors and vectors with a component that is not finite take no part; with fewer than ``k`` items a
query has them all; empty tables give no rows; ties by (rounded distance, item id) as in the exact search.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path
from . import knn as KNN

N_PIVOTS = 128
#: distances from one matrix product are trusted to this share of the vectors' lengths
SLACK = 1e-6
ROWS_PER_STEP = 256


class Groups(NamedTuple):
    """Groups of queries: ``of_cell`` maps a pivot to its group; ``low``/``high`` are (groups, pivots); ``blocks`` a group's parts."""
    of_cell: np.ndarray
    low: np.ndarray
    high: np.ndarray
    blocks: np.ndarray


def _distances(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distances to every pivot, and how far each row's distances may be off; rows that are not finite give NaN."""
    xn, pn = (x * x).sum(axis=1), (pivots * pivots).sum(axis=1)
    with np.errstate(invalid="ignore", over="ignore"):
        d = np.sqrt(np.maximum(xn[:, None] + pn[None, :] - 2.0 * x @ pivots.T, 0.0))
    d[~np.isfinite(x).all(axis=1)] = np.nan
    return d, SLACK * (np.sqrt(xn) + math.sqrt(pn.max()))


def choose_pivots(collection: DataFrame, item_id: str, item_vec: str, n_pivots: int) -> np.ndarray:
    """At most ``n_pivots`` item vectors, those with the smallest hashes of their ids."""
    finite = F.forall(item_vec, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    rows = collection.where(F.col(item_vec).isNotNull() & finite).select(item_vec, F.xxhash64(item_id).alias("_h"))
    return KNN._as_matrix(rows.orderBy("_h").limit(n_pivots).toPandas()[item_vec])


def nearest_to_pivots(collection: DataFrame, item_vec: str, pivots: np.ndarray, k: int) -> np.ndarray:
    """(pivots, k) smallest distances of each pivot's own items, upwards; infinite where it has fewer."""
    bc = collection.sparkSession.sparkContext.broadcast(pivots)

    def task(batches):
        p = bc.value
        near = np.full((len(p), k), np.inf)
        for pdf in batches:
            d, off = _distances(KNN._as_matrix(pdf[item_vec]), p) if len(pdf) else (np.zeros((0, len(p))), None)
            ok = np.flatnonzero(~np.isnan(d[:, 0]))
            if not len(ok):
                continue
            cell = d[ok].argmin(axis=1)
            own = d[ok, cell] + off[ok]
            for c in np.unique(cell):
                near[c] = np.sort(np.concatenate([near[c], own[cell == c]]))[:k]
        for c in np.flatnonzero(np.isfinite(near[:, 0])):
            yield pd.DataFrame({"pivot": [c], "near": [near[c][np.isfinite(near[c])]]})

    def merge(pdf):
        return pd.DataFrame({"pivot": pdf["pivot"][:1], "near": [np.sort(np.concatenate(pdf["near"].tolist()))[:k]]})

    schema = "pivot int, near array<double>"
    rows = (collection.where(F.col(item_vec).isNotNull()).select(item_vec).mapInPandas(task, schema)
            .groupBy("pivot").applyInPandas(merge, schema).collect())
    out = np.full((len(pivots), k), np.inf)
    for r in rows:
        out[r["pivot"], :len(r["near"])] = r["near"]
    return out


def _bounds(d: np.ndarray, off: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Upper bound of each query's k-th distance; infinite if there are fewer items."""
    k = near.shape[1]
    out = np.empty(len(d))
    for at in range(0, len(d), ROWS_PER_STEP):
        reach = (d[at:at + ROWS_PER_STEP, :, None] + near[None]).reshape(-1, near.size)
        out[at:at + ROWS_PER_STEP] = np.partition(reach, k - 1, axis=1)[:, k - 1]
    return out + off


def with_bounds(queries: DataFrame, query_vec: str, pivots: np.ndarray, near: np.ndarray) -> DataFrame:
    """Queries with ``_cell`` (nearest pivot) and ``_bound`` (of the k-th distance); others than finite vectors go.

    A column ``_within`` (of ``sample_bounds``) may bound the k-th distance better.
    """
    bc = queries.sparkSession.sparkContext.broadcast((pivots, near))
    schema = T.StructType(queries.schema.fields + [T.StructField("_cell", T.IntegerType()),
                                                   T.StructField("_bound", T.DoubleType())])

    def task(batches):
        p, n = bc.value
        for pdf in batches:
            if not len(pdf):
                continue
            d, off = _distances(KNN._as_matrix(pdf[query_vec]), p)
            ok = ~np.isnan(d[:, 0])
            if ok.any():
                bound = _bounds(d[ok], off[ok], n)
                if "_within" in pdf:
                    bound = np.fmin(bound, np.sqrt(pdf["_within"][ok].to_numpy()) + off[ok])
                yield pdf[ok].assign(_cell=d[ok].argmin(axis=1), _bound=bound)

    return queries.where(F.col(query_vec).isNotNull()).mapInPandas(task, schema)


def query_groups(bounded: DataFrame, query_vec: str, pivots: np.ndarray, block_rows: int) -> Groups:
    """Groups of about ``block_rows`` queries of neighbouring pivots, and their distance intervals."""
    bc = bounded.sparkSession.sparkContext.broadcast(pivots)
    schema = "cell int, n long, low array<double>, high array<double>"

    def task(batches):
        p = bc.value
        low, high = np.full((len(p), len(p)), np.inf), np.full((len(p), len(p)), -np.inf)
        n = np.zeros(len(p), np.int64)
        for pdf in batches:
            if not len(pdf):
                continue
            d, off = _distances(KNN._as_matrix(pdf[query_vec]), p)
            wide = (pdf["_bound"].to_numpy() + off)[:, None]
            cell = pdf["_cell"].to_numpy()
            np.minimum.at(low, cell, d - wide)
            np.maximum.at(high, cell, d + wide)
            n += np.bincount(cell, minlength=len(p))
        for c in np.flatnonzero(n):
            yield pd.DataFrame({"cell": [c], "n": [n[c]], "low": [low[c]], "high": [high[c]]})

    def merge(pdf):
        return pd.DataFrame({"cell": pdf["cell"][:1], "n": [pdf["n"].sum()], "low": [np.stack(pdf["low"]).min(axis=0)],
                             "high": [np.stack(pdf["high"]).max(axis=0)]})

    rows = {r["cell"]: r for r in bounded.select(query_vec, "_cell", "_bound").mapInPandas(task, schema)
            .groupBy("cell").applyInPandas(merge, schema).collect()}
    of_cell = np.full(len(pivots), -1)
    low, high, sizes = [], [], []
    for c in _chain(pivots, sorted(rows)):
        r = rows[c]
        if sizes and sizes[-1] + r["n"] <= block_rows:
            low[-1], high[-1] = np.minimum(low[-1], r["low"]), np.maximum(high[-1], r["high"])
            sizes[-1] += r["n"]
        else:
            low.append(np.array(r["low"]))
            high.append(np.array(r["high"]))
            sizes.append(r["n"])
        of_cell[c] = len(sizes) - 1
    shape = (len(sizes), len(pivots))
    return Groups(of_cell, np.array(low).reshape(shape), np.array(high).reshape(shape),
                  np.array([math.ceil(n / block_rows) for n in sizes], dtype=int))


def _chain(pivots: np.ndarray, cells: list[int]) -> list[int]:
    """The cells in an order where each is followed by the nearest one left."""
    left, out = list(cells), []
    while left:
        at = 0 if not out else int(((pivots[left] - pivots[out[-1]]) ** 2).sum(axis=1).argmin())
        out.append(left.pop(at))
    return out


def _reached(d: np.ndarray, off: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Which rows of distances lie inside a group's intervals."""
    return ((d + off[:, None] >= low) & (d - off[:, None] <= high)).all(axis=1)


def reached_groups(collection: DataFrame, item_vec: str, pivots: np.ndarray, groups: Groups) -> DataFrame:
    """Items with ``_g``, once for each group whose intervals hold all of the item's distances."""
    bc = collection.sparkSession.sparkContext.broadcast((pivots, groups.low, groups.high))

    @F.pandas_udf("array<int>")
    def reach(vectors: pd.Series) -> pd.Series:
        p, low, high = bc.value
        if not len(vectors):
            return pd.Series([], dtype=object)
        d, off = _distances(KNN._as_matrix(vectors), p)
        hit = np.stack([_reached(d, off, lo, hi) for lo, hi in zip(low, high)], axis=1)
        return pd.Series([np.flatnonzero(h).astype(np.int32) for h in hit], dtype=object)

    return collection.where(F.col(item_vec).isNotNull()).withColumn("_g", F.explode(reach(item_vec)))


def knn_join(queries: DataFrame, collection: DataFrame, k: int = 50, query_id: str = "query_id", query_vec: str = "embedding",
             item_id: str = "chunk_id", item_vec: str = "embedding", carry: list[str] | None = None, n_pivots: int = N_PIVOTS,
             query_block_rows: int | None = None, item_block_rows: int | None = None) -> DataFrame:
    """The ``k`` nearest items of every query: ``query_id, item_id, distance, rank, *carry``, as ``knn_exact`` gives them."""
    carry = [c for c in (carry or []) if c != item_id]
    spark = queries.sparkSession
    schema = KNN._out_schema(queries, collection, query_id, item_id, carry)
    items = collection.select(item_id, item_vec, *carry)
    pivots = choose_pivots(collection, item_id, item_vec, n_pivots)
    if not len(pivots):
        return KNN._final_rank(spark.createDataFrame([], schema), k, query_id, item_id)
    near = nearest_to_pivots(items, item_vec, pivots, k)
    path = scratch_path(spark, "bounded-queries")
    asked = KNN.sample_bounds(queries.select(query_id, query_vec), items, k, query_id, query_vec, item_id, item_vec)
    with_bounds(asked, query_vec, pivots, near).drop("_within").write.parquet(path)
    bounded = spark.read.parquet(path)
    groups = query_groups(bounded, query_vec, pivots, query_block_rows or KNN.QUERY_BLOCK_ROWS)
    if not len(groups.blocks):
        return KNN._final_rank(spark.createDataFrame([], schema), k, query_id, item_id)

    number = lambda values: F.array(*[F.lit(int(v)) for v in values])  # noqa: E731  (at most one for each pivot)
    parts = lambda g: F.get(number(groups.blocks), g)
    grouped = bounded.withColumn("_g", F.get(number(groups.of_cell), F.col("_cell"))) \
        .withColumn("_qb", F.pmod(F.xxhash64(query_id), parts(F.col("_g"))).cast("int"))
    first = np.cumsum(groups.blocks) - groups.blocks  # the number of each group's first block
    n_items = collection.count()
    if int(groups.blocks.sum()) * n_items * KNN._vector_bytes(items, item_vec) > KNN.COPIES_BYTES:
        stored = scratch_path(spark, "query-blocks")
        (grouped.withColumn("_block", F.get(number(first), F.col("_g")) + F.col("_qb"))
         .withColumn("_within", F.col("_bound") * F.col("_bound") + 1e-9)
         .select(query_id, query_vec, "_within", "_block").write.partitionBy("_block").parquet(stored))
        blocks = spark.read.parquet(stored)

        def keep(block: int):
            g = int(np.searchsorted(first, block, side="right")) - 1
            low, high = groups.low[g], groups.high[g]
            return lambda x: _reached(*_distances(x, pivots), low, high)

        return KNN.scan_blocks(blocks, KNN._numbers(blocks), items, k, query_id, query_vec, item_id, item_vec, carry, keep=keep)

    fitting = max(1, min(KNN.ITEM_BLOCK_ROWS, KNN.ITEM_BLOCK_BYTES // (8 * pivots.shape[1])))
    item_blocks = max(1, math.ceil(n_items / (item_block_rows or fitting)))
    if item_block_rows is None:  # enough pairs of blocks for all cores, unless the blocks would be tiny
        wanted = math.ceil(3 * spark.sparkContext.defaultParallelism / int(groups.blocks.sum()))
        item_blocks = max(item_blocks, min(wanted, math.ceil(n_items / KNN.ITEMS_PER_STEP)))
    q = (grouped
         .withColumn("_cb", F.explode(F.sequence(F.lit(0), F.lit(item_blocks - 1)))))
    c = (reached_groups(items, item_vec, pivots, groups)
         .withColumn("_qb", F.explode(F.sequence(F.lit(0), parts(F.col("_g")) - 1)))
         .withColumn("_cb", F.pmod(F.xxhash64(item_id), F.lit(item_blocks)).cast("int")))

    def begin(qpdf: pd.DataFrame):
        bound = qpdf["_bound"].to_numpy() ** 2 + 1e-9
        return KNN._TopK(k, qpdf[query_id].to_numpy(), KNN._as_matrix(qpdf[query_vec]), query_id, item_id, bound=bound)

    found = KNN.score_blocks(q, c, ["_g", "_qb", "_cb"], int(groups.blocks.sum()) * item_blocks, begin, item_vec, carry, schema)
    return KNN._final_rank(found, k, query_id, item_id)
