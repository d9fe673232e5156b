"""Exact top-k by inner product with segment statistics, coarse to fine.

For vectors ``q`` and ``c`` cut into segments of ``L`` components, with means ``m`` and
deviations ``s`` of each segment,

    |q - c|^2  >=  sum L * ((m_q - m_c)^2 + (s_q - s_c)^2)

or, as ``2 q.c = |q|^2 + |c|^2 - |q - c|^2``,  ``q.c <= sum L * (m_q m_c + s_q s_c)``.
The bound is one short product of statistics.  A task starts from the exact scores of a
first slice of candidates, so each query has a k-th score to beat, and then lowers the
survivors level by level (1, 4, 16 segments); exact scores are computed only for what is left.

Queries travel in blocks of ``QUERY_BLOCK``, candidates in blocks of ``CANDIDATE_BLOCK``
packed rows; a candidate block is sent once for each query block, by an equi-join on the
query block's number.  Each pair of blocks returns at most k rows for each query, which a
window ranks.

Defined cases: vectors that are null or hold null or non-finite components take no part;
vectors of different length are not compared; candidates with the query's id are its own;
a row that occurs twice is a candidate twice; a query with fewer than k candidates gets all; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import buckets_for, staged

QUERY_BLOCK, CANDIDATE_BLOCK = 512, 8192
LEVELS = (1, 4, 16)
FIRST_SLICE = 512


def scaled(vector: Column, factor: int = 256) -> Column:
    """floor(factor * x) of every component, as doubles (integers up to 2**53 are exact)."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(factor)) * x.cast("double")).cast("double"))


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


def _edges(d: int, segments: int) -> np.ndarray:
    return np.unique(np.linspace(0, d, min(segments, d) + 1).astype(int))


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """sqrt(L) * mean and sqrt(L) * deviation of every segment: their product bounds the inner product."""
    edges = _edges(x.shape[1], segments)
    n = np.diff(edges)
    total = np.add.reduceat(x, edges[:-1], axis=1)
    square = np.add.reduceat(x * x, edges[:-1], axis=1)
    mean = total / n
    spread = np.sqrt(np.maximum(square - n * mean * mean, 0.0))  # sqrt(L) * deviation
    return np.concatenate([np.sqrt(n) * mean, spread], axis=1)


def search_block(q_id, q, c_id, c, k: int) -> pd.DataFrame:
    """The k best candidates of one block for each query; ties to the smaller id."""
    order = np.argsort(c_id, kind="stable")
    c_id, c = c_id[order], c[order]
    own = lambda ids: q_id[:, None] == ids[None, :]
    head = slice(0, min(FIRST_SLICE, len(c)))
    score = np.where(own(c_id[head]), -np.inf, q @ c[head].T)
    least = np.full(len(q), -np.inf)
    if score.shape[1] > k:
        least = np.partition(score, -k, axis=1)[:, -k]
    found = [np.stack(np.nonzero((score >= least[:, None]) & (score > -np.inf)))]
    values = [score[tuple(found[0])]]
    rest = np.arange(head.stop, len(c))
    if len(rest):
        # Slack far above rounding: bounds are sums of some hundred products.
        slack = 1e-6 * (1 + np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(c[rest], axis=1)[None, :])
        alive = None
        for segments in LEVELS:
            sq, sc = statistics(q, segments), statistics(c[rest], segments)
            if alive is None:
                alive = sq @ sc.T + slack >= least[:, None]
            else:
                i, j = np.nonzero(alive)
                if len(i) * 8 > alive.size:  # most survive: one product is cheaper than many rows
                    alive &= sq @ sc.T + slack >= least[:, None]
                else:
                    alive[i, j] = np.einsum("ij,ij->i", sq[i], sc[j]) + slack[i, j] >= least[i]
        alive &= ~own(c_id[rest])
        i, j = np.nonzero(alive)
        exact = (q @ c[rest].T)[i, j] if len(i) * 8 > alive.size else np.einsum("ij,ij->i", q[i], c[rest][j])
        found.append(np.stack([i, rest[j]]))
        values.append(exact)
    (i, j), s = np.concatenate(found, axis=1), np.concatenate(values)
    order = np.lexsort((c_id[j], -s, i))
    i, j, s = i[order], j[order], s[order]
    nth = np.arange(len(i)) - np.searchsorted(i, i)
    keep = nth < k
    return pd.DataFrame({"query_id": q_id[i[keep]], "vec_id": c_id[j[keep]], "score": np.rint(s[keep]).astype(np.int64)})


def _blocks(vectors: DataFrame, size: int, id_column: str, name: str) -> DataFrame:
    """``d, block, ids, data``: vectors of one length as packed rows of about ``size`` vectors."""
    n = vectors.count()
    # By lot and not by id: an id may stand on very many rows.
    numbered = vectors.withColumn("block", F.floor(F.rand(7) * buckets_for(n, size)))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"d": [pdf["d"].iloc[0]], "block": [pdf["block"].iloc[0]],
                             "ids": [pdf[id_column].to_numpy(np.int64).tobytes()],
                             "data": [np.stack(pdf["v"].to_numpy()).astype(np.float64).tobytes()]})

    return staged(numbered.groupBy("d", "block").applyInPandas(pack, "d int, block long, ids binary, data binary"), name)


def top_k(vectors: DataFrame, is_query: Column, id_column: str = "vec_id", vector_column: str = "embedding",
          k: int = 5) -> DataFrame:
    """``query_id, rank, <id_column>, score`` of every query's k best candidates."""
    v = F.col(vector_column)
    rows = vectors.where(usable(v) & F.col(id_column).isNotNull()).select(
        F.col(id_column).cast("long").alias(id_column), is_query.alias("is_query"), F.size(v).alias("d"),
        scaled(v).alias("v")).where("d > 0")
    q = _blocks(rows.where("is_query").select(id_column, "d", "v").dropDuplicates([id_column, "v"]), QUERY_BLOCK,
                id_column, "queries")
    c = _blocks(rows.select(id_column, "d", "v"), CANDIDATE_BLOCK, id_column, "candidates")
    count = q.agg(F.max("block")).first()[0]
    if count is None:
        return rows.limit(0).select(F.col(id_column).alias("query_id"), F.lit(1).alias("rank"), id_column,
                                    F.lit(0).cast("long").alias("score"))
    sent = c.withColumn("q_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count).cast("long"))))
    pairs = sent.join(q.select("d", F.col("block").alias("q_block"), F.col("ids").alias("q_ids"),
                               F.col("data").alias("q_data")), ["d", "q_block"])

    def search(batches):
        for b in batches:
            for d, q_ids, q_data, ids, data in zip(b["d"], b["q_ids"], b["q_data"], b["ids"], b["data"]):
                out = search_block(np.frombuffer(q_ids, np.int64), np.frombuffer(q_data).reshape(-1, d),
                                   np.frombuffer(ids, np.int64), np.frombuffer(data).reshape(-1, d), k)
                yield out.rename(columns={"vec_id": id_column})

    found = pairs.select("d", "q_ids", "q_data", "ids", "data").mapInPandas(
        search, f"query_id long, {id_column} long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), id_column)
    return (found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", id_column, "score"))


def top_k_sql(table: str = "embeddings", every: int = 50, k: int = 5) -> str:
    """DuckDB SQL of the query over the view ``table``."""
    return f"""
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM {table}
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
      FROM e q, e c WHERE q.vec_id % {every} = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v))
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= {k}"""
