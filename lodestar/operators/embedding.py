"""Embedding: a built-in hashed bag-of-words embedder and a slot for a real model.

The hashed embedder splits text into words (as ``str.split()``), sends each word
to bucket ``int(md5(word)[:8], 16) % dim`` (JVM expressions), and counts the
buckets into an L2-normalised dense vector.  Only the counting is vectorised
NumPy inside an Arrow UDF; there is no per-row or per-word Python.

A caller's own model plugs in through :func:`embed_with`, an iterator Pandas UDF
that loads the model once per task and embeds Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import words

HASH_DIM = 384
#: texts whose counts are held at once
ROWS_PER_STEP = 512
HASHED_MODEL_NAME = "hashed-bow-384"


def hashed_buckets(col, dim: int = HASH_DIM) -> Column:
    """Bucket of every word: ``conv(substr(md5(w), 1, 8), 16, 10) % dim``."""
    return F.transform(
        words(col),
        lambda w: (F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("bigint") % F.lit(dim)).cast("int"),
    )


def _bucket_counts(buckets: pa.Array, dim: int) -> np.ndarray:
    """``(rows, dim)`` float64 counts from a list<int> Arrow array, without per-row Python."""
    if isinstance(buckets, pa.ChunkedArray):
        buckets = buckets.combine_chunks()
    n = len(buckets)
    lengths = pc.fill_null(pc.list_value_length(buckets), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.list_flatten(buckets).to_numpy(zero_copy_only=False).astype(np.int64)
    rows = np.repeat(np.arange(n, dtype=np.int64), lengths)
    return np.bincount(rows * dim + flat, minlength=n * dim).reshape(n, dim).astype(np.float64)


def _by_step(buckets: pa.Array, dim: int, dtype, finish) -> np.ndarray:
    """``finish(counts)`` of all rows, a few rows at a time: the counts of a whole batch are never held."""
    out = np.empty((len(buckets), dim), dtype)
    for at in range(0, len(buckets), ROWS_PER_STEP):
        out[at:at + ROWS_PER_STEP] = finish(_bucket_counts(buckets.slice(at, ROWS_PER_STEP), dim))
    return out


def _once(udf):
    """``udf`` where the query calls it: Spark pushes a filter on a deterministic one below joins and shuffles and calls it there again."""
    return udf.asNondeterministic()


def _as_list_array(mat: np.ndarray, value_type: pa.DataType) -> pa.Array:
    n, dim = mat.shape
    offsets = pa.array(np.arange(0, (n + 1) * dim, dim, dtype=np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(mat.ravel(), type=value_type))


def _normalised(counts: np.ndarray) -> np.ndarray:
    norms = np.sqrt((counts * counts).sum(axis=1))
    safe = np.where(norms > 0, norms, 1.0)
    return (counts / safe[:, None]).astype(np.float32)


def hashed_counts(col, dim: int = HASH_DIM) -> Column:
    """Bucket counts (INT): counts of a space-joined text are the sum of its parts' counts."""
    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def raw(buckets: pa.Array) -> pa.Array:
        return _as_list_array(_by_step(buckets, dim, np.int32, lambda counts: counts), pa.int32())

    return raw(hashed_buckets(col, dim))


def packed_counts(col, dim: int = HASH_DIM) -> Column:
    """Bucket counts as BINARY, in 1, 2 or 4 bytes each, whichever a text's largest count takes: a text's counts are often shuffled."""
    @F.arrow_udf(T.BinaryType())
    def packed(buckets: pa.Array) -> pa.Array:
        counts = _by_step(buckets, dim, np.uint32, lambda c: c)
        most = counts.max(axis=1, initial=0)
        return pa.array([row.astype("<u1" if m < 1 << 8 else "<u2" if m < 1 << 16 else "<u4").tobytes()
                         for row, m in zip(counts, most)], pa.binary())

    return packed(hashed_buckets(col, dim))


def _unpacked_sum(packed: pa.Array, dim: int) -> np.ndarray:
    """The sum of the rows of packed counts."""
    total = np.zeros(dim)
    size = pc.binary_length(packed).to_numpy(zero_copy_only=False)
    for width in np.unique(size):
        rows = b"".join(packed.filter(pa.array(size == width)).to_pylist())
        total += np.frombuffer(rows, f"<u{width // dim}").reshape(-1, dim).sum(axis=0, dtype=np.float64)
    return total


def embedding_of_sum(rows: DataFrame, key: str, counts_col: str, out_col: str = "embedding", dim: int = HASH_DIM) -> DataFrame:
    """``key, out_col``: the embedding of each key's texts joined by spaces, from their packed counts (the same vector, bit by bit)."""
    def total(group: pa.Table) -> pa.Table:
        vector = _normalised(_unpacked_sum(group[counts_col].combine_chunks(), dim)[None])
        return pa.table({key: group[key].slice(0, 1), out_col: _as_list_array(vector, pa.float32())})

    schema = T.StructType([rows.schema[key], T.StructField(out_col, T.ArrayType(T.FloatType()))])
    return rows.select(key, counts_col).groupBy(key).applyInArrow(total, schema)


def hashed_embedding(col, dim: int = HASH_DIM) -> Column:
    """Dense, L2-normalised hashed bag-of-words vector (all zeros for empty text).

    Bucketing runs in the JVM; counting and normalising are one vectorised NumPy
    pass per Arrow batch (offsets and values are read without per-row Python).
    """
    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def dense_normalised(buckets: pa.Array) -> pa.Array:
        return _as_list_array(_by_step(buckets, dim, np.float32, _normalised), pa.float32())

    return _once(dense_normalised)(hashed_buckets(col, dim))


def embed_hashed(
    df: DataFrame,
    text_col: str = "chunk_content",
    out_col: str = "embedding",
    dim: int = HASH_DIM,
    model_col: str | None = "embedding_model",
) -> DataFrame:
    out = df.withColumn(out_col, hashed_embedding(text_col, dim))
    if model_col:
        out = out.withColumn(model_col, F.lit(HASHED_MODEL_NAME))
    return out


def embed_with(
    df: DataFrame,
    load_model: Callable[[], Callable[[list[str]], np.ndarray]],
    text_col: str = "chunk_content",
    out_col: str = "embedding",
    model_name: str = "custom",
    model_col: str | None = "embedding_model",
) -> DataFrame:
    """Slot for a caller's embedding model.

    ``load_model()`` runs once per task and returns ``encode(list_of_texts) ->
    ndarray (n, dim)``.  Texts arrive in Arrow batches.
    """

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load_model()
        for texts in batches:
            vecs = np.asarray(model(texts.fillna("").tolist()), dtype=np.float32)
            yield pd.Series(list(vecs))

    out = df.withColumn(out_col, _once(encode)(F.col(text_col)))
    if model_col:
        out = out.withColumn(model_col, F.lit(model_name))
    return out
