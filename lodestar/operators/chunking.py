"""Token chunking: tokenize, overlapping windows, per-document stats, part numbers.

All native expressions.  A document is one row holding its token array; the
windows of that row are built by one ``transform`` over chunk numbers and
exploded with ``inline``, so the token array is never copied per chunk row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.text import token_length

TOKEN_MODES = {"ws": P.TOKEN_WS, "gpt2_pre": P.TOKEN_GPT2_PRE}


def tokenize(col, mode: str = "ws") -> Column:
    """Lossless tokens: ``array_join(tokenize(t), '') == t``."""
    c = F.col(col) if isinstance(col, str) else col
    return F.regexp_extract_all(c, F.lit(TOKEN_MODES[mode]), 0)


def chunk_count(n_tokens: Column, size: int, overlap: int) -> Column:
    """``ceil(n / (size - overlap))``; one chunk when overlap >= size; none for no tokens."""
    stride = size - overlap
    if stride <= 0:
        return F.when(n_tokens > 0, F.lit(1)).otherwise(F.lit(0))
    return F.when(n_tokens > 0, F.ceil(n_tokens / F.lit(stride)).cast("int")).otherwise(F.lit(0))


def chunk_tokens(
    df: DataFrame,
    text_col: str = "text",
    size: int = P.CHUNK_SIZE,
    overlap: int = P.CHUNK_OVERLAP,
    mode: str = "ws",
    keep: list[str] | None = None,
) -> DataFrame:
    """One row per window: ``chunk_index``, ``chunk_content``, ``chunk_tokens``, ``n_chunks``.

    Window ``i`` holds tokens ``[i*stride, i*stride + size)``; the loop runs while
    the start is inside the text, so a short tail wholly inside the previous window
    is still emitted.  ``keep`` lists the columns carried to every chunk row.
    """
    keep = [c for c in (keep if keep is not None else df.columns) if c != text_col]
    stride = size - overlap
    toks = tokenize(text_col, mode)
    staged = df.select(*keep, toks.alias("_tok"))
    n = F.size("_tok")
    n_chunks = chunk_count(n, size, overlap)
    step = stride if stride > 0 else size

    def window(i):
        start = i * F.lit(step)
        return F.struct(
            n_chunks.alias("n_chunks"),
            i.alias("chunk_index"),
            F.array_join(F.slice("_tok", start + 1, F.lit(size)), "").alias("chunk_content"),
            F.least(F.lit(size), n - start).alias("chunk_tokens"),
        )

    # Everything that reads the token array happens inside the generator, so the
    # array is not carried into (copied to) every chunk row.
    chunks = F.when(n_chunks > 0, F.transform(F.sequence(F.lit(0), n_chunks - 1), window))
    return staged.select(*keep, F.inline(chunks))


def chunk_stats(chunks: DataFrame, key: str = "title", content_col: str = "chunk_content") -> DataFrame:
    """Chunks and words per document (partial aggregation before the shuffle)."""
    return chunks.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_chunks"),
        F.sum(token_length(content_col)).cast("bigint").alias("n_words"),
    )


def part_numbers(
    chunks: DataFrame,
    max_chunks: int = P.PART_THRESHOLD,
    part_size: int = P.PART_SIZE,
    key: str = "title",
) -> DataFrame:
    """Part file number of each chunk: 1 unless the document has more than ``max_chunks``.

    ``n_chunks`` comes from ``chunk_tokens`` so no shuffle is needed; without it
    the count per ``key`` is computed by an aggregate and joined back.
    """
    if "n_chunks" not in chunks.columns:
        counts = chunks.groupBy(key).agg(F.count(F.lit(1)).alias("n_chunks"))
        chunks = chunks.join(counts, key)
    part = F.when(F.col("n_chunks") > max_chunks, F.floor(F.col("chunk_index") / part_size) + 1).otherwise(1)
    return chunks.withColumn("part_num", part.cast("bigint"))
