"""Token counts behind a digest cache.

The cache is a Parquet folder of ``content_digest, tokenizer_digest, n_tokens``.
A text's content digest is SHA-256 of the text as the tokenizer's own normalizer leaves
it (byte-level vocabularies have none, so of the text itself); the tokenizer's is SHA-256 of its
file.  Counting joins the two digests to the cache, encodes only the distinct
texts that miss, appends their counts, and joins the counts back to the documents.

Copies meet in a partial aggregate before the shuffle, so a group of copies,
however large, sends one text from each task.

Defined cases: null text counts as the empty text (0 bytes, 0 tokens); rows that
occur twice are returned twice; an empty table gives no rows and leaves the cache
as it is; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_column
from .tokens import encoder

CACHE = "content_digest binary, tokenizer_digest string, n_tokens long"


def tokenizer_digest(vocabulary: str) -> str:
    with open(vocabulary, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The cache, empty before the first append."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(CACHE).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CACHE)


def digested(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id, text, n_bytes, content_digest``; a tokenizer with a normalizer sees its normal form."""
    text = docs.select(F.col("doc_id").cast("long"), text_column().alias("text"))
    content = F.col("text")
    if encoder(vocabulary).library.normalizer is not None:
        @F.pandas_udf("string")
        def normal(texts: pd.Series) -> pd.Series:
            norm = encoder(vocabulary).library.normalizer
            return texts.map(norm.normalize_str)

        content = normal("text")
    return text.select("doc_id", "text", F.octet_length("text").cast("long").alias("n_bytes"),
                       F.unhex(F.sha2(content.cast("binary"), 256)).alias("content_digest"))


def misses(docs: DataFrame, cache: DataFrame, digest: str) -> DataFrame:
    """One text for each content digest that the cache lacks for this tokenizer."""
    known = cache.where(F.col("tokenizer_digest") == digest).select("content_digest")
    distinct = docs.groupBy("content_digest").agg(F.first("text").alias("text"))
    return distinct.join(known, "content_digest", "left_anti")


def count_misses(texts: DataFrame, vocabulary: str, digest: str) -> DataFrame:
    def count(batches):
        enc = encoder(vocabulary)
        for b in batches:
            yield pd.DataFrame({"content_digest": b["content_digest"], "tokenizer_digest": digest,
                                "n_tokens": [len(x) // 4 for x in enc.encode(b["text"].tolist())]})

    return texts.mapInPandas(count, CACHE)


def count_tokens(docs: DataFrame, vocabulary: str, cache_path: str, limit: int = 512) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row; the cache afterwards holds every text's count."""
    spark, digest = docs.sparkSession, tokenizer_digest(vocabulary)
    marked = digested(docs, vocabulary)
    new = count_misses(misses(marked, read_cache(spark, cache_path), digest), vocabulary, digest)
    new.write.mode("append").parquet(cache_path)
    # Two writers may have appended the same digest; both hold the same count.
    counts = (read_cache(spark, cache_path).where(F.col("tokenizer_digest") == digest)
              .groupBy("content_digest").agg(F.min("n_tokens").alias("n_tokens")))
    return (marked.select("doc_id", "n_bytes", "content_digest").join(counts, "content_digest")
            .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")))
