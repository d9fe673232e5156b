"""Small helpers shared by the operators: tables, staged copies, batches of texts."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_root

#: The six ASCII white-space characters; words of every contract are maximal runs of anything else.
WHITESPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared scratch root, as the URI the cluster names."""
    return f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared scratch folder and read back: a lineage cut that survives executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_column(column: str = "text") -> Column:
    """The text with null as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def total_bytes(docs: DataFrame, column: str = "text") -> int:
    """UTF-8 bytes of all texts (one narrow aggregate)."""
    return docs.agg(F.sum(F.octet_length(F.col(column)))).first()[0] or 0


def buckets_for(amount: int, each: int, least: int = 1) -> int:
    """How many buckets hold ``amount`` at ``each`` apiece; grows with the data, no upper cap."""
    return max(least, math.ceil(amount / each))


def chunks(rows: list, weight, most: int) -> Iterator[list]:
    """Consecutive slices of ``rows`` of at most ``most`` total weight (a heavier row stands alone)."""
    part, total = [], 0
    for row in rows:
        w = weight(row)
        if part and total + w > most:
            yield part
            part, total = [], 0
        part.append(row)
        total += w
    if part:
        yield part
