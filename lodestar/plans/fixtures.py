"""Table loading and the fixed decorations applied to the driver's tables.

The driver's tables contain no six-dot runs, legal keywords, noise tags or
"document X" mentions, so a no-op operator would pass on them.  Each registered
query therefore decorates its input by a fixed rule of the row id; the DuckDB
oracle applies the same rule.  Nothing here drops rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as TX
from ..session import spread

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations")


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def year_of(id_col: str) -> Column:
    """Corpus year folder: 2022, 2023, 2024 by ``id % 3``."""
    return (F.lit(2022) + F.col(id_col) % 3).cast("int")


def unique_title(source_col: str = "source", id_col: str = "doc_id") -> Column:
    return F.concat(F.col(source_col), F.lit("_"), F.col(id_col).cast("string"))


def shared_title(id_col: str = "doc_id") -> Column:
    """Titles that three neighbouring documents of three years share; their number grows with the corpus."""
    return F.concat(F.lit("t"), F.floor(F.col(id_col) / 3).cast("string"))


def corpus(spark: SparkSession, sf_dir: str, shared: bool = False) -> DataFrame:
    """documents as a corpus: ``doc_id, title, year, source, text`` (title unique unless ``shared``)."""
    docs = spread(table(spark, sf_dir, "documents"))
    title = shared_title() if shared else unique_title()
    return docs.select("doc_id", title.alias("title"), year_of("doc_id").alias("year"), "source", "text")


def noise_suffix(id_col: str = "doc_id") -> Column:
    """`` Table 1`` for ``id % 3 = 0``, `` suitable`` (contains "table") for 1, nothing for 2."""
    m = F.col(id_col) % 3
    return F.when(m == 0, F.lit(" Table 1")).when(m == 1, F.lit(" suitable")).otherwise(F.lit(""))


def clean_corpus(spark: SparkSession, sf_dir: str, shared: bool = False, noise: bool = False) -> DataFrame:
    """Extraction output as the reference cleans it: dot runs removed, blank texts dropped."""
    c = corpus(spark, sf_dir, shared)
    if noise:
        c = c.withColumn("text", F.concat(F.col("text"), noise_suffix()))
    c = c.withColumn("text", TX.clean_text("text"))
    return c.where(~TX.is_blank("text"))


def dotted_text(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """Append `` x`` + 0..8 dots + `` end`` by ``id % 9``: five stay, six go."""
    return F.concat(F.col(text_col), F.lit(" x"), F.repeat(F.lit("."), (F.col(id_col) % 9).cast("int")), F.lit(" end"))


def blanked_text(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """Three spaces and a newline where ``id % 10 = 0``."""
    return F.when(F.col(id_col) % 10 == 0, F.lit("   \n")).otherwise(F.col(text_col))


def legal_text(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """A legal line in front of the text: copyright for ``id % 4 = 0``, terms of use for 1."""
    line = (F.when(F.col(id_col) % 4 == 0, F.concat(F.lit("see copyright notice "), F.col(id_col).cast("string")))
            .when(F.col(id_col) % 4 == 1, F.lit("x TERMS OF USE y")))
    return F.when(line.isNull(), F.col(text_col)).otherwise(F.concat(line, F.lit("\n"), F.col(text_col)))


def composed_question(id_col: str = "item_id", text_col: str = "text") -> Column:
    """Benchmark item as a question, by ``item_id % 6`` naming a document or none; every item keeps its text."""
    m = F.col(id_col) % 6
    t = F.col(text_col)
    return (F.when(m == 0, F.concat(F.lit("see document t3 please "), t))
            .when(m == 1, F.concat(F.lit("open FILE t3. "), t))
            .when(m == 2, F.concat(F.lit("profile t3 x "), t))
            .when(m == 3, F.concat(F.lit("documents t3 "), t))
            .otherwise(F.concat(F.lit("no name "), t)))


def with_blank_questions(questions: DataFrame, id_col: str, query_col: str) -> DataFrame:
    """``questions`` and, for every sixth of them, one more row of blanks (id ``-1 - id``)."""
    blank = questions.where(F.col(id_col) % 6 == 5).select((-1 - F.col(id_col)).alias(id_col), F.lit("  ").alias(query_col))
    return questions.select(id_col, query_col).unionByName(blank)
