"""Question side: validation, title legs, vector leg, hybrid merge, noise filter, fuzzy titles.

Questions are a table ``(query_id, query)``; every operator answers all of them
in one job.  Ranked cuts are windows on ``query_id`` (never a global ``limit``),
which Spark turns into a ``WindowGroupLimit`` on both sides of the exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as TX
from . import embedding as EM
from . import knn as KNN

EMPTY_QUERY_ERROR = P.EMPTY_QUERY_ERROR
MISSING_TITLE_MESSAGE = P.MISSING_TITLE_MESSAGE
#: distinct names pushed into the scan as an IN-list; above this, a plain join
NAME_PUSHDOWN_LIMIT = 10_000

LEG_EXACT = 0
LEG_VECTOR = 1


def validate_query(df: DataFrame, col: str = "query") -> DataFrame:
    """Strip the question; ``error`` is set (and the row kept) when nothing is left."""
    q = TX.py_strip(col)
    return df.withColumn(col, q).withColumn(
        "error", F.when(F.col(col).isNull() | (F.col(col) == ""), F.lit(EMPTY_QUERY_ERROR)))


def question_names(questions: DataFrame, query_col: str = "query", qid: str = "query_id") -> DataFrame:
    """``(query_id, name)`` for questions that mention a document or file."""
    return (questions.select(qid, TX.extract_document_name(query_col).alias("name"))
            .where(F.col("name").isNotNull()))


def collection_view(collection: DataFrame) -> DataFrame:
    """Flat view of collection records used by the legs."""
    return collection.select(
        "chunk_id", "embedding",
        F.coalesce(F.col("metadata.title"), F.lit(P.DEFAULT_TITLE)).alias("title"),
        F.col("document").alias("content"),
        *[c for c in ("chunk_index",) if c in collection.columns])


def titles(collection: DataFrame) -> DataFrame:
    return collection.select(F.coalesce(F.col("metadata.title"), F.lit(P.DEFAULT_TITLE)).alias("title")).distinct()


def title_exists(names: DataFrame, collection: DataFrame) -> DataFrame:
    """Names that are a stored title (semi join)."""
    return names.join(titles(collection), names["name"] == F.col("title"), "left_semi")


def title_missing(names: DataFrame, collection: DataFrame) -> DataFrame:
    """Names that are not a stored title (anti join), with the reference's message."""
    miss = names.join(titles(collection), names["name"] == F.col("title"), "left_anti")
    return miss.withColumn("message", F.lit(MISSING_TITLE_MESSAGE))


def _pushdown_names(names: DataFrame, collection: DataFrame) -> DataFrame:
    """Filter the collection on the raw ``metadata.title`` so Parquet can skip row groups.

    The distinct names are bounded by ``NAME_PUSHDOWN_LIMIT`` before they become
    an IN list; above it the join alone does the work.
    """
    distinct = [r[0] for r in names.select("name").distinct().limit(NAME_PUSHDOWN_LIMIT + 1).collect()]
    if len(distinct) > NAME_PUSHDOWN_LIMIT:
        return collection
    cond = F.col("metadata.title").isin(distinct)
    if P.DEFAULT_TITLE in distinct:  # a missing title reads as the default
        cond = cond | F.col("metadata.title").isNull()
    return collection.where(cond)


def exact_title_leg(names: DataFrame, collection: DataFrame, limit: int | None = None,
                    qid: str = "query_id") -> DataFrame:
    """All chunks of the named title, score 1.0, ranked by ``chunk_index`` then ``chunk_id``.

    ``limit`` keeps the first ``limit`` per question (the merged list never uses
    more), so a title with millions of chunks contributes ``limit`` rows per task.
    """
    view = collection_view(_pushdown_names(names, collection))
    joined = names.join(view.drop("embedding"), names["name"] == view["title"], "inner")
    order = [F.col("chunk_index"), F.col("chunk_id")] if "chunk_index" in view.columns else [F.col("chunk_id")]
    ranked = joined.withColumn("leg_rank", F.row_number().over(Window.partitionBy(qid).orderBy(*order)))
    if limit is not None:
        ranked = ranked.where(F.col("leg_rank") <= limit)
    return ranked.select(qid, F.lit(LEG_EXACT).alias("leg"), F.col("leg_rank").cast("bigint").alias("leg_rank"),
                         "chunk_id", F.col("title").alias("source"), F.lit(1.0).alias("score"), "content")


#: hit rows (questions x k) above which the payload join is left to the planner
HIT_BROADCAST_ROWS = 5_000_000


def vector_leg(questions: DataFrame, collection: DataFrame, k: int = P.TOP_K, qid: str = "query_id",
               qvec: str = "embedding", flags: dict[str, Column] | None = None) -> DataFrame:
    """The ``k`` nearest chunks per question with their title and content (and ``flags``, worked out once for each chunk).

    Scoring reads only ``(chunk_id, embedding)``; the payload is attached after
    the global top-k.  The hit list has at most ``questions x k`` rows, so when
    that bound is under the limit it is broadcast and the collection is scanned,
    not shuffled, for the payload.
    """
    view = collection_view(collection)
    q = questions.select(qid, qvec)
    hits = KNN.knn_exact(q, view.select("chunk_id", "embedding"), k=k, query_id=qid, query_vec=qvec,
                         item_id="chunk_id", item_vec="embedding")
    n_questions = q.count()
    flags = flags or {}
    payload = view.select("chunk_id", "title", "content", *[c.alias(name) for name, c in flags.items()])
    if n_questions * k <= HIT_BROADCAST_ROWS:
        joined = payload.join(F.broadcast(hits), "chunk_id")
    else:
        joined = hits.join(payload, "chunk_id")
    return joined.select(qid, F.lit(LEG_VECTOR).alias("leg"), F.col("rank").alias("leg_rank"), "chunk_id",
                         F.col("title").alias("source"), F.col("distance").alias("score"), "content", *flags)


def hybrid_retrieve(questions: DataFrame, collection: DataFrame, k: int = P.TOP_K, extra: int = P.MERGED_EXTRA,
                    redact: bool = True, dedup: bool = False, qid: str = "query_id", query_col: str = "query",
                    embed=None) -> DataFrame:
    """Exact-title chunks first, then the ``k`` nearest, cut at ``k + extra`` per question.

    Duplicates across legs are kept unless ``dedup``.  ``score`` is 1.0 on the
    exact leg and squared L2 on the vector leg (``leg`` tells them apart).
    ``embed(df, text_col) -> df with 'embedding'`` defaults to the hashed embedder.
    """
    embed = embed or (lambda df, col: EM.embed_hashed(df, col, model_col=None))
    cut = k + extra
    names = question_names(questions, query_col, qid)
    exact = exact_title_leg(names, collection, limit=cut, qid=qid)
    qv = embed(questions.select(qid, query_col), query_col)
    vec = vector_leg(qv, collection, k=k, qid=qid)
    both = exact.unionByName(vec)
    if dedup:
        both = both.withColumn("_d", F.row_number().over(
            Window.partitionBy(qid, "chunk_id").orderBy("leg", "leg_rank"))).where("_d = 1").drop("_d")
    ranked = both.withColumn("rank", F.row_number().over(Window.partitionBy(qid).orderBy("leg", "leg_rank")))
    out = ranked.where(F.col("rank") <= cut).withColumn("rank", F.col("rank").cast("bigint"))
    if redact:
        out = out.withColumn("content", TX.redact_lines("content"))
    return out


def noise_filter(df: DataFrame, group: str = "query_id", content: str = "content", tags=P.NOISE_TAGS) -> DataFrame:
    """Drop chunks containing a noise tag; a question whose chunks are all noise keeps them all."""
    return _drop_noise(df.withColumn("_keep", ~TX.contains_any(content, tags)), group)


def _drop_noise(flagged: DataFrame, group: str) -> DataFrame:
    flagged = flagged.withColumn("_any", F.max(F.col("_keep").cast("int")).over(Window.partitionBy(group)))
    return flagged.where(F.col("_keep") | (F.col("_any") == 0)).drop("_keep", "_any")


def retrieve_vector(questions: DataFrame, collection: DataFrame, k: int = P.TOP_K, qid: str = "query_id",
                    qvec: str = "embedding") -> DataFrame:
    """Evaluation retrieval: the ``k`` nearest chunks' content, then the noise filter (tags looked up once for each chunk)."""
    keep = {"_keep": ~TX.contains_any("content", P.NOISE_TAGS)}
    return _drop_noise(vector_leg(questions, collection, k, qid, qvec, keep), qid)


# ---------------------------------------------------------------------------
# Fuzzy title match: ratio = 1 - indel / (len a + len b) = 2 LCS / (len a + len b)
# ---------------------------------------------------------------------------

def _bit(n: Column) -> Column:
    """``1 << n`` as BIGINT (shift amount is a column)."""
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), n)


def lcs_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence, bit-parallel over ``b`` (``len b <= 62``)."""
    lb = F.length(b)
    full = _bit(lb) - 1
    chars = F.transform(F.sequence(F.lit(1), F.greatest(F.length(a), F.lit(1))), lambda i: F.substring(a, i, 1))
    chars = F.when(F.length(a) > 0, chars).otherwise(F.array().cast("array<string>"))

    def mask(ch):
        return F.aggregate(F.sequence(F.lit(0), F.greatest(lb - 1, F.lit(0))), F.lit(0).cast("bigint"),
                           lambda m, j: m.bitwiseOR(F.when(F.substring(b, j + 1, 1) == ch,
                                                           _bit(j)).otherwise(F.lit(0).cast("bigint"))))

    def step(v, ch):
        u = v.bitwiseAND(mask(ch))
        return (v + u).bitwiseOR(v - u).bitwiseAND(full)

    v = F.aggregate(chars, full, step)
    return F.when(lb == 0, F.lit(0)).otherwise(lb - F.bit_count(v))


def lcs_length_dp(a: Column, b: Column) -> Column:
    """Plain dynamic-programming LCS, for pairs where both strings exceed 62 characters."""
    lb = F.length(b)
    chars = F.transform(F.sequence(F.lit(1), F.greatest(F.length(a), F.lit(1))), lambda i: F.substring(a, i, 1))

    def row_step(row, ch):
        return F.aggregate(
            F.sequence(F.lit(1), lb), F.array(F.lit(0)),
            lambda acc, j: F.concat(acc, F.array(F.when(F.substring(b, j, 1) == ch, F.element_at(row, j) + 1)
                                                 .otherwise(F.greatest(F.element_at(row, j + 1), F.element_at(acc, j))))))

    last = F.aggregate(chars, F.array_repeat(F.lit(0), lb + 1), row_step)
    return F.element_at(last, lb + 1)


def indel_ratio(a: Column, b: Column) -> Column:
    """``1 - indel / (len a + len b)``; 1.0 for two empty strings."""
    la, lb = F.length(a), F.length(b)
    # LCS is symmetric: run the bit vector over the shorter string.
    lcs = (F.when(F.least(la, lb) > 62, lcs_length_dp(a, b))
           .when(lb <= la, lcs_length(a, b)).otherwise(lcs_length(b, a)))
    total = la + lb
    return F.when(total == 0, F.lit(1.0)).otherwise(1.0 - (total - 2 * lcs) / total)


def fuzzy_title_match(names: DataFrame, title_df: DataFrame, threshold: float = P.FUZZY_THRESHOLD,
                      name_id: str = "name_id", name_col: str = "name", title_col: str = "title") -> DataFrame:
    """Best stored title with ``ratio > threshold`` per name (see ``operators.fuzzy``)."""
    from .fuzzy import fuzzy_title_match as run
    return run(names, title_df, threshold, name_id, name_col, title_col)
