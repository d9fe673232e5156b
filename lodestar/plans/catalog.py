"""Registered queries: one per operator of the survey's inventory, each with its DuckDB twin.

``QUERIES[name](spark, sf_dir) -> DataFrame`` and ``ORACLE_SQL[name]``.  All
queries read the driver's whole tables (decorated by ``fixtures``); nothing is
capped or sampled.  Floating results are rounded to 6 decimals and integers
are BIGINT on both sides so that the comparison is exact.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as TX
from ..operators import chunking as CH
from ..operators import embedding as EM
from ..operators import collection as CO
from ..operators import knn as KNN
from ..operators import pivots as PV
from ..operators import quantize as PQ
from ..operators import versions as VE
from . import fixtures as FX
from . import oracle as O

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = sql
        return fn
    return deco


def r6(col) -> F.Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.round(c.cast("double"), 6)


# ---------------------------------------------------------------------------
# Shared Spark building blocks
# ---------------------------------------------------------------------------

def corpus_chunks(spark, sf_dir, size=P.CHUNK_SIZE, overlap=P.CHUNK_OVERLAP, shared=False, noise=False) -> DataFrame:
    docs = FX.clean_corpus(spark, sf_dir, shared, noise)
    return CH.chunk_tokens(docs, "text", size, overlap, keep=["doc_id", "title", "year", "source"])


def embedded_chunks(spark, sf_dir, noise=False) -> DataFrame:
    chunks = corpus_chunks(spark, sf_dir, noise=noise).withColumn("chunk_id", TX.chunk_id("title", "chunk_index"))
    return EM.embed_hashed(chunks, "chunk_content")


def benchmark_queries(spark, sf_dir) -> DataFrame:
    bench = FX.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return EM.embed_hashed(bench, "text", model_col=None)


# ---------------------------------------------------------------------------
# Flagship: corpus -> clean -> chunk -> embed -> exact top-50 for every benchmark text
# ---------------------------------------------------------------------------

@register("retrieve_benchmark", f"""
WITH {O.corpus_ctes()},
{O.chunk_ctes()},
cks AS (SELECT title || '_chunk_' || CAST(chunk_index AS VARCHAR) AS chunk_id, chunk_content FROM chunks),
{O.embed_ctes('c', 'cks', 'chunk_id', 'chunk_content')},
{O.embed_ctes('q', 'benchmark', 'item_id', 'text')},
{O.sparse_knn_ctes('q', 'c', 50)}
SELECT qid AS query_id, cid AS chunk_id, round(d, 6) AS distance, CAST(rank AS BIGINT) AS rank FROM knn
""")
def retrieve_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = KNN.knn_exact(benchmark_queries(spark, sf_dir), embedded_chunks(spark, sf_dir), k=P.TOP_K,
                         query_id="query_id", item_id="chunk_id")
    return hits.select("query_id", "chunk_id", r6("distance").alias("distance"), "rank")


# ---------------------------------------------------------------------------
# Cleaning and projections
# ---------------------------------------------------------------------------

@register("clean_text", f"""
SELECT doc_id, {O.clean("text || ' x' || repeat('.', CAST(doc_id % 9 AS INTEGER)) || ' end'")} AS text FROM documents
""")
def q_clean_text(spark, sf_dir):
    docs = FX.table(spark, sf_dir, "documents")
    return docs.select("doc_id", TX.clean_text(FX.dotted_text()).alias("text"))


@register("drop_blank", f"""
SELECT doc_id FROM documents
WHERE {O.strip("CASE WHEN doc_id % 10 = 0 THEN '   ' || chr(10) ELSE text END")} <> ''
""")
def q_drop_blank(spark, sf_dir):
    docs = FX.table(spark, sf_dir, "documents").withColumn("text", FX.blanked_text())
    return docs.where(~TX.is_blank("text")).select("doc_id")


@register("derive_title", r"""
SELECT page_id,
       CASE WHEN regexp_extract(name, '\A(\.*[^.].*)\.[^.]*\z', 1) = '' THEN name
            ELSE regexp_extract(name, '\A(\.*[^.].*)\.[^.]*\z', 1) END AS title
FROM (SELECT page_id, regexp_extract(regexp_replace(url, '[?#].*\z', ''), '([^/]*)\z', 1) AS name FROM pages)
""")
def q_derive_title(spark, sf_dir):
    pages = FX.table(spark, sf_dir, "pages")
    return pages.select("page_id", TX.derive_title(TX.strip_url("url")).alias("title"))


@register("token_length", f"""
SELECT doc_id, CAST(len({O.words('text')}) AS BIGINT) AS token_length FROM documents
""")
def q_token_length(spark, sf_dir):
    docs = FX.table(spark, sf_dir, "documents")
    return docs.select("doc_id", TX.token_length("text").alias("token_length"))


# ---------------------------------------------------------------------------
# Tokens and chunks
# ---------------------------------------------------------------------------

@register("tokenize_counts", f"""
SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, array_to_string(t, '') = text AS lossless
FROM (SELECT doc_id, text, regexp_extract_all(text, '{O.TOKEN_WS}') AS t FROM documents)
""")
def q_tokenize_counts(spark, sf_dir):
    docs = FX.table(spark, sf_dir, "documents").withColumn("_t", CH.tokenize("text"))
    return docs.select("doc_id", F.size("_t").cast("bigint").alias("n_tokens"),
                       (F.array_join("_t", "") == F.col("text")).alias("lossless"))


@register("chunk_tokens", f"""
WITH {O.corpus_ctes()},
{O.chunk_ctes()}
SELECT doc_id, CAST(chunk_index AS BIGINT) AS chunk_index, chunk_content, CAST(chunk_tokens AS BIGINT) AS chunk_tokens
FROM chunks
""")
def q_chunk_tokens(spark, sf_dir):
    ch = corpus_chunks(spark, sf_dir)
    return ch.select("doc_id", F.col("chunk_index").cast("bigint").alias("chunk_index"), "chunk_content",
                     F.col("chunk_tokens").cast("bigint").alias("chunk_tokens"))


@register("chunk_stats", f"""
WITH {O.corpus_ctes()},
{O.chunk_ctes()}
SELECT title, count(*) AS n_chunks, CAST(sum(len({O.words('chunk_content')})) AS BIGINT) AS n_words
FROM chunks GROUP BY title
""")
def q_chunk_stats(spark, sf_dir):
    return CH.chunk_stats(corpus_chunks(spark, sf_dir), key="title")


@register("chunk_parts", f"""
WITH {O.corpus_ctes()},
{O.chunk_ctes(64, 16)}
SELECT title, CAST(chunk_index AS BIGINT) AS chunk_index,
       CAST(CASE WHEN n_chunks > 5 THEN floor(chunk_index / 2) + 1 ELSE 1 END AS BIGINT) AS part_num
FROM chunks
""")
def q_chunk_parts(spark, sf_dir):
    ch = corpus_chunks(spark, sf_dir, size=64, overlap=16)
    parts = CH.part_numbers(ch, max_chunks=5, part_size=2)
    return parts.select("title", F.col("chunk_index").cast("bigint").alias("chunk_index"), "part_num")


@register("chunk_id", f"""
WITH {O.corpus_ctes()},
{O.chunk_ctes()}
SELECT doc_id, CAST(chunk_index AS BIGINT) AS chunk_index, title || '_chunk_' || CAST(chunk_index AS VARCHAR) AS chunk_id
FROM chunks
""")
def q_chunk_id(spark, sf_dir):
    ch = corpus_chunks(spark, sf_dir)
    return ch.select("doc_id", F.col("chunk_index").cast("bigint").alias("chunk_index"),
                     TX.chunk_id("title", "chunk_index").alias("chunk_id"))


# ---------------------------------------------------------------------------
# Hashed embedding (sparse view of the dense vector)
# ---------------------------------------------------------------------------

@register("embed_hashed", f"""
WITH {O.corpus_ctes()},
{O.chunk_ctes()},
cks AS (SELECT title || '_chunk_' || CAST(chunk_index AS VARCHAR) AS chunk_id, chunk_content FROM chunks),
{O.embed_ctes('c', 'cks', 'chunk_id', 'chunk_content')}
SELECT id AS chunk_id, bucket, round(CAST(v AS DOUBLE), 6) AS weight FROM c_vec
""")
def q_embed_hashed(spark, sf_dir):
    emb = embedded_chunks(spark, sf_dir)
    sparse = emb.select("chunk_id", F.posexplode("embedding").alias("bucket", "weight")).where(F.col("weight") != 0)
    return sparse.select("chunk_id", F.col("bucket").cast("bigint").alias("bucket"), r6("weight").alias("weight"))


# ---------------------------------------------------------------------------
# Exact kNN over the embeddings table (every vector asks for its 50 nearest)
# ---------------------------------------------------------------------------

@register("knn_exact", f"""
WITH pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id AS item_id, greatest({O.dense_sq_l2('q.embedding', 'c.embedding')}, 0) AS d
  FROM embeddings q CROSS JOIN embeddings c),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(d, 10), item_id) AS rank FROM pairs)
SELECT query_id, item_id, round(d, 6) AS distance, CAST(rank AS BIGINT) AS rank FROM ranked WHERE rank <= 50
""")
def q_knn_exact(spark, sf_dir):
    emb = FX.table(spark, sf_dir, "embeddings")
    queries = emb.select(F.col("vec_id").alias("query_id"), "embedding")
    items = emb.select(F.col("vec_id").alias("item_id"), "embedding")
    hits = KNN.knn_exact(queries, items, k=P.TOP_K, query_id="query_id", item_id="item_id")
    return hits.select("query_id", "item_id", r6("distance").alias("distance"), "rank")


@register("knn_join", ORACLE_SQL["knn_exact"])
def q_knn_join(spark, sf_dir):
    """The exact search for query tables beyond the broadcast bound: pivots and the triangle inequality."""
    emb = FX.table(spark, sf_dir, "embeddings")
    queries = emb.select(F.col("vec_id").alias("query_id"), "embedding")
    items = emb.select(F.col("vec_id").alias("item_id"), "embedding")
    hits = PV.knn_join(queries, items, k=P.TOP_K, item_id="item_id")
    return hits.select("query_id", "item_id", r6("distance").alias("distance"), "rank")


# ---------------------------------------------------------------------------
# Metadata and validation
# ---------------------------------------------------------------------------

@register("enrich_metadata", """
SELECT doc_id, source || '_' || CAST(doc_id AS VARCHAR) AS meta_title, source || '_' || CAST(doc_id AS VARCHAR) AS meta_filename,
       lang AS meta_lang, CAST(4 AS BIGINT) AS n_keys
FROM documents
""")
def q_enrich_metadata(spark, sf_dir):
    from ..sources.corpus import enrich_metadata
    docs = FX.table(spark, sf_dir, "documents")
    raw = docs.select("doc_id", FX.unique_title().alias("title"),
                      F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source"),
                                   F.lit("title"), F.concat(F.lit("pdf title "), F.col("doc_id").cast("string"))).alias("metadata"))
    m = raw.withColumn("metadata", enrich_metadata("metadata", "title"))
    return m.select("doc_id", F.col("metadata")["title"].alias("meta_title"),
                    F.col("metadata")["filename"].alias("meta_filename"), F.col("metadata")["lang"].alias("meta_lang"),
                    F.size("metadata").cast("bigint").alias("n_keys"))


@register("default_metadata", f"""
SELECT doc_id, coalesce(CASE WHEN doc_id % 5 = 0 THEN NULL ELSE {O.UNIQUE_TITLE} END, 'Unknown') AS title,
       coalesce(CASE WHEN doc_id % 7 = 0 THEN NULL ELSE source END, 'Unknown') AS source,
       CAST(len({O.words('text')}) AS BIGINT) AS token_length,
       coalesce(CASE WHEN doc_id % 3 = 0 THEN NULL ELSE 'hashed-bow-384' END, 'Unknown Model') AS embedding_model,
       text AS document
FROM documents
""")
def q_default_metadata(spark, sf_dir):
    docs = FX.table(spark, sf_dir, "documents")
    raw = docs.select(
        "doc_id",
        F.when(F.col("doc_id") % 5 != 0, FX.unique_title()).alias("title"),
        F.when(F.col("doc_id") % 7 != 0, F.col("source")).alias("source_file"),
        TX.token_length("text").alias("token_length"),
        F.when(F.col("doc_id") % 3 != 0, F.lit(EM.HASHED_MODEL_NAME)).alias("embedding_model"),
        F.col("text").alias("chunk_content"))
    rec = CO.default_metadata(raw)
    return rec.select("doc_id", "metadata.title", "metadata.source", "metadata.token_length",
                      "metadata.embedding_model", "document")


@register("valid_embedding", """
SELECT vec_id, CASE WHEN vec_id % 11 = 0 OR vec_id % 13 = 0 THEN 'skipped' ELSE 'valid' END AS status FROM embeddings
""")
def q_valid_embedding(spark, sf_dir):
    emb = FX.table(spark, sf_dir, "embeddings").select(
        "vec_id",
        F.when(F.col("vec_id") % 11 == 0, F.lit(None).cast("array<float>"))
         .when(F.col("vec_id") % 13 == 0, F.array().cast("array<float>"))
         .otherwise(F.col("embedding")).alias("embedding"))
    ok, skipped = CO.valid_embedding(emb)
    return ok.select("vec_id", F.lit("valid").alias("status")).unionByName(
        skipped.select("vec_id", F.lit("skipped").alias("status")))


# ---------------------------------------------------------------------------
# Question parsing, redaction, validation
# ---------------------------------------------------------------------------

@register("extract_document_name", f"""
SELECT item_id, {O.title_name('q')} AS name FROM {O.QUESTIONS}
""")
def q_extract_document_name(spark, sf_dir):
    b = FX.table(spark, sf_dir, "benchmark").select("item_id", FX.composed_question().alias("q"))
    b = FX.with_blank_questions(b, "item_id", "q")
    return b.select("item_id", TX.extract_document_name("q").alias("name"))


@register("validate_query", f"""
SELECT item_id, {O.strip('q')} AS query,
       CASE WHEN {O.strip('q')} = '' THEN 'Query must be a non-empty string.' END AS error
FROM {O.QUESTIONS}
""")
def q_validate_query(spark, sf_dir):
    from ..operators import retrieval as RT
    b = FX.table(spark, sf_dir, "benchmark").select("item_id", FX.composed_question().alias("query"))
    return RT.validate_query(FX.with_blank_questions(b, "item_id", "query"), "query")


LEGAL_SQL = """
CASE WHEN doc_id % 4 = 0 THEN 'see copyright notice ' || CAST(doc_id AS VARCHAR) || chr(10) || text
     WHEN doc_id % 4 = 1 THEN 'x TERMS OF USE y' || chr(10) || text ELSE text END"""


@register("redact_lines", f"""
SELECT doc_id, {O.strip("regexp_replace(t, '(?i)(IPR|copyright|patents|trademarks|terms of use).*', '', 'g')")} AS text
FROM (SELECT doc_id, {LEGAL_SQL} AS t FROM documents)
""")
def q_redact_lines(spark, sf_dir):
    docs = FX.table(spark, sf_dir, "documents").withColumn("text", FX.legal_text())
    return docs.select("doc_id", TX.redact_lines("text").alias("text"))


@register("redact_lines_custom", f"""
SELECT doc_id, {O.strip("regexp_replace(text, '(?i)(Licensed|All rights reserved).*', '', 'g')")} AS text FROM documents
""")
def q_redact_lines_custom(spark, sf_dir):
    docs = FX.table(spark, sf_dir, "documents")
    return docs.select("doc_id", TX.redact_lines("text", ("Licensed", "All rights reserved")).alias("text"))


# ---------------------------------------------------------------------------
# Noise filter with fallback (retrieved rows = conversation turns per conversation)
# ---------------------------------------------------------------------------

NOISE_TEXT_SQL = """
text || CASE turn % 3 WHEN 0 THEN ' Table 1' WHEN 1 THEN ' suitable' ELSE '' END
     || CASE WHEN conv_id % 7 = 0 THEN ' list' ELSE '' END"""


@register("noise_filter", f"""
WITH r AS (SELECT conv_id, turn, {NOISE_TEXT_SQL} AS content FROM conversations),
f AS (SELECT *, NOT (contains(lower(content), 'table') OR contains(lower(content), 'figure')
                     OR contains(lower(content), 'list') OR contains(lower(content), 'appendix')) AS keep FROM r),
g AS (SELECT *, bool_or(keep) OVER (PARTITION BY conv_id) AS any_keep FROM f)
SELECT conv_id, turn FROM g WHERE keep OR NOT any_keep
""")
def q_noise_filter(spark, sf_dir):
    from ..operators import retrieval as RT
    conv = FX.table(spark, sf_dir, "conversations")
    content = F.concat(F.col("text"),
                       F.when(F.col("turn") % 3 == 0, F.lit(" Table 1")).when(F.col("turn") % 3 == 1, F.lit(" suitable")).otherwise(F.lit("")),
                       F.when(F.col("conv_id") % 7 == 0, F.lit(" list")).otherwise(F.lit("")))
    r = conv.select("conv_id", "turn", content.alias("content"))
    return RT.noise_filter(r, group="conv_id", content="content").select("conv_id", "turn")


# ---------------------------------------------------------------------------
# The collection (64/16-token chunks under titles that three documents share)
# ---------------------------------------------------------------------------

COLL_ORDER = ("year", "source", "chunk_index", "doc_id")


def shared_chunks(spark, sf_dir) -> DataFrame:
    ch = corpus_chunks(spark, sf_dir, size=64, overlap=16, shared=True)
    return ch.withColumn("chunk_id", TX.chunk_id("title", "chunk_index"))


def staged(spark, df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared scratch folder and read it back.

    The collection is a stored table in real use; staging it here means the
    legs that read it (scores, payload, titles) do not each re-embed the corpus,
    and the written table cuts the lineage.
    """
    from ..session import scratch_path
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.parquet(path)


def shared_collection(spark, sf_dir) -> DataFrame:
    """First chunk per id wins, then embed (so duplicates are never embedded); staged."""
    first = CO.first_per_key(shared_chunks(spark, sf_dir), "chunk_id", COLL_ORDER)
    return staged(spark, CO.to_records(EM.embed_hashed(first, "chunk_content")), "collection")


def embedded_records(rows: DataFrame, model: str = EM.HASHED_MODEL_NAME) -> DataFrame:
    """Chunks -> embedded collection records."""
    return CO.to_records(EM.embed_hashed(rows, "chunk_content", model_col=None).withColumn("embedding_model", F.lit(model)))


@register("rebuild_collection", f"""
WITH {O.shared_collection_ctes()}
SELECT chunk_id, doc_id, title, CAST(len({O.words('chunk_content')}) AS BIGINT) AS token_length,
       'hashed-bow-384' AS embedding_model
FROM coll
""")
def q_rebuild_collection(spark, sf_dir):
    from ..session import scratch_path
    path = scratch_path(spark, "collection")
    # Winners are picked on the chunks and embedded where they are written, so no vector is shuffled.
    CO.rebuild_collection(spark, path, shared_chunks(spark, sf_dir), order=COLL_ORDER, finish=embedded_records)
    back = spark.read.parquet(path)
    return back.select("chunk_id", "doc_id", "metadata.title", "metadata.token_length", "metadata.embedding_model")


@register("insert_if_absent", f"""
WITH {O.shared_collection_ctes()},
ex AS (SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY year, source, chunk_index, doc_id) AS rn
  FROM cks WHERE doc_id % 2 = 0) WHERE rn = 1)
SELECT chunk_id, doc_id, 'v0' AS embedding_model FROM ex
UNION ALL
SELECT chunk_id, doc_id, 'v1' AS embedding_model FROM coll WHERE chunk_id NOT IN (SELECT chunk_id FROM ex)
""")
def q_insert_if_absent(spark, sf_dir):
    from ..session import scratch_path
    path = scratch_path(spark, "collection")
    # stage the chunks once (a written table cuts the lineage; three writes reuse it); winners alone are embedded
    batch = staged(spark, shared_chunks(spark, sf_dir), "chunk-batch")
    v0, v1 = (functools.partial(embedded_records, model=m) for m in ("v0", "v1"))
    CO.rebuild_collection(spark, path, batch.where(F.col("doc_id") % 2 == 0), order=COLL_ORDER, finish=v0)
    CO.insert_if_absent(spark, path, batch, order=COLL_ORDER, finish=v1)
    CO.insert_if_absent(spark, path, batch, order=COLL_ORDER, finish=v1)  # a replay adds nothing
    back = spark.read.parquet(path)
    return back.select("chunk_id", "doc_id", "metadata.embedding_model")


@register("upsert_collection", f"""
WITH {O.shared_collection_ctes()},
ex AS (SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY year, source, chunk_index, doc_id) AS rn
  FROM cks WHERE doc_id % 2 = 0) WHERE rn = 1),
up AS (SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY year, source, chunk_index, doc_id) AS rn
  FROM cks WHERE doc_id % 3 <> 0) WHERE rn = 1)
SELECT chunk_id, doc_id, 'v1' AS embedding_model FROM up
UNION ALL
SELECT chunk_id, doc_id, 'v0' AS embedding_model FROM ex WHERE chunk_id NOT IN (SELECT chunk_id FROM up)
""")
def q_upsert_collection(spark, sf_dir):
    from ..session import scratch_path
    path = scratch_path(spark, "collection")
    chunks = staged(spark, shared_chunks(spark, sf_dir), "chunk-batch")
    batch = chunks.where(F.col("doc_id") % 3 != 0)
    v0, v1 = (functools.partial(embedded_records, model=m) for m in ("v0", "v1"))
    VE.rebuild(spark, path, chunks.where(F.col("doc_id") % 2 == 0), order=COLL_ORDER, finish=v0)
    VE.upsert(spark, path, batch, order=COLL_ORDER, finish=v1)
    VE.upsert(spark, path, batch, order=COLL_ORDER, finish=v1)  # the same records again change nothing
    return VE.read_version(spark, path).select("chunk_id", "doc_id", "metadata.embedding_model")


@register("list_titles", f"""
WITH {O.corpus_ctes(O.SHARED_TITLE)}
SELECT DISTINCT coalesce(CASE WHEN doc_id % 5 = 0 THEN NULL ELSE title END, 'Unknown') AS title FROM docs
""")
def q_list_titles(spark, sf_dir):
    docs = FX.clean_corpus(spark, sf_dir, shared=True)
    recs = CO.default_metadata(docs.withColumn("title", F.when(F.col("doc_id") % 5 != 0, F.col("title"))))
    return CO.list_titles(recs)


@register("get_by_title", f"""
WITH {O.shared_collection_ctes()}
SELECT chunk_id, chunk_content AS document FROM coll WHERE title = 't3'
""")
def q_get_by_title(spark, sf_dir):
    return CO.get_by_title(shared_collection(spark, sf_dir), "t3", ("chunk_id", "document"))


# ---------------------------------------------------------------------------
# Title legs, hybrid merge, prompts (composed benchmark questions)
# ---------------------------------------------------------------------------

def composed_questions(spark, sf_dir) -> DataFrame:
    from ..operators import retrieval as RT
    b = FX.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"),
                                                     FX.composed_question().alias("query"))
    b = FX.with_blank_questions(b, "query_id", "query")
    return RT.validate_query(b, "query").where(F.col("error").isNull()).drop("error")


@register("title_exists", f"""
WITH {O.shared_collection_ctes()}, {O.questions_ctes()}
SELECT item_id AS query_id, name FROM names WHERE name IN (SELECT title FROM coll)
""")
def q_title_exists(spark, sf_dir):
    from ..operators import retrieval as RT
    names = RT.question_names(composed_questions(spark, sf_dir))
    return RT.title_exists(names, shared_collection(spark, sf_dir)).select("query_id", "name")


@register("title_missing", f"""
WITH {O.shared_collection_ctes()}, {O.questions_ctes()}
SELECT item_id AS query_id, name, 'Couldn''t find a file' AS message FROM names
WHERE name IS NOT NULL AND name NOT IN (SELECT title FROM coll)
""")
def q_title_missing(spark, sf_dir):
    from ..operators import retrieval as RT
    names = RT.question_names(composed_questions(spark, sf_dir))
    return RT.title_missing(names, shared_collection(spark, sf_dir)).select("query_id", "name", "message")


@register("exact_title_leg", f"""
WITH {O.shared_collection_ctes()}, {O.questions_ctes()}
SELECT n.item_id AS query_id,
       CAST(row_number() OVER (PARTITION BY n.item_id ORDER BY c.chunk_index, c.chunk_id) AS BIGINT) AS leg_rank,
       c.chunk_id, c.title AS source, 1.0 AS score, c.chunk_content AS content
FROM names n JOIN coll c ON c.title = n.name
""")
def q_exact_title_leg(spark, sf_dir):
    from ..operators import retrieval as RT
    names = RT.question_names(composed_questions(spark, sf_dir))
    leg = RT.exact_title_leg(names, shared_collection(spark, sf_dir))
    return leg.select("query_id", "leg_rank", "chunk_id", "source", "score", "content")


HYBRID_SQL = f"""
WITH {O.shared_collection_ctes()}, {O.questions_ctes()},
ex AS (SELECT n.item_id AS query_id, 0 AS leg,
              row_number() OVER (PARTITION BY n.item_id ORDER BY c.chunk_index, c.chunk_id) AS leg_rank,
              c.chunk_id, c.title AS source, 1.0 AS score, c.chunk_content AS content
       FROM names n JOIN coll c ON c.title = n.name),
{O.embed_ctes('q', 'qs', 'item_id', 'query')},
{O.embed_ctes('c', 'coll', 'chunk_id', 'chunk_content')},
{O.sparse_knn_ctes('q', 'c', 50)},
vec AS (SELECT knn.qid AS query_id, 1 AS leg, knn.rank AS leg_rank, knn.cid AS chunk_id, coll.title AS source,
               knn.d AS score, coll.chunk_content AS content
        FROM knn JOIN coll ON coll.chunk_id = knn.cid),
u AS (SELECT * FROM ex UNION ALL SELECT * FROM vec),
hybrid AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY leg, leg_rank) AS rank FROM u)
           WHERE rank <= 52)"""


@register("hybrid_retrieve", HYBRID_SQL + f"""
SELECT query_id, CAST(rank AS BIGINT) AS rank, leg, chunk_id, source, round(score, 6) AS score,
       {O.legal_redact('content')} AS content
FROM hybrid
""")
def q_hybrid_retrieve(spark, sf_dir):
    from ..operators import retrieval as RT
    out = RT.hybrid_retrieve(composed_questions(spark, sf_dir), shared_collection(spark, sf_dir))
    return out.select("query_id", "rank", "leg", "chunk_id", "source", r6("score").alias("score"), "content")


@register("assemble_prompt", HYBRID_SQL + f""",
ctx AS (SELECT query_id, string_agg('Source: ' || source || chr(10) || {O.legal_redact('content')}, chr(10) ORDER BY rank) AS context
        FROM hybrid GROUP BY query_id)
SELECT qs.item_id AS query_id,
       chr(10) || '    ### Instructions for LLM:' || chr(10) ||
       '    - **Only answer based on the retrieved context.** ' || chr(10) ||
       '    - **Do not mix Non-RT RIC and Near-RT RIC roles.**' || chr(10) ||
       '    - **Exclude security considerations unless explicitly mentioned in the retrieved context.**' || chr(10) ||
       chr(10) || '    ### Retrieved Context:' || chr(10) || '    ' || coalesce(ctx.context, '') || chr(10) ||
       chr(10) || '    ### Query:' || chr(10) || '    ' || qs.query || chr(10) ||
       chr(10) || '    ### Expected Output:' || chr(10) ||
       '    Provide a structured and accurate response strictly from the context.' || chr(10) || '    ' AS prompt
FROM qs LEFT JOIN ctx ON ctx.query_id = qs.item_id
""")
def q_assemble_prompt(spark, sf_dir):
    from ..operators import prompt as PR
    from ..operators import retrieval as RT
    qs = composed_questions(spark, sf_dir)
    hits = RT.hybrid_retrieve(qs, shared_collection(spark, sf_dir))
    return PR.assemble_prompt(qs, hits, "structured")


# ---------------------------------------------------------------------------
# Evaluation over conversation pairs (user turn = reference,
# next assistant turn = generated answer)
# ---------------------------------------------------------------------------

def conversation_pairs(spark, sf_dir) -> DataFrame:
    from ..operators import evaluation as EV
    conv = FX.table(spark, sf_dir, "conversations")
    qs = conv.where(F.col("role") == "user").select("conv_id", F.col("turn"), F.col("text").alias("reference"))
    ans = conv.where(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("turn"),
                                                          F.col("text").alias("generated"))
    return EV.pair_eval_set(qs, ans, keys=("conv_id", "turn"))


PAIR_IDS = ["conv_id", "turn"]


@register("pair_eval_set", f"""
WITH {O.PAIRS} SELECT conv_id, turn, reference, generated FROM pairs
""")
def q_pair_eval_set(spark, sf_dir):
    return conversation_pairs(spark, sf_dir).select("conv_id", "turn", "reference", "generated")


@register("bleu4", f"""
WITH {O.PAIRS}, {O.bleu_ctes()}
SELECT conv_id, turn, round(bleu, 6) AS bleu FROM bleu
""")
def q_bleu4(spark, sf_dir):
    from ..operators import evaluation as EV
    b = EV.bleu4(conversation_pairs(spark, sf_dir), PAIR_IDS, "reference", "generated")
    return b.select(*PAIR_IDS, r6("bleu").alias("bleu"))


@register("rouge1_f", f"""
WITH {O.PAIRS}, {O.rouge_ctes()}
SELECT conv_id, turn, round(rouge1, 6) AS rouge1 FROM rouge
""")
def q_rouge1_f(spark, sf_dir):
    from ..operators import evaluation as EV
    r = EV.rouge1_f(conversation_pairs(spark, sf_dir), PAIR_IDS, "reference", "generated")
    return r.select(*PAIR_IDS, r6("rouge1").alias("rouge1"))


@register("rouge1_stemmed")
def q_rouge1_stemmed(spark, sf_dir):
    """ROUGE-1 with Porter stemming (rows check: the stemmer has no SQL twin)."""
    from ..operators import evaluation as EV
    r = EV.rouge1_f(conversation_pairs(spark, sf_dir), PAIR_IDS, "reference", "generated", stem=True)
    return r.select(*PAIR_IDS, r6("rouge1").alias("rouge1"))


@register("cosine_mean", """
WITH u AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE) /
         sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * CAST(y AS DOUBLE))))) AS u
  FROM embeddings),
d AS (SELECT label, i, avg(u[i]) AS m FROM (SELECT label, u, unnest(range(1, len(u) + 1)) AS i FROM u) GROUP BY label, i)
SELECT CAST(label AS BIGINT) AS label, round(sum(m * m), 6) AS cosine_mean FROM d GROUP BY label
""")
def q_cosine_mean(spark, sf_dir):
    from ..operators import evaluation as EV
    emb = FX.table(spark, sf_dir, "embeddings").withColumn("label", F.col("label").cast("bigint"))
    cm = EV.cosine_mean(emb, emb, ["label"])
    return cm.select("label", r6("cosine_mean").alias("cosine_mean"))


PAIRS_ID = O.PAIRS + """,
pid AS (SELECT *, CAST(conv_id AS VARCHAR) || '_' || CAST(turn AS VARCHAR) AS pair_id FROM pairs)"""


@register("semantic_similarity", f"""
WITH {PAIRS_ID},
{O.embed_ctes('g', 'pid', 'pair_id', 'generated')},
{O.embed_ctes('r', 'pid', 'pair_id', 'reference')},
{O.sparse_cosine('g', 'r', 'sim')}
SELECT p.conv_id, p.turn, round(sim.cos, 6) AS semantic_similarity FROM pid p JOIN sim ON sim.id = p.pair_id
""")
def q_semantic_similarity(spark, sf_dir):
    from ..operators import evaluation as EV
    s = EV.semantic_similarity(conversation_pairs(spark, sf_dir), "generated", "reference")
    return s.select(*PAIR_IDS, r6("semantic_similarity").alias("semantic_similarity"))


# ---------------------------------------------------------------------------
# Evaluation retrieval and the full evaluation
# ---------------------------------------------------------------------------

@register("retrieve_vector", f"""
WITH {O.corpus_ctes(noise=True)},
{O.chunk_ctes()},
cks AS (SELECT title || '_chunk_' || CAST(chunk_index AS VARCHAR) AS chunk_id, chunk_content FROM chunks),
{O.embed_ctes('c', 'cks', 'chunk_id', 'chunk_content')},
{O.embed_ctes('q', 'benchmark', 'item_id', 'text')},
{O.sparse_knn_ctes('q', 'c', 50)},
hits AS (SELECT knn.qid, knn.cid, knn.rank, cks.chunk_content AS content FROM knn JOIN cks ON cks.chunk_id = knn.cid),
{O.noise_filter_ctes('hits', 'qid', 'kept')}
SELECT qid AS query_id, cid AS chunk_id, CAST(rank AS BIGINT) AS rank FROM kept
""")
def q_retrieve_vector(spark, sf_dir):
    from ..operators import retrieval as RT
    coll = staged(spark, CO.to_records(embedded_chunks(spark, sf_dir, noise=True)), "collection")
    out = RT.retrieve_vector(benchmark_queries(spark, sf_dir), coll, k=P.TOP_K)
    return out.select("query_id", "chunk_id", F.col("leg_rank").alias("rank"))


def _pairs_with_id(spark, sf_dir) -> DataFrame:
    p = conversation_pairs(spark, sf_dir)
    return p.withColumn("query_id", F.concat(F.col("conv_id").cast("string"), F.lit("_"), F.col("turn").cast("string")))


def _eval_retrieval(spark, sf_dir, pairs: DataFrame) -> tuple[DataFrame, DataFrame, bool]:
    """Each pair's reference retrieves its 50 nearest chunks of the corpus (then the noise filter): hits, the chunks' texts, and
    whether there are as many hits as chunks.
    """
    from ..operators import retrieval as RT
    coll = staged(spark, CO.to_records(embedded_chunks(spark, sf_dir)), "collection")
    qv = EM.embed_hashed(pairs.select("query_id", "reference"), "reference", model_col=None)
    hits = RT.retrieve_vector(qv, coll, k=P.TOP_K).select("query_id", "chunk_id", F.col("leg_rank").alias("rank"))
    # grounding reads the hits twice; the search runs once.  A text is stored once, not with each of its hits.
    hits = staged(spark, hits, "hits")
    return hits, coll.select("chunk_id", F.col("document").alias("content")), hits.count() >= coll.count()


GROUNDING_SQL = f"""
WITH {PAIRS_ID},
{O.corpus_ctes()},
{O.chunk_ctes()},
cks AS (SELECT title || '_chunk_' || CAST(chunk_index AS VARCHAR) AS chunk_id, chunk_content FROM chunks),
{O.embed_ctes('c', 'cks', 'chunk_id', 'chunk_content')},
{O.embed_ctes('q', 'pid', 'pair_id', 'reference')},
{O.sparse_knn_ctes('q', 'c', 50)},
hits AS (SELECT knn.qid, knn.rank, cks.chunk_content AS content FROM knn JOIN cks ON cks.chunk_id = knn.cid),
{O.noise_filter_ctes('hits', 'qid', 'kept')},
ctx AS (SELECT p.pair_id, coalesce(string_agg(k.content, ' ' ORDER BY k.rank), '') AS ctx
        FROM pid p LEFT JOIN kept k ON k.qid = p.pair_id GROUP BY p.pair_id),
{O.embed_ctes('x', 'ctx', 'pair_id', 'ctx')},
{O.embed_ctes('g', 'pid', 'pair_id', 'generated')},
{O.embed_ctes('r', 'pid', 'pair_id', 'reference')},
{O.sparse_cosine('g', 'x', 'kg')},
{O.sparse_cosine('g', 'r', 'sim')},
{O.bleu_ctes()},
{O.rouge_ctes()},
ev AS (
  SELECT p.conv_id, p.turn,
         coalesce('q' || CAST(l.quality AS VARCHAR) || '_t' || CAST(l.toxic AS VARCHAR), 'unlabeled') AS category,
         b.bleu, r.rouge1, sim.cos AS semantic_similarity, kg.cos AS kg_score
  FROM pid p
  LEFT JOIN labels l ON l.doc_id = p.conv_id
  JOIN bleu b ON b.conv_id = p.conv_id AND b.turn = p.turn
  JOIN rouge r ON r.conv_id = p.conv_id AND r.turn = p.turn
  JOIN sim ON sim.id = p.pair_id
  JOIN kg ON kg.id = p.pair_id)"""


@register("grounding_score", GROUNDING_SQL + """
SELECT conv_id, turn, round(kg_score, 6) AS kg_score FROM ev
""")
def q_grounding_score(spark, sf_dir):
    from ..operators import evaluation as EV
    pairs = _pairs_with_id(spark, sf_dir)
    hits, contents, most = _eval_retrieval(spark, sf_dir, pairs)
    g = EV.grounding_score(hits, pairs, "query_id", "generated", contents=contents, most_retrieved=most)
    return g.select(*PAIR_IDS, r6("kg_score").alias("kg_score"))


def evaluation_rows(spark, sf_dir) -> DataFrame:
    from ..operators import evaluation as EV
    pairs = _pairs_with_id(spark, sf_dir)
    labels = FX.table(spark, sf_dir, "labels")
    cat = F.coalesce(F.concat(F.lit("q"), F.col("quality").cast("string"), F.lit("_t"), F.col("toxic").cast("string")),
                     F.lit("unlabeled"))
    pairs = pairs.join(labels.select(F.col("doc_id").alias("conv_id"), cat.alias("category")), "conv_id", "left") \
        .withColumn("category", F.coalesce("category", F.lit("unlabeled")))
    hits, contents, most = _eval_retrieval(spark, sf_dir, pairs)
    return EV.evaluate(pairs, hits, PAIR_IDS, "query_id", "reference", "generated", stem=False,  # the SQL twin has no stemmer
                       contents=contents, most_retrieved=most)


METRICS = ("bleu", "rouge1", "semantic_similarity", "kg_score")


@register("evaluate", GROUNDING_SQL + """
SELECT conv_id, turn, category, round(bleu, 6) AS bleu, round(rouge1, 6) AS rouge1,
       round(semantic_similarity, 6) AS semantic_similarity, round(kg_score, 6) AS kg_score FROM ev
""")
def q_evaluate(spark, sf_dir):
    ev = evaluation_rows(spark, sf_dir)
    return ev.select(*PAIR_IDS, "category", *[r6(m).alias(m) for m in METRICS])


@register("summary_by_category", GROUNDING_SQL + """
SELECT category, round(avg(bleu), 4) AS bleu, round(avg(rouge1), 4) AS rouge1,
       round(avg(semantic_similarity), 4) AS semantic_similarity, round(avg(kg_score), 4) AS kg_score
FROM ev GROUP BY category
""")
def q_summary_by_category(spark, sf_dir):
    from ..operators import evaluation as EV
    return EV.summary(evaluation_rows(spark, sf_dir), "category", METRICS)


@register("summary_rows", GROUNDING_SQL + """
SELECT conv_id, turn, category, CAST(nullif(list_position(['q0_t0', 'q0_t1', 'q1_t0', 'q1_t1', 'unlabeled'], category), 0) AS INTEGER)
       AS category_order, round(bleu, 4) AS bleu, round(rouge1, 4) AS rouge1,
       round(semantic_similarity, 4) AS semantic_similarity, round(kg_score, 4) AS kg_score FROM ev
""")
def q_summary_rows(spark, sf_dir):
    from ..operators import evaluation as EV
    order = ["q0_t0", "q0_t1", "q1_t0", "q1_t1", "unlabeled"]
    return EV.summary_rows(evaluation_rows(spark, sf_dir), PAIR_IDS, "category", order, METRICS)


@register("eval_results_readback", GROUNDING_SQL + """
SELECT conv_id, turn, category, round(bleu, 6) AS bleu, round(rouge1, 6) AS rouge1,
       round(semantic_similarity, 6) AS semantic_similarity, round(kg_score, 6) AS kg_score FROM ev
""")
def q_eval_results_readback(spark, sf_dir):
    from ..session import scratch_path
    from ..sources import corpus as SC
    path = scratch_path(spark, "eval-results")
    SC.write_results(evaluation_rows(spark, sf_dir).drop("query_id"), path)
    back = spark.read.json(path)
    return back.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), "category",
                       *[r6(m).alias(m) for m in METRICS])


# ---------------------------------------------------------------------------
# Sources and sinks
# ---------------------------------------------------------------------------

@register("scan_corpus", f"""
SELECT doc_id, CAST(2022 + doc_id % 3 AS INTEGER) AS year, {O.UNIQUE_TITLE} AS title FROM documents
""")
def q_scan_corpus(spark, sf_dir):
    from ..session import scratch_path
    from ..sources import corpus as SC
    path = scratch_path(spark, "corpus")
    FX.corpus(spark, sf_dir).write.mode("overwrite").partitionBy("year").parquet(path)
    # 2025 has no folder: it is skipped, as the reference skips a missing year
    docs = SC.scan_corpus(spark, path, years=(2022, 2023, 2024, 2025))
    return docs.select("doc_id", "year", "title")


@register("route_format", r"""
SELECT page_id, regexp_extract(name, '\.([^.]*)\z', 1) AS extension,
       CASE WHEN suffix(name, '.html') THEN 'accepted' ELSE 'unsupported' END AS status
FROM (SELECT page_id, regexp_extract(regexp_replace(url, '[?#].*\z', ''), '([^/]*)\z', 1) AS name FROM pages)
""")
def q_route_format(spark, sf_dir):
    from ..sources import corpus as SC
    routed = SC.route_format(FX.table(spark, sf_dir, "pages"), "url", allowed=("html",), case_sensitive=True)
    return routed.select("page_id", "extension", "status")


@register("extract_text")
def q_extract_text(spark, sf_dir):
    """HTML pages through the extractor table (rows check: the parser is Python)."""
    from ..sources import corpus as SC
    pages = SC.route_format(FX.table(spark, sf_dir, "pages"), "url", allowed=("html",), case_sensitive=False)
    pages = pages.withColumn("extension", F.when(F.col("status") == "accepted", F.lower("extension")))
    out = SC.extract_text(pages.select("page_id", "extension", F.col("html").alias("content")))
    return out.select("page_id", "status", F.length("text").cast("bigint").alias("n_chars"))


@register("assemble_parts", """
SELECT conv_id, string_agg(text || chr(10), '' ORDER BY turn) AS text FROM conversations GROUP BY conv_id
""")
def q_assemble_parts(spark, sf_dir):
    from ..sources import corpus as SC
    return SC.assemble_parts(FX.table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")


@register("write_documents_readback", f"""
SELECT year, title, doc_id FROM (
  SELECT CAST(2022 + doc_id % 3 AS INTEGER) AS year, {O.SHARED_TITLE} AS title, doc_id,
         row_number() OVER (PARTITION BY 2022 + doc_id % 3, {O.SHARED_TITLE}
                            ORDER BY {O.SHARED_TITLE} || CASE WHEN doc_id % 2 = 0 THEN '.pdf' ELSE '.docx' END DESC,
                                     doc_id DESC) AS rn
  FROM documents) WHERE rn = 1
""")
def q_write_documents_readback(spark, sf_dir):
    from ..session import scratch_path
    from ..sources import corpus as SC
    path = scratch_path(spark, "documents")
    docs = FX.corpus(spark, sf_dir, shared=True).withColumn(
        "file_name", F.concat(F.col("title"), F.when(F.col("doc_id") % 2 == 0, F.lit(".pdf")).otherwise(F.lit(".docx"))))
    SC.write_documents(docs, path, name_col="file_name", tie="doc_id")
    return spark.read.parquet(path).select("year", "title", "doc_id")


@register("read_chunks", f"""
WITH {O.corpus_ctes()},
{O.chunk_ctes(64, 16)}
SELECT title, CAST(chunk_index AS BIGINT) AS chunk_index, chunk_content,
       CAST(CASE WHEN n_chunks > 5 THEN floor(chunk_index / 2) + 1 ELSE 1 END AS BIGINT) AS part_num
FROM chunks
""")
def q_read_chunks(spark, sf_dir):
    from ..session import scratch_path
    from ..sources import corpus as SC
    path = scratch_path(spark, "chunk-files")
    SC.write_chunks(corpus_chunks(spark, sf_dir, size=64, overlap=16), path, max_chunks=5, part_size=2)
    flat, _rejected = SC.read_chunks(spark, path)
    return flat.select("title", F.col("chunk_index").cast("bigint"), "chunk_content", F.col("part_num").cast("bigint"))


INGEST_SQL = r"""
WITH r AS (
  SELECT page_id, regexp_extract(regexp_replace(url, '[?#].*\z', ''), '([^/]*)\z', 1) AS name, html FROM pages),
t AS (SELECT page_id, suffix(name, '.html') AS ok,
             regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>', ' ', 'g'),
                            '(?s)<[^>]*>', ' ', 'g') AS text FROM r),
c AS (SELECT page_id, ok, text, len(regexp_extract_all(text, '{tok}')) AS n_tok FROM t)
SELECT status, count(*) AS n FROM (
  SELECT CASE WHEN NOT ok THEN 'unsupported' WHEN {strip} = '' THEN 'empty'
              WHEN ceil(n_tok / 48.0) > 5 THEN 'split' ELSE 'processed' END AS status FROM c)
GROUP BY status
"""


@register("ingest_report", INGEST_SQL.replace("{tok}", P.TOKEN_WS_RE2).replace("{strip}", O.strip("text")))
def q_ingest_report(spark, sf_dir):
    from ..sources import corpus as SC
    pages = SC.route_format(FX.table(spark, sf_dir, "pages"), "url", allowed=("html",), case_sensitive=True)
    text = SC.strip_html("html")
    n_chunks = CH.chunk_count(F.size(CH.tokenize(text)), 64, 16)
    status = (F.when(F.col("status") != "accepted", F.lit("unsupported"))
              .when(TX.is_blank(text), F.lit("empty"))
              .when(n_chunks > 5, F.lit("split"))
              .otherwise(F.lit("processed")))
    return SC.ingest_report(pages.select(status.alias("status")))


# ---------------------------------------------------------------------------
# Fuzzy title match and approximate kNN (rows checks + pytest against brute force)
# ---------------------------------------------------------------------------

def mutated_names(spark, sf_dir) -> DataFrame:
    """Every title with one character changed, dropped or upper-cased (by ``doc_id % 3``), plus one unrelated name."""
    docs = FX.table(spark, sf_dir, "documents").select("doc_id", FX.unique_title().alias("title"))
    m = F.col("doc_id") % 3
    t = F.col("title")
    name = (F.when(m == 0, F.concat(F.expr("substring(title, 1, length(title) - 1)"), F.lit("x")))
            .when(m == 1, F.concat(F.substring(t, 1, 1), F.expr("substring(title, 3)")))
            .otherwise(F.upper(t)))
    names = docs.select(F.col("doc_id").alias("name_id"), name.alias("name"))
    unrelated = spark.createDataFrame([(-1, "completely unrelated name")], "name_id bigint, name string")
    return names.unionByName(unrelated)


@register("fuzzy_title_match")
def q_fuzzy_title_match(spark, sf_dir):
    from ..operators import retrieval as RT
    titles = FX.table(spark, sf_dir, "documents").select(FX.unique_title().alias("title"))
    out = RT.fuzzy_title_match(mutated_names(spark, sf_dir), titles)
    return out.select("name_id", "name", "title", r6("ratio").alias("ratio"))


def _cells_of(spark, sf_dir):
    """``(queries, items stored by cell, centroids)`` of the embeddings."""
    from ..session import scratch_path
    emb = FX.table(spark, sf_dir, "embeddings")
    items = emb.select(F.col("vec_id").alias("item_id"), "embedding")
    cents = KNN.train_cells(items, n_cells=16)
    path = scratch_path(spark, "cells")
    KNN.assign_cells(items, cents).write.partitionBy("cell").parquet(path)
    return emb.select(F.col("vec_id").alias("query_id"), "embedding"), spark.read.parquet(path), cents


def _coded(spark, sf_dir):
    """``(questions, items stored with their codes, codebooks)`` of the embeddings."""
    from ..session import scratch_path
    emb = FX.table(spark, sf_dir, "embeddings")
    items = emb.select(F.col("vec_id").alias("item_id"), "embedding")
    books = PQ.train_codebooks(items, id_col="item_id")
    path = scratch_path(spark, "coded")
    PQ.with_codes(items, books).write.parquet(path)
    return emb.select(F.col("vec_id").alias("query_id"), "embedding"), spark.read.parquet(path), books


@register("knn_approx")
def q_knn_approx(spark, sf_dir):
    """Product-quantised search; lists as long as a measured recall of 0.9 or more takes."""
    queries, coded, books = _coded(spark, sf_dir)
    length = PQ.choose_list(queries, coded, books, k=P.TOP_K, item_id="item_id")
    hits = PQ.knn_quantized(queries, coded, books, k=P.TOP_K, list_length=length, item_id="item_id")
    return hits.select("query_id", "item_id", r6("distance").alias("distance"), "rank")


@register("knn_approx_whole_list", ORACLE_SQL["knn_exact"])
def q_knn_approx_whole_list(spark, sf_dir):
    """Product-quantised search with lists as long as the table: the same rows as the exact search."""
    queries, coded, books = _coded(spark, sf_dir)
    hits = PQ.knn_quantized(queries, coded, books, k=P.TOP_K, list_length=coded.count(), item_id="item_id")
    return hits.select("query_id", "item_id", r6("distance").alias("distance"), "rank")


@register("knn_cells")
def q_knn_cells(spark, sf_dir):
    """As many cells as a measured recall of 0.9 or more takes."""
    queries, cells, cents = _cells_of(spark, sf_dir)
    nprobe = KNN.choose_nprobe(queries, cells, cents, k=P.TOP_K, item_id="item_id")
    hits = KNN.knn_approx(queries, cells, cents, k=P.TOP_K, nprobe=nprobe, item_id="item_id")
    return hits.select("query_id", "item_id", r6("distance").alias("distance"), "rank")


@register("knn_approx_all_cells", ORACLE_SQL["knn_exact"])
def q_knn_approx_all_cells(spark, sf_dir):
    """Every cell probed: the same rows as the exact search."""
    queries, cells, cents = _cells_of(spark, sf_dir)
    hits = KNN.knn_approx(queries, cells, cents, k=P.TOP_K, nprobe=16, item_id="item_id")
    return hits.select("query_id", "item_id", r6("distance").alias("distance"), "rank")


# ---------------------------------------------------------------------------
# Streams (each equals its batch twin)
# ---------------------------------------------------------------------------

def _chunks_of_stream(df: DataFrame) -> DataFrame:
    docs = df.select("doc_id", FX.shared_title().alias("title"), FX.year_of("doc_id").alias("year"), "source",
                     TX.clean_text("text").alias("text")).where(~TX.is_blank("text"))
    ch = CH.chunk_tokens(docs, "text", 64, 16, keep=["doc_id", "title", "year", "source"])
    return ch.withColumn("chunk_id", TX.chunk_id("title", "chunk_index"))


def _prepare_shared(df: DataFrame) -> DataFrame:
    return embedded_records(_chunks_of_stream(df))


@register("ingest_stream", ORACLE_SQL["rebuild_collection"])
def q_ingest_stream(spark, sf_dir):
    from ..session import scratch_path
    from .. import streaming as ST
    schema = FX.table(spark, sf_dir, "documents").schema
    stream = ST.table_stream(spark, FX.table_path(sf_dir, "documents"), schema)
    path, ckpt = scratch_path(spark, "collection"), scratch_path(spark, "ckpt-ingest")
    q = ST.ingest_stream(spark, stream, _chunks_of_stream, path, ckpt, order=COLL_ORDER, finish=embedded_records)
    q.awaitTermination()
    back = spark.read.parquet(path)
    return back.select("chunk_id", "doc_id", "metadata.title", "metadata.token_length", "metadata.embedding_model")


@register("dedup_stream", """
SELECT md5(text) AS text_key, min(doc_id) AS doc_id FROM documents GROUP BY md5(text)
""")
def q_dedup_stream(spark, sf_dir):
    from ..session import scratch_path
    from .. import streaming as ST
    schema = FX.table(spark, sf_dir, "documents").schema
    stream = ST.table_stream(spark, FX.table_path(sf_dir, "documents"), schema).select(
        "doc_id", F.md5("text").alias("text_key"))
    target, ckpt = scratch_path(spark, "dedup"), scratch_path(spark, "ckpt-dedup")
    ST.dedup_stream(spark, stream, "text_key", ["doc_id"], target, ckpt).awaitTermination()
    return spark.read.parquet(target).select("text_key", "doc_id")


@register("query_stream", ORACLE_SQL["assemble_prompt"])
def q_query_stream(spark, sf_dir):
    from ..operators import prompt as PR
    from ..operators import retrieval as RT
    from ..session import scratch_path
    from .. import streaming as ST
    coll_path = scratch_path(spark, "collection")
    # As in rebuild_collection: each winner is embedded and written once, and no vector is shuffled.
    CO.rebuild_collection(spark, coll_path, shared_chunks(spark, sf_dir), order=COLL_ORDER, finish=embedded_records)
    schema = FX.table(spark, sf_dir, "benchmark").schema
    raw = ST.table_stream(spark, FX.table_path(sf_dir, "benchmark"), schema)
    qs = raw.select(F.col("item_id").alias("query_id"), TX.py_strip(FX.composed_question()).alias("query")) \
        .where(F.col("query") != "")

    def answer(batch: DataFrame) -> DataFrame:
        coll = spark.read.parquet(coll_path)
        hits = RT.hybrid_retrieve(batch, coll)
        return PR.assemble_prompt(batch, hits, "structured")

    target, ckpt = scratch_path(spark, "prompts"), scratch_path(spark, "ckpt-questions")
    ST.query_stream(spark, qs, answer, target, ckpt).awaitTermination()
    return spark.read.parquet(target).select("query_id", "prompt")


@register("ingest_outcomes")
def q_ingest_outcomes(spark, sf_dir):
    """Every page routed, extracted by the HTML extractor, chunked (64/16, split above 5) and counted by outcome."""
    from ..sources import corpus as SC
    pages = SC.route_format(FX.table(spark, sf_dir, "pages"), "url", allowed=("html",), case_sensitive=True)
    pages = pages.withColumn("extension", F.when(F.col("status") == "accepted", F.col("extension")))
    extracted = SC.extract_text(pages.select("page_id", "extension", F.col("html").alias("content")))
    outcomes = SC.ingest_outcomes(extracted, size=64, overlap=16, max_chunks=5)
    return SC.ingest_report(outcomes, "outcome")
