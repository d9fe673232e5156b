"""Benchmark passages in documents, found by winnowed fingerprints; SQL functions only.

1. Benchmark items become windows of ``width`` consecutive words (a shorter item is one window); a window's
   fingerprint is the smallest hash among its runs of ``GRAM`` words.
2. Of a document the smallest hash of every stretch of ``width`` words is kept, once for each run of neighbouring stretches
   that share it.  A stretch equal to a window has the window's fingerprint, so a join of fingerprints meets every
   shared span of ``width`` words or more.
3. Each hit is extended: at every stretch of its run the document's words are compared with the window's.

Items of fewer words than ``width`` have fingerprints of their own length; the documents are fingerprinted once for each
length that occurs, at most ``width`` of them.  Windows that fit into ``BROADCAST_BYTES`` are sent to the documents, which
then pass in one narrow step with a shuffle of one row a document and its hits; more windows are joined by shuffles, where
only documents with an equal hash come back with their words.

Defined cases: null and blank texts have no words; an item without words has no window; item rows of one id are one
item; an item without an id marks words but is not counted; document rows that agree in id and
text have the same figures and are all returned; empty tables give no rows (documents) or no hits (benchmark); other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_column
from .quality import let

WIDTH, GRAM = 10, 5
#: Serialised size of windows up to which they are broadcast, as the sum of their words and ``ROW`` for each.
BROADCAST_BYTES, ROW = 32 << 20, 200
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Maximal runs of letters, digits and characters beyond ASCII, with A-Z lower-cased."""
    low = F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, CAPITALS, CAPITALS.lower())).otherwise(F.lower(text))
    return F.array_remove(F.split(low, SEPARATORS), "")


def grams(w: Column, gram: int) -> Column:
    """The hash of the ``gram`` words from each word on; beyond the last word fewer are left (``xxhash64`` passes nulls over)."""
    return let(F.transform(w, lambda x: F.xxhash64(x)),
               lambda h: F.transform(h, lambda _, i: F.xxhash64(*(F.get(h, i + k) for k in range(gram)))))


def least_hashes(w: Column, width: int) -> Column:
    """For every stretch of ``width`` words the smallest hash of its runs of ``GRAM`` words; empty for fewer words."""
    gram = min(GRAM, width)
    least = lambda g: F.transform(
        F.slice(g, F.lit(1), F.greatest(F.size(w) - width + 1, F.lit(0))),
        lambda x, i: F.least(x, *(F.get(g, i + k) for k in range(1, width - gram + 1))) if width > gram else x)
    return let(grams(w, gram), least)


def fingerprints(w: Column, width: int) -> Column:
    """``(width, first, last, hash)`` of each run of neighbouring stretches with the same smallest hash."""
    def runs(m: Column) -> Column:
        firsts = F.filter(F.transform(m, lambda x, i: F.when((i == 0) | (F.get(m, i - 1) != x), i)), lambda i: i.isNotNull())
        return let(firsts, lambda f: F.transform(f, lambda first, k: F.struct(
            F.lit(width).alias("width"), first.alias("first"),
            (F.coalesce(F.get(f, k + 1), F.size(m)) - 1).alias("last"), F.get(m, first).alias("hash"))))

    return let(least_hashes(w, width), runs)


def windows(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """``width, hash, window, items`` of each distinct window; ``items`` are the ids of the items that hold it."""
    w = benchmark.select("item_id", words(text_column()).alias("w")).where(F.size("w") > 0)
    each = F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - width + 1, F.lit(1))))
    cut = w.select("item_id", "w", each.alias("at")).select("item_id", F.slice("w", F.col("at"), F.lit(width)).alias("window"))
    distinct = cut.groupBy("window").agg(F.collect_set(F.col("item_id").cast("string")).alias("items"))
    full = F.greatest(F.size("window") - GRAM + 1, F.lit(1))  # a window of fewer words is one run of all of them
    least = F.array_min(F.slice(grams(F.col("window"), GRAM), F.lit(1), full))
    return distinct.select(F.size("window").alias("width"), least.alias("hash"), "window", "items")


def _starts(words: Column, first: Column, last: Column, window: Column) -> Column:
    """Which stretches ``first`` to ``last`` of ``words`` equal ``window``."""
    return F.filter(F.sequence(first, last), lambda i: F.slice(words, i + 1, F.size(window)) == window)


def _marked(spans: Column) -> Column:
    """Words that the spans (first word, number of words) cover together; spans in order."""
    return F.aggregate(
        spans, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda acc, s: F.struct(
            (acc["n"] + F.greatest(s["first"] + s["n"] - F.greatest(acc["end"], s["first"]), F.lit(0))).alias("n"),
            F.greatest(acc["end"], s["first"] + s["n"]).alias("end")), lambda acc: acc["n"])


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` of every row."""
    held = windows(benchmark, width)
    size = F.octet_length(F.array_join("window", " ")) + F.coalesce(F.octet_length(F.array_join("items", " ")), F.lit(0)) + ROW
    figures = held.agg(F.sort_array(F.collect_set("width")).alias("widths"), F.sum(size).alias("bytes")).first()
    lengths = figures["widths"]  # at most ``width`` numbers

    text = text_column()
    found = lambda w: F.struct(
        F.size(w).alias("n_words"), w.alias("w"),
        F.concat(F.array().cast("array<struct<width:int,first:int,last:int,hash:bigint>>"),
                 *(fingerprints(w, n) for n in lengths)).alias("prints"))
    cut = docs.select(F.col("doc_id").cast("long"), F.md5(text).alias("digest"), F.explode(F.array(let(words(text), found))).alias("d"))
    key = ["doc_id", "digest"]
    n_words, starts = F.col("d.n_words").alias("n_words"), _starts(F.col("d.w"), F.col("p.first"), F.col("p.last"), F.col("window"))
    small = (figures["bytes"] or 0) <= broadcast_bytes
    if small:
        # One print of no window stands for the document itself, so one pass returns its length and its hits.
        own = F.struct(F.lit(0).alias("width"), F.lit(0).alias("first"), F.lit(0).alias("last"), F.lit(0).cast("long").alias("hash"))
        none = held.sparkSession.range(1).select(
            F.lit(0).alias("width"), F.lit(0).cast("long").alias("hash"), F.lit(None).cast("array<string>").alias("window"),
            F.lit(None).cast("array<string>").alias("items"))
        prints = cut.select(*key, "d", F.explode(F.concat("d.prints", F.array(own))).alias("p")).select(
            "*", "p.width", "p.hash")
        hits = prints.join(F.broadcast(held.unionByName(none)), ["width", "hash"]).select(
            *key, n_words, "items", F.size("window").alias("n"), F.when(F.col("window").isNotNull(), starts).alias("starts"))
    else:
        prints = cut.select(*key, F.explode("d.prints").alias("p")).select(*key, "p.width", "p.hash", "p.first", "p.last")
        alike = (prints.join(held.select("width", "hash").distinct(), ["width", "hash"], "left_semi").distinct()
                 .groupBy(*key).agg(F.collect_list(F.struct("width", "first", "last", "hash")).alias("ps")))
        source = docs.select(F.col("doc_id").cast("long"), F.md5(text).alias("digest"), text.alias("text"))
        same = (source["digest"] == alike["digest"]) & source["doc_id"].eqNullSafe(alike["doc_id"])
        back = source.dropDuplicates(key).join(alike, same, "inner").select(
            source["doc_id"], source["digest"], "ps", F.explode(F.array(words(F.col("text")))).alias("w"))
        hits = (back.select(*key, "w", F.explode("ps").alias("p")).select("*", "p.width", "p.hash")
                .join(held, ["width", "hash"])
                .select(*key, F.lit(None).cast("int").alias("n_words"), "items", F.size("window").alias("n"),
                        _starts(F.col("w"), F.col("p.first"), F.col("p.last"), F.col("window")).alias("starts"))
                .unionByName(cut.select(*key, n_words, F.lit(None).cast("array<string>").alias("items"), F.lit(None).cast("int").alias("n"),
                                        F.lit(None).cast("array<int>").alias("starts"))))
    # No filter on the hits: in the join's condition its lambda would keep the join out of generated code.
    return _figures(hits, key)


def _figures(hits: DataFrame, key: list[str]) -> DataFrame:
    """One row per document from its own row (no starts) and its hits; rows that agree in id and text share their hits."""
    spans = F.array_sort(F.flatten(F.collect_list(F.transform("starts", lambda i: F.struct(i.alias("first"), F.col("n").alias("n"))))))
    items = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(F.size("starts") > 0, F.col("items"))))))
    by_doc = hits.groupBy(*key).agg(
        F.max("n_words").cast("long").alias("n_words"), F.count(F.when(F.col("starts").isNull(), 1)).alias("copies"),
        spans.alias("spans"), items.alias("items"))
    each = by_doc.select("doc_id", "n_words", _marked(F.col("spans")).cast("long").alias("n_hit"), "items",
                         F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))))
    return each.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                       F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def contamination_sql(width: int = WIDTH) -> str:
    """DuckDB SQL of ``contamination`` over the views ``documents`` and ``benchmark``."""
    cut = lambda t: (f"regexp_extract_all(translate(coalesce({t}, ''), '{CAPITALS}', '{CAPITALS.lower()}'), "  # noqa: E731
                     "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')")
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {cut('text')} AS w FROM documents),
b AS (SELECT item_id, w, len(w) AS n FROM (SELECT item_id, {cut('text')} AS w FROM benchmark) WHERE len(w) > 0),
win AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, least(n, {width}) AS n, w[i:i + {width - 1}] AS x
        FROM (SELECT *, unnest(range(1, greatest(n - {width - 1}, 1) + 1)) AS i FROM b)),
lens AS (SELECT DISTINCT n FROM win),
dw AS (SELECT r, n, i, w[i:i + n - 1] AS x FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens)),
h AS (SELECT r, i, dw.n, item FROM dw JOIN win ON dw.n = win.n AND dw.x = win.x),
marks AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM h) GROUP BY r),
its AS (SELECT r, count(item) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN marks USING (r) LEFT JOIN its USING (r)"""
