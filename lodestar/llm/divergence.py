"""Divergence of each source's words from its language and from the language's other sources.

1. Inside ``mapInArrow`` the texts stay Arrow arrays: ``ascii_lower``, ``split_pattern_regex``,
   ``dictionary_encode`` and two hash ``group_by`` steps give, for each (lang, source, term), its
   occurrences and the documents that hold it.  A task merges its partial counts and sends them on
   when they reach ``HELD_ROWS``, so a frequent word is a few rows of each task.
2. The partial counts meet by (lang, term): one shuffle.  Terms in fewer than ``least_documents``
   documents of their language go.
3. The kept counts are dealt by term into shards of a bounded number of rows.  A shard is a small dense table (sources
   by terms, in slices) whose shares give partial distances between sources; partial distances are summed.

Shares are integers, ``p = 1 + floor(SCALE * (count + PRIOR) / (N + PRIOR * V))`` with V the kept terms of the
language and N the counts summed over them, so every sum is exact.

Defined cases: null text, lang and source are the empty string; a text without a term still makes its
(lang, source) group occur; a row that occurs twice is two documents; a source alone in its language has no pairs; a language
without kept terms has pairs of value 0 and no terms; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import buckets_for, staged

#: Between two terms stand characters that are no letter of ASCII and nothing beyond ASCII.
SEPARATORS = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
LEAST_DOCUMENTS, PRIOR, SCALE, TERM_RANKS = 30, 5, 1_000_000_000, 50
#: Text bytes split at a time, and partial counts that a task holds.
SLICE_BYTES, HELD_ROWS = 4 << 20, 1 << 20
#: Kept counts of a shard, sources whose distances a shard returns at once, cells of a dense slice.
SHARD_ROWS, SOURCE_BLOCK, CELLS = 1 << 20, 512, 1 << 21

_GROUP = ["lang", "source", "term"]
_PARTIAL = "lang string, source string, term string, n long, df long"


def partial_counts(batch: pa.RecordBatch) -> pa.Table:
    """``lang, source, term, n, df`` of a batch of ``lang, source, text`` without nulls."""
    lists = pc.split_pattern_regex(pc.ascii_lower(batch["text"]), pattern=SEPARATORS)
    words, owner = lists.flatten(), pc.list_parent_indices(lists)
    some = pc.not_equal(words, "")  # a text that starts or ends with a separator
    term = words.filter(some).dictionary_encode()
    lang, source = (batch[c].dictionary_encode() for c in ("lang", "source"))
    width = max(1, len(source.dictionary))
    group = pc.add(pc.multiply(lang.indices.cast(pa.int64()), width), source.indices.cast(pa.int64()))
    each = (pa.table({"row": owner.filter(some), "term": term.indices})
            .group_by(["row", "term"], use_threads=False).aggregate([([], "count_all")]))
    by_group = (pa.table({"group": group.take(each["row"]), "term": each["term"], "n": each["count_all"]})
                .group_by(["group", "term"], use_threads=False).aggregate([("n", "sum"), ("n", "count")]))
    at = by_group["group"].to_numpy()
    return pa.table({"lang": lang.dictionary.take(pa.array(at // width)), "source": source.dictionary.take(pa.array(at % width)),
                     "term": term.dictionary.take(by_group["term"].combine_chunks()),
                     "n": by_group["n_sum"], "df": by_group["n_count"]})


def _merged(tables: list[pa.Table]) -> pa.Table:
    out = pa.concat_tables(tables).group_by(_GROUP, use_threads=False).aggregate([("n", "sum"), ("df", "sum")])
    return out.rename_columns([c.removesuffix("_sum") for c in out.column_names]).select([*_GROUP, "n", "df"])


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of at most SLICE_BYTES of text (a longer text stands alone)."""
    for batch in batches:
        size = np.asarray(pc.binary_length(batch["text"]), np.int64)
        at = 0
        while at < len(size):
            n = max(1, int(np.searchsorted(np.cumsum(size[at:]), SLICE_BYTES, "right")))
            yield batch.slice(at, n)
            at += n


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.Table] = []
    rows = merged = 0
    for part in _slices(batches):
        held.append(partial_counts(part))
        rows += len(held[-1])
        if rows > merged + HELD_ROWS // 2:
            held = [_merged(held)]
            rows = merged = len(held[0])
            if rows > HELD_ROWS:
                yield from held[0].to_batches(max_chunksize=1 << 16)
                held, rows, merged = [], 0, 0
    if held:
        yield from _merged(held).to_batches(max_chunksize=1 << 16)


def shares(count: np.ndarray, total, terms) -> np.ndarray:
    """``1 + floor(SCALE * (count + PRIOR) / (total + PRIOR * terms))``, exact for counts of any size."""
    low = np.asarray(total, object) + PRIOR * np.asarray(terms, object)
    high = (int(count.max(initial=0)) + PRIOR) * SCALE
    if high < 2**63 and low.max(initial=0) < 2**63:
        return 1 + (count + PRIOR) * SCALE // low.astype(np.int64)
    return (1 + (count.astype(object) + PRIOR) * SCALE // low).astype(np.int64)


def share(count: Column, total: Column, terms: Column) -> Column:
    """``shares`` as a column expression; decimals keep every digit."""
    wide = lambda c: c.cast("decimal(20,0)")
    return F.call_function("div", (wide(count) + PRIOR) * F.lit(SCALE), wide(total) + wide(terms) * PRIOR) + 1


def _distances(key, left: pa.Table, right: pa.Table) -> pa.Table:
    """Partial distances of a shard: from each source of the block to every other source of the language."""
    lang, slot, block = (k.as_py() for k in key)
    out: dict[str, list] = {"lang": [], "source": [], "item": [], "value": []}
    if len(left) or slot == 0:
        right = right.sort_by("place")
        sources, total = right["source"].to_pylist(), right["total"].to_numpy()
        rows = np.arange(block * SOURCE_BLOCK, min(len(sources), (block + 1) * SOURCE_BLOCK))
        found = np.zeros((len(rows), len(sources)), np.int64)
        term = left["term"].combine_chunks().dictionary_encode()
        code, place, n = term.indices.to_numpy(), left["row"].to_numpy(), left["n"].to_numpy()
        order = np.argsort(code, kind="stable")
        code, place, n = code[order], place[order], n[order]
        step = max(1, CELLS // max(1, len(sources)))
        for at in range(0, len(term.dictionary), step):
            a, b = np.searchsorted(code, [at, at + step])
            count = np.zeros((len(sources), min(step, len(term.dictionary) - at)), np.int64)
            count[place[a:b], code[a:b] - at] = n[a:b]
            p = shares(count, total[:, None], right["terms"].to_numpy()[:, None])
            for k, r in enumerate(rows.tolist()):
                found[k] += np.abs(p - p[r]).sum(1)
        for k, r in enumerate(rows.tolist()):
            others = [i for i in range(len(sources)) if i != r]
            out["lang"] += [lang] * len(others)
            out["source"] += [sources[r]] * len(others)
            out["item"] += [sources[i] for i in others]
            out["value"] += found[k, others].tolist()
    return pa.table(out, pa.schema([("lang", "string"), ("source", "string"), ("item", "string"), ("value", "int64")]))


def kept_counts(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """``lang, source, term, n`` of the kept terms of ``docs(lang, source, text)`` without nulls."""
    counts = (docs.select("lang", "source", "text").mapInArrow(_count, _PARTIAL).repartition("lang", "term")
              .groupBy(*_GROUP).agg(F.sum("n").alias("n"), F.sum("df").alias("df")))  # dealt by a part of the key
    held = F.sum("df").over(Window.partitionBy("lang", "term"))
    return counts.withColumn("held", held).where(F.col("held") >= least_documents).select(*_GROUP, "n")


def divergences(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, term_ranks: int = TERM_RANKS) -> DataFrame:
    """``lang, source, part, item, value, rank``: every pair of sources of a language, and each group's leading terms."""
    plain = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    kept = staged(kept_counts(plain, least_documents), "kept-counts")
    of_lang = kept.groupBy("lang").agg(F.countDistinct("term").alias("terms"), F.sum("n").alias("lang_total"))
    occurring = plain.select("lang", "source").distinct()
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    numbered = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = staged(occurring.join(totals, ["lang", "source"], "left").join(of_lang, "lang", "left")
                    .na.fill(0, ["total", "terms", "lang_total"]).withColumn("place", numbered), "groups")

    slots = buckets_for(kept.count(), SHARD_ROWS)
    dealt = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    blocks = groups.groupBy("lang").agg(F.ceil(F.count("*") / SOURCE_BLOCK).cast("int").alias("blocks"))
    sides = (groups.join(blocks, "lang").withColumn("slot", dealt(F.lit(slots))).withColumn("block", dealt(F.col("blocks")))
             .select("lang", "slot", "block", "source", "place", "total", "terms"))
    places = groups.join(blocks, "lang").select("lang", "source", F.col("place").alias("row"), "blocks")
    cells = (kept.join(places, ["lang", "source"])
             .withColumn("slot", F.pmod(F.xxhash64("term"), F.lit(slots)).cast("int"))
             .withColumn("block", dealt(F.col("blocks"))).select("lang", "slot", "block", "row", "term", "n"))
    key = ["lang", "slot", "block"]
    pairs = (cells.groupBy(*key).cogroup(sides.groupBy(*key))
             .applyInArrow(_distances, "lang string, source string, item string, value long")
             .groupBy("lang", "source", "item").agg(F.sum("value").alias("value")))

    of_term = kept.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"))
    p = share(F.col("n"), F.col("total"), F.col("terms"))
    q = share(F.col("lang_n"), F.col("lang_total"), F.col("terms"))
    terms = (kept.join(of_term, ["lang", "term"]).join(groups, ["lang", "source"])
             .select("lang", "source", F.col("term").alias("item"), (p - q).alias("value")).where("value > 0"))

    def ranked(rows: DataFrame, part: str) -> DataFrame:
        by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
        return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(by).alias("rank"))

    return ranked(pairs, "pair").unionByName(ranked(terms, "term").where(F.col("rank") <= term_ranks))


def divergences_sql(least_documents: int = LEAST_DOCUMENTS, term_ranks: int = TERM_RANKS) -> str:
    """DuckDB SQL of ``divergences`` over the view ``documents``."""
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    p = lambda n, total: (
        f"1 + ((CAST({n} AS HUGEINT) + {PRIOR}) * {SCALE}) // (CAST({total} AS HUGEINT) + {PRIOR} * V)")
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  translate(coalesce(text, ''), '{capitals}', '{capitals.lower()}') AS t FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= {least_documents}),
c AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY ALL),
l AS (SELECT lang, count(*) AS V, sum(n) AS NL FROM k GROUP BY lang),
g AS (SELECT lang, source, coalesce(sum(n), 0) AS N FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, {p('coalesce(c.n, 0)', 'g.N')} AS p, {p('k.n', 'l.NL')} AS q
      FROM g JOIN l USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
u AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
      UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM u)
WHERE part = 'pair' OR rank <= {term_ranks}"""
