"""Fuzzy title match: best title with ``ratio > 0.85`` per name, exact.

``ratio(a, b) = 1 - indel(a, b) / (len a + len b) = 2 LCS / (len a + len b)``.

Near step: ``LCS(a, b)`` is the length of the longest string that is left of both when characters are deleted.  So
every title gives the strings left when at most two of its characters go, every name those when at most one goes, and an
equality join on these strings finds all pairs that need no more deletions.  Of the titles of one length behind
one string only the smallest counts, so the join grows with the strings and not with pairs.  Two deletions
of a title are tried only for names without any, and only where that can still better what the name has.  A
name is settled once what it has is above every ratio that other deletions could give.

Names that are not settled then (far from all titles, or long) are compared with every title of a fitting length.  Plan
(the same shape as exact kNN): these names, usually few, are collected once behind a size check and broadcast; the titles are
scanned where they lie by ``mapInPandas``.  Each task scores its title batches
against all names with a bit-parallel LCS (Allison-Dix / Hyyro) vectorised in
NumPy over a whole (names x titles) block of compatible lengths, and keeps only
the best title per name.  No (name, title) pair is ever a row; the shuffle carries
at most one row per name and task, and an aggregate per name picks the winner.
Above the broadcast limit both sides are hashed into blocks, keyed also by title
length (a name joins only the lengths that can reach the threshold), and every
block is scored by the same kernel in a cogrouped ``applyInPandas``.

Ties go to the smaller title; lower-cased text is compared and the original title
returned.  Strings of more than 62 characters on both sides of a pair use a plain
dynamic-programming LCS (the bit vector lives in one 64-bit word).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import patterns as P
from ..session import scratch_path

DEFAULT_BROADCAST_NAMES = 200_000
PAIRS_PER_STEP = 2_000_000
#: Longest strings of which one character, two characters are deleted (64 and 496 strings at most).
DELETE_ONE, DELETE_TWO = 64, 32
NAME_BLOCK_ROWS = 50_000
TITLE_BLOCK_ROWS = 200_000
MAX_BITS = 62


def _lcs_dp(a: str, b: str) -> int:
    prev = [0] * (len(b) + 1)
    for ca in a:
        cur = [0]
        for j, cb in enumerate(b):
            cur.append(prev[j] + 1 if ca == cb else max(prev[j + 1], cur[j]))
        prev = cur
    return prev[-1]


def _lcs_block(names: list[str], titles: list[str]) -> np.ndarray:
    """LCS of every (name, title) pair of one block; all titles have the same length <= 62.

    Bit j of a title's word stands for its character j; one pass over the name's
    characters updates all (title, name) words at once.
    """
    lb = len(titles[0])
    n_q, n_t = len(names), len(titles)
    if lb == 0:
        return np.zeros((n_q, n_t), dtype=np.int64)
    word = np.int32 if lb <= 30 else np.int64
    alphabet = {ch: i for i, ch in enumerate(sorted(set("".join(titles)) | set("".join(names))))}
    # match masks: masks[t, c] has bit j set when titles[t][j] is character c
    masks = np.zeros((n_t, len(alphabet) + 1), dtype=word)
    tcodes = np.array([[alphabet[ch] for ch in t] for t in titles], dtype=np.int64)
    rows = np.arange(n_t)
    for j in range(lb):
        np.bitwise_or.at(masks, (rows, tcodes[:, j]), word(1 << j))
    full = word((1 << lb) - 1)
    la_max = max((len(n) for n in names), default=0)
    codes = np.full((n_q, la_max), len(alphabet), dtype=np.int64)  # padding char matches nothing
    for i, n in enumerate(names):
        if n:
            codes[i, :len(n)] = [alphabet[ch] for ch in n]
    v = np.full((n_t, n_q), full, dtype=word)
    u = np.empty_like(v)
    w = np.empty_like(v)
    for p in range(la_max):
        np.bitwise_and(v, masks[:, codes[:, p]], out=u)
        np.add(v, u, out=w)
        np.subtract(v, u, out=u)
        np.bitwise_or(w, u, out=v)
        np.bitwise_and(v, full, out=v)
    return (lb - np.bitwise_count(v).astype(np.int64)).T


class _Best:
    """Best title per name over title batches (task-local, vectorised)."""

    def __init__(self, name_ids: np.ndarray, names_low: list[str], threshold: float):
        self.ids = name_ids
        self.low = names_low
        self.len = np.array([len(n) for n in names_low], dtype=np.int64)
        self.threshold = threshold
        self.best_ratio = np.full(len(name_ids), -1.0)
        self.best_title = np.full(len(name_ids), None, dtype=object)

    def add(self, titles: list[str], titles_low: list[str]) -> None:
        e = 1.0 - self.threshold
        by_len: dict[int, list[int]] = {}
        for i, t in enumerate(titles_low):
            by_len.setdefault(len(t), []).append(i)
        for lb, idx in by_len.items():
            # only names whose length can reach the threshold with this title length
            ok = np.abs(self.len - lb) < e * (self.len + lb)
            q_idx = np.nonzero(ok)[0]
            if len(q_idx) == 0:
                continue
            t_low = [titles_low[i] for i in idx]
            t_orig = np.array([titles[i] for i in idx], dtype=object)
            step = max(1, PAIRS_PER_STEP // max(1, len(q_idx)))
            for t0 in range(0, len(idx), step):
                tl, to = t_low[t0:t0 + step], t_orig[t0:t0 + step]
                names = [self.low[i] for i in q_idx]
                if lb <= MAX_BITS:
                    lcs = _lcs_block(names, tl)
                else:
                    lcs = np.array([[_lcs_dp(n, t) if len(n) > MAX_BITS else _lcs_block([t], [n])[0, 0]
                                     for t in tl] for n in names], dtype=np.int64) if names else np.zeros((0, len(tl)))
                total = (self.len[q_idx][:, None] + lb).astype(np.float64)
                ratio = np.where(total > 0, 1.0 - (total - 2 * lcs) / np.where(total > 0, total, 1), 1.0)
                ratio = np.where(ratio > self.threshold, ratio, -1.0)
                # best per name inside the block: highest ratio, then smallest title
                col = _argbest(ratio, to)
                cand_r = ratio[np.arange(len(q_idx)), col]
                cand_t = to[col]
                cur_r = self.best_ratio[q_idx]
                cur_t = self.best_title[q_idx]
                better = (cand_r > cur_r) | ((cand_r == cur_r) & (cand_r > 0) &
                                              np.array([ct is not None and (bt is None or ct < bt)
                                                        for ct, bt in zip(cand_t, cur_t)], dtype=bool))
                upd = q_idx[better]
                self.best_ratio[upd] = cand_r[better]
                self.best_title[upd] = cand_t[better]

    def result(self) -> pd.DataFrame:
        hit = self.best_ratio > 0
        return pd.DataFrame({"name_id": self.ids[hit], "title": self.best_title[hit],
                             "ratio": self.best_ratio[hit]})


def _argbest(ratio: np.ndarray, titles: np.ndarray) -> np.ndarray:
    """Column of the highest ratio per row; among equal ratios the smallest title."""
    rank = np.argsort(titles.astype(str), kind="stable")  # title order
    pos = np.empty_like(rank)
    pos[rank] = np.arange(len(rank))
    best = np.argmax(ratio, axis=1)
    mx = ratio[np.arange(ratio.shape[0]), best]
    ties = ratio == mx[:, None]
    if ties.sum() > ratio.shape[0]:
        masked = np.where(ties, pos[None, :], len(rank) + 1)
        best = np.argmin(masked, axis=1)
    return best


RESULT_COLUMNS = ["name_id", "title", "ratio"]


def _without_one(s: Column) -> Column:
    """All strings left when one character of ``s`` goes."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(s)), lambda k: _left(s, k)))


def _left(s: Column, k: Column) -> Column:
    return F.concat(F.substr(s, F.lit(1), k - 1), F.substr(s, k + 1))


def _without_two(s: Column) -> Column:
    """All strings left when two characters of ``s`` go (at least two must be there)."""
    return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.length(s) - 1), lambda k: F.transform(
        F.sequence(k, F.length(s) - 1), lambda m: _left(_left(s, k), m)))))


def _tried(la: int, lb: int) -> int:
    """Length of the shortest common string that the near step finds for a name and a title of these lengths."""
    found = [max(la, lb)]  # equal strings alone; a shorter string can't be what is left
    for i, j in ((0, 0), (0, 1), (1, 0), (1, 1), (0, 2)):
        if la - i == lb - j and (i == 0 or la <= DELETE_ONE) and (j == 0 or lb <= (DELETE_ONE, DELETE_TWO)[j - 1]):
            found.append(la - i)
    return min(found)


def _open_ratio(la: int, threshold: float, two: bool) -> float:
    """Highest ratio above the threshold that a name of this length can have unseen by the near step (none: -1).

    ``two`` tells whether two deletions of titles have been tried.
    """
    e = 1.0 - threshold
    best = -1.0
    for lb in range(max(1, int(la * (1 - e) / (1 + e)) - 1), int(la * (1 + e) / (1 - e)) + 2):
        tried = _tried(la, lb)
        if not two and lb == la + 2:
            tried = lb
        # The longest common string not looked for; of two lengths that differ it is the shorter whole, if even that was not.
        l = min(la, lb, tried - 1)
        ratio = 1.0 - (la + lb - 2 * l) / (la + lb)
        if ratio > threshold:
            best = max(best, ratio)
    return best


def _nearest(names: DataFrame, titles: DataFrame, threshold: float) -> DataFrame:
    """``low, title, ratio``: of each name's titles that share a string ``v`` with it, the best."""
    # Titles of one string and length have the same ratio with a name, so the smallest stands for all.
    least = titles.groupBy("v", "lb").agg(F.min("title").alias("title"))
    total = F.length("low") + F.col("lb")
    met = names.join(least, "v").withColumn("ratio", 1.0 - (total - 2 * F.length("v")) / total)
    return met.where(F.col("ratio") > threshold).select("low", "title", "ratio")


def _best(found: DataFrame, key: str) -> DataFrame:
    return found.groupBy(key).agg(F.min_by(
        F.struct("title", "ratio"), F.struct((-F.col("ratio")).alias("neg"), F.col("title"))).alias("b"))


def fuzzy_title_match(names: DataFrame, title_df: DataFrame, threshold: float = P.FUZZY_THRESHOLD,
                      name_id: str = "name_id", name_col: str = "name", title_col: str = "title",
                      broadcast_names: int = DEFAULT_BROADCAST_NAMES) -> DataFrame:
    """``(name_id, name, title, ratio)``: best stored title with ratio above the threshold, else null."""
    spark = names.sparkSession
    n = names.select(F.col(name_id).alias("name_id"), F.col(name_col).alias("name")).withColumn(
        "low", F.lower(F.coalesce("name", F.lit(""))))
    titles = title_df.select(F.col(title_col).alias("title")).where(F.col("title").isNotNull()).withColumn("low", F.lower("title"))
    lows = n.select("low").where("low != ''").distinct()  # an empty name has no match
    folder = scratch_path(spark, "fuzzy")

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    def one(s: str) -> Column:
        return F.concat(F.array(s), F.when(F.length(s) <= DELETE_ONE, _without_one(F.col(s))).otherwise(F.array().cast("array<string>")))

    def open_ratios(two: bool) -> DataFrame:
        """By name length, the best ratio that a title unseen so far could have."""
        bound = spark.createDataFrame([(la, _open_ratio(la, threshold, two)) for la in lengths], "la int, open double")
        return F.broadcast(bound)

    lengths = [r[0] for r in lows.select(F.length("low")).distinct().collect()]
    given = titles.where("low != ''").groupBy("low").agg(F.min("title").alias("title")).withColumn("lb", F.length("low"))
    near = _nearest(lows.withColumn("v", F.explode(one("low"))), given.select("title", "lb", F.explode(one("low")).alias("v")), threshold)
    first = stored(lows.join(_best(near, "low"), "low", "left").withColumn("la", F.length("low")), "first")
    unsettled = first.join(open_ratios(False), "la").where(F.coalesce("b.ratio", F.lit(0.0)) <= F.col("open"))
    # Two deletions of titles, for names whole.
    after = open_ratios(True)
    fitting = unsettled.where((F.col("la") + 2 <= DELETE_TWO))
    longer = given.join(F.broadcast(fitting.select((F.col("la") + 2).alias("lb")).distinct()), "lb")
    two = _nearest(fitting.select("low", F.col("low").alias("v")),
                   longer.select("title", "lb", F.explode(_without_two(F.col("low"))).alias("v")), threshold)
    found = first.where("b IS NOT NULL").select("low", "b.title", "b.ratio")
    seen = stored(unsettled.select("la", "low", "b").join(_best(two, "low").withColumnRenamed("b", "b2"), "low", "left").select(
        "la", "low", F.when(F.col("b.ratio") > F.col("b2.ratio"), F.col("b")).when(F.col("b2.ratio") > F.col("b.ratio"), F.col("b2"))
        .when(F.col("b2.title") < F.col("b.title"), F.col("b2")).otherwise(F.coalesce("b", "b2")).alias("b")), "second")
    found = found.unionByName(seen.where("b IS NOT NULL").select("low", "b.title", "b.ratio"))
    rest = seen.join(after, "la").where(F.coalesce("b.ratio", F.lit(0.0)) <= F.col("open")).select(F.col("low").alias("name_id"), "low")
    far = _compared(rest, titles, threshold, broadcast_names).select(F.col("name_id").alias("low"), "title", "ratio")
    best = _best(n.join(_best(found.unionByName(far), "low"), "low").select("name_id", "b.title", "b.ratio"), "name_id")
    return n.join(best, "name_id", "left").select(
        F.col("name_id").alias(name_id), "name", F.col("b.title").alias("title"), F.col("b.ratio").alias("ratio"))


def _compared(n: DataFrame, titles: DataFrame, threshold: float, broadcast_names: int) -> DataFrame:
    """``name_id, title, ratio``: the best titles of names ``name_id, low``, each compared with every title of a fitting length."""
    spark = n.sparkSession
    result = T.StructType([T.StructField("name_id", n.schema["name_id"].dataType), T.StructField("title", T.StringType()),
                           T.StructField("ratio", T.DoubleType())])
    # Scoring costs CPU per title, not bytes: spread the distinct titles over the
    # cluster explicitly (AQE would coalesce a small title set into one task).
    t = titles.select("title", "low").distinct().repartition(spark.sparkContext.defaultParallelism * 2)
    local = n.select("name_id", "low").limit(broadcast_names + 1).toPandas()
    if len(local) <= broadcast_names:
        bc = spark.sparkContext.broadcast((local["name_id"].to_numpy(), local["low"].tolist()))

        def score(batches):
            ids, low = bc.value
            best = _Best(ids, low, threshold)
            for pdf in batches:
                best.add(pdf["title"].tolist(), pdf["low"].tolist())
            res = best.result()
            if len(res):
                yield res

        return t.mapInPandas(score, result)
    n_names = n.count()
    n_titles = t.count()
    qb = max(1, math.ceil(n_names / NAME_BLOCK_ROWS))
    cb = max(1, math.ceil(n_titles / TITLE_BLOCK_ROWS))
    # Blocks are also keyed by title length: a name only meets titles whose
    # length can reach the threshold (|la - lb| < e (la + lb)).
    e = 1.0 - threshold
    la = F.length("low")
    lo = F.floor(la * (1 - e) / (1 + e)).cast("int")
    hi = F.ceil(la * (1 + e) / (1 - e)).cast("int")
    nq = (n.withColumn("_lb", F.explode(F.sequence(lo, hi)))
          .withColumn("_qb", F.pmod(F.xxhash64("name_id"), F.lit(qb)).cast("int"))
          .withColumn("_cb", F.explode(F.sequence(F.lit(0), F.lit(cb - 1)))))
    tc = (t.withColumn("_lb", F.length("low"))
          .withColumn("_cb", F.pmod(F.xxhash64("title"), F.lit(cb)).cast("int"))
          .withColumn("_qb", F.explode(F.sequence(F.lit(0), F.lit(qb - 1)))))

    def block(qpdf: pd.DataFrame, tpdf: pd.DataFrame) -> pd.DataFrame:
        best = _Best(qpdf["name_id"].to_numpy(), qpdf["low"].tolist(), threshold)
        best.add(tpdf["title"].tolist(), tpdf["low"].tolist())
        res = best.result()
        return res if len(res) else pd.DataFrame({c: pd.Series([], dtype=object) for c in RESULT_COLUMNS})

    keys = ["_lb", "_qb", "_cb"]
    return nq.groupBy(*keys).cogroup(tc.groupBy(*keys)).applyInPandas(block, result)
