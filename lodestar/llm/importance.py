"""Importance resampling of documents towards a target corpus, by hashed n-gram features.

One 256-byte table lower-cases A-Z and blanks separators in the UTF-8 bytes, ``bytes.split`` gives the
words, CRC-32 chained over the words of a run (each continues from the one before) gives its bucket, and
Counters reduce words before any of it is hashed.

1. Every task counts the buckets of its rows, so at most ``buckets`` rows leave it; the sums of the corpus and of
   the target give each bucket's gain, an integer.  Gains are as many as ``buckets``, whatever the corpus.
2. A document's weight is the floored mean gain of its features, its score the weight plus
   Gumbel noise seeded by its id.
3. Scores are integers of a bounded range: the count of each score tells how many documents stand above
   it, and only documents of equal score are numbered among themselves.

Defined cases: null and empty texts have no features and weight 0; rows of equal score and id are ordered by
their figures, rows that agree in all of them share out consecutive ranks; a null id is noise of the seed alone and comes after all
others; an empty target makes every target count 0; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged, text_column

GRAMS, BUCKETS, SEED, LEAST_WORDS, PERCENT = 1, 10_000, 2024, 20, 10
#: Distinct words, and features of a text at a time, that a task holds before it reduces them.
HELD = 1 << 18


def _folded(byte: int) -> int:
    if 0x41 <= byte <= 0x5A:
        return byte + 0x20
    return byte if 0x30 <= byte <= 0x39 or 0x61 <= byte <= 0x7A or byte >= 0x80 else 0x20


FOLD = bytes(map(_folded, range(256)))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split()


def hashes(words: list[bytes], grams: int):
    """Counters of CRC-32 by features: runs of 1 to ``grams`` words joined by one space (longer runs by chaining)."""
    ones = Counter(words)
    yield ((crc32(w), n) for w, n in ones.items())
    seeds = [crc32(w) for w in words] if grams > 1 else []
    for reach in range(1, grams):
        seeds = [crc32(w, crc32(b" ", s)) for s, w in zip(seeds, words[reach:])]
        yield Counter(seeds).items()


def features(n_words: int, grams: int) -> int:
    return sum(max(0, n_words - k) for k in range(grams))


def bucket_counts(docs: DataFrame, grams: int = GRAMS, buckets: int = BUCKETS) -> DataFrame:
    """``bucket, n`` of all texts; a task returns each bucket at most once."""
    def count(batches):
        total = np.zeros(buckets, np.int64)
        ones: Counter = Counter()

        def reduce():
            at = np.fromiter(map(crc32, ones), np.int64, len(ones)) % buckets
            np.add.at(total, at, np.fromiter(ones.values(), np.int64, len(ones)))
            ones.clear()

        for b in batches:
            for text in b["text"]:
                words = words_of(text)
                ones.update(words)
                if len(ones) > HELD:
                    reduce()
                if grams > 1:
                    longer = hashes(words, grams)
                    next(longer)
                    for some in longer:
                        for h, n in some:
                            total[h % buckets] += n
        reduce()
        found = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": found.astype(np.int32), "n": total[found]})

    return (docs.select(text_column().alias("text")).mapInPandas(count, "bucket int, n long")
            .groupBy("bucket").agg(F.sum("n").alias("n")))


def gains(corpus: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> np.ndarray:
    """Floored thousandfold log ratio of the smoothed shares of each bucket in the target and in the corpus."""
    all_s, all_t = sum(corpus.values()), sum(target.values())
    return np.array([math.floor(1000 * math.log(
        (float(target.get(b, 0) + 1) * float(all_s + buckets)) / (float(corpus.get(b, 0) + 1) * float(all_t + buckets))))
        for b in range(buckets)], np.int64)


def noise(doc_id: str, seed: int = SEED) -> float:
    """Thousandfold Gumbel noise from the first 32 bits of the SHA-256 of ``seed:doc_id``."""
    h = int(hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()[:8], 16)
    return -1000 * math.log(-math.log((h + 0.5) / 4294967296))


def scored(docs: DataFrame, target: DataFrame, grams: int = GRAMS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score`` of every row."""
    spark = docs.sparkSession
    s, t = ({r["bucket"]: r["n"] for r in bucket_counts(d, grams, buckets).collect()} for d in (docs, target))
    gain = spark.sparkContext.broadcast(gains(s, t, buckets).tolist())

    def score(batches):
        of_bucket, of_word = gain.value, {}
        for b in batches:
            rows = []
            for doc_id, text in zip(b["doc_id"], b["text"]):  # ids as text: a null must not turn them into doubles
                words = words_of(text)
                n, total = features(len(words), grams), 0
                if grams == 1:
                    for w in words:
                        if (g := of_word.get(w)) is None:
                            g = of_word[w] = of_bucket[crc32(w) % buckets]
                        total += g
                    if len(of_word) > HELD:
                        of_word.clear()
                else:
                    for some in hashes(words, grams):
                        for h, k in some:
                            total += k * of_bucket[h % buckets]
                weight = total // n if n else 0
                rows.append((len(words), n, weight, weight + math.floor(noise(doc_id or "", seed))))
            out = pd.DataFrame(rows, columns=["n_words", "n_features", "weight", "score"])
            out["doc_id"] = pd.array([int(i) if i else None for i in b["doc_id"]], "Int64")
            yield out

    return docs.select(F.col("doc_id").cast("long").cast("string"), text_column().alias("text")).mapInPandas(
        score, "doc_id long, n_words long, n_features long, weight long, score long")


def resample(docs: DataFrame, target: DataFrame, grams: int = GRAMS, buckets: int = BUCKETS, seed: int = SEED,
             least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every row; undrawn rows have no rank."""
    rows = staged(scored(docs, target, grams, buckets, seed), "scored")
    fit = rows.where(F.col("n_words") >= least_words)
    per_score = fit.groupBy("score").agg(F.count("*").alias("held"))  # as many rows as scores have values
    above = F.coalesce(F.sum("held").over(Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("held").over(Window.partitionBy())
    place = staged(per_score.select("score", above.alias("above"), F.call_function("div", total * percent, F.lit(100)).alias("drawn"))
                   .where("above < drawn"), "places")  # only scores that any drawn document has

    own = ["doc_id", "n_features", "weight", "score"]
    tops = fit.join(place, "score").groupBy(*own, "above", "drawn").agg(F.count("*").alias("copies"))
    by = Window.partitionBy("score").orderBy(F.asc_nulls_last("doc_id"), "n_features", "weight")
    before = F.coalesce(F.sum("copies").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = (tops.withColumn("before", F.col("above") + before)
              .withColumn("rank", F.explode(F.expr("sequence(before + 1, before + copies)")))
              .select(*own, F.when(F.col("rank") <= F.col("drawn"), F.col("rank")).alias("rank")))
    rest = (rows.join(place.select("score", F.lit(True).alias("listed")), "score", "left")
            .where((F.col("n_words") < least_words) | F.col("listed").isNull())
            .select(*own, F.lit(None).cast("long").alias("rank")))
    return ranked.unionByName(rest)
