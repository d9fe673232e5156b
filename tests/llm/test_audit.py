"""Decontamination, source divergence and importance resampling against plain Python and DuckDB SQL."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from llm_cases import NEAR, ROWS

from lodestar.llm import contamination as CT
from lodestar.llm import divergence as DV
from lodestar.llm import importance as IM
from lodestar.llm.common import table

SMALL = "/root/testdata/sf0.001"


def folded(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded(text))


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def duck(sql, **tables):
    con = duckdb.connect()
    for name, frame in tables.items():
        con.register(name, frame)
    return con.sql(sql).fetchall()


# --- decontamination

def contaminated(docs, items, width=10):
    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        for s in range(max(1, len(w) - width + 1) if w else 0):
            windows[tuple(w[s:s + width])].add(item)
    out = []
    for doc_id, text in docs:
        w = words(text)
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for s in range(len(w) - n + 1):
                if (own := windows.get(tuple(w[s:s + n]))) is not None:
                    hit.update(range(s, s + n))
                    found |= own
        ids = sorted(str(i) for i in found if i is not None)
        out.append((doc_id, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


ITEMS = [(1, "tiny"), (2, "A, b c!"), (3, " ".join(NEAR.split()[4:18])), (30, " ".join(NEAR.split()[4:14]).upper()), (4, "x " * 11),
         (4, "line 12 goes on for a while as lines do"), (5, None), (6, "..."), (7, "le ÉTÉ"), (8, "le été ﬁn 漢字"), (None, "no id"),
         (9, "c d e a b c d e a b"), (9, "c d e a b c d e a b"), (10, "seven eight nine ten eleven twelve thirteen")]


@pytest.mark.parametrize("bytes_", [CT.BROADCAST_BYTES, -1])
def test_contamination_of_odd_rows(spark, odd, empty, bytes_):
    items = spark.createDataFrame([(i, t, "clash") for i, t in ITEMS], "item_id long, text string, doc_id string")
    got = rows(CT.contamination(odd, items, broadcast_bytes=bytes_))
    assert got == contaminated(ROWS, ITEMS)
    assert sum(r[5] for r in got) >= 8
    assert rows(CT.contamination(empty, items, broadcast_bytes=bytes_)) == []
    assert rows(CT.contamination(odd, items.limit(0), broadcast_bytes=bytes_)) == contaminated(ROWS, [])


@pytest.mark.parametrize("bytes_", [CT.BROADCAST_BYTES, -1])
def test_contamination_of_the_table(spark, small, texts, bytes_):
    items = table(spark, SMALL, "benchmark")
    got = rows(CT.contamination(small, items, broadcast_bytes=bytes_))
    assert got == contaminated(texts, [(r["item_id"], r["text"]) for r in items.collect()])
    if bytes_ > 0:
        frames = {"documents": small.toPandas(), "benchmark": items.toPandas()}
        assert got == sorted(duck(CT.contamination_sql(), **frames), key=repr)


def test_every_shared_span_is_met(spark):
    """A span of exactly ten words at any place, among repeated words that tie in their hashes."""
    rng = np.random.default_rng(3)
    pool = ["a", "b", "c"]
    docs = [(k, " ".join(rng.choice(pool, 200))) for k in range(30)] + [(99, "a " * 300)]
    items = [(k, " ".join(docs[k][1].split()[5 * k:5 * k + 10 + k % 3])) for k in range(30)] + [(50, "a " * 10)]
    got = rows(CT.contamination(spark.createDataFrame(docs, "doc_id long, text string"),
                                spark.createDataFrame(items, "item_id long, text string")))
    assert got == contaminated(docs, items)


def test_contamination_has_no_python(spark, small):
    plan = CT.contamination(small, table(spark, SMALL, "benchmark"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- divergence

def divergent(docs, least, ranks=50):
    """Rows (lang, source, part, item, value, rank) of ``(lang, source, text)``."""
    docs = [(a or "", b or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", folded(t))) for a, b, t in docs]
    out = []
    for lang in {d[0] for d in docs}:
        df = Counter(t for a, _, w in docs if a == lang for t in set(w))
        kept = {t for t, n in df.items() if n >= least}
        by_source = defaultdict(Counter)
        for a, b, w in docs:
            if a == lang:
                by_source[b].update(x for x in w if x in kept)
        whole = sum(by_source.values(), Counter())

        def p(count):
            total = sum(count.values())
            return {t: 1 + 1000000000 * (count[t] + 5) // (total + 5 * len(kept)) for t in kept}

        shares, q = {b: p(c) for b, c in by_source.items()}, p(whole)
        for b in by_source:
            pairs = [(c, sum(abs(shares[b][t] - shares[c][t]) for t in kept)) for c in by_source if c != b]
            lead = [(t, shares[b][t] - q[t]) for t in kept if by_source[b][t] and shares[b][t] > q[t]]
            for part, values, most in (("pair", pairs, None), ("term", lead, ranks)):
                values.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, b, part, i, v, k) for k, (i, v) in enumerate(values[:most], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("least", [1, 3, 10_000])
def test_divergence_of_the_table(spark, small, least):
    docs = [(r["lang"], r["source"], r["text"]) for r in small.collect()]
    got = rows(DV.divergences(small, least))
    assert got == divergent(docs, least)
    assert got == sorted(duck(DV.divergences_sql(least), documents=small.toPandas()), key=repr)


def test_divergence_of_odd_rows(spark, odd, empty, monkeypatch):
    extra = [(None, None, "Ab ab AB é"), ("", "s", None), ("en", None, "one ab"), ("fr", "only", "seul"), ("en", "t", "a b c ab one One")]
    docs = [("en", "s", t) for _, t in ROWS] + extra + extra
    more = spark.createDataFrame([(a, b, t, "clash", 1) for a, b, t in docs], "lang string, source string, text string, term string, place int")
    assert rows(DV.divergences(more.repartition(5), 2, 3)) == divergent(docs, 2, 3)
    assert rows(DV.divergences(odd, 1)) == divergent([("en", "s", t) for _, t in ROWS], 1)
    assert rows(DV.divergences(empty)) == []


def test_divergence_in_small_pieces(spark, small, monkeypatch):
    """Partial counts sent on early, many shards, blocks of sources and dense slices give the same rows."""
    want = rows(DV.divergences(small, 2))
    seen = []
    count, batch = DV._count, small.select("lang", "source", "text").toArrow().to_batches()
    monkeypatch.setattr(DV, "HELD_ROWS", 64)
    monkeypatch.setattr(DV, "SLICE_BYTES", 3000)
    for b in count(iter(batch)):
        seen += b.to_pylist()
    whole = Counter()
    for r in seen:
        whole[r["lang"], r["source"], r["term"]] += r["n"]
    monkeypatch.undo()
    again = Counter()
    for b in DV._count(iter(batch)):
        for r in b.to_pylist():
            again[r["lang"], r["source"], r["term"]] += r["n"]
    assert whole == again and len(seen) > len(whole)
    monkeypatch.setattr(DV, "SHARD_ROWS", 200)
    assert rows(DV.divergences(small, 2)) == want


def test_source_blocks_and_slices(monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(1)
    left = pa.table({"row": rng.integers(0, 7, 60).astype(np.int32), "term": [f"t{k}" for k in range(60)], "n": rng.integers(1, 9, 60)})
    right = pa.table({"source": [f"s{k}" for k in range(7)], "place": np.arange(7, dtype=np.int32), "total": rng.integers(1, 99, 7),
                      "terms": np.full(7, 60)})

    def run(blocks):
        found = [DV._distances([pa.scalar("x"), pa.scalar(0), pa.scalar(b)], left, right).to_pylist() for b in range(blocks)]
        return sorted((r["source"], r["item"], r["value"]) for f in found for r in f)

    want = run(1)
    assert len(want) == 42
    monkeypatch.setattr(DV, "SOURCE_BLOCK", 3)
    monkeypatch.setattr(DV, "CELLS", 20)
    assert run(3) == want


def test_shares_are_exact(spark):
    counts = np.array([0, 1, 10**12, 9 * 10**15])
    total, terms = 10**16 + 7, 12345
    want = [1 + 10**9 * (int(c) + 5) // (total + 5 * terms) for c in counts]
    assert DV.shares(counts, total, terms).tolist() == want
    from pyspark.sql import functions as F
    df = spark.createDataFrame([(int(c), total, terms) for c in counts], "n long, total long, terms long")
    assert [r[0] for r in df.select(DV.share(F.col("n"), F.col("total"), F.col("terms"))).collect()] == want


# --- importance resampling

def drawn(docs, target, grams=1, buckets=10_000, seed=2024, least=20, percent=10):
    def hashed(text):
        w = words(text)
        return [zlib.crc32(" ".join(w[s:s + n]).encode()) % buckets for n in range(1, grams + 1) for s in range(len(w) - n + 1)]

    s, t = Counter(x for _, d in docs for x in hashed(d)), Counter(x for d in target for x in hashed(d))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)]
    out, fit = [], []
    for doc_id, text in docs:
        f = hashed(text)
        weight = math.floor(sum(gain[x] for x in f) / len(f)) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append((doc_id, len(f), weight, score))
        if len(words(text)) >= least:
            fit.append(out[-1])
    fit.sort(key=lambda r: (-r[3], math.inf if r[0] is None else r[0], r[1], r[2]))
    n = percent * len(fit) // 100
    rest = Counter(out) - Counter(fit[:n])
    return sorted([(*r, k) for k, r in enumerate(fit[:n], 1)] + [(*r, None) for r in rest.elements()], key=repr)


def test_resampling_of_the_table(spark, small, texts):
    items = table(spark, SMALL, "benchmark")
    target = [r["text"] for r in items.collect()]
    got = rows(IM.resample(small, items))
    assert got == drawn(texts, target)
    assert sum(r[4] is not None for r in got) >= 15
    assert rows(IM.resample(small, items, grams=3, buckets=500, percent=55)) == drawn(texts, target, grams=3, buckets=500, percent=55)
    assert rows(IM.resample(small, items, percent=100)) == drawn(texts, target, percent=100)


def test_resampling_of_odd_rows(spark, odd, empty):
    items = spark.createDataFrame([(1, NEAR, 5), (2, None, 5), (3, "", 5)], "item_id long, text string, score int")
    got = IM.resample(odd, items, least_words=1, percent=50)
    assert got.schema.simpleString() == "struct<doc_id:bigint,n_features:bigint,weight:bigint,score:bigint,rank:bigint>"
    assert rows(got) == drawn(ROWS, [NEAR], least=1, percent=50)
    assert rows(IM.resample(empty, items)) == []
    assert rows(IM.resample(odd, items.limit(0), percent=99)) == drawn(ROWS, [], percent=99)


def test_repeated_rows_share_out_ranks(spark):
    text = "w " * 25
    docs = [(7, text)] * 40 + [(2**62 + k, text) for k in range(20)] + [(None, text)] * 3
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    items = spark.createDataFrame([(1, text)], "item_id long, text string")
    assert rows(IM.resample(df, items, percent=60)) == drawn(docs, [text], percent=60)


def test_words_and_chained_hashes():
    assert IM.words_of("Don't İ-x9_Y\x00Z é") == [w.encode() for w in words("Don't İ-x9_Y\x00Z é")]
    own = [b"a", b"bc", b"d"]
    got = [dict(c) for c in IM.hashes(own, 3)]
    assert got[1] == {zlib.crc32(b"a bc"): 1, zlib.crc32(b"bc d"): 1} and got[2] == {zlib.crc32(b"a bc d"): 1}
