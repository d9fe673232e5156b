"""Hand-made cases for the text functions and the chunker (no parquet)."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lodestar.functions import patterns as P
from lodestar.functions import text as TX
from lodestar.operators import chunking as CH


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "v string").select(expr(F.col("v")).alias("r")).collect()[0]["r"]


def test_dot_runs(spark):
    assert one(spark, TX.clean_text, "a.....b") == "a.....b"  # five stay
    assert one(spark, TX.clean_text, "a......b") == "ab"  # six go
    assert one(spark, TX.clean_text, "a..........b") == "ab"


def test_strip_is_python_strip(spark):
    for s in ["  x  ", "\x1cx\x1f", " x　", "\t\n\r x \x0b\x0c", "x"]:
        assert one(spark, TX.py_strip, s) == s.strip()


def test_words_python_split(spark):
    s = "a\x1cb c"
    assert one(spark, TX.token_length, s) == 3 == len(s.split())
    for s in ["", "   ", " a  b ", "x\ty\nz"]:
        assert one(spark, TX.token_length, s) == len(s.split())


def test_redaction_stops_at_newline_only(spark):
    out = one(spark, TX.redact_lines, "x IPR foo\rbar\nkeep")
    assert out == "x \nkeep"


def test_title_mention(spark):
    f = TX.extract_document_name
    assert one(spark, f, "see document t3 please") == "t3"
    assert one(spark, f, "open FILE t3.") == "t3."  # sentence-final dot captured
    assert one(spark, f, "profile t3 x") == "t3"  # no word boundary
    assert one(spark, f, "documents t3") is None
    assert one(spark, f, "no name") is None
    assert one(spark, f, "  ") is None


def test_derive_title(spark):
    cases = {"dir/a.b.pdf": "a.b", ".bashrc": ".bashrc", "x/y_chunks.json": "y", "plain": "plain", "a.": "a"}
    for path, title in cases.items():
        assert one(spark, TX.derive_title, path) == title


@pytest.mark.parametrize("n,expected", [(0, 0), (1, 1), (412, 1), (413, 2), (512, 2), (513, 2)])
def test_chunk_counts(spark, n, expected):
    text = " ".join(["w"] * n)
    df = spark.createDataFrame([(1, text)], "id int, text string")
    assert CH.chunk_tokens(df, "text", 512, 100).count() == expected


def test_overlap_not_below_size_gives_one_chunk(spark):
    df = spark.createDataFrame([(1, " ".join(["w"] * 50))], "id int, text string")
    rows = CH.chunk_tokens(df, "text", 10, 10).collect()
    assert len(rows) == 1 and rows[0]["chunk_tokens"] == 10


def test_chunk_properties(spark):
    rnd = random.Random(7)
    vocab = ["a", "bb", "ccc", "é", "x.y", " ", "\t", "\n"]
    texts = ["".join(rnd.choice(vocab) + rnd.choice([" ", "  ", "\n"]) for _ in range(rnd.randint(1, 300))).strip()
             for _ in range(40)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    toks = {r["id"]: r["t"] for r in df.select("id", CH.tokenize("text").alias("t")).collect()}
    for i, t in enumerate(texts):
        assert "".join(toks[i]) == t  # lossless
    size, overlap = 16, 5
    stride = size - overlap
    chunks = CH.chunk_tokens(df, "text", size, overlap).collect()
    by = {}
    for r in chunks:
        by.setdefault(r["id"], []).append(r)
    for i, t in enumerate(texts):
        n = len(toks[i])
        got = sorted(by.get(i, []), key=lambda r: r["chunk_index"])
        assert len(got) == (math.ceil(n / stride) if n else 0)
        for r in got:
            s = r["chunk_index"] * stride
            assert r["chunk_content"] == "".join(toks[i][s:s + size])


def test_whitespace_class_matches_python():
    assert all(chr(c).isspace() for c in P.WS_CODES)
    assert 0x1C in P.WS_CODES and 0xA0 in P.WS_CODES


def test_java_whitespace_equals_python_over_all_code_points(spark):
    from lodestar.functions.patterns import WS, NOT_WS
    rows = spark.range(0, 0x110000).where("id < 55296 OR id > 57343")  # no surrogates
    ch = F.udf(lambda c: chr(c), "string")("id")  # test-only helper
    flagged = rows.select("id", ch.alias("c")).select(
        "id", F.col("c").rlike(f"(?U)^{WS}$").alias("ws"), F.col("c").rlike(f"(?U)^{NOT_WS}$").alias("nws"))
    java = {r["id"] for r in flagged.where("ws").collect()}
    assert java == {c for c in range(0x110000) if chr(c).isspace()}
    assert flagged.where("ws = nws").count() == 0


def test_gpt2_pre_tokens_lossless(spark):
    texts = ["Hello, world! It's 2024.\n\n  Next   line\t", "don't stop'x", "ünïcödé 123abc ..."]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    got = {r["id"]: r["t"] for r in df.select("id", CH.tokenize("text", "gpt2_pre").alias("t")).collect()}
    for i, t in enumerate(texts):
        assert "".join(got[i]) == t
    assert got[0][:4] == ["Hello", ",", " world", "!"]
