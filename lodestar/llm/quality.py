"""Line-first quality rules, in DataFrame functions only.

Every line with a word is judged first:

* punctuation: it must end in a closing mark or hold the end of a sentence, and symbols and
  exclamation marks may make up at most ``NOISE`` of its characters;
* navigation: it may not hold ``SEPARATORS`` or more menu separators;
* boilerplate: it may not hold one of ``PHRASES``.

Failing lines are removed.  A document is rejected if it fails the base rules (fewer
than 10 words, or over 20 % of its words in repeated five-word windows) or if it
loses more than ``LOST`` of its characters with the removed lines.

Defined cases: null and empty texts have no words and fail the base; lines of
white space are neither judged nor counted; a row that occurs twice is judged twice;
an empty table gives no rows; other columns pass through ``clean_documents`` unchanged
(the helper column's name is none of theirs).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITESPACE, text_column

SYMBOLS = "#*$%&|<>"
CLOSING = (".", "!", "?", ":", ";", ",", '"', "'", ")", "]", "…", "”", "’", "»")
SENTENCE_ENDS = (". ", "! ", "? ")
MENU = ("|", "»", "›", "•")
PHRASES = ("cookie policy", "privacy policy", "terms of use", "terms of service", "all rights reserved",
           "enable javascript", "lorem ipsum", "click here", "read more", "sign in", "log in", "subscribe to our")
NOISE, SEPARATORS, LOST = 0.08, 3, 0.5
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def occurrences(text: Column, symbols) -> Column:
    """How many characters of ``text`` are one of ``symbols``."""
    total = F.lit(0)
    for s in symbols:
        total = total + F.char_length(text) - F.char_length(F.replace(text, F.lit(s), F.lit("")))
    return total


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, "[ \\t\\n\\x0B\\f\\r]+"), "")


def lines_with_words(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(WHITESPACE)) != "")


def repeated_words(w: Column) -> Column:
    """Words that windows of five cover which are found twice or more among the words ``w``.

    Window hashes tell most documents, which repeat none; only where two hashes agree are the
    windows themselves sorted and compared.
    """
    starts = F.sequence(F.lit(0), F.size(w) - WINDOW)
    hashes = F.transform(starts, lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(WINDOW))))
    windows = F.array_sort(F.transform(starts, lambda i: F.struct(F.slice(w, i + 1, WINDOW).alias("w"), i.alias("i"))))
    twice = let(windows, lambda s: F.filter(s, lambda x, k: (
        F.get(s, k - 1)["w"].eqNullSafe(x["w"]) | F.get(s, k + 1)["w"].eqNullSafe(x["w"]))))
    at = F.array_sort(F.transform(twice, lambda x: x["i"]))
    covered = F.aggregate(
        at, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda acc, i: F.struct((acc["n"] + i + WINDOW - F.greatest(acc["end"], i)).alias("n"),
                                (i + WINDOW).alias("end")),
        lambda acc: acc["n"])
    again = let(hashes, lambda h: F.size(F.array_distinct(h)) < F.size(h))
    return F.when(F.size(w) < WINDOW, 0).when(again, covered).otherwise(0)


def line_passes(line: Column) -> Column:
    bare = F.btrim(line, F.lit(WHITESPACE))
    noise = occurrences(line, SYMBOLS + "!")
    low = F.lower(line)
    sentence, boilerplate = F.right(bare, F.lit(1)).isin(*CLOSING), F.lit(False)
    for e in SENTENCE_ENDS:
        sentence = sentence | F.contains(bare, F.lit(e))
    for p in PHRASES:
        boilerplate = boilerplate | F.contains(low, F.lit(p))
    return (sentence & (noise <= F.char_length(line) * F.lit(NOISE))
            & (occurrences(line, MENU) < SEPARATORS) & ~boilerplate)


def _characters(lines: Column) -> Column:
    return F.char_length(F.array_join(lines, ""))


def verdict(text: Column) -> Column:
    """One struct: the base figures, ``kept`` and the cleaned text.  Every part is evaluated once for a text."""
    def figures(p: Column) -> Column:
        return F.struct(
            F.size(p["words"]).cast("long").alias("n_words"),
            F.char_length(F.array_join(p["words"], "")).cast("long").alias("word_chars"),
            (F.size(p["lines"]) - F.size(F.array_distinct(p["lines"]))).cast("long").alias("n_dup_lines"),
            repeated_words(p["words"]).cast("long").alias("n_repeat_words"),
            p["lines"].alias("lines"), F.filter(p["lines"], line_passes).alias("good"))

    def judge(q: Column) -> Column:
        base_failed = (q["n_words"] < MIN_WORDS) | (100 * q["n_repeat_words"] > MAX_REPEAT_PERCENT * q["n_words"])
        remains = _characters(q["good"]) >= _characters(q["lines"]) * F.lit(1 - LOST)
        return F.struct(
            q["n_words"].alias("n_words"), q["word_chars"].alias("word_chars"),
            occurrences(text, SYMBOLS).cast("long").alias("n_symbols"), q["n_dup_lines"].alias("n_dup_lines"),
            q["n_repeat_words"].alias("n_repeat_words"), base_failed.alias("base_failed"),
            (~base_failed & remains).alias("kept"), F.size(q["lines"]).cast("long").alias("n_lines"),
            F.size(q["good"]).cast("long").alias("n_good_lines"), F.array_join(q["good"], "\n").alias("clean_text"))

    parts = F.struct(words(text).alias("words"), lines_with_words(text).alias("lines"))
    return let(parts, lambda p: let(figures(p), judge))


def quality_report(docs: DataFrame) -> DataFrame:
    """One row per document: figures and verdict."""
    return docs.select("doc_id", verdict(text_column()).alias("q")).select(
        "doc_id", "q.n_words", "q.word_chars", "q.n_symbols", "q.n_dup_lines", "q.n_repeat_words", "q.base_failed",
        "q.kept", "q.n_lines", "q.n_good_lines")


def clean_documents(docs: DataFrame) -> DataFrame:
    """The kept documents, all columns, with failing lines gone from ``text``.

    The verdict is an array of one struct or none that is exploded: a filter on it would be
    pushed below the projection and the verdict computed twice.
    """
    name = "quality"
    while name in docs.columns:
        name += "_"
    kept = F.explode(F.filter(F.array(verdict(text_column())), lambda q: q["kept"]))
    names = [F.col(f"`{c}`") if c != "text" else F.col(name)["clean_text"].alias("text") for c in docs.columns]
    return docs.withColumn(name, kept).select(*names)


def _sql_list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def report_sql() -> str:
    """DuckDB SQL of ``quality_report`` over the view ``documents``."""
    count = lambda column, symbols: " + ".join(
        f"length({column}) - length(replace({column}, '{s}', ''))" for s in symbols)
    phrases = " OR ".join(f"contains(lower(l), '{p}')" for p in PHRASES)
    ends = " OR ".join(f"contains(trim(l, @), '{e}')" for e in SENTENCE_ENDS)
    space = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws,
             list_filter(string_split(text, chr(10)), lambda l: trim(l, {space}) <> '') AS lines FROM d),
win AS (SELECT r, i, ws[i:i + 4] AS x FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
twice AS (SELECT r, unnest(list(i)) AS i FROM win GROUP BY r, x HAVING count(*) > 1),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2, i + 3, i + 4]) AS p FROM twice) GROUP BY r),
f AS (SELECT w.r, doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, {count('text', SYMBOLS)} AS n_symbols,
             len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, lines,
             list_filter(lines, lambda l: (right(trim(l, {space}), 1) IN ({_sql_list(CLOSING)}) OR {ends.replace("@", space)})
                 AND {count('l', SYMBOLS + '!')} <= length(l) * CAST({NOISE} AS DOUBLE)
                 AND {count('l', MENU)} < {SEPARATORS} AND NOT ({phrases})) AS good
      FROM w LEFT JOIN rep USING (r)),
g AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM f)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND length(array_to_string(good, '')) >= length(array_to_string(lines, '')) * CAST({1 - LOST} AS DOUBLE) AS kept,
       CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(good) AS BIGINT) AS n_good_lines
FROM g"""
