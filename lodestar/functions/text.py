"""Text column functions (all native Spark expressions, no Python UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def py_strip(col) -> Column:
    """Python ``str.strip()``: removes the full Python whitespace set at both ends.

    ``trim`` only removes spaces, so it is never used for this.
    """
    return F.regexp_replace(_c(col), P.STRIP, "")


def clean_text(col) -> Column:
    """Remove dot runs of six or more (one dot plus five or more)."""
    return F.regexp_replace(_c(col), P.DOT_RUN, "")


def is_blank(col) -> Column:
    return py_strip(col) == F.lit("")


def words(col) -> Column:
    """Python ``str.split()`` with no argument: non-empty whitespace-separated words."""
    return F.filter(F.split(_c(col), P.WS_RUN), lambda w: w != F.lit(""))


def token_length(col) -> Column:
    """Word count as the reference stores it (``len(text.split())``)."""
    return F.size(words(col)).cast("bigint")


def strip_url(col) -> Column:
    """Drop the query string and fragment of a URL, keeping the path."""
    return F.regexp_replace(_c(col), r"[?#].*\z", "")


def base_name(col) -> Column:
    """Last path element (``os.path.basename``)."""
    return F.regexp_extract(_c(col), r"([^/]*)\z", 1)


def split_ext_root(col) -> Column:
    """``os.path.splitext(name)[0]``: drop the last extension; leading dots are no extension."""
    name = _c(col)
    root = F.regexp_extract(name, r"\A(\.*[^.].*)\.[^.]*\z", 1)
    return F.when(root == F.lit(""), name).otherwise(root)


def derive_title(path_col) -> Column:
    """Title of a file: base name without the last extension, or without ``_chunks.json``."""
    name = base_name(path_col)
    suffix = P.CHUNK_FILE_SUFFIX
    return F.when(name.endswith(suffix), F.substring(name, F.lit(1), F.length(name) - len(suffix))).otherwise(
        split_ext_root(name)
    )


def chunk_id(title_col, index_col) -> Column:
    """``{title}_chunk_{index}``."""
    return F.format_string(P.CHUNK_ID_FORMAT, _c(title_col), _c(index_col))


def extract_document_name(query_col) -> Column:
    """Name after "document"/"file" in a question; null if none or the question is blank."""
    q = _c(query_col)
    name = F.regexp_extract(q, P.TITLE_MENTION, 1)
    return F.when(is_blank(q) | (name == F.lit("")), F.lit(None).cast("string")).otherwise(name)


def redact_lines(col, keywords=P.LEGAL_KEYWORDS) -> Column:
    """Cut from each legal keyword to the end of its line, then strip."""
    return py_strip(F.regexp_replace(_c(col), P.keyword_pattern(keywords), ""))


def contains_any(col, tags=P.NOISE_TAGS) -> Column:
    """True when the lower-cased text contains any tag as a substring."""
    low = F.lower(_c(col))
    cond = F.lit(False)
    for t in tags:
        cond = cond | (F.instr(low, t) > 0)
    return cond
