"""Regular expressions in the Java dialect that Spark runs.

The reference is written against Python's ``re``.  Java differs in three ways
that matter here: ``\\s`` and ``\\w`` are ASCII unless ``(?U)`` is given, ``.``
also stops at ``\\r`` and other line terminators unless ``(?d)`` is given, and
``$`` matches before a final line break.  Every pattern below is written so that
it behaves as the Python original on the same input.
"""

from __future__ import annotations


def _python_whitespace() -> list[int]:
    # Rule, not a table: exactly the code points Python's str.isspace() accepts
    # (this is what str.split() and str.strip() use).  It includes U+001C..U+001F,
    # which no Java or RE2 whitespace class contains.
    return [c for c in range(0x110000) if chr(c).isspace()]


def _char_class(codes: list[int], negate: bool = False) -> str:
    """Character class of the given code points, contiguous runs written as ranges."""
    runs, start, prev = [], None, None
    for c in codes:
        if start is None:
            start = prev = c
        elif c == prev + 1:
            prev = c
        else:
            runs.append((start, prev))
            start = prev = c
    if start is not None:
        runs.append((start, prev))
    body = "".join(f"\\x{{{a:x}}}" if a == b else f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in runs)
    return f"[{'^' if negate else ''}{body}]"


WS_CODES = _python_whitespace()

# RE2 (DuckDB) has no Unicode \s, so the oracle spells the set out.
WS_RE2 = _char_class(WS_CODES)
NOT_WS_RE2 = _char_class(WS_CODES, negate=True)
STRIP_RE2 = rf"\A{WS_RE2}+|{WS_RE2}+\z"
TOKEN_WS_RE2 = rf"{WS_RE2}*{NOT_WS_RE2}+|{WS_RE2}+\z"

# Java: under (?U), \s is the Unicode White_Space property, which is Python's
# whitespace set minus U+001C..U+001F (checked over all code points in the tests).
# One property test is several times faster than a long class of single characters.
#: one whitespace character as Python sees it (use inside a (?U) pattern)
WS = r"[\s\x{1c}-\x{1f}]"
#: one non-whitespace character (use inside a (?U) pattern)
NOT_WS = r"[^\s\x{1c}-\x{1f}]"
#: whitespace run, a complete pattern (for split)
WS_RUN = rf"(?U){WS}+"
#: leading or trailing whitespace, the two ends of Python's ``str.strip``
STRIP = rf"(?U)\A{WS}+|{WS}+\z"

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for equal results.
# ---------------------------------------------------------------------------
#: dot cleaner: one dot then five or more, so runs of six or more dots go
DOT_RUN = r"\.\.{5,}"
#: legal keywords removed from retrieved text, each up to the end of its line
LEGAL_KEYWORDS = ("IPR", "copyright", "patents", "trademarks", "terms of use")
#: noise tags; a retrieved chunk containing any of them (lower-cased) is noise
NOISE_TAGS = ("table", "figure", "list", "appendix")
#: token chunking: window of 512 tokens, 100 tokens shared with the next window
CHUNK_SIZE = 512
CHUNK_OVERLAP = 100
#: chunk files: more than 5,000 chunks are split into parts of 2,000
PART_THRESHOLD = 5000
PART_SIZE = 2000
#: retrieval: 50 nearest chunks, merged list cut at 50 + 2
TOP_K = 50
MERGED_EXTRA = 2
#: fuzzy title match: strictly above 0.85
FUZZY_THRESHOLD = 0.85
#: collection defaults for missing fields
DEFAULT_TITLE = "Unknown"
DEFAULT_SOURCE = "Unknown"
DEFAULT_TOKEN_LENGTH = 0
DEFAULT_MODEL = "Unknown Model"
#: allowed upload extensions (web path) and batch extensions
UPLOAD_EXTENSIONS = ("pdf", "docx")
#: chunk id and chunk file name
CHUNK_ID_FORMAT = "%s_chunk_%d"
CHUNK_FILE_SUFFIX = "_chunks.json"
#: messages
EMPTY_QUERY_ERROR = "Query must be a non-empty string."
MISSING_TITLE_MESSAGE = "Couldn't find a file"
INVALID_TYPE_PREFIX = "Invalid file type: ."
#: one retrieved chunk in a prompt context: "Source: <title>" newline "<content>"
SOURCE_LINE_PREFIX = "Source: "
# ---------------------------------------------------------------------------

# Java form of the title mention: (?i) case-insensitive, (?U) Unicode \w and \s.
# Python's \s also covers U+001C..U+001F, so use our whitespace class there.
TITLE_MENTION = rf"(?iU)(?:document|file){WS}+([\w.-]+)"

#: whitespace-mode tokens: optional leading whitespace then a word, or the
#: trailing whitespace at the very end.  Concatenating the tokens gives the text.
TOKEN_WS = rf"(?U){WS}*{NOT_WS}+|{WS}+\z"

#: GPT-2 pre-tokenizer pattern (published with the GPT-2 encoder), without the
#: byte-pair merges.  Also lossless.
TOKEN_GPT2_PRE = (
    r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)


def keyword_pattern(keywords=LEGAL_KEYWORDS) -> str:
    """Keyword alternation up to the end of the line, Python semantics.

    ``(?i)`` + ``(?u)``: Unicode case-insensitive.  ``(?d)``: only ``\\n`` ends a
    line, so ``.`` runs over ``\\r`` as Python's does.
    """
    alt = "|".join(_java_quote(k) for k in keywords)
    return f"(?iud)({alt}).*"


def _java_quote(s: str) -> str:
    # Escape regex metacharacters one by one; letters, digits and spaces stay.
    return "".join("\\" + ch if ch in r"\.^$|?*+()[]{}" else ch for ch in s)

