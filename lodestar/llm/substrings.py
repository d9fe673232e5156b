"""Exact removal of repeated word windows, partitioned by super-k-mers.

A window is ``width`` consecutive words of one document.  Its minimiser is the
smallest hash among its runs of ``MER`` words; consecutive windows that share
one minimiser occurrence form a super-k-mer, which travels as one packed string (its words
joined by one space) to the bucket that the minimiser names.  Equal windows have equal
minimisers, so they meet in one bucket; there words become numbers by an exact
dictionary, windows are sorted by a rolling hash, and neighbours of equal hash
are compared word by word.  All but the smallest (doc_id, start) of equal windows mark their
words; marks return to the documents as intervals.

Super-k-mers of equal words inside one batch are packed once: the later ones are marked
on the spot, so a passage that a third of all documents share sends one string from
each batch, not one from each document.  Packed strings of one batch and
bucket are compressed together.  A bucket is counted one of its ``CELLS`` cells at a time, and only
``CELLS_HELD`` of them are unpacked.

A first pass counts the words of every cell.  A cell of more than ``HOT_WORDS`` words (the flanks of a passage
that very many documents share have their own words beside shared ones, so none is packed once) is not kept together:
its windows travel by their 128-bit digests, each batch sends the smallest window of each digest, and they are dealt
by digest over as many buckets as they fill.  Equal windows have equal digests, so they still meet.

Defined cases: null, empty and blank texts have no words (0, 0, SHA-256 of the
empty text); a text of fewer than ``width`` words has no window; rows with equal ids are told apart by
a 64-bit digest of their text (rows without id by 128 bits), and rows that agree in both are one document; rows with null ids
come after all others; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import buckets_for, text_column, total_bytes

WIDTH = 20
MER = 3
#: Text bytes for each bucket (a bucket holds about three times as much in packed strings), cells of a bucket, and
#: cells whose strings are unpacked at a time.
BUCKET_BYTES, CELLS, CELLS_HELD = 12 << 20, 16, 4
#: Text bytes that a task packs at a time.
BATCH_BYTES = 6 << 20
#: Words of packed strings that are counted together; cells beyond are dealt by window. A bucket of such windows.
HOT_WORDS, HOT_WINDOWS = 1_500_000, 1 << 19

_MIX = np.random.default_rng(20240502).integers(0, 2**63, 32, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: A document is (key, tag, tag2): its id (null: the largest long) and digests of its text.
DOCUMENT = ["key", "tag", "tag2"]
PACKED = "bucket int, docs binary, text binary, key long, tag long, tag2 long, start int, n int"
MARKS = "key long, tag long, tag2 long, start int, n int"
LAST = 2**63 - 1


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split()  # bytes split at the six ASCII white-space characters


def _runs_hash(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` consecutive hashes, built from runs of 1, 2, 4, ..."""
    out, done, power, reach = None, 0, h, 1
    while True:
        if n & reach:
            if out is None:
                out = power
            else:
                m = len(power) - done if done else len(power)
                out = _mixed(out[:m], power[done:done + m])
            done += reach
        if reach * 2 > n:
            return out[:len(h) - n + 1]
        power = _mixed(power[:-reach], power[reach:])
        reach *= 2


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = (a ^ (a >> np.uint64(29))) * _MIX[0] + b
    out ^= out >> np.uint64(32)
    out *= _MIX[1]
    return out


def super_kmers(words: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and minimiser hash of each super-k-mer."""
    windows = len(words) - width + 1
    if windows < 1:
        return (np.empty(0, np.int64),) * 2 + (np.empty(0, np.uint64),)
    mer = min(MER, width)
    h = _runs_hash(np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)), mer)
    span = width - mer + 1
    best, at = h.copy(), np.arange(len(h))
    # Leftmost smallest of `span` neighbours, by doubling: stretches of 1, 2, 4, ... then two that overlap.
    reach = 1
    while reach * 2 <= span:
        best, at = _smaller(best[:-reach], at[:-reach], best[reach:], at[reach:])
        reach *= 2
    if reach < span:
        shift = span - reach
        best, at = _smaller(best[:-shift], at[:-shift], best[shift:], at[shift:])
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    return first, np.diff(np.append(first, windows)), best[first]


def _smaller(a, ia, b, ib):
    left = a <= b
    return np.where(left, a, b), np.where(left, ia, ib)


def _batches(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pd.DataFrame]:
    """Consecutive rows ``key, tag, tag2, text`` of at most ``most`` bytes of text (a longer text stands alone)."""
    held, size = [], 0

    def frame():
        return pd.DataFrame(held, columns=[*DOCUMENT, "text"])

    for b in batches:
        sizes = np.asarray(pc.binary_length(b["text"]), np.int64)
        at = 0
        while at < len(b):
            n = max(1, int(np.searchsorted(np.cumsum(sizes[at:]), most - size, "right")))
            if held and size + sizes[at] > most:
                yield frame()
                held, size = [], 0
                continue
            part = b.slice(at, n)
            held += zip(*(part[c].to_pylist() for c in (*DOCUMENT, "text")))
            size += int(sizes[at:at + n].sum())
            at += n
    if held:
        yield frame()


def _cell_words(docs: pd.DataFrame, width: int, cells: int) -> pa.RecordBatch:
    """Words of the super-k-mers of each cell."""
    found = [super_kmers(words_of(text), width)[1:] for text in docs["text"]]
    cell = np.concatenate([least % np.uint64(cells) for _, least in found])
    at, which = np.unique(cell, return_inverse=True)
    words = np.bincount(which, np.concatenate([count for count, _ in found]) + width - 1, len(at))
    return pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(words.astype(np.int64))], ["cell", "words"])


def _pack(docs: pd.DataFrame, width: int, buckets: int, hot: frozenset = frozenset(), hot_buckets: int = 1) -> pd.DataFrame:
    """Packed strings by bucket, windows of hot cells by digest, and marks of what repeats inside the batch.

    All columns but ``text`` together name a document.
    """
    names = [c for c in docs.columns if c != "text"]
    # Numbers and bytes by bucket: no object stays for each string.
    own: dict[int, array] = defaultdict(lambda: array("q"))
    texts: dict[int, bytearray] = defaultdict(bytearray)
    seen: set[bytes] = set()
    marks = array("q")
    cells = buckets * CELLS
    for *doc, text in sorted(set(zip(*(docs[c].tolist() for c in (*names, "text"))))):
        words = words_of(text)
        first, count, least = super_kmers(words, width)
        for f, c, cell in zip(first.tolist(), count.tolist(), (least % np.uint64(cells)).tolist()):
            s = b" ".join(words[f:f + c + width - 1])
            if (digest := xxhash.xxh3_128_digest(s)) in seen:
                marks.extend((*doc, f, c))
                continue
            seen.add(digest)
            if cell not in hot:
                own[cell // CELLS].extend((*doc, f, c, cell % CELLS))
                texts[cell // CELLS] += s + b"\n"
                continue
            for at in range(f, f + c):
                digest = xxhash.xxh3_128_digest(b" ".join(words[at:at + width])) + b"w"  # apart from those of strings
                if digest in seen:
                    marks.extend((*doc, at, 1))
                    continue
                seen.add(digest)
                bucket = buckets + int.from_bytes(digest[:8], "little") % hot_buckets
                own[bucket].extend((*doc, at, 1, 0))
                texts[bucket] += digest[:16]
    del seen
    zip_ = zstandard.ZstdCompressor(level=3)
    buckets_held, packed = list(own), []
    for b in buckets_held:
        rows = np.frombuffer(own.pop(b), np.int64).reshape(-1, len(names) + 3)
        packed.append((zip_.compress(rows.T.tobytes()), zip_.compress(texts.pop(b))))
    # Packed rows first, then marks; typed column by column, as a null among 64-bit numbers must not turn them into doubles.
    marked = np.frombuffer(marks, np.int64).reshape(-1, len(names) + 2).T
    n, m = len(packed), marked.shape[1]
    is_mark = np.repeat([False, True], [n, m])

    def numbers(values, kind, null):
        return pd.arrays.IntegerArray(np.concatenate(values).astype(kind), null)

    zeros = np.zeros(n, np.int64)
    return pd.DataFrame({
        "bucket": numbers([np.array(buckets_held, np.int64), np.zeros(m, np.int64)], np.int32, is_mark),
        **{c: pd.Series([p[k] for p in packed] + [None] * m, dtype=object) for k, c in enumerate(("docs", "text"))},
        **{c: numbers([zeros, marked[k]], np.int64, ~is_mark) for k, c in enumerate(names)},
        "start": numbers([zeros, marked[-2]], np.int32, ~is_mark), "n": numbers([zeros, marked[-1]], np.int32, ~is_mark)})


def _marked(doc: np.ndarray, begins: np.ndarray, first: np.ndarray, first_begins: np.ndarray) -> np.ndarray:
    """Which windows are not the first of their group (documents as rows of the columns that name them)."""
    return (doc != first).any(0) | (begins != first_begins)


def _runs(doc: np.ndarray, begins: np.ndarray, names: list[str]) -> pd.DataFrame:
    """Marked windows as runs of neighbouring starts."""
    run = np.lexsort((begins, *doc[::-1]))
    doc, begins = doc[:, run], begins[run]
    new = np.ones(len(begins), bool)
    new[1:] = (doc[:, 1:] != doc[:, :-1]).any(0) | (begins[1:] != begins[:-1] + 1)
    head = np.flatnonzero(new)
    return pd.DataFrame({**dict(zip(names, doc[:, head])), "start": begins[head], "n": np.diff(np.append(head, len(begins)))})


def _heads(new: np.ndarray) -> np.ndarray:
    """The position at which each row's group starts; ``new`` tells the first row of each group."""
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))


def _numbered(strings: bytes) -> np.ndarray:
    """A number for each word; equal words, and no others, have equal numbers."""
    data = strings.replace(b"\n", b" ") + b" "
    ends = np.append(0, np.flatnonzero(np.frombuffer(data, np.uint8) == ord(" ")) + 1)  # a word and the space behind it
    words = pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)])
    return np.asarray(words.dictionary_encode().indices).astype(np.uint64)


def _count_cell(docs: np.ndarray, strings: bytes, width: int, names: list[str]) -> pd.DataFrame:
    """Marks of every window of packed strings (one to a line) whose words also start earlier."""
    ids = _numbered(strings)
    doc, start, count = docs[:-3], docs[-3], docs[-2]
    base = np.cumsum(count + width - 1) - (count + width - 1)  # of each super-k-mer's words in ids
    order = np.lexsort((start, *doc[::-1]))
    which = np.repeat(order, count[order])  # the super-k-mer of each window, windows in document order
    nth = np.arange(len(which)) - np.repeat(np.cumsum(count[order]) - count[order], count[order])
    at = base[which] + nth
    h = _runs_hash(ids, width)[at]
    by = np.argsort(h, kind="stable")
    equal = h[by][1:] == h[by][:-1]
    near = np.flatnonzero(np.concatenate((equal, [False])) | np.concatenate(([False], equal)))
    by = by[near]
    # Word by word: windows of one hash stay together only where their words agree.
    group = np.cumsum(np.concatenate(([True], h[by][1:] != h[by][:-1])))[:len(by)]
    differ = np.zeros(max(0, len(by) - 1), bool)
    for k in range(width):
        differ |= ids[at[by][1:] + k] != ids[at[by][:-1] + k]
    if np.any(differ & (group[1:] == group[:-1])):
        _, group = np.unique(ids[at[by][:, None] + np.arange(width)], axis=0, return_inverse=True)
        again = np.lexsort((by, group))
        by, group = by[again], group[again]
    head = _heads(np.concatenate(([True], group[1:] != group[:-1]))[:len(by)])
    w, first = which[by], which[by][head]
    begins = start[w] + nth[by]
    later = _marked(doc[:, w], begins, doc[:, first], begins[head])
    return _runs(doc[:, w[later]], begins[later], names)


def _count_digests(docs: np.ndarray, digests: bytes, names: list[str]) -> pd.DataFrame:
    """Marks of every window whose digest also starts earlier."""
    doc, start = docs[:-3], docs[-3]
    d = np.frombuffer(digests, np.uint64).reshape(-1, 2).T
    by = np.lexsort((start, *doc[::-1], *d))
    new = np.ones(len(by), bool)
    new[1:] = (d[:, by[1:]] != d[:, by[:-1]]).any(0)
    first = by[_heads(new)]
    later = _marked(doc[:, by], start[by], doc[:, first], start[first])
    return _runs(doc[:, by[later]], start[by[later]], names)


def _count_bucket(pdf: pd.DataFrame, width: int, hot: bool = False) -> pd.DataFrame:
    """Marks of a bucket as ``_pack`` gave it, of strings or of hot windows."""
    unzip = zstandard.ZstdDecompressor()
    names = [c for c in DOCUMENT if c in pdf.columns]
    docs = [np.frombuffer(unzip.decompress(d), np.int64).reshape(len(names) + 3, -1) for d in pdf["docs"]]
    sizes = [d.shape[1] for d in docs]
    ends, docs = np.cumsum(sizes), np.concatenate(docs, axis=1)
    if hot:
        return _count_digests(docs, b"".join(map(unzip.decompress, pdf["text"])), names)
    out = []
    for low in range(0, CELLS, CELLS_HELD):
        lines: list[list[bytes]] = [[] for _ in range(CELLS_HELD)]
        for data, end, size in zip(pdf["text"], ends, sizes):
            cells = docs[-1, end - size:end]
            every = unzip.decompress(data).split(b"\n")
            for k in range(CELLS_HELD):
                at = np.flatnonzero(cells == low + k)
                if len(at):
                    lines[k].append(b"\n".join(map(every.__getitem__, at.tolist())))
        for k in range(CELLS_HELD):
            if lines[k]:
                strings, lines[k] = b"\n".join(lines[k]), []
                out.append(_count_cell(docs[:, docs[-1] == low + k], strings, width, names))
    return pd.concat(out)


def repeated_windows(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``key, tag, tag2, start, n``: runs of windows whose words also start earlier (documents as ``keyed`` gives them)."""
    buckets = buckets_for(total_bytes(docs), BUCKET_BYTES)
    cells = buckets * CELLS

    def weigh(batches):
        for b in _batches(batches, BATCH_BYTES):
            yield _cell_words(b, width, cells)

    # One cell in HOT_WORDS words of strings at most.
    hot = (docs.mapInArrow(weigh, "cell int, words long").groupBy("cell").agg(F.sum("words").alias("words"))
           .where(F.col("words") > HOT_WORDS).collect())
    hot_cells = docs.sparkSession.sparkContext.broadcast(frozenset(r["cell"] for r in hot))
    hot_buckets = buckets_for(sum(r["words"] for r in hot), HOT_WINDOWS)

    def pack(batches):
        for b in _batches(batches, BATCH_BYTES):
            yield from pa.Table.from_pandas(_pack(b, width, buckets, hot_cells.value, hot_buckets), preserve_index=False,
                                            schema=schema).to_batches()

    binary, long, short = pa.binary(), pa.int64(), pa.int32()
    schema = pa.schema([("bucket", short), ("docs", binary), ("text", binary), *((c, long) for c in DOCUMENT),
                        ("start", short), ("n", short)])
    packed = docs.mapInArrow(pack, PACKED)
    # Marks made on the spot pass through the same exchange, spread by their document.
    dealt = packed.withColumn("slot", F.coalesce("bucket", -1 - F.pmod(F.xxhash64(*DOCUMENT), F.lit(buckets))))

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        if pdf["bucket"].isna().any():
            return pdf[[*DOCUMENT, "start", "n"]]
        return _count_bucket(pdf, width, pdf["bucket"].iat[0] >= buckets)

    return dealt.groupBy("slot").applyInPandas(count, MARKS)


def document_key(doc_id: Column, text: Column) -> dict[str, Column]:
    """The columns that name a document."""
    doc_id = doc_id.cast("long")
    return {"key": F.coalesce(doc_id, F.lit(LAST)), "tag": F.xxhash64(text),
            "tag2": F.when(doc_id.isNull(), F.xxhash64(F.lit(1), text)).otherwise(F.lit(0).cast("long"))}


def keyed(docs: DataFrame) -> DataFrame:
    """``doc_id, key, tag, tag2, text`` with null texts empty."""
    text = docs.select(F.col("doc_id").cast("long"), text_column().alias("text"))
    return text.select("doc_id", *(c.alias(n) for n, c in document_key(F.col("doc_id"), F.col("text")).items()), "text")


def covered(n: int, starts, counts, width: int) -> np.ndarray:
    """Which of ``n`` words some marked window covers."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, np.asarray(starts) + np.asarray(counts) + width - 1, -1)
    return np.cumsum(step[:-1]) > 0


def with_marks(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``docs`` (as ``keyed``) with ``starts`` and ``counts`` of the marked runs, null where there are none."""
    marks = repeated_windows(docs.select(*DOCUMENT, "text"), width).groupBy(*DOCUMENT).agg(
        F.collect_list(F.struct("start", "n")).alias("marks"))
    return docs.join(marks, DOCUMENT, "left").withColumns(
        {"starts": F.col("marks.start"), "counts": F.col("marks.n")}).drop("marks")


def remove_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of every row."""
    def remove(batches):
        for b in batches:
            rows = []
            for doc_id, text, starts, counts in zip(b["doc_id"], b["text"], b["starts"], b["counts"]):
                words = words_of(text)
                kept = words
                if starts is not None:
                    gone = covered(len(words), starts, counts, width)
                    kept = [w for w, g in zip(words, gone.tolist()) if not g]
                rows.append((doc_id, len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            yield pd.DataFrame(rows, columns=["doc_id", "n_words", "n_removed", "kept_sha256"]).astype(
                {"doc_id": "Int64"})

    held = with_marks(keyed(docs), width).select("doc_id", "text", "starts", "counts")
    return held.mapInPandas(remove, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def clean_documents(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``docs``, every column kept, with the marked words gone from ``text`` (other texts as they are).

    A text that loses words keeps its lines: what stands between two kept words is the
    white space before the second, and lines left empty go.
    """
    names = docs.columns
    own = [f"__{c}" for c in DOCUMENT]
    numbered = docs.withColumns({f"__{n}": c for n, c in document_key(F.col("doc_id"), text_column()).items()})
    marks = repeated_windows(numbered.select(*(F.col(o).alias(c) for o, c in zip(own, DOCUMENT)), text_column().alias("text")),
                             width).groupBy(*(F.col(c).alias(o) for o, c in zip(own, DOCUMENT))).agg(
        F.collect_list(F.struct("start", "n")).alias("__marks"))

    @F.pandas_udf("string")
    def cut(texts: pd.Series, starts: pd.Series, counts: pd.Series) -> pd.Series:
        return pd.Series([t if s is None else without(t, s, c, width) for t, s, c in zip(texts, starts, counts)],
                         dtype=object)

    joined = numbered.join(marks, own, "left")
    return joined.withColumn("text", cut("text", "__marks.start", "__marks.n")).select(*names)


_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def without(text: str, starts, counts, width: int) -> str:
    """The text without the words of the marked windows."""
    spans = [m.span() for m in _WORD.finditer(text)]
    gone = covered(len(spans), starts, counts, width)
    out, end = [], 0
    for (a, b), g in zip(spans, gone.tolist()):
        if not g:
            between = text[end:a]
            if out:
                out.append("\n" if "\n" in between else between or " ")
            out.append(text[a:b])
        elif "\n" in text[end:a] and out and out[-1] != "\n":
            out.append("\n")
        end = b
    return "".join(out).strip("\n")
