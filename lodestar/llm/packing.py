"""Best-fit packing by sums of squares.

A sequence holds at most ``capacity`` tokens.  Open sequences are known only by
their residual gap: ``open[g]`` counts those with ``g`` free tokens.  A piece of
length ``s`` goes where the sum of ``open[g] ** 2`` over all gaps becomes
smallest: into a gap ``g >= s`` (which turns into ``g - s``; a gap of exactly
``s`` closes the sequence and leaves the sum), or into a new sequence.  Ties go to
the tightest gap.

Pieces of a group of bounded size are placed by one task; groups hold a random share of
all pieces, so every group sees the same mix of lengths.  Sequences left
with a gap are then opened again and their pieces placed anew by the same rule.  The rule keeps gaps
of all sizes at hand; lengths that few others fit leave many of them unused.  So a closing step empties the
sequences that still have a gap, places their pieces longest first into the tightest gap, and stands if it needs fewer sequences.

Defined cases: null text is the empty text (one piece, the end id alone); a document longer
than ``capacity`` is cut into pieces of ``capacity``, the last may be shorter;
a row that occurs twice is packed twice; rows with a null id are packed like others;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from array import array

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buckets_for, staged, text_column
from .tokens import encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = PIECES + ", sequence_id long, offset long"
CAPACITY = 2048
#: Pieces placed by one task: the time of a task, and its memory, follow from it alone.
GROUP = 8192
END_ID = array("I", [0]).tobytes()


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """Each document as pieces of at most ``capacity`` ids (its ids, then id 0)."""

    def cut(batches):
        enc = encoder(vocabulary)
        for b in batches:
            rows = []
            for doc_id, ids in zip(b["doc_id"], enc.encode(b["text"].tolist())):
                ids += END_ID
                n = len(ids) // 4
                for k, at in enumerate(range(0, n, capacity)):
                    part = ids[4 * at:4 * (at + capacity)]
                    rows.append((doc_id, k, at, len(part) // 4, zlib.crc32(part)))
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            yield out.astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long"), text_column().alias("text")).mapInPandas(cut, PIECES)


def place(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each length, placed in the given order."""
    open_ = np.zeros(capacity + 1, np.int64)  # by gap; a new sequence has the gap `capacity`, which stays 0
    at_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    sequence = np.empty(len(lengths), np.int64)
    offset = np.empty(len(lengths), np.int64)
    made = 0
    for k, s in enumerate(lengths.tolist()):
        # Change of the sum of squares, halved: open[g] goes down by one and open[g - s] up by one.
        change = open_[:capacity + 1 - s] - open_[s:] + 1.0
        change[0] = 0.5 - open_[s] if s < capacity else 0.0  # the gap closes
        ok = open_[s:] > 0
        ok[-1] = True  # a new sequence
        if s < capacity:
            change[-1] = open_[capacity - s] + 0.5
        g = s + int(np.argmin(np.where(ok, change, np.inf)))
        if g == capacity:
            b, made = made, made + 1
        else:
            b = at_gap[g].pop()
            open_[g] -= 1
        sequence[k], offset[k] = b, capacity - g
        if g > s:
            at_gap[g - s].append(b)
            open_[g - s] += 1
    return sequence, offset


def place_all(lengths: np.ndarray, capacity: int, rounds: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """``place`` longest first; the pieces of sequences left with a gap are then placed anew, ``rounds`` times in all.

    A round is kept only if it needs no more sequences than the one before.
    """
    sequence, offset = place(lengths, capacity)
    for _ in range(rounds - 1):
        fill = np.bincount(sequence, weights=lengths)
        again = np.flatnonzero(fill[sequence] < capacity)
        if not len(again):
            break
        s, o = place(lengths[again], capacity)
        left, number = np.unique(sequence[again], return_inverse=True)
        if s.max() + 1 > len(left) or (len(left) == s.max() + 1 and np.array_equal(number, s)):
            break
        sequence[again], offset[again] = left[s], o
    return sequence, offset


def place_tightest(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each length: in the given order, each to the tightest gap that holds it."""
    at_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    gaps, made = 0, 0  # bit g of gaps: a sequence with the gap g is open
    sequence = np.empty(len(lengths), np.int64)
    offset = np.empty(len(lengths), np.int64)
    for k, s in enumerate(lengths.tolist()):
        fitting = gaps >> s
        if fitting:
            g = s + (fitting & -fitting).bit_length() - 1
            b = at_gap[g].pop()
            if not at_gap[g]:
                gaps ^= 1 << g
        else:
            g, b, made = capacity, made, made + 1
        sequence[k], offset[k] = b, capacity - g
        if g > s:
            at_gap[g - s].append(b)
            gaps |= 1 << (g - s)
    return sequence, offset


def close_gaps(lengths: np.ndarray, sequence: np.ndarray, offset: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of sequences with a gap (longest first) placed by tightest fit, if that needs fewer sequences."""
    fill = np.bincount(sequence, weights=lengths)
    again = np.flatnonzero(fill[sequence] < capacity)
    if len(again):
        s, o = place_tightest(lengths[again], capacity)
        left = np.unique(sequence[again])
        if s.max() + 1 < len(left):
            sequence[again], offset[again] = left[s], o
    return sequence, offset


def _pack_group(pdf: pd.DataFrame, capacity: int) -> pd.DataFrame:
    pdf = pdf.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True])
    lengths = pdf["length"].to_numpy(np.int64)
    sequence, offset = close_gaps(lengths, *place_all(lengths, capacity), capacity)
    out = pdf[["doc_id", "piece", "start", "length", "ids_crc32"]].astype({"doc_id": "Int64"})
    return out.assign(sequence_id=(pdf["group"].to_numpy(np.int64) << 32) + sequence, offset=offset)


def pack(pieces: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """Place pieces (``PIECES`` columns); adds ``sequence_id`` and a gapless ``offset`` from 0."""
    held = staged(pieces, "pieces")
    groups = buckets_for(held.count(), group)
    # The stored row's own number deals equal rows (null ids, empty texts) to all groups.
    dealt = held.withColumn("group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()),
                                            F.lit(groups)))
    return dealt.groupBy("group").applyInPandas(lambda pdf: _pack_group(pdf, capacity), PLACED)


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """Cut and place whole documents."""
    return pack(pieces(docs, vocabulary, capacity), capacity)
