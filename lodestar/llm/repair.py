"""Token ids in Re-Pair compressed shard files.

Rows are dealt to shards by ranges of doc_id; a shard concatenates the ids of its documents in ascending
order, each ended by id 0.  Re-Pair then replaces frequent pairs of neighbouring ids by
nonterminals, round by round: a round counts all pairs, makes a rule of each pair that is among the
most frequent and worth a rule, and replaces them left to right (where two overlap, the earlier stays).  Pairs
never cross the end of a document, so every document is a run of symbols of its own.

A shard file (little-endian, all parts unsigned):

    8 bytes  magic ``IDSRPR01``
    8 x 6    number of documents, rules, symbols, ids; bits of a symbol (16 or 32); first nonterminal
    rules    left and right symbol of each rule (32 bits each)
    lengths  expansion length of each rule (32 bits)
    docs     id (64 bits, signed), number of ids (32), first symbol (64) of each document
    symbols  16 or 32 bits each

Symbols below ``first nonterminal`` are ids.  A document is read by its first symbol alone;
a position inside it is found by the expansion lengths, without expanding what lies before.

Shards are rows ``shard, data`` of a Parquet table, so that a retried or speculative task never leaves
half a file; one row is one file of the format above.  Where a shard starts follows from the totals of the
shards before it.

Defined cases: null text is the empty text (the end id alone); rows with equal ids follow each other by their
ids' bytes; rows with a null id come after all others; an empty table writes no shard; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import buckets_for, chunks, shared_path, text_column, total_bytes
from .tokens import encoder

MAGIC = b"IDSRPR01"
END_ID = 0
#: Text bytes of a shard (a longer document stands in a shard with its neighbours), rounds, rules of a round.
SHARD_BYTES, ROUNDS, RULES, LEAST_COUNT = 4 << 20, 4, 6000, 8
#: Pairs are counted in 2**CELL_BITS cells first.
CELL_BITS = 18
LAST = 2**63 - 1


def frequent_pairs(symbols: np.ndarray, joins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The most frequent pairs (left << 32 | right), where they stand, and which pair stands there.

    Only positions where ``joins`` count.  Exact counts are made for the pairs of full cells: a pair is at most as
    frequent as its cell, so these hold the most frequent pairs.
    """
    pair = (symbols[:-1].astype(np.uint64) << np.uint64(32)) | symbols[1:]
    cell = ((pair * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - CELL_BITS)).astype(np.intp)
    count = np.bincount(cell, minlength=1 << CELL_BITS) - np.bincount(cell[~joins], minlength=1 << CELL_BITS)
    least = max(LEAST_COUNT, int(np.partition(count, -RULES)[-RULES]) // 2)
    where = np.flatnonzero(joins & (count >= least)[cell])
    numbered = pa.array(pair[where]).dictionary_encode()
    pairs, which = np.asarray(numbered.dictionary), np.asarray(numbered.indices)
    n = np.bincount(which, minlength=len(pairs))
    best = np.flatnonzero(n >= LEAST_COUNT)
    best = best[np.lexsort((pairs[best], -n[best]))[:RULES]]
    rank = np.full(len(pairs), -1)
    rank[best] = np.arange(len(best))
    rule = rank[which]
    return pairs[best], where[rule >= 0], rule[rule >= 0]


def compress(ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Symbols, first symbol of each document, rules (n, 2) and the first nonterminal."""
    base = int(ids.max()) + 1 if len(ids) else 1
    symbols = ids.astype(np.uint32)
    starts = np.zeros(len(ids) + 1, bool)  # whether a document starts at the symbol
    starts[first] = True
    starts[len(ids)] = True
    rules = np.empty((0, 2), np.uint32)
    for _ in range(ROUNDS):
        if len(symbols) < 2:
            break
        joins = ~starts[1:-1]
        pairs, where, rule = frequent_pairs(symbols, joins)
        if not len(pairs):
            break
        # Left to right: in a stretch of hits side by side every second one stands.
        new = np.concatenate(([True], where[1:] != where[:-1] + 1))
        since = np.arange(len(where)) - np.maximum.accumulate(np.where(new, np.arange(len(where)), 0))
        where, rule = where[since % 2 == 0], rule[since % 2 == 0]
        symbols = symbols.copy()
        symbols[where] = (base + len(rules) + rule).astype(np.uint32)
        rules = np.concatenate([rules, np.stack([pairs >> np.uint64(32), pairs & np.uint64(0xFFFFFFFF)], 1).astype(np.uint32)])
        keep = np.ones(len(symbols), bool)
        keep[where + 1] = False
        symbols = symbols[keep]
        starts = np.append(starts[:-1][keep], True)
    return symbols, np.flatnonzero(starts[:-1]), rules, base


def expansion_lengths(rules: np.ndarray, base: int) -> np.ndarray:
    """Length of each rule's expansion; a rule names earlier rules only."""
    out: list[int] = []
    for a, b in rules.tolist():
        out.append((out[a - base] if a >= base else 1) + (out[b - base] if b >= base else 1))
    return np.array(out, np.uint32)


def expand(symbols: np.ndarray, rules: np.ndarray, base: int) -> np.ndarray:
    """All ids of ``symbols``, one generation of rules at a time."""
    out = symbols.astype(np.uint32)
    while True:
        high = out >= base
        if not high.any():
            return out
        size = np.where(high, 2, 1)
        at = np.cumsum(size) - size
        nxt = np.empty(int(size.sum()), np.uint32)
        nxt[at[~high]] = out[~high]
        pair = rules[out[high] - base]
        nxt[at[high]], nxt[at[high] + 1] = pair[:, 0], pair[:, 1]
        out = nxt


def write_shard(doc_ids: list, ids: list[bytes]) -> bytes:
    """One shard file; ``ids`` are packed unsigned 32-bit ids, the end id included."""
    n = np.array([len(x) // 4 for x in ids], np.uint32)
    flat = np.frombuffer(b"".join(ids), "<u4")
    first = (np.cumsum(n, dtype=np.int64) - n)
    symbols, at, rules, base = compress(flat, first)
    bits = 16 if base + len(rules) <= 1 << 16 else 32
    head = struct.pack("<6Q", len(n), len(rules), len(symbols), len(flat), bits, base)
    return b"".join([MAGIC, head, rules.astype("<u4").tobytes(), expansion_lengths(rules, base).astype("<u4").tobytes(),
                     np.array(doc_ids, "<i8").tobytes(), n.astype("<u4").tobytes(), at.astype("<u8").tobytes(),
                     symbols.astype("<u2" if bits == 16 else "<u4").tobytes()])


class Shard:
    """A shard file, read without expanding more than is asked for."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a shard file")
        docs, n_rules, n_symbols, self.n_ids, bits, self.base = struct.unpack_from("<6Q", data, 8)
        at = 56

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        self.rules = take("<u4", 2 * n_rules).reshape(-1, 2)
        self.rule_lengths = take("<u4", n_rules)
        self.doc_ids, self.n_tokens, self.first = take("<i8", docs), take("<u4", docs), take("<u8", docs).astype(np.int64)
        self.symbols = take("<u2" if bits == 16 else "<u4", n_symbols)

    def symbols_of(self, k: int) -> np.ndarray:
        return self.symbols[self.first[k]:self.first[k + 1] if k + 1 < len(self.first) else None]

    def document(self, k: int) -> np.ndarray:
        """Ids of the k-th document."""
        return expand(self.symbols_of(k), self.rules, self.base)

    def slice(self, k: int, start: int, stop: int) -> np.ndarray:
        """Ids [start, stop) of the k-th document: only the symbols over it are expanded."""
        s = self.symbols_of(k)
        length = np.ones(len(s), np.int64)
        high = s >= self.base
        length[high] = self.rule_lengths[s[high] - self.base]
        end = np.cumsum(length)
        a = int(np.searchsorted(end, start, "right"))
        b = int(np.searchsorted(end, stop, "left")) + 1
        before = int(end[a - 1]) if a else 0
        return expand(s[a:b], self.rules, self.base)[start - before:stop - before]

    def all_ids(self) -> np.ndarray:
        """Ids of all documents: each rule is expanded once, symbols take their ids or expansions."""
        ids = np.concatenate([np.arange(self.base), expand(np.arange(self.base, self.base + len(self.rules)), self.rules, self.base)])
        ends = 4 * np.cumsum(np.concatenate([np.arange(self.base + 1) > 0, self.rule_lengths]), dtype=np.int64)
        table = pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(ids.astype("<u4"))])
        return np.frombuffer(table.take(pa.array(self.symbols)).buffers()[2], "<u4", self.n_ids)


def write_shards(docs: DataFrame, vocabulary: str, path: str, shard_bytes: int = SHARD_BYTES) -> None:
    """Encode every text, end it with id 0 and write shards in ascending doc_id order below ``path``."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("key"), text_column().alias("text"))
    shards = buckets_for(total_bytes(docs), shard_bytes)
    ordered = rows.repartitionByRange(shards, "key", F.crc32("text")).sortWithinPartitions("key", F.crc32("text"))

    def write(batches):
        enc = encoder(vocabulary)
        end = END_ID.to_bytes(4, "little")
        keys, ids, size = [], [], 0
        for b in batches:
            for part in chunks(list(zip(b["key"].tolist(), b["text"].tolist())), lambda row: len(row[1]), 2 * shard_bytes):
                new = [x + end for x in enc.encode([text for _, text in part])]
                keys += [key for key, _ in part]
                ids += new
                size += sum(map(len, new))
                if size > 4 * shard_bytes:  # ids take more room than text; a range may also be larger than asked
                    yield one(keys, ids)
                    keys, ids, size = [], [], 0
        if keys:
            yield one(keys, ids)

    def one(keys: list, ids: list[bytes]) -> pd.DataFrame:
        # Inside equal ids the order is that of the ids' bytes, whatever the texts' checksums were.
        order = sorted(range(len(keys)), key=lambda k: (keys[k], ids[k]))
        keys, ids = [keys[k] for k in order], [ids[k] for k in order]
        return pd.DataFrame({"first_key": [keys[0]], "last_key": [keys[-1]], "n_ids": [sum(map(len, ids)) // 4],
                             "n_docs": [len(keys)], "data": [write_shard(keys, ids)]})

    ordered.mapInPandas(write, "first_key long, last_key long, n_ids long, n_docs long, data binary").withColumn(
        "shard", F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files alone."""
    # One narrow row for each shard: its place in the order gives where its ids start.
    shards = spark.read.parquet(path)
    order = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = shards.select("shard", F.coalesce(F.sum("n_ids").over(order), F.lit(0)).alias("base"))

    def read(batches):
        for b in batches:
            for data, base in zip(b["data"], b["base"]):
                s = Shard(data)
                ids = s.all_ids().astype("<u4")
                n = s.n_tokens.astype(np.int64)
                start = np.cumsum(n) - n
                view = memoryview(ids.tobytes())
                crc = [zlib.crc32(view[4 * a:4 * (a + c)]) for a, c in zip(start.tolist(), n.tolist())]
                out = pd.DataFrame({"doc_id": pd.array(s.doc_ids, "Int64"), "start": base + start, "n_tokens": n,
                                    "ids_crc32": crc})
                out.loc[out["doc_id"] == LAST, "doc_id"] = pd.NA
                yield out

    return shards.select("shard", "data").join(F.broadcast(starts), "shard").mapInPandas(
        read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Write all documents' ids and return what the files hold."""
    path = shared_path(docs.sparkSession, "id-shards")
    write_shards(docs, vocabulary, path)
    return read_shards(docs.sparkSession, path)
