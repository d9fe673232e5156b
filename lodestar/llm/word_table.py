"""Byte-pair encoding and decoding through a table of distinct words.

1. Spark splits texts at the six ASCII white-space characters, which no token of a
   word-level vocabulary crosses.  A block of consecutive rows (bounded by its characters) lists each of its
   distinct words once, in one packed list for each word bucket.
2. In a bucket the lists of all blocks meet: the union is the distinct-word table, whose words are encoded
   once each by the library.  Every block gets its own list back with the ids.
3. Blocks and their lists are joined on the block: the list's ids are joined with the table ``id, piece`` (each distinct id
   once), and ids and pieces go back to each word's position.  Words are numbered and put back in Arrow, with no object
   for each word.

A word, however frequent, travels once for each block, so no bucket holds more than
one entry for each block and word.  Nothing but the packed lists and the packed texts is shuffled.
A block's name is a digest of its rows.  A block that is made again of other rows (a lost executor, rows in another
order) finds no list of its name, or lists of words it doesn't hold; words without an entry are encoded with the block, so
the result is the same.

Defined cases: null and empty texts have no ids (SHA-256 of the empty text); special strings in texts are
handled as the library does; rows that occur twice are returned twice; rows with a null id are encoded like
others; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import pickle
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import buckets_for, text_column, total_bytes
from .tokens import _binary, _ends, encoder

#: Characters of a block, and text bytes of the corpus for each word bucket.
BLOCK_BYTES, BUCKET_BYTES = 8 << 20, 32 << 20
LIST = "block binary, bucket int, words binary"
ENTRIES = "block binary, bucket int, words binary, n binary, ids binary"


def words_of(texts: pa.Array) -> pa.Array:
    """Lists of maximal runs of anything but the six ASCII white-space characters; an empty word may begin or end a list."""
    return pc.ascii_split_whitespace(texts.cast(pa.large_string()))


def _unpacked(lists: pd.Series) -> pa.Array:
    """The words of each packed list."""
    unzip = zstandard.ZstdDecompressor()
    return pc.split_pattern(pa.array([unzip.decompress(w) for w in lists], pa.large_string()), "\n")


def _blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[bytes, pa.Table]]:
    """Name and rows of each block: consecutive rows of at most ``most`` characters (a longer text stands alone)."""
    held: list[pa.RecordBatch] = []
    size = 0

    def block():
        rows = pa.Table.from_batches(held)
        figures = [rows[c].to_pylist() for c in ("doc_id", "chars", "crc")]
        return hashlib.blake2b(pickle.dumps(figures), digest_size=12).digest(), rows

    for b in batches:
        chars, at = b["chars"].to_numpy().astype(np.int64), 0
        while at < len(chars):
            n = int(np.searchsorted(np.cumsum(chars[at:]), most - size, "right"))
            if not n and held:
                yield block()
                held, size = [], 0
                continue
            n = max(n, 1)
            held.append(b.slice(at, n))
            size += int(chars[at:at + n].sum())
            at += n
    if held:
        yield block()


def _rows(docs: DataFrame, payload: Column) -> DataFrame:
    """``doc_id, chars, crc`` (which name a block) and the payload."""
    text = docs.select(F.col("doc_id").cast("long"), text_column().alias("text"))
    return text.select("doc_id", F.char_length("text").alias("chars"), F.crc32("text").alias("crc"), payload.alias("payload"))


def word_lists(docs: DataFrame, buckets: int) -> DataFrame:
    """Each block's distinct words, packed for each bucket."""
    most = BLOCK_BYTES

    def lists(batches):
        zip_ = zstandard.ZstdCompressor(level=3)
        for name, rows in _blocks(batches, most):
            own: dict[int, list[bytes]] = defaultdict(list)
            distinct = rows["payload"].combine_chunks().flatten().unique()
            for w in distinct.take(pc.sort_indices(distinct)).cast(pa.binary()).to_pylist():
                if w:
                    own[zlib.crc32(w) % buckets].append(w)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(own), pa.binary()), pa.array(list(own), pa.int32()),
                 pa.array([zip_.compress(b"\n".join(w)) for w in own.values()], pa.binary())], ["block", "bucket", "words"])

    return _rows(docs, F.split("text", "[ \\t\\n\\x0B\\f\\r]+")).mapInArrow(lists, LIST)


def packed_blocks(docs: DataFrame) -> DataFrame:
    """Each block's rows as one compressed value."""
    most = BLOCK_BYTES

    def pack(batches):
        zip_ = zstandard.ZstdCompressor(level=3)
        for name, rows in _blocks(batches, most):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema) as out:
                out.write_table(rows)
            data = zip_.compress(sink.getvalue())
            yield pa.RecordBatch.from_arrays([pa.array([name], pa.binary()), pa.array([data], pa.binary())], ["block", "rows"])

    return _rows(docs, F.col("text")).mapInArrow(pack, "block binary, rows binary")


def encoded_lists(lists: DataFrame, vocabulary: str) -> DataFrame:
    """The distinct-word table of each bucket, returned to every block with its own list."""
    def encode(pdf: pd.DataFrame) -> pd.DataFrame:
        zip_ = zstandard.ZstdCompressor(level=3)
        own = _unpacked(pdf["words"])
        words = own.flatten().dictionary_encode()
        table = pa.array(encoder(vocabulary).encode(words.dictionary.to_pylist()), pa.large_binary())
        n, ids = [], []
        at = own.offsets.to_pylist()
        for a, b in zip(at, at[1:]):
            found = table.take(words.indices[a:b])
            n.append(zip_.compress((np.diff(_ends(found)) // 4).astype(np.uint32).tobytes()))
            ids.append(zip_.compress(found.buffers()[2] or b""))
        return pd.DataFrame({"block": pdf["block"], "bucket": pdf["bucket"], "words": pdf["words"], "n": n, "ids": ids})

    return lists.groupBy("bucket").applyInPandas(encode, ENTRIES)


def _entries(pdf: pd.DataFrame) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words of a block (the last one empty) with the number of ids of each and all ids."""
    unzip = zstandard.ZstdDecompressor()
    n, ids = (np.frombuffer(b"".join(map(unzip.decompress, pdf[c])), np.uint32) for c in ("n", "ids"))
    words = pa.concat_arrays([_unpacked(pdf["words"]).flatten(), pa.array([""], pa.large_string())])
    return words, np.append(n, np.uint32(0)), ids


def _completed(words: pa.Array, counts: np.ndarray, ids: np.ndarray, more: pa.Array, vocabulary: str) -> tuple:
    """The entries with those of ``more`` words added."""
    found = encoder(vocabulary).encode(more.to_pylist())
    return (pa.concat_arrays([words, more]), np.concatenate([counts, np.array([len(x) // 4 for x in found], np.uint32)]),
            np.concatenate([ids, np.frombuffer(b"".join(found), np.uint32)]))


def _put_back(of_ids: pa.Array, counts: np.ndarray, places: pa.Array, ends: np.ndarray) -> Iterator[memoryview]:
    """Each text's bytes: those of its words' ids, in order.

    ``of_ids`` holds the bytes of every entry's ids and ``counts`` how many an entry has; ``places`` are the entries of all words of
    all texts, which end at ``ends``.
    """
    starts = np.append(0, np.cumsum(counts.astype(np.int64)))
    of_words = _binary(_ends(of_ids)[starts], of_ids.buffers()[2]).take(places)
    data, at = memoryview(of_words.buffers()[2] or b""), _ends(of_words)[ends].tolist()
    return (data[a:b] for a, b in zip(at, at[1:]))


def joined_pieces(ids: np.ndarray, table: pa.Table) -> list[str]:
    """The piece of every id, in order: an equi-join of positions with ``table(id, piece)``."""
    at = pa.table({"pos": np.arange(len(ids)), "id": ids.astype(np.int64)})
    return at.join(table, "id").sort_by("pos")["piece"].to_pylist()


def pieces(spark: SparkSession, vocabulary: str) -> DataFrame:
    """``id, piece`` of the vocabulary: as many rows as the tokenizer file has tokens."""
    lib = encoder(vocabulary).library
    rows = sorted((i, p) for p, i in lib.get_vocab(with_added_tokens=True).items())
    return spark.createDataFrame(pd.DataFrame(rows, columns=["id", "piece"]), "id long, piece string")


def with_positions(docs: DataFrame, vocabulary: str, finish, schema: str) -> DataFrame:
    """``finish(counts, ids, places, ends)`` of every block, after the join back by position.

    The block's entries have ``counts[k]`` of the ``ids`` each; ``places`` are the entries of its texts' words, one text
    between two ``ends``.
    """
    buckets = buckets_for(total_bytes(docs), BUCKET_BYTES)
    entries = encoded_lists(word_lists(docs, buckets), vocabulary)
    names = [c.split()[0] for c in schema.split(", ")]

    def join(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left):  # else lists of a block that was made again of other rows
            held = _entries(right)
            for packed in left["rows"]:
                rows = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(packed)).read_all()
                own = words_of(rows["payload"].combine_chunks())
                words = own.flatten().dictionary_encode()
                at, found = pc.index_in(words.dictionary, value_set=held[0]), held
                if at.null_count:  # words without an entry
                    found = _completed(*held, words.dictionary.filter(at.is_null()), vocabulary)
                    at = pc.index_in(words.dictionary, value_set=found[0])
                done = finish(*found[1:], at.take(words.indices), np.asarray(own.offsets))
                out.append(done.assign(doc_id=pd.array(rows["doc_id"].to_pylist(), "Int64")))
        return pd.concat(out)[names] if out else pd.DataFrame(columns=names, dtype=object)

    return (packed_blocks(docs).groupBy("block").cogroup(entries.groupBy("block"))
            .applyInPandas(join, schema))


def text_digests(counts: np.ndarray, ids: np.ndarray, places: pa.Array, ends: np.ndarray, table: pa.Table) -> pd.DataFrame:
    """``n_tokens, ids_sha256, decoded_sha256`` of a block's texts, given as ``with_positions`` does."""
    distinct = pa.array(ids).dictionary_encode()

    def digests(shown: pa.Array) -> list[str]:
        """SHA-256 of each text's ids as ``shown``, joined by one space."""
        spaced = pc.binary_join_element_wise(shown, *(pa.scalar(x, shown.type) for x in (" ", "")))
        texts = _put_back(spaced.take(distinct.indices), counts, places, ends)
        return [hashlib.sha256(t[:-1]).hexdigest() for t in texts]

    numbers = np.append(0, np.cumsum(counts[np.asarray(places)].astype(np.int64)))
    parts = joined_pieces(np.asarray(distinct.dictionary), table)
    return pd.DataFrame({"n_tokens": np.diff(numbers[ends]), "ids_sha256": digests(distinct.dictionary.cast(pa.large_string())),
                         "decoded_sha256": digests(pa.array(parts, pa.large_string()))})


def encode_and_decode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every row.

    The vocabularies of this kind have no decoder: decoding is the ids' pieces joined by one space,
    which words inherit, so each distinct id of a block is joined to its piece once.
    """
    spark = docs.sparkSession
    # Bounded by the tokenizer file, whatever the corpus.
    table = spark.sparkContext.broadcast(pieces(spark, vocabulary).toArrow())

    def finish(counts, ids, places, ends):
        return text_digests(counts, ids, places, ends, table.value)

    return with_positions(docs, vocabulary, finish,
                          "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id, ids`` (array of int) of every row."""
    def finish(counts, ids, places, ends):
        of_ids = _binary(4 * np.arange(len(ids) + 1), pa.py_buffer(ids))
        return pd.DataFrame({"ids": [np.frombuffer(t, np.int32) for t in _put_back(of_ids, counts, places, ends)]})

    return with_positions(docs, vocabulary, finish, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, pieces: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, text``: ids joined to ``pieces(id, piece)`` by position; keys are distinct, an id without a piece is left out."""
    at = encoded.select(key, F.posexplode_outer("ids").alias("pos", "id"))
    found = at.join(F.broadcast(pieces), at["id"] == pieces["id"], "left")
    ordered: Column = F.array_sort(F.collect_list(F.when(F.col("piece").isNotNull(), F.struct("pos", "piece"))))
    return found.groupBy(key).agg(F.array_join(F.transform(ordered, lambda x: x["piece"]), " ").alias("text"))
