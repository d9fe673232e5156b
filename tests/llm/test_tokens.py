"""Operators on token ids: packing, shard files, distinct-word table, digest cache."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from brute import crc
from llm_cases import ROWS
from tokenizers import Tokenizer

from lodestar.llm import packing, repair, token_counts, word_table
from lodestar.llm.common import shared_path
from lodestar.llm.tokens import PieceEncoder, vocabulary_path

WORD, BYTE = vocabulary_path("word_bpe_49k.json"), vocabulary_path("byte_bpe_50k.json")


def library_ids(path, text):
    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_piece_encoder_equals_library(path):
    rng = random.Random(5)
    letters = "ab Z9'.\n\t\r\x0b\x0céßÀÿ¿!s td ll  <|"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += ["a<|endoftext|>b  c", "  x\n\n y\t", "İ ẞ 漢字 ﬁ", "x\x1cy z", "a  b   c \n d\r\n"]
    enc = PieceEncoder(path, keep=50)  # the remembered generations turn over all the time
    lib = Tokenizer.from_file(path)
    got = enc.encode(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [
        lib.encode(t, add_special_tokens=False).ids for t in texts]


def test_long_text_is_cut_where_no_piece_is(monkeypatch):
    from lodestar.llm import tokens

    text = " ".join(f"word{k}," for k in range(400)) + "\n\n  end"
    want = library_ids(BYTE, text)
    monkeypatch.setattr(tokens, "_LONG", 50)
    assert np.frombuffer(PieceEncoder(BYTE).encode([text])[0], "<u4").tolist() == want


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_a_piece_is_merged_once(path, monkeypatch):
    from lodestar.llm import tokens

    monkeypatch.setattr(tokens, "_CHUNK", 200)
    enc = PieceEncoder(path)
    merged = []
    merge = enc._merged
    monkeypatch.setattr(enc, "_merged", lambda pieces: merged.extend(pieces.to_pylist()) or merge(pieces))
    texts = [f"Word, word. (word) word{k % 3}\nword" for k in range(300)]
    got = enc.encode(texts)
    assert len(merged) == len(set(merged)) < 20  # one call took "word," and "word." as different words
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [library_ids(path, t) for t in texts[:3]] * 100


def test_few_pieces_do_not_search_all_remembered(monkeypatch):
    enc = PieceEncoder(WORD)
    enc.encode([" ".join(f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(500))])
    held = enc.pieces
    assert len(held) == 500
    assert np.frombuffer(enc.encode(["two words"])[0], "<u4").tolist() == library_ids(WORD, "two words")
    assert enc.pieces is held


def test_pieces_of_letters_that_the_vocabulary_lacks(tmp_path):
    import json

    with open(BYTE) as f:
        spec = json.load(f)
    gone = "Q"
    vocab = {t: i for t, i in spec["model"]["vocab"].items() if gone not in t}
    spec["model"]["vocab"] = vocab
    spec["model"]["merges"] = [m for m in spec["model"]["merges"] if gone not in "".join(m)]
    path = tmp_path / "lacking.json"
    path.write_text(json.dumps(spec))
    texts = ["Q", "aQb Qc Q", "no letter lacks", "Q a Q"]
    assert [np.frombuffer(g, "<u4").tolist() for g in PieceEncoder(str(path)).encode(texts)] == [
        library_ids(str(path), t) for t in texts]


def check_packed(rows, docs, capacity=2048):
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
        by_doc[r["doc_id"]].append(r)
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    lib = Tokenizer.from_file(WORD)
    copies = Counter(i for i, _ in docs)
    for doc_id, text in docs:
        ids = lib.encode(text or "", add_special_tokens=False).ids + [0]
        got = sorted(by_doc[doc_id], key=lambda r: r["piece"])[::copies[doc_id]]
        assert [(r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got] == [
            (k, a, len(ids[a:a + capacity]), crc(ids[a:a + capacity])) for k, a in enumerate(range(0, len(ids), capacity))]
    return by_sequence


def test_packing(small, texts):
    rows = packing.pack_documents(small, WORD).collect()
    packed = check_packed(rows, texts)
    assert len(packed) <= -(-sum(r["length"] for r in rows) // 2048) + 3


def test_packing_odd_rows(odd, empty):
    rows = packing.pack_documents(odd, WORD).collect()
    check_packed(rows, ROWS)
    assert packing.pack_documents(empty, WORD).count() == 0


def tightest_decreasing(lengths, capacity):
    gaps = []
    for s in sorted(lengths, reverse=True):
        fit = [g for g in gaps if g >= s]
        if fit:
            gaps.remove(min(fit))
        gaps.append((min(fit) if fit else capacity) - s)
    return len(gaps)


@pytest.mark.parametrize("lengths", [[700] * 8192, [1024] * 999, [2048, 1, 1], [683] * 3000,
                                     np.random.default_rng(2).integers(600, 1101, 4000).tolist(),
                                     np.random.default_rng(3).integers(1, 2049, 3000).tolist()])
def test_closing_step_nears_tightest_fit(lengths):
    given = np.sort(np.array(lengths, np.int64))[::-1]
    sequence, offset = packing.close_gaps(given, *packing.place_all(given, 2048), 2048)
    made = len(set(sequence.tolist()))
    # Sequences that the sums of squares have filled stay, which costs up to 2.1 % on lengths spread over the whole range.
    assert made <= (1.022 if min(lengths) < 600 else 1.002) * tightest_decreasing(lengths, 2048)
    if len(set(lengths)) == 1:
        assert made == -(-len(lengths) // (2048 // lengths[0]))
    for b in set(sequence.tolist()):
        own = sequence == b
        at, n = offset[own], given[own]
        order = np.argsort(at)
        assert at[order].tolist() == [0, *np.cumsum(n[order])[:-1]] and n.sum() <= 2048


def test_equal_rows_are_dealt_to_all_groups(spark):
    rows = spark.createDataFrame([(None, 0, 0, 700, 7)] * 400, packing.PIECES)
    out = packing.pack(rows, group=50).collect()
    groups = Counter(r["sequence_id"] >> 32 for r in out)
    assert len(out) == 400 and len(groups) == 8 and max(groups.values()) < 100


def test_place_minimises_the_sum_of_squares():
    rng = np.random.default_rng(1)
    lengths, capacity = rng.integers(1, 21, 200), 20
    sequence, offset = packing.place(lengths, capacity)
    fill = {}
    for s, b, o in zip(lengths.tolist(), sequence.tolist(), offset.tolist()):
        def total(levels):
            return sum(n * n for g, n in Counter(capacity - f for f in levels).items() if 0 < g < capacity)

        choices = [total([*[f for x, f in fill.items() if x != k], f0 + s]) for k, f0 in fill.items() if f0 + s <= capacity]
        choices.append(total([*fill.values(), s]))
        assert o == fill.get(b, 0)
        fill[b] = o + s
        assert total(fill.values()) == min(choices)


def check_shards(rows, docs):
    lib = Tokenizer.from_file(BYTE)
    want, at = [], 0
    for i, t in sorted(((2**63 if i is None else i, t or "") for i, t in docs)):
        ids = lib.encode(t, add_special_tokens=False).ids + [0]
        want.append((None if i == 2**63 else i, at, len(ids), crc(ids)))
        at += len(ids)
    assert sorted(map(tuple, rows), key=lambda r: r[1]) == want


def test_shards_round_trip(spark, small, texts, odd, empty):
    check_shards(repair.round_trip(small, BYTE).collect(), texts)
    check_shards(repair.round_trip(odd, BYTE).collect(), ROWS)
    assert repair.round_trip(empty, BYTE).count() == 0


def test_many_small_shards_hold_the_same(spark, small, texts):
    path = shared_path(spark, "shards")
    repair.write_shards(small, BYTE, path, shard_bytes=20_000)
    assert spark.read.parquet(path).count() > 5
    check_shards(repair.read_shards(spark, path).collect(), texts)


def test_all_ids_expand_every_rule_once(monkeypatch):
    rng = np.random.default_rng(4)
    docs = [np.append(rng.integers(1, 9, n), 0).astype("<u4") for n in (0, 1, 500, 3000)]
    shard = repair.Shard(repair.write_shard(list(range(len(docs))), [d.tobytes() for d in docs]))
    expand, asked = repair.expand, []
    monkeypatch.setattr(repair, "expand", lambda symbols, *rest: asked.append(len(symbols)) or expand(symbols, *rest))
    assert shard.all_ids().tolist() == np.concatenate(docs).tolist()
    assert sum(asked) == len(shard.rules) < len(shard.symbols)


def test_random_access():
    rng = np.random.default_rng(2)
    docs = [np.append(rng.integers(1, 9, n), 0).astype("<u4") for n in (0, 1, 500, 3000)] + [np.zeros(400, "<u4")]
    shard = repair.Shard(repair.write_shard(list(range(len(docs))), [d.tobytes() for d in docs]))
    assert len(shard.rules) and len(shard.symbols) < shard.n_ids / 2
    for k, d in enumerate(docs):
        assert shard.document(k).tolist() == d.tolist()
        for a, b in ((0, 0), (0, len(d)), (len(d) // 3, len(d) // 2), (len(d) - 1, len(d))):
            assert shard.slice(k, a, b).tolist() == d[a:b].tolist()
    for (a, b), n in zip(shard.rules.tolist(), shard.rule_lengths.tolist()):
        assert n == len(repair.expand(np.array([a, b]), shard.rules, shard.base))


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def check_words(rows, docs):
    lib = Tokenizer.from_file(WORD)
    want = []
    for i, t in docs:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(lib.decode(ids, skip_special_tokens=False))))
    order = lambda r: (r[0] is None, r[0] or 0, r[2])
    assert sorted(map(tuple, rows), key=order) == sorted(want, key=order)


def test_word_table(small, texts, odd, empty, monkeypatch):
    check_words(word_table.encode_and_decode(odd, WORD).collect(), ROWS)
    assert word_table.encode_and_decode(empty, WORD).count() == 0
    monkeypatch.setattr(word_table, "BUCKET_BYTES", 50_000)
    check_words(word_table.encode_and_decode(small, WORD).collect(), texts)


def test_word_table_of_blocks_made_again(small, texts, monkeypatch):
    """Lists of other rows than the blocks' (as after a lost executor) change nothing: words without an entry are encoded."""
    lists = word_table.word_lists
    monkeypatch.setattr(word_table, "BLOCK_BYTES", 200_000)
    monkeypatch.setattr(word_table, "word_lists", lambda docs, n: lists(docs.where("doc_id % 3 > 0").repartition(3, "doc_id"), n))
    check_words(word_table.encode_and_decode(small, WORD).collect(), texts)


def test_word_table_puts_words_back_without_an_object_for_each(monkeypatch):
    import tracemalloc

    import pandas as pd
    import pyarrow as pa

    rng = np.random.default_rng(3)
    table = pa.table({"id": np.arange(500), "piece": [f"p{k}é" for k in range(500)]})
    asked, join = [], word_table.joined_pieces
    monkeypatch.setattr(word_table, "joined_pieces", lambda ids, t: asked.append(ids.tolist()) or join(ids, t))

    def digests(counts, words, ends):
        ids = rng.integers(0, 500, int(counts.sum())).astype(np.uint32)
        asked.clear()
        tracemalloc.start()
        got = word_table.text_digests(counts, ids, pa.array(words, pa.int32()), ends, table)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert sorted(asked[0]) == sorted(set(ids.tolist()))  # every distinct id is joined once
        entries = np.split(ids, np.cumsum(counts)[:-1])
        texts = [[i for k in words[a:b] for i in entries[k].tolist()] for a, b in zip(ends, ends[1:])]
        assert got.equals(pd.DataFrame({"n_tokens": list(map(len, texts)), "ids_sha256": [sha(" ".join(map(str, t))) for t in texts],
                                        "decoded_sha256": [sha(" ".join(f"p{i}é" for i in t)) for t in texts]}))
        return most

    digests(np.array([2, 0, 1, 3], np.uint32), np.array([1, 0, 3, 1, 2, 1, 1, 1]), np.array([0, 0, 3, 6, 8, 8]))
    digests(np.array([0], np.uint32), np.array([0, 0], int), np.array([0, 0, 2]))
    digests(np.array([0], np.uint32), np.array([], int), np.array([0, 0]))
    counts = rng.integers(0, 6, 50_000).astype(np.uint32)
    n = 100_000
    assert digests(counts, rng.integers(0, len(counts), n), np.arange(0, n + 1, 1000)) < 50 * n  # words as objects, held in dictionaries, took 228


def test_word_table_encode_then_decode(spark, odd):
    lib = Tokenizer.from_file(WORD)
    docs = odd.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    encoded = word_table.encode(docs, WORD)
    got = {r["doc_id"]: r["text"] for r in word_table.decode(encoded, word_table.pieces(spark, WORD)).collect()}
    assert got == {i: lib.decode(lib.encode(t or "", add_special_tokens=False).ids, skip_special_tokens=False)
                   for i, t in ROWS if i is not None}


def check_counts(rows, docs):
    lib = Tokenizer.from_file(BYTE)
    want = Counter()
    for i, t in docs:
        n = len(lib.encode(t or "", add_special_tokens=False).ids)
        want[(i, len((t or "").encode()), n, n > 512)] += 1
    assert Counter(map(tuple, rows)) == want


def test_token_counts_and_cache(spark, small, texts, odd, empty):
    path = shared_path(spark, "counts")
    check_counts(token_counts.count_tokens(odd, BYTE, path).collect(), ROWS)
    n = spark.read.parquet(path).count()
    assert n == len({t or "" for _, t in ROWS})
    check_counts(token_counts.count_tokens(small, BYTE, path).collect(), texts)
    n = spark.read.parquet(path).count()
    digest = token_counts.tokenizer_digest(BYTE)
    again = token_counts.misses(token_counts.digested(small, BYTE), token_counts.read_cache(spark, path), digest)
    assert again.count() == 0
    assert token_counts.count_tokens(empty, BYTE, path).count() == 0
    assert spark.read.parquet(path).count() == n
    # Another tokenizer shares the folder, not the counts.
    other = token_counts.count_tokens(odd.where("doc_id = 4"), WORD, path).first()
    assert other["n_tokens"] == 3
