"""Token ids of whole texts, equal to the ``tokenizers`` library's, at the price of one merge for each new piece.

Byte-pair merges never cross the pieces that a tokenizer's own split makes.  The words of a
chunk of texts are numbered in Arrow, only distinct words are split into pieces, and only
pieces that the worker does not remember are merged by the library's model, all of a chunk in one call.
The split runs here only for texts made of ASCII and Latin-1 letters, for which it
is the fixed pattern below; any other text, and any text that may hold a special
token, goes through the library whole.
"""

from __future__ import annotations

import os
import re
import sys
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: The split patterns of the two vocabularies, restricted to the characters of PLAIN.
_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
PLAIN = re.compile("[\t\n\x0b\x0c\r -~¡¿À-ÖØ-öø-ÿ]*")
#: (the zero byte, which no plain text holds, stands between words that are split together).
WORD_SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[0-9]|[^\s{_LETTER}0-9\x00]+|\x00")
BYTE_SPLIT = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[0-9]+| ?[^\s{_LETTER}0-9\x00]+|\s+(?![^\s\x00])|\s+|\x00")

#: A single space between two visible characters: no piece of either split crosses the point before it.
_CUT = re.compile(r"(?<=\S) (?=\S)")
_LONG = 1 << 20
#: Characters of texts that are encoded together.
_CHUNK = 6 << 20
#: Pieces remembered for each one asked for, beyond which asking takes longer than merging.
_FEW = 16
#: Stands between words that are split together.
_BETWEEN = "\x00"
#: Marks a part of a text that has no space before it, and a space at which a text is not cut.
_HEAD, _SPACE = "\x01", "\x02"
#: A space that other white space or the end follows.
_RUN = re.compile(r" (?!\S)")


def _byte_letters() -> dict[int, str]:
    """Code point -> the letters that byte-level vocabularies write for its UTF-8 bytes."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    letter = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return {c: "".join(letter[b] for b in chr(c).encode()) for c in range(1, 256)}


def pieces_of_long(text: str) -> list[str]:
    """A text of over a million characters, cut where no piece is split."""
    out, at = [], 0
    while len(text) - at > _LONG:
        m = _CUT.search(text, at + _LONG)
        if m is None:
            break
        out.append(text[at:m.start()])
        at = m.start()
    out.append(text[at:])
    return out


class PieceEncoder:
    """Ids as little-endian unsigned 32-bit bytes; the ``keep`` pieces met last are remembered."""

    def __init__(self, path: str, keep: int = 400_000):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.bare = Tokenizer(self.library.model)
        self.split = self._known_split()
        self.letters = _byte_letters()
        suffix = getattr(self.library.model, "end_of_word_suffix", None) or ""
        vocabulary = self.library.get_vocab(with_added_tokens=False)
        self.lengths = np.zeros(1 + max(vocabulary.values()), np.int64)  # letters of each id
        for token, number in vocabulary.items():
            self.lengths[number] = len(token.removesuffix(suffix))
        self.keep = keep
        self.pieces, self.ids = pa.array([], pa.large_string()), pa.array([], pa.large_binary())

    def _known_split(self) -> re.Pattern | None:
        """The pattern above if the file's normalizer and split are the known ones, else None (always whole texts)."""
        import json

        spec = json.loads(self.library.to_str())
        before, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer") or {}
        if not norm and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space"):
            return BYTE_SPLIT
        kinds = [x.get("type") for x in norm.get("normalizers", [])]
        steps = before.get("pretokenizers", [])
        if kinds == ["NFC", "Replace", "Lowercase"] and [x.get("type") for x in steps] == ["Split", "ByteLevel"]:
            if r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+" in steps[0]["pattern"].get("Regex", "") and not steps[1]["add_prefix_space"]:
                return WORD_SPLIT
        return None

    def whole(self, text: str) -> bytes:
        return _packed(self.library.encode(text, add_special_tokens=False).ids)

    def _merged(self, pieces: pa.Array) -> pa.Array:
        """Ids of distinct pieces, merged by the library's model in one call."""
        joined = _joined(pieces)
        if joined.isascii():
            for c in " \t\n\x0b\x0c\r":
                joined = joined.replace(c, self.letters[ord(c)])
        else:
            joined = joined.translate(self.letters)
        words = joined.split(_BETWEEN)[:-1]
        # The call without offsets does not tell which piece an id is of; the letters of the ids do, as they make up the pieces.
        [e] = self.bare.encode_batch_fast([words], is_pretokenized=True, add_special_tokens=False)
        ids = np.array(e.ids, "<u4")
        letters = np.append(0, np.cumsum(self.lengths[ids]))
        ends = np.append(0, np.cumsum(np.fromiter(map(len, words), np.int64, len(words))))
        at = np.searchsorted(letters, ends)
        if letters[-1] != ends[-1] or not np.array_equal(letters[at], ends):  # letters that the vocabulary lacks
            e = self.bare.encode(words, is_pretokenized=True, add_special_tokens=False)
            ids = np.array(e.ids, "<u4")
            at = np.append(0, np.cumsum(np.bincount(np.array(e.word_ids, np.int64), minlength=len(words))))
        return _binary(4 * at, pa.py_buffer(ids))

    def _ids_of(self, pieces: pa.Array) -> pa.Array:
        """Ids of distinct pieces, which are remembered before those met earlier."""
        if 0 < len(pieces) * _FEW < len(self.pieces):
            return self._merged(pieces)
        at = pc.index_in(pieces, value_set=self.pieces)
        new = np.asarray(at.is_null())
        known = at.drop_null()
        ids = self.ids
        if new.any():
            ids = pa.concat_arrays([ids, self._merged(pieces.filter(pa.array(new)))])
        where = np.empty(len(pieces), np.int64)
        where[~new] = known
        where[new] = np.arange(len(self.ids), len(ids))
        found = ids.take(pa.array(where))
        earlier = np.ones(len(self.pieces), bool)
        earlier[known] = False
        earlier = np.flatnonzero(earlier)[:max(0, self.keep - len(pieces))]
        self.pieces, self.ids = (pa.concat_arrays([a[:self.keep], b.take(pa.array(earlier))])
                                 for a, b in ((pieces, self.pieces), (found, self.ids)))
        return found

    def _words(self, texts: list[str]) -> pa.Array:
        """Lists of the parts of plain texts that encode by themselves.

        Lower-case words split at white space, or for the byte-level split the
        stretches between spaces: each but the first stands for itself with the
        space before it.  A space before other white space would join its run,
        so such a text is one part.
        """
        if self.split is WORD_SPLIT:
            return pc.ascii_split_whitespace(pc.utf8_lower(pa.array(texts, pa.large_string())))
        texts = [_HEAD + (t.replace(" ", _SPACE) if _RUN.search(t) else t) for t in texts]
        return pc.split_pattern(pa.array(texts, pa.large_string()), " ")

    def _word_ids(self, words: pa.Array) -> pa.Array:
        """Ids of distinct words, as ``_words`` gives them."""
        joined = _BETWEEN + _joined(words)[:-1]  # before each word
        if self.split is BYTE_SPLIT:
            joined = joined.replace(_BETWEEN, _BETWEEN + " ").replace(f"{_BETWEEN} {_HEAD}", _BETWEEN).replace(_SPACE, " ")
        flat = pa.array(self.split.findall(joined), pa.large_string())
        between = np.asarray(pc.equal(flat, _BETWEEN))
        pieces = flat.filter(pa.array(~between)).dictionary_encode()
        ids = self._ids_of(pieces.dictionary).take(pieces.indices)
        first = np.flatnonzero(between) - np.arange(len(words))  # the pieces before each word
        return _binary(_ends(ids)[np.append(first, len(ids))], ids.buffers()[2])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of every text, in order."""
        out: list[bytes] = [b""] * len(texts)
        owners: list[int] = []
        parts: list[str] = []
        size = 0
        for k, text in enumerate(texts):
            if not text:
                continue
            if self.split is None or "<|" in text or not PLAIN.fullmatch(text):
                out[k] = self.whole(text)
                continue
            for part in pieces_of_long(text):
                if size and size + len(part) > _CHUNK:
                    self._finish(owners, parts, out)
                    owners, parts, size = [], [], 0
                owners.append(k)
                parts.append(part)
                size += len(part)
        self._finish(owners, parts, out)
        return out

    def _finish(self, owners: list[int], parts: list[str], out: list[bytes]) -> None:
        if not parts:
            return
        lists = self._words(parts)
        words = lists.flatten().dictionary_encode()
        ids = self._word_ids(words.dictionary).take(words.indices)
        ends = _ends(ids)[np.asarray(lists.offsets)].tolist()
        data = memoryview(ids.buffers()[2] or b"")
        for k, a, b in zip(owners, ends, ends[1:]):
            out[k] += data[a:b]


def _joined(strings: pa.Array) -> str:
    """All strings, each with the mark that stands between words behind it."""
    if not len(strings):
        return ""
    both = pc.binary_join_element_wise(strings, *(pa.scalar(x, strings.type) for x in (_BETWEEN, "")))
    return str(both.buffers()[2], "utf-8")


def _binary(ends: np.ndarray, data: pa.Buffer | None) -> pa.Array:
    """The stretches of ``data`` between ``ends``."""
    return pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int64)), data])


def _ends(binary: pa.Array) -> np.ndarray:
    """Where the values of a whole large binary array begin, and where the last one ends."""
    if not len(binary):
        return np.zeros(1, np.int64)
    return np.frombuffer(binary.buffers()[1], np.int64)[:len(binary) + 1]


def _packed(ids: list[int]) -> bytes:
    a = array("I", ids)
    if sys.byteorder == "big":
        a.byteswap()
    return a.tobytes()


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """One encoder per vocabulary and Python worker; workers live for many tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
