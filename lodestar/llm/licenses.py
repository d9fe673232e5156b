"""License notices by conditional compression.

A candidate block is a run of lines that hold a licensing cue.  Equal blocks are judged once.  Each block is compressed
alone and with every template as zstandard raw dictionary; the share of bytes that a
template saves ranks the templates.  The best ``RANKED`` are confirmed by the exact wording: words of block and
template are aligned, and the template with the most matched words and the fewest differences wins if at
least ``LEAST_MATCH`` of the shorter text's words match.  A template is no winner if a differing word names a license or a
version ("lesser", "affero", "3"): the text is then another license's, or none the templates know.  The differing words are returned.

A block that holds other words too is cut into sentences, and the sentences around
each cue, alone and in runs of up to the longest template's length, are judged by the same two steps; so are, in a
sentence longer than that, the stretches where a template's sentence would lie if the cue's word were its own.  Of
confirmed stretches that overlap, the one with the most matched less differing words stands, so a block may hold
several notices, each a row.

Cues are looked for in whole texts.  A block of very many documents is one row after the partial
aggregate; verdicts return to the documents by a join on the block's digest.

Defined cases: null and empty texts hold no block; a block without a confirmed template gives no row;
a row that occurs twice gives its rows twice; an empty table or template list gives no rows; ties go to the
template whose name sorts first; other columns are ignored.
"""

from __future__ import annotations

import difflib
import re

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_column

#: The usual notices of well-known licenses, by their short identifiers.
TEMPLATES = {
    "AGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero "
                "General Public License as published by the Free Software Foundation, either version 3 of the License, or (at "
                "your option) any later version. This work is licensed under the GNU Affero General Public License, version 3.",
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
                  "compliance with the License. You may obtain a copy of the License at "
                  "http://www.apache.org/licenses/LICENSE-2.0",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted "
                    "provided that the following conditions are met",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to "
               "this work. This work is licensed under CC0 1.0 Universal.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License. "
                 "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License. "
                    "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License. "
                    "Licensed under CC BY-SA 4.0.",
    "GPL-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
               "Public License as published by the Free Software Foundation; either version 2 of the License, or (at your "
               "option) any later version. This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
               "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
               "option) any later version. This work is licensed under the GNU General Public License, version 3.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
           "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "LGPL-2.0": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Library "
                "General Public License as published by the Free Software Foundation; either version 2 of the License, or "
                "(at your option) any later version.",
    "LGPL-2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
                "General Public License as published by the Free Software Foundation; either version 2.1 of the License, or "
                "(at your option) any later version. This work is licensed under the GNU Lesser General Public License, "
                "version 2.1.",
    "LGPL-3.0": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser "
                "General Public License as published by the Free Software Foundation, either version 3 of the License, or "
                "(at your option) any later version. This work is licensed under the GNU Lesser General Public License, "
                "version 3.",
    "MIT": "Released under the MIT License. Permission is hereby granted, free of charge, to any person obtaining a copy of "
           "this software and associated documentation files, to deal in the Software without restriction",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
               "not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
                 "publish, use, compile, sell, or distribute this software",
}
#: Words that tell one license from another, beside the identifiers and version numbers.
NAMES = frozenset("affero apache attribution attribution-noncommercial attribution-sharealike attribution-noderivatives bsd by by-nc "
                  "by-nc-nd by-nc-sa by-nd by-sa cc0 creative gpl isc lesser lgpl mit mozilla mpl noncommercial "
                  "noderivatives sharealike unlicense".split())
_VERSION_NUMBER = re.compile(r"v?\d{1,2}(\.\d{1,2})*")
#: Lower-case strings of which a candidate line holds one.
CUES = ("licen", "copyright", "redistribut", "permission is", "rights reserved", "public domain", "spdx", "warrant")
RANKED, LEAST_SAVING, LEAST_MATCH = 5, 0.25, 0.75

_WORD = re.compile(r"[^\s\"'();:,]+")
_SENTENCE = re.compile(r"\S(?:[^\n]*?[.!?](?=\s)|[^\n]*)")


def wording(text: str) -> list[str]:
    """Lower-case words without quotes, brackets and closing marks; comment signs are no words."""
    return [w for w in (x.rstrip(".") for x in _WORD.findall(text.lower())) if any(map(str.isalnum, w))]


def _has_cue(text):
    low, found = F.lower(text), F.lit(False)
    for c in CUES:
        found = found | F.contains(low, F.lit(c))
    return found


def candidate_blocks(docs: DataFrame) -> DataFrame:
    """``doc_id, block_no, block``: maximal runs of lines with a cue; block_no counts a document's blocks from 0."""
    rows = docs.select("doc_id", text_column().alias("text")).where(_has_cue(F.col("text")))
    # Lines without a cue become empty; runs then stand between empty lines.
    marked = F.transform(F.split("text", "\n"), lambda line: F.when(_has_cue(line), line).otherwise(F.lit("")))
    blocks = F.filter(F.split(F.array_join(marked, "\n"), "\n\n+"), lambda b: F.btrim(b) != "")
    return rows.select("doc_id", F.posexplode(blocks).alias("block_no", "block")).withColumn(
        "block", F.btrim("block", F.lit("\n")))


def with_identifiers(templates: dict[str, str]) -> dict[str, str]:
    """Templates with one more line, as a license may also be named by its short identifier."""
    return {name: f"{text}\nSPDX-License-Identifier: {name}" for name, text in templates.items()}


class Scanner:
    """Compressors with one raw dictionary each."""

    def __init__(self, templates: dict[str, str]):
        templates = with_identifiers(templates)
        self.alone = self._compressor(None)
        self.names = sorted(templates)
        self.given = {n: self._compressor(templates[n].encode()) for n in self.names}
        self.words = {n: wording(templates[n]) for n in self.names}
        self.tell = NAMES | {w for n in self.names for w in wording(n)}
        self.sentences = [wording(x) for n in self.names for x in _SENTENCE.findall(templates[n])]
        self.longest = max(map(len, self.words.values()), default=0)

    @staticmethod
    def _compressor(dictionary: bytes | None) -> zstandard.ZstdCompressor:
        d = dictionary and zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return zstandard.ZstdCompressor(level=9, dict_data=d or None, write_content_size=False, write_dict_id=False)

    def savings(self, block: str) -> list[tuple[float, str]]:
        """(share of bytes saved, template) of each template, largest first."""
        data = block.encode()
        alone = len(self.alone.compress(data))
        found = [(1 - len(self.given[n].compress(data)) / alone, n) for n in self.names]
        return sorted(found, key=lambda x: (-x[0], x[1]))

    def differences(self, block: str, name: str) -> tuple[int, list[str], list[str]]:
        """Matched words, words only in the block, and words of the template missing between matched ones."""
        own, template = wording(block), self.words[name]
        parts = [m for m in difflib.SequenceMatcher(None, template, own, autojunk=False).get_matching_blocks() if m.size]
        matched = sum(m.size for m in parts)
        if not parts:
            return 0, own, []
        kept = {k for m in parts for k in range(m.b, m.b + m.size)}
        # A notice may quote a part of the template: only gaps inside the quoted part are differences.
        missing = [w for a, b in zip(parts, parts[1:]) for w in template[a.a + a.size:b.a]]
        return matched, [w for k, w in enumerate(own) if k not in kept], missing

    def judge(self, block: str) -> tuple | None:
        """(template, saving, words, matched, extra, missing) of the winner, or None."""
        best = None
        for saving, name in self.savings(block)[:RANKED]:
            if saving < LEAST_SAVING:
                break
            matched, extra, missing = self.differences(block, name)
            n = len(wording(block))
            if not n or matched < LEAST_MATCH * min(n, len(self.words[name])):
                continue
            if any(w in self.tell or _VERSION_NUMBER.fullmatch(w) for w in extra + missing):
                continue
            rank = (len(extra) + len(missing), -matched, -saving, name)
            if best is None or rank < best[0]:
                best = rank, (name, round(saving, 6), n, matched, extra, missing)
        return best and best[1]

    def notices(self, block: str) -> list[tuple]:
        """(text, *verdict) of the block itself or, if it holds other words or is no notice, of the notices inside."""
        whole = self.judge(block)
        if whole is not None and not whole[4]:
            return [(block, *whole)]
        found = []
        for a, b in self.stretches(block) | {(0, len(block))}:
            if (v := self.judge(block[a:b])) is not None:
                found.append((len(v[4]) + len(v[5]) - v[3], b - a, a, b, v))
        out = []
        for _, _, a, b, v in sorted(found, key=lambda x: x[:4]):
            if all(b <= c or d <= a for c, d, _ in out):
                out.append((a, b, v))
        return [(block[a:b], *v) for a, b, v in sorted(out, key=lambda x: x[:2])]

    def stretches(self, block: str) -> set[tuple[int, int]]:
        """Where a notice may stand: (start, end) of the stretches around cues."""
        parts = [m.span() for m in _SENTENCE.finditer(block)]
        sizes = [len(wording(block[a:b])) for a, b in parts]
        out = set()
        for k, (a, b) in enumerate(parts):
            low = block[a:b].lower()
            if not any(c in low for c in CUES):
                continue
            if sizes[k] > self.longest:
                out |= {(a + c, a + d) for c, d in self._word_stretches(block[a:b])}
                continue
            for first in range(k, -1, -1):
                if sum(sizes[first:k + 1]) > self.longest:
                    break
                for last in range(k, len(parts)):
                    if sum(sizes[first:last + 1]) > self.longest:
                        break
                    out.add((parts[first][0], parts[last][1]))
        return out

    def _word_stretches(self, sentence: str) -> set[tuple[int, int]]:
        spans = [(m.start(), m.end(), m[0].lower().rstrip(".")) for m in _WORD.finditer(sentence)]
        spans = [x for x in spans if x[2]]
        out = set()
        for k, (_, _, word) in enumerate(spans):
            if any(c in word for c in CUES) or word in ("permission", "rights", "public"):
                for t in self.sentences:
                    for at in (p for p, w in enumerate(t) if w == word):
                        first, last = max(0, k - at), min(len(spans), k - at + len(t)) - 1
                        out.add((spans[first][0], spans[last][1]))
        return out


VERDICT = ("digest binary, notice string, license string, saving double, n_words int, n_matched int, extra array<string>, "
           "missing array<string>")


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """``doc_id, block_no, license, saving, n_words, n_matched, extra, missing, block`` of every confirmed block
    or notice inside a block."""
    blocks = candidate_blocks(docs).withColumn("digest", F.unhex(F.sha2(F.col("block").cast("binary"), 256)))
    distinct = blocks.groupBy("digest").agg(F.first("block").alias("block"))

    def judge(batches):
        scanner = Scanner(templates)
        for b in batches:
            found = [(d, *v) for d, t in zip(b["digest"], b["block"]) for v in scanner.notices(t)]
            yield pd.DataFrame(found, columns=["digest", "notice", "license", "saving", "n_words", "n_matched", "extra",
                                               "missing"])

    return (blocks.join(distinct.mapInPandas(judge, VERDICT), "digest")
            .select("doc_id", "block_no", "license", "saving", "n_words", "n_matched", "extra", "missing",
                    F.col("notice").alias("block")))
