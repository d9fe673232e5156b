"""Operators on texts: quality rules, licenses, near-duplicates, toxicity, repeated windows."""

import duckdb
import pytest
from brute import near_components, removed_windows, words
from llm_cases import NEAR, ROWS
from pyspark.sql import functions as F

from lodestar.llm import components, licenses, minhash, quality, substrings, toxicity
from lodestar.llm.common import table

SMALL, MEDIUM, LARGE = "/root/testdata/sf0.001", "/root/testdata/sf0.01", "/root/testdata/sf0.1"


def test_quality_figures_on_odd_rows(odd, empty):
    rows = quality.quality_report(odd).collect()
    by_id = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(ROWS)
    for i, t in ROWS:
        w = words(t)
        windows = [tuple(w[k:k + 5]) for k in range(len(w) - 4)]
        twice = {k + j for k, x in enumerate(windows) if windows.count(x) > 1 for j in range(5)} if len(w) < 4000 else set(range(6000))
        lines = [x for x in (t or "").split("\n") if words(x)]
        r = by_id[i]
        assert (r["n_words"], r["word_chars"], r["n_dup_lines"]) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)))
        assert r["n_repeat_words"] == len(twice)
        assert r["base_failed"] == (len(w) < 10 or 100 * len(twice) > 20 * len(w))
        assert not (r["kept"] and r["base_failed"])
    assert quality.quality_report(empty).count() == 0


def test_quality_lines_go_and_documents_stay(spark):
    good = "This is a sentence that any reader would call clean and complete."
    other = "Here stands another statement, made of different words; it closes as lines should."
    text = "\n".join([good, "Home | About | News | Contact", other, "Click here for more of this.", "No closing mark"])
    docs = spark.createDataFrame([(1, text, "x"), (2, "buy### now### ***%%% $$$ && <<>> " * 8, "x"), (3, None, "x")],
                                 "doc_id long, text string, quality string")
    out = quality.clean_documents(docs).collect()
    assert [tuple(r) for r in out] == [(1, good + "\n" + other, "x")]


def test_quality_plan_has_no_python(small):
    plan = quality.clean_documents(small)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_quality_equals_sql(small):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
             "n_lines", "n_good_lines"]
    want = con.execute(f"SELECT {', '.join(names)} FROM ({quality.report_sql()})").fetchall()
    assert sorted(map(tuple, quality.quality_report(small).select(*names).collect())) == sorted(want)


def test_license_wording(spark, empty, odd):
    rows = [
        (1, "Some text.\nReleased under the MIT License.\nMore text."),
        (2, "This work is licensed under the GNU General Public License, version 2."),
        (3, "This work is licensed under the GNU General Public License, version 3."),
        (4, "Licensed under CC BY-NC 4.0.\n\nLicensed under the Apache License, Version 2.0."),
        (5, "He got a licence to drive and a permission to stay."), (6, None), (7, ""),
        (8, "Licensed under the Apache License, Version 2.0, by the authors of this small book."),
    ]
    out = licenses.scan(spark.createDataFrame(rows * 2, "doc_id long, text string")).collect()
    got = {(r["doc_id"], r["block_no"], r["license"]) for r in out}
    assert got == {(1, 0, "MIT"), (2, 0, "GPL-2.0"), (3, 0, "GPL-3.0"), (4, 0, "CC-BY-NC-4.0"), (4, 1, "Apache-2.0")}
    assert len(out) == 2 * len(got)
    assert all(not r["extra"] and not r["missing"] and r["n_words"] == r["n_matched"] for r in out)
    assert licenses.scan(empty).count() == 0 and licenses.scan(odd, {}).count() == 0
    scanner = licenses.Scanner(licenses.TEMPLATES)
    matched, extra, missing = scanner.differences("This work is licensed under the GNU Public License, version 4.", "GPL-3.0")
    assert extra == ["4"] and missing == ["general"] and matched == 10


@pytest.mark.parametrize("n", [0, 5, 40, 200, 800])
def test_license_notices_inside_long_lines(spark, n):
    prose = "".join(f"Some plain words of a story number {k} go here. " for k in range(n))
    notice, mit = "Licensed under the Apache License, Version 2.0.", "Released under the MIT License."
    loose = "plain words without any mark " * n
    gpl = "This work is licensed under the GNU General Public License, version 3"
    mpl = licenses.TEMPLATES["MPL-2.0"]
    rows = [(1, prose + notice), (2, notice + " " + prose), (3, prose + notice + " " + prose + mit + " " + prose),
            (4, loose + gpl + " " + loose), (5, prose + "He got a licence to drive and a permission to stay."),
            (6, prose + mpl + " " + prose)]
    got = [(r["doc_id"], r["license"], r["block"].strip()) for r in
           licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    want = [(1, "Apache-2.0", notice), (2, "Apache-2.0", notice), (3, "Apache-2.0", notice), (3, "MIT", mit),
            (4, "GPL-3.0", gpl), (6, "MPL-2.0", mpl)]
    if n:
        assert sorted(got) == want
    else:
        assert {(1, "Apache-2.0", notice), (4, "GPL-3.0", gpl), (6, "MPL-2.0", mpl)} <= set(got)


def test_license_names_and_versions_decide(spark):
    general = "{} is free software: you can redistribute it and/or modify it under the terms of the GNU {}General Public License " \
              "as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
    rows = [(1, general.format("This library", "Lesser ", 3)), (2, general.format("This program", "Affero ", 3)),
            (3, general.format("This program", "", 3)), (4, general.format("This program", "", 2)),
            (5, general.format("This program", "Lesser ", "2.1")), (6, general.format("Foo", "", 3)),
            (7, general.format("This program", "", 4)), (8, general.format("This program", "Artistic ", 3)),
            (9, "# SPDX-License-Identifier: MIT"), (10, "SPDX-License-Identifier: LGPL-2.1"),
            (11, "SPDX-License-Identifier: Zlib"), (12, licenses.TEMPLATES["ISC"]),
            (13, licenses.TEMPLATES["Unlicense"]),
            (14, "This work is licensed under the GNU General Public License, version 4."),
            (15, "Licensed under CC BY-ND 4.0."), (16, "This work is licensed under CC0 1.0 Universal.")]
    got = {}
    for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault(r["doc_id"], []).append(r["license"])
    assert got == {1: ["LGPL-3.0"], 2: ["AGPL-3.0"], 3: ["GPL-3.0"], 4: ["GPL-2.0"], 5: ["LGPL-2.1"], 6: ["GPL-3.0"],
                   8: ["GPL-3.0"], 9: ["MIT"], 10: ["LGPL-2.1"], 12: ["ISC"], 13: ["Unlicense"], 16: ["CC0-1.0"]}


def brute_notices(text, templates):
    """Every run of words of every template, looked for in every run of the text's words: exact notices alone."""
    own, found = licenses.wording(text), set()
    for name, template in templates.items():
        for sentence in licenses._SENTENCE.findall(template):
            words = licenses.wording(sentence)
            if any(own[k:k + len(words)] == words for k in range(len(own) - len(words) + 1)):
                found.add((name, tuple(words)))
    return found


def test_license_scan_finds_each_sentence_of_each_template(spark):
    templates = licenses.with_identifiers(licenses.TEMPLATES)
    sentences = [(n, x) for n, t in sorted(templates.items()) for x in licenses._SENTENCE.findall(t)
                 if any(c in x.lower() for c in licenses.CUES) and len(licenses.wording(x)) >= 2]
    prose = "Some plain words of a story go here, and they are long enough to hide a notice in."
    rows = [(k, f"{prose}\n{x}\n{prose}") for k, (_, x) in enumerate(sentences)]
    got = {r["doc_id"]: r["license"] for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, text in rows:
        may = {n for n, words in brute_notices(text, templates) if list(words) == licenses.wording(sentences[k][1])}
        assert got.get(k) in may, (sentences[k], got.get(k))


def test_license_scan_of_odd_rows(spark, odd):
    assert licenses.scan(odd).select("doc_id", "license").collect() is not None
    notice = "Released under the MIT License."
    rows = [(None, notice, "a"), (1, None, "b"), (2, "", "c"), (3, notice, "d"), (3, notice, "d"),
            (4, "words " * 60_000 + "\n" + notice, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, block string").withColumn("digest", F.lit(1)).withColumn(
        "license", F.lit("own"))
    out = licenses.scan(docs).collect()
    assert sorted((r["doc_id"] or -1, r["license"], r["block"]) for r in out) == [
        (i, "MIT", notice) for i in (-1, 3, 3, 4)]


def test_license_scan_finds_every_notice(small, texts):
    notice = {i for i, t in texts for x in (t or "").split("\n") if "icensed under" in x or "under the MIT License" in x}
    assert {r["doc_id"] for r in licenses.scan(small).collect()} == notice


@pytest.mark.parametrize("blocks", [(1024, 512), (3, 2)])
def test_near_duplicates(spark, monkeypatch, blocks):
    monkeypatch.setattr(minhash, "BLOCK", blocks[0])
    monkeypatch.setattr(minhash, "FULL_BLOCK", blocks[1])
    docs = table(spark, SMALL if blocks[0] == 3 else MEDIUM, "documents")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(docs).collect()}
    assert got == near_components(rows)


def test_near_duplicates_of_odd_rows(odd, empty):
    out = minhash.near_duplicates(odd).collect()
    assert len(out) == len(ROWS)
    want = near_components([(i, t) for i, t in ROWS if i is not None])
    for r in out:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]
            assert r["kept"] == (r["doc_id"] == r["component_id"])
    assert {want[i][1] for i in (5, 6, 7)} == {5} and want[9][1] == 4 and want[2][1] == 2
    assert minhash.near_duplicates(empty).count() == 0
    kept = minhash.representatives(odd)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] for r in kept.where("doc_id IS NOT NULL").collect()) == sorted(
        i for i, (_, c) in want.items() if i == c)


def test_one_id_on_two_texts_links_both(spark):
    a, b = "one two three four five six", "seven eight nine ten eleven twelve"
    rows = [(3, a), (3, b), (4, b), (1, a), (9, "x y z"), (9, "x y z")]
    out = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in out) == [(1, 1), (3, 1), (3, 1), (4, 1), (9, 9), (9, 9)]


@pytest.mark.parametrize("blocks", [(1024, 512), (3, 2)])
def test_near_copies_of_each_text_of_one_id(spark, monkeypatch, blocks):
    monkeypatch.setattr(minhash, "BLOCK", blocks[0])
    monkeypatch.setattr(minhash, "FULL_BLOCK", blocks[1])
    texts = [" ".join(f"t{t}w{k}" for k in range(100)) for t in range(6)]
    rows = [(1, t) for t in texts] + [(10 + k, t + " more") for k, t in enumerate(texts)] + [(50, "else " + texts[0][:99])]
    rows += [(7, texts[0].replace("t0", "a")), (7, texts[0].replace("t0", "a") + " b"), (8, texts[0].replace("t0", "a") + " c")]
    out = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = {i: 1 for i in (1, *range(10, 16))} | {50: 50, 7: 7, 8: 7}
    assert len(out) == len(rows) and {(r["doc_id"], r["component_id"]) for r in out} == set(want.items())


def test_estimate_counts_equal_bytes():
    import numpy as np

    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 4, (5, 256), dtype=np.uint8), rng.integers(0, 4, (7, 256), dtype=np.uint8)
    assert (minhash.equal_bytes(a, b) == (a[:, None] == b[None]).sum(2)).all()


def test_components_of_a_chain_and_a_star(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(200, 260)] + [(5, 5), (None, 3), (1, 0)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{k: 0 for k in range(61)}, **{k: 100 for k in [100, *range(200, 260)]}}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_toxicity_held_out(spark):
    docs, labels = table(spark, MEDIUM, "documents"), table(spark, MEDIUM, "labels")
    rows = toxicity.score_documents(docs, labels).join(labels, "doc_id").where("held_out").collect()
    toxic, clean = [r["score"] for r in rows if r["toxic"]], [r["score"] for r in rows if not r["toxic"]]
    auc = sum((a > b) + 0.5 * (a == b) for a in toxic for b in clean) / (len(toxic) * len(clean))
    assert auc > 0.75
    assert sum(r["predicted"] for r in rows if not r["toxic"]) <= 0.02 * len(clean)


def test_toxicity_recall_of_each_language(spark):
    """Small languages too: a few toxic texts are enough for their words."""
    docs, labels = table(spark, LARGE, "documents"), table(spark, LARGE, "labels")
    rows = (toxicity.score_documents(docs, labels).where("held_out").join(labels, "doc_id")
            .join(docs.select("doc_id", "lang"), "doc_id").select("lang", "toxic", "predicted").collect())
    for lang in {r["lang"] for r in rows}:
        found = [r["predicted"] for r in rows if r["lang"] == lang and r["toxic"]]
        assert sum(found) >= 0.6 * len(found), lang
    clean = [r["predicted"] for r in rows if not r["toxic"]]
    assert sum(clean) <= 0.02 * len(clean)


def test_toxicity_learns_nothing_from_held_out_labels(spark):
    docs, labels = table(spark, MEDIUM, "documents"), table(spark, MEDIUM, "labels")
    flipped = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(doc_id AS STRING)) % 3 = 1 THEN 1 - toxic ELSE toxic END AS toxic")
    assert toxicity.train(docs, flipped) == toxicity.train(docs, labels)


def test_toxicity_odd_rows(spark, odd, empty):
    labels = table(spark, MEDIUM, "labels").limit(0)
    out = toxicity.score_documents(odd, labels).collect()
    assert len(out) == len(ROWS) and all(0 <= r["score"] <= 1 and r["predicted"] == 0 for r in out)
    labels = spark.createDataFrame([(4, 1), (4, 0), (None, 1), (9, None), (12, 0)], "doc_id long, toxic int")
    assert toxicity.score_documents(odd, labels).count() == len(ROWS)
    assert toxicity.score_documents(empty, labels).count() == 0
    assert toxicity.clean_documents(odd, labels).columns == odd.columns


def test_non_negative_risk_separates_planted_words():
    import random

    rng = random.Random(1)
    plain = lambda: {f"w{rng.randint(0, 300)}" for _ in range(30)}
    bad = lambda: plain() | {rng.choice(["vile", "foul"])}
    model = toxicity.fit([bad() for _ in range(200)], [plain() for _ in range(900)] + [bad() for _ in range(100)], 0.1)
    assert min(model.score("vile w1 w2"), model.score("a foul w7")) > 0.7 > 0.3 > model.score("w1 w2 w3")


def test_small_groups_are_estimated_together():
    """Forests of many groups at once connect what forests of single groups do, wherever batches are cut."""
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(1)
    rows = []
    for g in range(120):
        base, two = rng.integers(0, 256, minhash.MINIMA, dtype=np.uint8), rng.random() < 0.3
        for _ in range(rng.choice([1, 2, 2, 3, 5, 16, 17, 40])):
            s, k = base.copy(), rng.integers(0, 110)
            s[rng.choice(minhash.MINIMA, k, replace=False)] = rng.integers(0, 256, k)
            rows.append((g // 3, g % 3, g % 3, int(two and rng.random() < 0.5), len(rows), s.tobytes()))
    df = pd.DataFrame(rows, columns=["key", "i", "j", "side", "doc_id", "sig"])

    def linked(forests):
        forest = minhash.Forest(len(df))
        for f in forests:
            for a, b in zip(f["u"], f["v"]):
                forest.join(a, b)
        return [forest.root(k) for k in range(len(df))]

    want = linked(minhash._forest_of_estimates(g, 0.75) for _, g in df.groupby(["key", "i", "j"]))
    assert len(set(want)) < len(df) - 300
    for step in (1, 7, 100, len(df)):
        assert linked(minhash._estimated_links((df.iloc[k:k + step] for k in range(0, len(df), step)), 0.75)) == want


def check_removed(rows, docs):
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows} == removed_windows(docs)


def test_repeated_windows(small, texts, monkeypatch):
    check_removed(substrings.remove_repeats(small).collect(), texts)
    monkeypatch.setattr(substrings, "BUCKET_BYTES", 20_000)
    monkeypatch.setattr(substrings, "BATCH_BYTES", 30_000)
    check_removed(substrings.remove_repeats(small).collect(), texts)


def test_hot_cells_are_dealt_by_window(spark, small, texts, monkeypatch):
    """A passage in a third of the rows, each copy between words of its own; cells over the bound are dealt by digest."""
    import random

    rng = random.Random(5)
    own = lambda n: " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(n))
    passage = own(45)
    rows = [(i, f"{own(rng.randint(0, 9))} {passage} {own(rng.randint(0, 9))}" if i % 3 == 0 else own(40)) for i in range(300)]
    rows += [(1000 + i, (t + " ") * 2) for i, t in rows[:9]]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    monkeypatch.setattr(substrings, "BATCH_BYTES", 2000)
    for most in (300, 0):
        monkeypatch.setattr(substrings, "HOT_WORDS", most)
        monkeypatch.setattr(substrings, "HOT_WINDOWS", 500)
        check_removed(substrings.remove_repeats(docs).collect(), rows)
    check_removed(substrings.remove_repeats(small).collect(), texts)


def test_rows_without_id_are_told_apart_by_their_texts(spark):
    texts = [f"{k} " + " ".join(f"a{j}" for j in range(30)) + f" z{k}" for k in range(40)]
    docs = spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string").repartition(5)
    got = sorted(r["n_removed"] for r in substrings.remove_repeats(docs).collect())
    assert got == [0] + [30] * 39


def test_repeated_windows_with_equal_hashes(small, texts, monkeypatch):
    """Windows are told apart word by word even where their hashes agree."""
    import numpy as np

    pdf_rows = [(i, 0, t or "") for i, t in texts[:60]]
    import pandas as pd

    packed = substrings._pack(pd.DataFrame(pdf_rows, columns=["key", "tag", "text"]), 20, 1)
    true = substrings._runs_hash
    monkeypatch.setattr(substrings, "_runs_hash", lambda h, n: true(h, n) % np.uint64(7))
    marks = substrings._count_bucket(packed[packed["bucket"].notna()], 20)
    monkeypatch.undo()
    again = substrings._count_bucket(packed[packed["bucket"].notna()], 20)
    order = lambda d: sorted({(k, t, s + j) for k, t, s, n in d.itertuples(index=False) for j in range(n)})
    assert order(marks) == order(again)


def test_repeated_windows_of_odd_rows(spark, odd, empty):
    out = substrings.remove_repeats(odd).collect()
    assert len(out) == len(ROWS)
    want = removed_windows([(2**63 if i is None else i, t) for i, t in dict(ROWS).items()])
    for r in out:
        assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == want[2**63 if r["doc_id"] is None else r["doc_id"]]
    assert substrings.remove_repeats(empty).count() == 0
    cleaned = substrings.clean_documents(odd)
    assert cleaned.columns == odd.columns and cleaned.count() == len(ROWS)
    got = {r["doc_id"]: r["text"] for r in cleaned.collect()}
    assert got[6] == "twentyseven more." and got[5] == NEAR + "."


def test_packing_and_counting_keep_no_object_for_each_string():
    import tracemalloc

    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(5)
    rows = [" ".join(map(str, rng.integers(0, 10**6, 3000))) for _ in range(60)]
    docs, size = pd.DataFrame({"key": range(60), "tag": 0, "text": rows}), sum(map(len, rows))

    def peak(run):
        tracemalloc.start()
        run()
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return most / size

    assert peak(lambda: substrings._pack(docs, 20, 40)) < 6
    packed = substrings._pack(docs, 20, 1)
    assert peak(lambda: substrings._count_bucket(packed, 20)) < 12.2


def test_words_of_a_cell_are_numbered_without_an_object_for_each():
    import tracemalloc

    import numpy as np

    lines = [b"a b a \xc3\xa9 ab", b"b\x00 b", b"\xff a"]
    want = [w for line in lines for w in line.split()]
    got = substrings._numbered(b"\n".join(lines)).tolist()
    assert [(x == y) for x in got for y in got] == [(x == y) for x in want for y in want]
    data = b" ".join(b"%d" % k for k in np.random.default_rng(5).integers(0, 10**6, 200_000))
    tracemalloc.start()
    substrings._numbered(data)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 7 * len(data)  # words as objects, held in a dictionary, took 30
