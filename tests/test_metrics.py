"""BLEU / ROUGE hand-computed cases and a pure-Python form of the formulas."""

import math
from collections import Counter

import pytest

from lodestar.operators import evaluation as EV
from lodestar.operators import retrieval as RT


def py_bleu(ref, gen):
    r, g = ref.split(), gen.split()
    nums, dens = [], []
    for n in range(1, 5):
        cg = Counter(tuple(g[i:i + n]) for i in range(len(g) - n + 1))
        cr = Counter(tuple(r[i:i + n]) for i in range(len(r) - n + 1))
        nums.append(sum(min(c, cr[k]) for k, c in cg.items()))
        dens.append(max(1, len(g) - n + 1))
    if nums[0] == 0:
        return 0.0
    ps = [(0.1 if m == 0 else m) / d for m, d in zip(nums, dens)]
    bp = 1.0 if len(g) > len(r) else math.exp(1 - len(r) / len(g))
    return bp * math.exp(sum(math.log(p) for p in ps) / 4)


def run_bleu(spark, pairs):
    df = spark.createDataFrame([(i, r, g) for i, (r, g) in enumerate(pairs)], "id int, reference string, generated string")
    return {r["id"]: r["bleu"] for r in EV.bleu4(df, ["id"]).collect()}


def test_bleu_cases(spark):
    pairs = [("a b c d", ""), ("a b c d", "x y z"), ("a b c d", "a b c d"), ("the cat sat on the mat", "the cat"),
             ("the cat sat on the mat", "the the the"), ("a b", "a b c d e f"), ("a", "a")]
    got = run_bleu(spark, pairs)
    assert got[0] == 0.0 and got[1] == 0.0 and got[2] == pytest.approx(1.0)
    for i, (r, g) in enumerate(pairs):
        assert got[i] == pytest.approx(py_bleu(r, g), abs=1e-12)


def test_rouge_cases(spark):
    pairs = [("The cat, sat!", "the CAT"), ("abc", ""), ("", ""), ("x y", "y x y")]
    df = spark.createDataFrame([(i, r, g) for i, (r, g) in enumerate(pairs)], "id int, reference string, generated string")
    got = {r["id"]: r["rouge1"] for r in EV.rouge1_f(df, ["id"]).collect()}
    assert got[0] == pytest.approx(2 * 1.0 * (2 / 3) / (1 + 2 / 3))
    assert got[1] == 0.0 and got[2] == 0.0
    assert got[3] == pytest.approx(2 * (2 / 3) * 1.0 / (2 / 3 + 1.0))


def py_ratio(a, b):
    if not a and not b:
        return 1.0
    m = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            m[i + 1][j + 1] = m[i][j] + 1 if a[i] == b[j] else max(m[i][j + 1], m[i + 1][j])
    return 1 - (len(a) + len(b) - 2 * m[-1][-1]) / (len(a) + len(b))


def test_indel_ratio(spark):
    from pyspark.sql import functions as F
    pairs = [("kitten", "sitting"), ("abc", "abc"), ("ab", "xy"), ("a-set.wg1", "a-set.wg2"), ("", ""),
             ("a" * 70 + "b", "a" * 69 + "bb"), ("x" * 64, "y" + "x" * 63)]
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", RT.indel_ratio(F.col("a"), F.col("b")).alias("r"))
    for row in df.collect():
        assert row["r"] == pytest.approx(py_ratio(row["a"], row["b"]), abs=1e-12)
    assert round(py_ratio("kitten", "sitting"), 6) == 0.615385


def test_porter_published_examples():
    from lodestar.operators.stemming import porter_stem
    cases = {"caresses": "caress", "ponies": "poni", "ties": "ti", "caress": "caress", "cats": "cat",
             "feed": "feed", "agreed": "agre", "plastered": "plaster", "bled": "bled", "motoring": "motor",
             "sing": "sing", "conflated": "conflat", "troubled": "troubl", "sized": "size", "hopping": "hop",
             "tanned": "tan", "falling": "fall", "hissing": "hiss", "fizzed": "fizz", "failing": "fail",
             "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "conditional": "condit",
             "rational": "ration", "valenci": "valenc", "hesitanci": "hesit", "digitizer": "digit",
             "conformabli": "conform", "radicalli": "radic", "differentli": "differ", "vileli": "vile",
             "analogousli": "analog", "vietnamization": "vietnam", "predication": "predic", "operator": "oper",
             "feudalism": "feudal", "decisiveness": "decis", "hopefulness": "hope", "callousness": "callous",
             "formaliti": "formal", "sensitiviti": "sensit", "sensibiliti": "sensibl", "triplicate": "triplic",
             "formative": "form", "formalize": "formal", "electriciti": "electr", "electrical": "electr",
             "hopeful": "hope", "goodness": "good", "revival": "reviv", "allowance": "allow",
             "inference": "infer", "airliner": "airlin", "gyroscopic": "gyroscop", "adjustable": "adjust",
             "defensible": "defens", "irritant": "irrit", "replacement": "replac", "adjustment": "adjust",
             "dependent": "depend", "adoption": "adopt", "homologou": "homolog", "communism": "commun",
             "activate": "activ", "angulariti": "angular", "homologous": "homolog", "effective": "effect",
             "bowdlerize": "bowdler", "probate": "probat", "rate": "rate", "cease": "ceas",
             "controll": "control", "roll": "roll"}
    bad = {w: (porter_stem(w), s) for w, s in cases.items() if porter_stem(w) != s}
    assert not bad, bad


def test_rouge_stemmed(spark):
    df = spark.createDataFrame([(1, "the cats were running", "a cat runs")], "id int, reference string, generated string")
    plain = EV.rouge1_f(df, ["id"]).collect()[0]["rouge1"]
    stemmed = EV.rouge1_f(df, ["id"], stem=True).collect()[0]["rouge1"]
    # stems: reference [the, cat, were, run], answer [a, cat, run] -> P = 2/3, R = 2/4
    assert plain == 0.0 and stemmed == pytest.approx(4 / 7)


def test_evaluate_stems_by_default_and_rows_have_four_decimals(spark):
    from lodestar.operators import evaluation as EV
    pairs = spark.createDataFrame([("q1", "the cats were running", "the cat was running", "b")],
                                  "query_id string, reference string, generated string, category string")
    hits = spark.createDataFrame([("q1", 1, "c1", "cats run")], "query_id string, rank int, chunk_id string, content string")
    on = EV.evaluate(pairs, hits, ["query_id"]).first()
    off = EV.evaluate(pairs, hits, ["query_id"], stem=False).first()
    assert on["rouge1"] > off["rouge1"]
    row = EV.summary_rows(EV.evaluate(pairs, hits, ["query_id"]), ["query_id"], categories=["a", "b"]).first()
    assert row["category_order"] == 2 and row["rouge1"] == round(on["rouge1"], 4)


def test_grounding_takes_texts_from_a_table(spark):
    from lodestar.operators import evaluation as EV
    hits = spark.createDataFrame([(1, "a", 1, "the cat"), (1, "b", 2, "sat the"), (1, "a", 3, "the cat"), (2, "b", 1, "sat the"),
                                  (3, "n", 1, None)], "query_id long, chunk_id string, rank int, content string")
    answers = spark.createDataFrame([(1, "the cat sat"), (2, "a dog"), (3, "x"), (4, "y")], "query_id long, generated string")
    texts = hits.select("chunk_id", "content").dropDuplicates()
    rows = lambda df: sorted((r["query_id"], r["kg_score"]) for r in df.collect())
    want = rows(EV.grounding_score(hits, answers))
    assert rows(EV.grounding_score(hits.drop("content"), answers, contents=texts)) == want
    # joined: "the cat sat the the cat", the x 3, cat x 2, sat x 1
    assert abs(want[0][1] - 6 / (14 ** 0.5 * 3 ** 0.5)) < 1e-6 and want[2][1] is None and want[3][1] is None


def test_bleu_tasks_are_bounded_by_words(spark, monkeypatch):
    from lodestar.operators import evaluation as EV
    pairs = spark.createDataFrame([(k, "a b c d e f " * 5, "a b c d e x " * 5) for k in range(40)], "id int, reference string, generated string")
    want = sorted(tuple(r) for r in EV.bleu4(pairs, ["id"]).collect())
    monkeypatch.setattr(EV, "WORDS_PER_TASK", 300)
    got = EV.bleu4(pairs, ["id"])
    assert "REPARTITION_BY_NUM" in got._jdf.queryExecution().toString() and sorted(tuple(r) for r in got.collect()) == want
    assert EV.bleu4(pairs.limit(0), ["id"]).collect() == []


def test_grounding_shuffles_packed_counts_and_no_text(spark):
    from pyspark.sql import functions as F
    from lodestar.operators import embedding as EM
    from lodestar.operators import evaluation as EV
    texts = spark.createDataFrame([("a", "the cat " * 300), ("b", "sat the"), ("c", "the " * 70_000), ("n", None), ("b", "sat the")],
                                  "chunk_id string, content string")
    hits = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "b", 1), (2, "c", 2), (3, "n", 1), (4, "a", 1)],
                                 "query_id long, chunk_id string, rank int")
    answers = spark.createDataFrame([(1, "the cat sat"), (2, "the dog sat"), (3, "x"), (4, "cat"), (5, "y")], "query_id long, generated string")
    rows = lambda df: sorted((r["query_id"], r["kg_score"]) for r in df.collect())
    embed = lambda d, c, o: EM.embed_hashed(d, c, o, model_col=None)
    want = rows(EV.grounding_score(hits, answers, embed=embed, contents=texts))  # the joined text is embedded
    for most in (False, True):
        assert rows(EV.grounding_score(hits, answers, contents=texts, most_retrieved=most)) == want
    sizes = [r[0] for r in texts.select(F.length(EM.packed_counts("content"))).orderBy("chunk_id", "content").collect()]
    assert sizes == [2 * EM.HASH_DIM, EM.HASH_DIM, EM.HASH_DIM, 4 * EM.HASH_DIM, EM.HASH_DIM]
