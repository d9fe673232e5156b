"""The pipeline's stages against plain versions, each on its own input."""

from brute import near_components, removed_windows, words
from test_tokens import check_packed

import corpus_pipeline
from lodestar.llm.common import table

SMALL = "/root/testdata/sf0.001"


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_stages(spark):
    docs = table(spark, SMALL, "documents")
    for (name, stage), number in zip(corpus_pipeline.STAGES, range(5)):
        before = rows_of(docs)
        out = corpus_pipeline.staged(stage(spark, docs, SMALL), name)
        if number < 4:
            assert out.columns == docs.columns
            after = rows_of(out)
            assert {i for i, _ in after} <= {i for i, _ in before}
        if name == "quality_rules":
            texts = dict(before)
            assert all(set(t.split("\n")) <= set(texts[i].split("\n")) for i, t in after)
            assert 0.6 * len(before) < len(after) < len(before)
        elif name == "near_duplicates":
            assert {i for i, _ in after} == {i for i, (_, c) in near_components(before).items() if i == c}
            assert set(after) <= set(before)
        elif name == "repeated_passages":
            removed = removed_windows(before)
            for i, t in after:
                assert len(words(t)) == removed[i][0] - removed[i][1]
            assert all(t == dict(before)[i] for i, t in after if not removed[i][1])
        elif name == "best_fit_packing":
            check_packed(out.collect(), before)
        docs = out


def test_run_and_odd_rows(spark, odd, empty):
    assert corpus_pipeline.run(spark, SMALL).count() > 0
    for docs in (odd, empty):
        for name, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.staged(stage(spark, docs, SMALL), name)
    assert docs.count() == 0
