import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from llm_cases import ROWS  # noqa: E402

#: Names that operators use inside, as columns of the input.
CLASHES = ["key", "tag", "words", "lines", "kept", "quality", "digest", "sig", "bands", "block", "bucket", "component",
           "node", "u", "v", "score", "rank", "group", "length", "starts", "counts", "marks", "id"]

@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, a repeated row, and extra columns with clashing names."""
    rows = [(i, t, "en", "s", len(t or ""), *["clash"] * len(CLASHES)) for i, t in ROWS]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(
        f"{c} string" for c in CLASHES)
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def small(spark):
    from lodestar.llm.common import table
    from lodestar.session import ship_package

    ship_package(spark)
    return table(spark, "/root/testdata/sf0.001", "documents")


@pytest.fixture(scope="session")
def texts(small):
    return [(r["doc_id"], r["text"]) for r in small.collect()]
