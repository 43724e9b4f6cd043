import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
os.environ["PYTHONPATH"] = os.pathsep.join([sys.path[0], os.environ.get("PYTHONPATH", "")])

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def make(spark, texts, lang="en", source="src0", ids=None):
    rows = [(ids[i] if ids else i, t, lang, source, None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and blank texts, equal rows, a very long text, odd characters, and a further column with a clashing name."""
    import random

    rng = random.Random(3)
    vocabulary = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(300)]
    long = " ".join(rng.choices(vocabulary, k=30_000))
    texts = [None, "", "   \n\t ", "one", "Same text here. It is said twice.\nReally twice!", "Same text here. It is said twice.\nReally twice!", long, "é́ 日本\x85 <|endoftext|> don't I'LL 12", "a.b.c...\n\n!!"]
    rows = [(None if i == 3 else i, t, None if i % 4 == 1 else "en", None if i % 5 == 2 else f"src{i % 3}", 1, "x") for i, t in enumerate(texts)]
    rows += [rows[4], rows[6][:1] + ("another text of the same id",) + rows[6][2:]]
    return spark.createDataFrame(rows, DOCS + ", n_tokens string")


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
