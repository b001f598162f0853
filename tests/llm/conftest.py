"""Documents with every awkward case, and the small tables."""

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, extra string, line string, size long, fp long"


def docs_frame(spark, rows):
    """rows of (doc_id, text) or (doc_id, text, source); with extra columns whose names operators use themselves."""
    return spark.createDataFrame([(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), "x", "y", 7, 9) for r in rows], DOCS)


@pytest.fixture(scope="session")
def make_docs(spark):
    return lambda rows: docs_frame(spark, rows)


@pytest.fixture(scope="session")
def small_docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet").cache()


#: Texts that are null, empty, blank, very long, oddly spaced or oddly lettered.
AWKWARD = [
    None,
    "",
    " ",
    "\n\n",
    "a",
    "one two",
    "One  TWO\tthree\r\nfour",
    "É è ß İ ı ﬁ     x\x1cy\x85z",
    "I'll we've they're don't 'S 12345 ½ ² ٣ 漢字 😀😀 é",
    "a b c " * 20_000,
    "x" * 50_000,
    "same line here\n" * 300,
    "the quick brown fox jumps over the lazy dog " * 3,
]


@pytest.fixture(scope="session")
def awkward():
    return [(i, t) for i, t in enumerate(AWKWARD)]
