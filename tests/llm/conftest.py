"""Documents with every awkward case, shared by the operator tests."""

from __future__ import annotations

import pytest

#: The columns of documents, then names that the operators use inside.
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, score double, key string, n int, fp string, p string, row int, "
    "paragraph int, digest string, shard string, size int, task int, base string, extra string, chunk int, node long, first int, root long, n_lines int, held_out string"
)


def frame(spark, rows, schema=SCHEMA):
    """A DataFrame of (doc_id, text, lang); further columns clash with inner names."""
    more = ("s", 1, 0.5, "k", 3, "f", "q", 9, 1, "d", "h", 2, 3, "b", "x", 4, 5, 6, 7, 8, "o")
    return spark.createDataFrame([(i, t, lang, *more) for i, t, lang in rows], schema)


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empties, white space, long texts, ties and repeated rows."""
    long_text = "lorem ipsum dolor sit amet consectetur " * 20_000
    rows = [
        (1, None, "en"),
        (2, "", "de"),
        (3, " \t\r\n\x0b ", None),
        (4, long_text, "en"),
        (5, long_text, "en"),
        (6, "one", "en"),
        (6, "one", "en"),
        (7, "one two", "fr"),
        (None, "a null id with some words in it", "en"),
        (8, "\n\n\n", "en"),
        (9, "x" * 200_000, "en"),
        (10, "naïve café — Größe 中文 \U0001f600 text", "fr"),
        (11, "0" * 50_000 + "@" + "1." * 30_000, None),
    ]
    return frame(spark, rows).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return frame(spark, [])
