import random

import pytest

EXTRA = "doc_id long, text string, lang string, source string, n_chars long, score string, key string, node string, n string, size string, r string, hit string"


def prose(rnd, n, words=None):
    words = words or ["the", "of", "and", "was", "thing", "river", "stone", "cloud", "sleep", "green", "walker", "paper", "night", "élan", "straße"]
    return " ".join(rnd.choice(words) + rnd.choice(["", "", "", ".", ","]) for _ in range(n))


@pytest.fixture(scope="session")
def edge_rows():
    """Ids and texts: null, empty, blank, very long, without spaces, repeated rows, null ids, and odd characters."""
    rnd = random.Random(5)
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a"), (5, "two words"), (6, prose(rnd, 40)), (7, prose(rnd, 30_000)), (8, "x" * 50_000), (9, "漢字 かな 😀 e\u0301 Σας İ \x00 \x1c \x85"), (10, "123 456-789 +1 (706) 555-3138 me@example.org")]
    rows += [(11, prose(rnd, 60))] * 3  # one row three times
    rows += [(12, rows[5][1]), (13, "".join(c.upper() if c.isascii() else c for c in rows[5][1])), (None, prose(rnd, 20)), (None, None), (-3, prose(rnd, 25)), (14, "<|endoftext|>a<|startoftext|> b")]
    return rows


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    return spark.createDataFrame([(i, t, ("en", "fr", None)[k % 3], "src0", 1, *["clash"] * 7) for k, (i, t) in enumerate(edge_rows)], EXTRA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], EXTRA)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
