import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, h string, bucket int, spans string, kind string, label string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns named like the operators' own."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 7)))
    base = " ".join(word() for _ in range(120))
    near = " ".join(["other", *base.split()[1:]])
    texts = [
        (1, base), (2, near), (3, base), (3, base), (4, None), (5, ""), (None, "Password: hunter22 MIT License a@b.org"), (None, None),
        (6, "x" * 40_000), (7, " ".join(word() for _ in range(30_000))), (8, "one two"), (9, "one two"), (10, "😀 漢字   \t\n"),
        (11, "token = " + "0f" * 20 + " call +1 (555) 555-0100 or 10.0.0.1"), (12, near), (12, "same id, another text"),
    ]
    rows = [(i, t, rng.choice(["aa", "bb", None]), None, None, "x", 1, None, "k", None) for i, t in texts]
    return spark.createDataFrame(rows, COLUMNS)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
