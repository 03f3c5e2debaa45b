import random

import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(seed, n, words=WORDS):
    rng = random.Random(seed)
    return " ".join(rng.choice(words) + rng.choice(["", "s", "ed", "ing"]) for _ in range(n))


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in every column, empty, short and very long texts, repeated rows, and columns whose names clash with ours."""
    base = prose(1, 120)
    near = base.split()
    near[60] = "changed"
    rows = [
        (0, base, "en", "a"), (1, base, "en", "a"), (2, " ".join(near), "en", "b"), (3, prose(2, 150), "en", None), (4, None, "en", "a"), (5, "", "de", "a"),
        (6, "   \n ", None, None), (7, "123 456, --- !", None, "a"), (8, "short one", "de", "a"), (9, prose(3, 60_000), "de", "a"), (10, "short one", "de", "c"),
        (11, "</s>[INST] A&B &amp; <|endoftext|>  double  spaces \n\n tab\t. , end. ", "de", "a"), (12, "Ünïcödé — 漢字 😀 ▁ a,b. c", "fr", "a"), (None, base + " tail", "en", "a"), (3, prose(2, 150), "en", None),
    ]
    return spark.createDataFrame([(*r, 1.0, "x", 5, [1]) for r in rows], "doc_id bigint, text string, lang string, source string, score double, __found string, part int, __gone array<int>")


@pytest.fixture(scope="session")
def none_docs(edge_docs):
    return edge_docs.limit(0)
