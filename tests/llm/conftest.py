import random

import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) * (rng.random() < 0.5) for _ in range(n))


#: (doc_id, text, lang, source): copies, near copies, empty, null, short and long texts, repeated rows and null ids.
BASE = prose(1, 120)
ROWS = [
    (0, BASE, "en", "a"),
    (1, BASE, "en", "b"),
    (2, BASE.replace("alpha", "ALPHA,", 1), "en", "a"),
    (3, BASE + " one two three", "de", None),
    (4, "", "en", "a"),
    (5, None, None, "b"),
    (6, "x", "en", "c"),
    (7, prose(2, 3000), "en", "c"),
    (8, "ñandú ça 日本語 🙂 " * 5, "es", "a"),
    (9, prose(3, 60), "en", "a"),
    (9, prose(3, 60), "en", "a"),
    (10, prose(4, 4), "en", ""),
    (11, prose(4, 4), "en", ""),
    (None, prose(5, 50), "en", "a"),
    (12, "\t\n \x0b", "en", "b"),
    *[(20 + i, prose(100 + i, 30 + 7 * i), "en", "abcde"[i % 5]) for i in range(30)],
]


@pytest.fixture(scope="session")
def docs(spark):
    """With columns whose names the operators use themselves."""
    rows = [(*r, len(r[1] or ""), 7, 7, 7, 7, 7) for r in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size int, shard int, slot int, findings int, length int")


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)
