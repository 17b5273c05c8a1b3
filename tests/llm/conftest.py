import random

import pytest

SYLLABLES = "ka lo mi ren tu sol ver ana dor el fin gu hal ist jo".split()


def sentence(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choices(SYLLABLES, k=rng.randint(1, 3))) for _ in range(n))


def edited(rng: random.Random, text: str, share: float) -> str:
    return " ".join(sentence(rng, 1) if rng.random() < share else w for w in text.split(" "))


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls in every column, empty and long texts, ties, repeats and columns whose names operators use inside."""
    rng = random.Random(3)
    long = sentence(rng, 30_000)
    same = sentence(rng, 120)
    rows = [
        (1, same, "en", 5), (2, same, None, 5), (2, same, None, 5), (3, "", "en", 0), (4, None, "fr", None), (None, same, "fr", 1), (None, None, None, None),
        (5, long, "en", 1), (6, long + " tail", None, 1), (7, "!!! ???", "en", 2), (8, "é", "fr", 1), (9, "a " * 5000, "en", 1), (10, "\n\n\t  　", "en", 1), (11, "word", "en", 4),
    ]
    clash = [(*r, "x", 1, 2, b"3", 4.0, "k", 7) for r in rows]
    schema = "doc_id bigint, text string, lang string, n_chars bigint, key string, a int, b int, digest binary, similarity double, anchor string, `__drop_id` int"
    return spark.createDataFrame(clash, schema)


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")
