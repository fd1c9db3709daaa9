import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def words():
    rng = random.Random(5)
    return ["".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(2, 9))) for _ in range(400)]


@pytest.fixture(scope="session")
def prose(words):
    """A text of ``n`` words in sentences and lines, the same for the same seed."""

    def make(seed, n):
        rng = random.Random(seed)
        out = []
        for k in range(n):
            out.append(rng.choice(words) + ("." if rng.random() < 0.1 else ""))
            out.append("\n" if rng.random() < 0.02 and k < n - 1 else " ")
        return "".join(out[:-1])

    return make


@pytest.fixture(scope="session")
def odd_rows(prose):
    """Nulls in every column, empty and white texts, a very long one, ties, repeated rows."""
    base = prose(1, 120)
    near = " ".join(base.split(" ")[:-3] + ["other", "last", "words"])
    return [
        (1, base, "en", "a", 1),
        (2, near, "en", "a", 1),
        (3, base, "en", "b", None),
        (3, base, "en", "b", None),
        (3, prose(2, 50), None, None, 3),
        (4, None, "fr", "a", 4),
        (5, "", None, "a", 0),
        (6, " \n\t ", "fr", None, 3),
        (None, base, "en", "a", 7),
        (None, prose(3, 30), None, None, None),
        (None, None, None, None, None),
        (7, "one two", "fr", "c", 7),
        (8, "One  two", "fr", "c", 8),
        (9, prose(4, 60_000), "en", "a", 9),
        (10, "x" * 100_000, "en", "a", 10),
        (11, "12 34 .. !!", None, "a", 11),
        (12, "É à la “Straße”\r\n日本語　x y <|endoftext|> z", "fr", "c", 12),
        (13, prose(5, 40) + "\n\n" + prose(6, 40) + "  end ", "en", "c", 13),
    ]


@pytest.fixture
def odd(spark, odd_rows):
    """The odd rows with further columns named like ones that operators make."""
    from pyspark.sql import functions as F

    names = ["h", "n", "copy", "kept", "digest", "node", "row", "block", "tokens", "_row", "_id", "of", "url2"]
    df = spark.createDataFrame(odd_rows, SCHEMA).repartition(3)
    return df.withColumns({c: F.lit(f"extra {c}") for c in names})


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], SCHEMA)
