import string

import pytest

LOW = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
BLANKS = " \t\n\x0b\x0c\r"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = ("score", "kept", "fp", "ids", "row", "hits", "whole", "block", "clean", "n_words", "bin", "spans")


def odd_documents() -> list[tuple]:
    """Nulls in every column, empty and long texts, ties, copies, repeated rows, frequent lines."""
    line = "This line is in many documents."
    long = " ".join(f"Word{i % 977} and so on," for i in range(30_000))
    rows = [
        (1, None, "en", "a", 0),
        (2, "", "en", "a", 0),
        (3, " \t\n \n", None, None, None),
        (None, "A text without an id, of a few words.", "en", "b", 5),
        (4, long, "en", "a", len(long)),
        (5, "one", "en", "b", 3),
        (6, "two words", "en", "b", 9),
        (7, "Mail bob.1@mail.example.com or +1 (459) 555-9246 or 10.0.0.1", "en", "b", 1),
        (7, "Mail bob.1@mail.example.com or +1 (459) 555-9246 or 10.0.0.1", "en", "b", 1),
        (8, "# % " * 100, "en", "c", 400),
        (9, "same same same same " * 40, "en", "c", 800),
        (10, "é Ünï 日本語 🙂 <|endoftext|> it's  spaced\r\n out", "fr", "c", 1),
    ]
    for i in range(20, 34):
        rows.append((i, f"{line}\nA line of its own, number {i}, that nobody else has written down.\n  {line.upper()}\t\n\nend {i}", "en", "a", 9))
    body = " ".join(f"plain{i} text{i * 7 % 31}" for i in range(120))
    rows += [(i, body, "en", "d", len(body)) for i in range(40, 46)]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_documents(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def clashing(odd):
    """The same with columns of names that operators use themselves."""
    from pyspark.sql import functions as F

    return odd.withColumns({c: F.lit("mine") for c in EXTRA})


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def multiset(rows) -> list:
    return sorted(map(repr, rows))
