import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, n: int) -> str:
    import random

    draw = random.Random(seed)
    words = [f"{a}{b}" for a in ("the", "of", "and", "to", "ka", "mo", "ri", "su") for b in ("", "n", "lo", "ter", "ba")]
    return " ".join(draw.choice(words) for _ in range(n))


@pytest.fixture(scope="session")
def messy_rows():
    """Nulls in every column, empty and long texts, ties, repeated rows, odd blanks and bytes."""
    long = "\n".join(prose(s, 40) for s in range(400))
    a, b = prose(1, 120), prose(2, 90)
    return [
        (1, a, "en", "s1", len(a)), (1, a, "en", "s1", len(a)), (2, a, "en", "s2", None), (3, a + " tail", None, "s3", 1), (4, None, "en", None, None),
        (5, "", "en", "s1", 0), (6, "", None, "s2", 0), (None, b, "en", "s1", 3), (7, b, "fr", None, 3), (8, long, "en", "s4", 5), (9, "one two", "en", "s1", 7),
        (10, "one  two", "en", "s2", 8), (11, " \t\n\x0b\x0c\r ", "en", "s1", 7), (12, "café 中文 \U0001f600 it's", "en", "s1", 9), (13, "x\x00y \x1c\x85 z w", "en", "s1", 9),
    ]


@pytest.fixture(scope="session")
def messy(spark, messy_rows):
    """The rows, with columns whose names operators might use themselves."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(messy_rows, DOC)
    names = ("k1", "k2", "key", "row", "gone", "mix", "epoch", "block", "part", "id", "quality_figures", "kept", "score", "component", "h1", "line_figures", "_spot", "tokens")
    return df.select("*", *[F.lit(f"own {n}").alias(n) for n in names])


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOC)


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
