import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def long_text(n=6000, seed=1):
    import random

    rng = random.Random(seed)
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "epsilon", "zeta"]) + str(rng.randrange(50)) for _ in range(n))


def odd_rows():
    """Nulls, blanks, a very long text, ties and rows that repeat."""
    rows = [
        (1, "The cat sat on the mat and the dog sat on the log.", "en", "a", 10),
        (2, "The cat sat  on\tthe mat and the dog sat on the log.", "en", "a", 10),
        (2, "The cat sat  on\tthe mat and the dog sat on the log.", "en", "a", 10),
        (3, None, None, None, None),
        (4, "", "en", "a", 0),
        (5, " \n\t ", None, "b", 3),
        (None, "no id here at all", "en", None, 1),
        (None, "no id here at all", "en", None, 1),
        (7, long_text(), "en", "a", 1),
        (8, "12 34 !!", "de", "a", 1),
        (9, "The cat sat on the mat and the dog sat on the log.", "en", "a", 10),
    ]
    return rows


@pytest.fixture
def odd_docs(spark):
    return spark.createDataFrame(odd_rows(), DOCS).repartition(3)


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture
def clashing(odd_docs):
    """Extra columns named like the operators' own."""
    from pyspark.sql import functions as F

    extra = ["sha", "row", "maybe", "k1", "k2", "fp", "node", "key", "ids", "decoded", "leaks", "marks", "base", "spans", "pos", "c", "n", "keep_id", "component_id", "value"]
    return odd_docs.select("*", *[F.lit(f"x{i}").alias(n) for i, n in enumerate(extra)])
