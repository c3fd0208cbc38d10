import os

import pytest

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def data():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    return DATA


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null ids and texts, repeated rows, empty and long texts, special strings, and columns named like results."""
    long = " ".join(f"word{i % 977} it's {i}" for i in range(6000))
    rows = [
        (1, "Hello, world! It's 2024.\n\n  Tabs\tand　spaces"), (2, None), (3, ""), (4, "   \n\t"), (5, "a<|endoftext|>b <|endoftext|>"), (5, "a<|endoftext|>b <|endoftext|>"), (5, "another text with the same id"), (None, "no id"), (None, None),
        (7, long), (8, "你好，世界 🙂‍ قلم ɏɐ նոր \U0001e6c3"), (9, long), (10, "x" * 5000), (11, "the same words here " * 30), (-3, "Été à Noël, ça va? " * 12), (12, "Hello, world! It's 2024.\n\n  Tabs\tand　spaces"),
    ]
    extra = [(i, t, "en" if k % 2 else None, f"s{k % 3}" if k % 4 else None, k, k, f"{k}") for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(extra, "doc_id long, text string, lang string, source string, n_words int, N_Removed int, copy string").repartition(3)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
