import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

#: Columns that operators use inside; tables may have their own of these names.
CLASH = "key norm sha fp part slot row kind start end th mark same seed x label score tree node rank value".split()


@pytest.fixture(scope="session")
def make(spark):
    """A table from rows, with columns whose names clash with the operators' own."""
    from pyspark.sql import functions as F

    def table(rows, schema):
        frame = spark.createDataFrame(rows, schema)
        return frame.withColumns({c: F.lit("own") for c in CLASH if c not in frame.columns})

    return table


@pytest.fixture(scope="session")
def long_text():
    return " ".join(f"w{i % 977}x{i}" for i in range(250_000))  # about 3 MB


@pytest.fixture(scope="session")
def odd_docs(long_text):
    """Nulls, empty and long texts, ties, repeats: (doc_id, text)."""
    passage = " ".join(f"passage{i * i}" for i in range(120))
    return [
        (1, None),
        (2, ""),
        (3, "Same Text"),
        (4, "same text"),
        (5, "SAME TEXT"),
        (6, "ÄÖ same"),
        (7, "äö same"),
        (8, " \n\t "),
        (9, long_text),
        (10, long_text.upper()),
        (11, "before " + passage + " after it"),
        (12, "other words " + passage + " and then more"),
        (13, "x" * 5000),
        (14, "one two three"),
        (15, "mail a@b.co, +1 (555) 123-4567 at 10.0.0.1 card 4111 1111 1111 1111"),
        (15, "mail a@b.co, +1 (555) 123-4567 at 10.0.0.1 card 4111 1111 1111 1111"),
    ]
