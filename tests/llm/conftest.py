import os

import pytest

TEXT = "the quick brown fox jumps over the lazy dog and runs far away into the deep dark forest of the northern hills"
LONG = " ".join(f"word{i % 977} other{i % 31}" for i in range(30_000))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, k string, h long, n int, key string, id string, sha string, target string"


def make(spark, rows):
    """Documents (doc_id, text[, lang, source]) with extra columns whose names the operators use inside."""
    full = [(r[0], r[1], (r[2] if len(r) > 2 else "en"), (r[3] if len(r) > 3 else "s1"), 1, "x", "y", 5, 6, "z", "i", "j", "t") for r in rows]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls, empty and very long texts, ties, repeated rows."""
    rows = [(1, TEXT), (2, TEXT.upper()), (2, TEXT.upper()), (3, ""), (4, None), (None, TEXT), (5, LONG, None, None), (6, TEXT + " today", "en", None), (7, " \n ", None, "s2"), (8, "é" * 50, "fr", "s2"), (9, TEXT, None, None)]
    return make(spark, rows).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return make(spark, [(1, "x")]).limit(0)


@pytest.fixture(scope="session")
def larger_sf(sf_dir):
    """Enough rows to fit a classifier or measure recall: sf0.01 beside the tests' own folder where that is smaller."""
    beside = f"{os.path.dirname(sf_dir.rstrip('/'))}/sf0.01"
    return beside if sf_dir.rstrip("/").endswith("sf0.001") and os.path.isdir(beside) else sf_dir
