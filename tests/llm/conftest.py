import random

import pytest


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and very long texts, repeated rows, shared ids and clashing column names."""
    long = " ".join(f"word{i % 977}" for i in range(30_000))
    rows = [(1, "", "en"), (2, None, None), (3, "one", "en"), (3, "one", "en"), (4, long, "de"), (5, "x" * 20_000, ""), (6, " \t\n ", "en"), (7, "Ünïcödé  日本語 😀 ▁ <|endoftext|> it's", "en"), (8, "one", "fr"), (None, "no id here", "en")]
    return spark.createDataFrame([(a, b, c, "k", "v", 0, 1) for a, b, c in rows], "doc_id long, text string, lang string, key string, base string, n long, _tie int").repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


@pytest.fixture()
def rng():
    return random.Random(7)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r.doc_id: r.text or "" for r in documents.select("doc_id", "text").collect()}
