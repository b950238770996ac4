import pytest
from pyspark.sql import functions as F

WIDE = "doc_id long, text string, lang string, source string, n_chars long, score double, row long, block string, size long"


@pytest.fixture(scope="session")
def table(spark):
    """Documents from (doc_id, text, source) rows, with extra columns whose names clash with the operators' own."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), 0.5, 7, "b", 3) for r in rows]
        return spark.createDataFrame(full, WIDE).repartition(2)

    return make


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def corpus(documents):
    return {r.doc_id: r.text for r in documents.select("doc_id", F.col("text")).collect()}
