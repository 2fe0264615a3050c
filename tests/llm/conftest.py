import pytest


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, node long"


@pytest.fixture
def frame(spark):
    """Rows of ``(doc_id, text)`` as documents, with extra columns of clashing names."""

    def make(rows, parts=3):
        full = [(i, t, None, "s", None, "k", 7) for i, t in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(parts)

    return make
