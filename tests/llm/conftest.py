import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """Documents from ``(doc_id, text[, lang, source])``, with columns of clashing names."""
    from pyspark.sql import functions as F

    def make(rows):
        full = [(*r, *(None,) * (4 - len(r)), None) for r in rows]
        frame = spark.createDataFrame(full, SCHEMA)
        for name in ("size", "n", "c1", "spans", "items", "score", "label", "pos", "line", "block"):
            frame = frame.withColumn(name, F.lit("clash"))
        return frame

    return make


@pytest.fixture(scope="session")
def sample():
    """``(doc_id, text, lang, source)`` of the smallest tables."""
    import duckdb

    return duckdb.sql(
        "SELECT doc_id, text, lang, source FROM '/root/testdata/sf0.001/documents.parquet' ORDER BY doc_id"
    ).fetchall()
