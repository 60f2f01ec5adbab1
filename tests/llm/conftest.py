import pytest
from pyspark.sql import functions as F

#: Columns whose names operators use themselves.
CLASH = ("row", "node", "score", "kept", "size", "h", "copies", "draw", "of", "record")


@pytest.fixture(scope="session")
def docs(spark):
    """rows of (doc_id, text[, source]) -> a documents table with extra
    columns that clash with the operators' own names."""
    def make(rows, clash=True):
        df = spark.createDataFrame([(r[0], r[1], "en", r[2] if len(r) > 2 else "s", 0) for r in rows],
                                   "doc_id long, text string, lang string, source string, n_chars long")
        return df.select("*", *(F.lit("x").alias(c) for c in CLASH)) if clash else df
    return make


LONG = " ".join(f"w{i % 977}x{i}" for i in range(60_000))      # a very long text
