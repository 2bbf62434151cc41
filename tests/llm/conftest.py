import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Rows to a documents table; further columns clash with names that operators might use."""

    def make(rows, extra=False):
        df = spark.createDataFrame([(i, t, "en", s, len(t) if t is not None else None) for i, t, s in rows], DOCS)
        if extra:
            from pyspark.sql import functions as F

            for name in ("size", "score", "key", "rep", "sig", "copies", "at", "n", "rank", "cell", "length", "host", "row", "doc", "y", "h", "k", "label", "_c0", "first"):
                df = df.withColumn(name, F.lit(1))
        return df

    return make
