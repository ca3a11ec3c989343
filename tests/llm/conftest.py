import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def table(spark):
    """Documents from (doc_id, text) rows, with columns whose names operators use inside."""

    def build(rows, clashes=True):
        df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)
        names = ("id", "row", "size", "prefix", "full", "node", "root", "block", "lines", "score", "key")
        return df.select("*", *(F.lit(k).alias(n) for k, n in enumerate(names))) if clashes else df

    return build
