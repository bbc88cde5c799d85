import pytest


@pytest.fixture
def frame(spark):
    """Documents with the awkward cases: null ids and texts, empty and blank texts, repeated rows, a clashing column."""
    def make(rows, schema="doc_id long, text string"):
        df = spark.createDataFrame(rows, schema)
        return df.selectExpr("*", "'x' as id", "1 as doc", "2 as term", "3 as _n", "4 as row")
    return make
