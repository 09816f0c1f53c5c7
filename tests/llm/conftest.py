import pytest


@pytest.fixture
def docs(spark):
    """Documents from {doc_id: text}; a clashing extra column comes along."""

    def build(rows, extra="kept"):
        return spark.createDataFrame([(k, t, "x") for k, t in rows], f"doc_id long, text string, {extra} string")

    return build
