import pytest


@pytest.fixture
def docs(spark):
    """Documents with clashing extra columns from (id, text) rows."""

    def make(rows, **more):
        return spark.createDataFrame([(i, t, 1, "x", "y") for i, t in rows], "doc_id long, text string, start int, sequence_id string, node string")

    return make
