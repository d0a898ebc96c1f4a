import pytest


@pytest.fixture(autouse=True, scope="session")
def wide_batches(spark):
    """Models read thousands of documents: batches of a usual size here."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
