import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from itemloom.session import local_session

    session = local_session(8, 4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def one(spark):
    """Evaluate a column over one row."""
    from pyspark.sql import functions as F

    def run(column):
        return spark.range(1).select(column.alias("v")).first()["v"]

    run.F = F
    return run
