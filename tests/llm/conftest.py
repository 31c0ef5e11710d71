import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from conftest_data import COLUMNS, TEXTS, rows_of  # noqa: E402


@pytest.fixture(scope="session")
def messy(spark):
    return spark.createDataFrame(rows_of(TEXTS), COLUMNS).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], COLUMNS)
