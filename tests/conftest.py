import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from talkloom.session import local_session

    return local_session(8, 8, "tests")


@pytest.fixture(autouse=True)
def short_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "4")
