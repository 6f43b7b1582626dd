import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from ordermart.session import get_spark

    ckpt = tempfile.mkdtemp(prefix="ordermart-test-ckpt-")
    s = get_spark(
        "local[4]",
        app="ordermart-tests",
        shuffle_partitions=4,
        extra={"spark.checkpoint.dir": ckpt, "spark.driver.memory": "4g"},
    )
    s.sparkContext.setCheckpointDir(ckpt)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def mart(spark):
    from ordermart.plans.mart import Mart

    return Mart(spark, SF_SMALL)
