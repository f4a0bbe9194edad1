import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from caliper.session import get_spark
    s = get_spark("local[4]", app="caliper-tests", shuffle_partitions=4,
                  extra={"spark.sql.autoBroadcastJoinThreshold": str(10 * 1024 * 1024)})
    s.sparkContext.setLogLevel("ERROR")
    if not s.sparkContext.getCheckpointDir():
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="caliper-test-ckpt-"))
    yield s


@pytest.fixture()
def tmp_dir():
    return tempfile.mkdtemp(prefix="caliper-test-")
