import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SMOKE = "/root/testdata/sf0.001"
CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from tripstar.session import get_session

    # Tests own no cluster folder: the checkpoint setting gets a fresh local one.
    s = get_session("tripstar-tests", master="local[*]", shuffle_partitions=8,
                    extra={"spark.driver.memory": "6g",
                           "spark.checkpoint.dir": tempfile.mkdtemp(prefix="tripstar-test-ckpt-")})
    yield s
    s.stop()


def pytest_configure(config):
    config.addinivalue_line("markers", "slow: trains 100-tree models; run with TRIPSTAR_SLOW=1")


def pytest_collection_modifyitems(config, items):
    if os.environ.get("TRIPSTAR_SLOW"):
        return
    skip = pytest.mark.skip(reason="slow; set TRIPSTAR_SLOW=1")
    for item in items:
        if "slow" in item.keywords:
            item.add_marker(skip)
