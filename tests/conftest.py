import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


def core(names) -> list[str]:
    """The queries of the library itself: training-data operators have tests of their own."""
    return sorted(n for n in names if not n.startswith("op") and n != "pipeline")


@pytest.fixture(scope="session")
def spark():
    from runlens.session import get_spark

    s = get_spark("local[4]", shuffle_partitions=8, extra={
        # tests only: a scratch checkpoint folder when the session names none
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="runlens-test-ckpt-"),
        "spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="runlens-test-wh-"),
    })
    yield s
    s.stop()
