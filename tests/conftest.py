import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from provlake.session import build_session

    s = build_session("tests", "local[8]", {"spark.ui.enabled": "false",
                                            "spark.checkpoint.dir": str(
                                                tmp_path_factory.mktemp("shared")),
                                            "spark.sql.warehouse.dir": str(
                                                tmp_path_factory.mktemp("warehouse")),
                                            "spark.sql.shuffle.partitions": "8"})
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()
