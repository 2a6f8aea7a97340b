import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SMALL = "/root/testdata/sf0.001"
MIDDLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from tidemark.session import local_session

    shown = {"spark.sql.maxMetadataStringLength": "4000", "spark.sql.debug.maxToStringFields": "200"}
    s = local_session(4, **{"spark.driver.memory": "4g"} | shown)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
