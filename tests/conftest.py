import pathlib
import sys

import pytest

ROOT = pathlib.Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tools")]

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from visitmill.session import local_session

    session = local_session(cpus="8", memory="8g", shuffle="4")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def log(spark):
    from visitmill.plans.fixture import access_log

    return access_log(spark, SF).drop("event_time").cache()
