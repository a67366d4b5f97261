import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.dirname(os.path.abspath(__file__))]

DATA = os.environ.get("TESTDATA", "/root/testdata")


@pytest.fixture(scope="session")
def spark():
    from harborline.session import local_session

    session = local_session(4, shuffle_partitions=4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_small():
    path = f"{DATA}/sf0.001"
    if not os.path.isdir(path):
        pytest.skip("no sample tables")
    return path


@pytest.fixture(scope="session")
def sf_medium():
    path = f"{DATA}/sf0.01"
    if not os.path.isdir(path):
        pytest.skip("no sample tables")
    return path
