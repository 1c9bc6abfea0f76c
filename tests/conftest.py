import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from hirelode.launch import local_session
    return local_session(4, "6g")


@pytest.fixture(scope="session")
def tables(spark):
    from hirelode.adapters import Tables
    return Tables(spark, "/root/testdata/sf0.001")
