import os
import sys

import pytest

from datasets import SF_SMALL

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

os.environ.setdefault("ORACLE_TYPES", "1")  # schema types must match too


@pytest.fixture(scope="session")
def spark():
    from vistaspark.session import build_session

    s = build_session("local[4]", 8, "vistaspark-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def tables(spark):
    from vistaspark.plans.bind import Tables

    return Tables(spark, SF_SMALL)
