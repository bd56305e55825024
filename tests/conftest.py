import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]


@pytest.fixture(scope="session")
def spark():
    from compare import session

    spark = session("8")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


@pytest.fixture()
def folder(tmp_path):
    return str(tmp_path)
