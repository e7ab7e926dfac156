import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from volpanel.session import local_session

    return local_session("tests", 8, 4)


@pytest.fixture(scope="session")
def con():
    duckdb = pytest.importorskip("duckdb")
    from check_oracle import TABLES

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c
