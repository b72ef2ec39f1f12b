import os

import pytest

from featherloom.session import get_session

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = get_session(8)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return DATA


@pytest.fixture(scope="session")
def same_as_sql(spark, sf_dir):
    """Runs a query and its SQL and compares the rows."""
    import math

    import duckdb

    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{name}'")

    def plain(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else round(v, 5) + 0.0
        return v

    def run(query, sql):
        df = query(spark, sf_dir)
        columns = sorted(df.columns)
        got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
        listed = ", ".join(f'"{c}"' for c in columns)
        want = sorted((tuple(map(plain, r)) for r in con.sql(f"SELECT {listed} FROM ({sql})").fetchall()), key=repr)
        assert got == want

    return run
