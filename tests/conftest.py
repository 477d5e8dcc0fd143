import os
import sys
from pathlib import Path

import duckdb
import pytest

ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, [os.environ.get("PYTHONPATH")])])
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from orbitquery.session import session

    s = session("local[4]", 4, spark__ui__enabled="false", spark__ui__showConsoleProgress="false", spark__driver__memory="4g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF


@pytest.fixture(scope="session")
def oracle():
    con = duckdb.connect()
    for f in Path(SF).iterdir():
        con.sql(f"CREATE VIEW {f.name.split('.')[0]} AS SELECT * FROM '{f}{'/*.parquet' if f.is_dir() else ''}'")
    return con


def _plain(v):
    return repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v)


@pytest.fixture(scope="session")
def same():
    """Compare a DataFrame with a relation: columns by name, rows in any order."""

    def check(df, relation):
        assert sorted(df.columns) == sorted(relation.columns)
        names = sorted(df.columns)
        mine = sorted(tuple(_plain(r[n]) for n in names) for r in df.collect())
        at = [relation.columns.index(n) for n in names]
        theirs = sorted(tuple(_plain(r[k]) for k in at) for r in relation.fetchall())
        assert mine == theirs

    return check
