import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from quarryline.session import session

    s = session("tests", "local[4]", spark__sql__shuffle__partitions="2", spark__sql__adaptive__enabled="false", spark__sql__codegen__wholeStage="false", spark__driver__memory="4g", spark__ui__showConsoleProgress="false")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def _plain(v):
    if v is None or v != v:
        return ""
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return repr(float(v))
    if isinstance(v, (list, tuple)) or type(v).__name__ == "ndarray":
        return repr([_plain(x) for x in v])
    return str(v)


@pytest.fixture(scope="session")
def against_sql(spark):
    """Compares a query with its SQL over the smallest tables: columns, and rows in any order."""
    import duckdb

    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f if f.is_file() else f / '*.parquet'}'")

    def compare(query, sql):
        df = query(spark, str(DATA))
        rel = con.sql(sql)
        names = sorted(df.columns)
        assert names == sorted(rel.columns)
        ours = sorted(tuple(_plain(r[c]) for c in names) for r in df.collect())
        at = {c: i for i, c in enumerate(rel.columns)}
        theirs = sorted(tuple(_plain(r[at[c]]) for c in names) for r in rel.fetchall())
        assert ours == theirs

    return compare


needs_data = pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
