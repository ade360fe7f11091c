import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    tmp = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", str(tmp / "warehouse"))
        .config("spark.checkpoint.dir", f"file://{tmp}/shared")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 6)
    return v if v is None or isinstance(v, int | str | bool) else str(v)


@pytest.fixture(scope="session")
def same(duck):
    """Holds a DataFrame against SQL: names, and rows in any order."""

    def check(df, sql):
        key = lambda r: tuple((x is None, str(x)) for x in r)
        mine = sorted((tuple(map(_plain, r)) for r in df.select(*[f"`{c}`" for c in sorted(df.columns)]).collect()), key=key)
        got = duck.execute(sql)
        names = [x[0] for x in got.description]
        order = sorted(range(len(names)), key=names.__getitem__)
        theirs = sorted((tuple(_plain(r[i]) for i in order) for r in got.fetchall()), key=key)
        assert sorted(df.columns) == sorted(names)
        assert len(mine) == len(theirs)
        assert mine == theirs
        return mine

    return check
