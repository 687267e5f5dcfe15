"""One local session for all tests."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoint"))).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    if not DATA.exists():
        pytest.skip("no test data here")
    return str(DATA)


@pytest.fixture(scope="session")
def same_as_sql(spark, data):
    """Run a query and its SQL twin on the smallest tables and compare rows as multisets."""
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for p in DATA.glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")

    def plain(v):
        if isinstance(v, float):
            return f"{v:.6g}"
        if isinstance(v, list | tuple):
            return "[" + ",".join(map(plain, v)) + "]"
        return v.isoformat() if hasattr(v, "isoformat") else str(v)

    def check(query, sql):
        from collections import Counter

        df = query(spark, data)
        columns = sorted(df.columns)
        ours = Counter(tuple(map(plain, r)) for r in df.select(*columns).collect())
        found = con.execute(sql)
        names = [c[0] for c in found.description]
        assert sorted(names) == columns
        order = sorted(range(len(names)), key=lambda i: names[i])
        theirs = Counter(tuple(plain(r[i]) for i in order) for r in found.fetchall())
        assert ours == theirs, (list((ours - theirs).items())[:3], list((theirs - ours).items())[:3])

    return check
