from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from echoline.session import local_session

    session = local_session(4, "tests")
    session.conf.set("spark.sql.shuffle.partitions", "3")
    return session


@pytest.fixture
def small_partitions(spark):
    """Thresholds so low that a join of a hot key must be split: no broadcast, no coalescing."""
    adaptive = "spark.sql.adaptive."
    settings = {
        "spark.sql.shuffle.partitions": "12", "spark.sql.autoBroadcastJoinThreshold": "-1", adaptive + "autoBroadcastJoinThreshold": "-1", adaptive + "coalescePartitions.enabled": "false",
        adaptive + "skewJoin.skewedPartitionThresholdInBytes": "16k", adaptive + "skewJoin.skewedPartitionFactor": "1.1", adaptive + "advisoryPartitionSizeInBytes": "16k",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def is_split(df):
    """Whether the executed plan of a collected df has a join with a split partition."""
    return "skew=true" in df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="session")
def data():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    return DATA


@pytest.fixture(scope="session")
def duck(data):
    """Rows of an SQL query over the smallest tables."""
    import glob

    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(value):
    if hasattr(value, "tolist"):
        value = value.tolist()
    if isinstance(value, float):
        return None if value != value else round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(plain(x) for x in value)
    return value


def same_rows(df, con, sql):
    from collections import Counter

    columns = sorted(df.columns)
    left = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    answer = con.execute(sql)
    names = [c[0] for c in answer.description]
    assert sorted(names) == columns
    right = Counter(tuple(plain(row[names.index(c)]) for c in columns) for row in answer.fetchall())
    assert left == right
