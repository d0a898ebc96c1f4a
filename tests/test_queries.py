"""Every registered trajectory query gives the rows of its SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from waymark import queries_files  # noqa: F401
from waymark.operators import partition
from waymark.queries import ORACLES, QUERIES, flagship
from waymark.sources.fixture import gps_points


def plain(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if str(df[c].dtype).startswith("datetime"):
            df[c] = df[c].astype("datetime64[us]").astype(str)
    tidy = lambda x: None if x is None or isinstance(x, float) and math.isnan(x) else x.item() if hasattr(x, "item") else x
    return list(df.columns), sorted(repr(tuple(map(tidy, r))) for r in df.itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    c.execute(f"create view events as select * from '{sf}/events.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    got = QUERIES[name](spark, sf).toPandas()
    assert len(got) and name in ORACLES
    assert plain(got) == plain(con.execute(ORACLES[name]).df())


def test_flagship(spark, sf):
    assert flagship(spark, sf).count() > 0


@pytest.fixture(scope="module")
def border(tmp_path_factory):
    """Trucks of sf0.1 whose mean longitude is on the border of Hilbert cells, in files that Spark reads in another order."""
    d = str(tmp_path_factory.mktemp("border"))
    os.makedirs(f"{d}/events.parquet")
    c = duckdb.connect()
    c.execute("create table t as select *, row_number() over (partition by user_id order by event_id) as n from '/root/testdata/sf0.1/events.parquet' where user_id in (1123, 146)")
    for k, where in enumerate(("n <= 5", "n > 5 and n <= 20", "n > 20")):
        c.execute(f"copy (select * exclude (n) from t where {where} order by event_id) to '{d}/events.parquet/part-{k}.parquet'")
    c.execute(f"set threads = 1; create view events as select * from '{d}/events.parquet/*.parquet'")
    return d, c


@pytest.mark.parametrize("name", ["assign_partitions", "partition_points", "plan_slices", "rebalanced_partitions", "written_partitions"])
def test_border(spark, border, name):
    got = QUERIES[name](spark, border[0]).toPandas()
    assert plain(got) == plain(border[1].execute(ORACLES[name]).df())


def test_written_columns(spark, sf, con):
    """A layout read back has the columns of its SQL in the same order, so that rows compare by position too."""
    assert QUERIES["written_partitions"](spark, sf).columns == [r[0] for r in con.execute(f"describe {ORACLES['written_partitions']}").fetchall()]


def test_keys_do_not_hang_on_dealing(spark, border):
    """Pings in any order give the same keys, also where nothing but positions tells the order."""
    pings = gps_points(spark, border[0])
    dealt = [pings.orderBy(by) for by in ("time", F.desc("time"), "speed", F.xxhash64("time"))]
    keys = [{tuple(r) for r in partition.partition_points(df).select("id", "tier", "partition_id", "hilbert_idx").collect()} for df in dealt]
    alone = {tuple(r) for r in partition.assign_partitions(partition.trip_metadata(dealt[0])).select("id", "tier", "partition_id", "hilbert_idx").collect()}
    assert len(alone) == 2 and all(k == alone for k in keys)
