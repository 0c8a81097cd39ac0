"""The recordings' queries against their DuckDB statements on the smallest tables, and the functions without a statement."""

from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from isochron import file_queries, recording_queries
from isochron.operators import signal
from isochron.sources import readers

SF = Path("/root/testdata/sf0.001")
NAMES = [n for n, f in __spark_entry__.queries().items() if f.__module__ in (recording_queries.__name__, file_queries.__name__)]


@pytest.fixture(scope="module")
def tables():
    connection = duckdb.connect()
    for path in SF.glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, tables, name):
    got = __spark_entry__.queries()[name](spark, str(SF))
    columns = sorted(got.columns)
    found = tables.execute(__spark_entry__.oracle_sql()[name])
    places = [[d[0] for d in found.description].index(c) for c in columns]
    rounded = lambda row: tuple(f"{x:.9g}" if isinstance(x, float) else str(x) for x in row)
    assert sorted(rounded(r[c] for c in columns) for r in got.collect()) == sorted(rounded(r[k] for k in places) for r in found.fetchall())


def test_short_trajectories_end_with_an_error(spark):
    lines = spark.createDataFrame([("a", f"{k} 0 0 0 0 0 0 1") for k in range(10)] + [("b", "1 0 0 0 0 0 0 1")], "recording_id string, value string")
    poses = readers.poses_of(lines)
    assert readers.long_enough(poses.filter("recording_id = 'a'")).count() == 10
    with pytest.raises(Exception, match="too few poses in b"):
        readers.long_enough(poses).collect()


def test_sample_is_the_same_for_a_seed(spark):
    rows = spark.range(1000)
    first, again, other = (sorted(r["id"] for r in signal.sampled(rows, ["id"], 50, seed).collect()) for seed in (1, 1, 2))
    assert len(set(first)) == 50 and first == again != other and len(signal.sampled(rows, ["id"], 5000).collect()) == 1000


def test_average_adds_the_decimal_share(spark):
    """0.9 and 0.1 as written: with 1 - 0.9 in binary this average falls on the other side of a half millionth."""
    x = [56.39, 381.72, 179.4, 416.95, 213.06, 312.16, 473.11]
    rows = spark.createDataFrame([(x,), ([1.0, None, *x],)], "x array<double>")
    want = x[0]
    for v in x[1:]:
        want = 0.9 * want + 0.1 * v
    assert [r[0] for r in rows.select(signal.smoothed(F.col("x"), 0.9)).collect()] == [want, want]
