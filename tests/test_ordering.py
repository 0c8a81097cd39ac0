"""Exact order statistics and the scan of turn rates against NumPy and the sequential loop."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from isochron.operators import fusion, ordering, signal


def test_statistics_equal_numpy(spark):
    """One key with most rows, ties, one value, nulls only, a null key."""
    r = np.random.default_rng(4)
    keys = {"most": r.integers(0, 50, 5000) / 4, "few": r.standard_normal(7), "one": np.array([3.5]), None: r.standard_normal(20)}
    rows = [(k, float(v)) for k, x in keys.items() for v in x] + [("none", None), ("most", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(6)
    wanted = {"low": 0.02, "half": 0.5, "high": 0.98, "top": 1.0, "upper": "upper"}
    found = {x["k"]: x for x in ordering.statistics(df, ["k"], "v", wanted).collect()}
    assert set(found) == set(keys)
    for k, x in keys.items():
        assert found[k]["n"] == len(x) and found[k]["upper"] == sorted(x)[len(x) // 2]
        for name in ("low", "half", "high", "top"):
            assert found[k][name] == pytest.approx(np.quantile(x, wanted[name]), abs=1e-12)
    assert ordering.statistics(df.filter("v > 100"), ["k"], "v", wanted).collect() == []
    whole = ordering.statistics(df, [], "v", {"half": 0.5}).first()
    assert whole["half"] == pytest.approx(np.quantile(np.concatenate(list(keys.values())), 0.5), abs=1e-12)


def test_ranks_are_places(spark):
    df = spark.range(1000).selectExpr("id % 3 k", "id % 7 v", "id").repartition(5)
    found = ordering.ranked(df, ["k"], ["v", "id"]).collect()
    for k in range(3):
        own = sorted((r["rank"], r["v"], r["id"]) for r in found if r["k"] == k)
        assert [x[0] for x in own] == list(range(len(own))) and [x[1:] for x in own] == sorted(x[1:] for x in own)


def test_rate_and_clip(spark):
    df = spark.createDataFrame([("a", 10 * k) for k in range(12)] + [("b", k) for k in range(5)], "k string, t long")
    assert {r["k"]: r["rate_hz"] for r in signal.sample_rate(df, ["k"], "t").collect()} == {"a": 100_000_000, "b": None}
    values = spark.range(101).selectExpr("double(id) v")
    assert signal.percentile_clip(values, ["v"]).agg(F.min("v"), F.max("v")).first()[:] == (2.0, 98.0)


@pytest.mark.parametrize("block", [1, 7_000_000, 50_000_000_000])
def test_scan_equals_the_loop(spark, block):
    """Recordings of one sample, with pauses, repeated times, no numbers, and a null name: to 1e-9 as one after the other."""
    r = np.random.default_rng(6)
    rows, want = [], {}
    for name, n in (("long", 700), ("one", 1), (None, 40)):
        t = np.cumsum(r.choice([0, 2_500_000, 2_500_000, 600_000_000], n, p=[0.02, 0.5, 0.47, 0.01])) - 1_000_000
        t = np.unique(t)
        g = r.standard_normal((len(t), 3)) * 3
        g[r.random(len(t)) < 0.05] = 0
        rows += [(name, int(a), tuple(map(float, b))) for a, b in zip(t, g, strict=True)]
        want[name] = fusion.gyro_only(t, g)
    df = spark.createDataFrame(rows, "recording_id string, ts_ns long, gyro struct<x:double,y:double,z:double>").repartition(5)
    found = fusion.gyro_scan(df, ["recording_id"], block).collect()
    for name, q in want.items():
        own = np.array([[x[c] for c in fusion.TURN] for x in sorted((x for x in found if x["recording_id"] == name), key=lambda x: x["ts_ns"])])
        assert own.shape == q.shape and np.abs(own - q).max() < 1e-9
