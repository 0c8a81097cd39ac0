"""Streams whose rows come in any order, against the batch operators on the same rows, and the end of their state."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from isochron.operators import asof, fusion, signal
from isochron.streaming import ordered, stream

MS = 1_000_000
END = 10**14  # a row far behind, which moves the watermark past all others


def fed(spark, path, rows, ddl, files=4, late="2 seconds"):
    """A stream of the rows, shuffled within half the watermark's delay, in a few files; then the row that ends it."""
    for k, part in enumerate(np.array_split(np.arange(len(rows)), files)):
        spark.createDataFrame([rows[i] for i in part], ddl).coalesce(1).write.parquet(f"{path}/{k}")
    source = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(path))
    return stream.with_event_time(source, late=late)


def shuffled(rows, r):
    return sorted(rows, key=lambda x: x[1] + r.uniform(0, 900 * MS))


def run(spark, table, name, tmp_path):
    query = table.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    query.awaitTermination(300)
    return spark.table(name).collect(), query


def left_keys(query):
    """Rows of state that the last batch left."""
    return query.lastProgress["stateOperators"][0]["numRowsTotal"]


@pytest.fixture
def r():
    return np.random.default_rng(8)


def test_gaps(spark, tmp_path, r):
    rows = [(k, int(t) * MS) for k in ("a", "b") for t in np.cumsum(r.choice([10, 10, 400], 150))]
    ddl = "k string, ts_ns long"
    source = fed(spark, tmp_path / "in", [*shuffled(rows, r), (None, 5), ("end", END)], ddl)
    found, query = run(spark, ordered.gap_stream(source, "k", 100 * MS, idle_ms=30_000), "gaps_any_order", tmp_path)
    batch = signal.gaps(spark.createDataFrame(rows, ddl), ["k"], "ts_ns", 1.0, F.lit(100 * MS)).select("k", "ts_ns", "step").collect()
    assert sorted((g["k"], g["before_ns"], g["after_ns"]) for g in found) == sorted((g["k"], g["ts_ns"] - g["step"], g["ts_ns"]) for g in batch) and found


def test_state_ends(spark, tmp_path, r):
    """A hundred keys, one after the other: what the last batch holds is of the last ones, not of all."""
    rows = [(f"k{n}", (n * 60_000 + t) * MS) for n in range(100) for t in range(0, 1000, 100)]
    source = fed(spark, tmp_path / "in", [*rows, ("end", END)], "k string, ts_ns long", files=5)
    _, query = run(spark, ordered.gap_stream(source, "k", 50 * MS, idle_ms=30_000), "gaps_that_end", tmp_path)
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert 2 <= max(held) <= 80 and left_keys(query) <= 12  # 200 and more if each key stayed


def test_attitudes(spark, tmp_path, r):
    rows = [("a", int(t) * MS, *map(float, r.standard_normal(6))) for t in np.cumsum(r.choice([5, 20], 120))]
    source = fed(spark, tmp_path / "in", [*shuffled(rows, r), ("end", END, *[0.0] * 6)], "k string, ts_ns long, ax double, ay double, az double, gx double, gy double, gz double")
    found, _ = run(spark, ordered.fused_stream(source, "k", idle_ms=30_000), "fused_any_order", tmp_path)
    got = {x["ts_ns"]: x["qw"] for x in found if x["k"] == "a"}
    values = np.array([x[2:] for x in rows])
    want = fusion.gradient_filter(np.array([x[1] for x in rows]), values[:, :3], values[:, 3:])
    assert [got[x[1]] for x in rows] == pytest.approx(want[:, 3].tolist(), abs=1e-9)


def test_nearest_pairs(spark, tmp_path, r):
    side = lambda n, step: [(k, int(t) * MS // 3, float(v)) for k in ("a", "b") for t, v in zip(np.cumsum(r.choice([3, step, 900], n, p=[0.3, 0.6, 0.1])), range(n), strict=True)]
    left, right = side(120, 40), side(150, 25)
    left += [("a", right[3][1], 7.5)]
    right += [("a", right[3][1], -1.0)]
    ddl = "k string, ts_ns long, v double"
    a = fed(spark, tmp_path / "l", [*shuffled(left, r), ("end", END, 0.0)], ddl)
    b = fed(spark, tmp_path / "r", [*shuffled(right, r), ("end", END, 0.0)], ddl)
    gate = 20 * MS
    found, query = run(spark, ordered.nearest_stream(a, b, "k", "v", gate, idle_ms=30_000), "nearest_any_order", tmp_path)
    batch = asof.nearest(spark.createDataFrame(left, ddl), spark.createDataFrame(right, ddl), ["k"], "ts_ns", ["v"], gate).collect()
    want = [(x["k"], x["ts_ns"], x["v"], x["match"] and x["match"]["t"], x["match"] and x["match"]["v"]) for x in batch]
    got = [(x["k"], x["ts_ns"], x["left_value"], x["match_ns"], x["match_value"]) for x in found if x["k"] != "end"]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert {x[3] is None for x in got} == {True, False} and left_keys(query) <= 12


def test_many_keys_share_state(spark, tmp_path, monkeypatch, r):
    """Pairs of 200 keys in four groups: each key matched by itself, with values that are null, and no state of a key's own."""
    monkeypatch.setattr(ordered, "GROUPS", 4)
    side = lambda n: [(int(k) - 100, int(t) * MS, float(v)) for k, t, v in zip(r.integers(0, 200, n), r.integers(0, 2000, n), range(n), strict=True)]
    left, right = side(600), side(900)
    right[5] = (*right[5][:2], None)
    ddl = "k long, ts_ns long, v double"
    a = fed(spark, tmp_path / "l", [*left, (None, 5, 1.0), (3, None, 1.0), (999, END, 0.0)], ddl, files=2)
    b = fed(spark, tmp_path / "r", [*right, (3, None, 2.0), (999, END, 0.0)], ddl, files=2)
    gate = 60 * MS
    found, query = run(spark, ordered.nearest_stream(a, b, "k", "v", gate, idle_ms=30_000), "nearest_of_many_keys", tmp_path)
    values = {(k, t): [v for q, s, v in right if (q, s) == (k, t)] for k, t, _ in right}
    want = []
    for k, t, v in left:
        near = min(((abs(s - t), s) for q, s, _ in right if q == k), default=(gate + 1, 0))
        met = near[0] <= gate
        want.append((k, t, v, near[1] if met else None, min((x for x in values[k, near[1]] if x is not None), default=None) if met else None))
    got = [(x["k"], x["ts_ns"], x["left_value"], x["match_ns"], x["match_value"]) for x in found if x["k"] != 999]
    assert sorted(got, key=str) == sorted(want, key=str)
    held = max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"])
    assert held <= 5 * 8  # some values and a timer for each group and the last key; more than 200 if each key had its own
