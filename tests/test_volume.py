"""Fused volumes and their surface against a plane and a sphere, PLY files, and disparities of known pictures."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from isochron.operators import disparity, volume
from isochron.sources import formats

LENS = (60.0, 60.0, 39.5, 29.5)
IMAGES = "take string, width int, height int, depth binary, lens array<double>, pose array<array<double>>"


def view(take, depth, pose=None):
    return (take, 80, 60, bytearray(depth.astype("<f4").tobytes()), list(LENS), (np.eye(4) if pose is None else pose).tolist())


def rays():
    v, u = np.indices((60, 80))
    return np.stack([(u - LENS[2]) / LENS[0], (v - LENS[3]) / LENS[1], np.ones(u.shape)], -1)


def sphere_seen(pose, radius):
    """Depth along the camera's axis of a sphere around the world's origin; 0 where the ray misses it."""
    d = rays() @ pose[:3, :3].T
    o = pose[:3, 3]
    a, b, c = (d * d).sum(-1), (d * o).sum(-1), o @ o - radius**2
    root = b * b - a * c
    return np.where(root > 0, (-b - np.sqrt(np.maximum(root, 0))) / a, 0.0)


def around(angle):
    c, s = np.cos(angle), np.sin(angle)
    pose = np.eye(4)
    pose[:3, :3] = [[c, 0, s], [0, 1, 0], [-s, 0, c]]
    pose[:3, 3] = pose[:3, :3] @ [0, 0, -2.0]
    return pose


def corners(spark, images, voxel):
    found = volume.surface(volume.fused(spark.createDataFrame(images, IMAGES).repartition(3), voxel), voxel)
    return {t: g[[f"{a}{n}" for n in range(3) for a in "xyz"]].to_numpy().reshape(-1, 3) for t, g in found.toPandas().groupby("take")}


def test_plane_and_sphere(spark, monkeypatch):
    monkeypatch.setattr(volume, "HELD", 20)
    images = [view("plane", np.full((60, 80), 1.5)), view("plane", np.full((60, 80), 1.5)), view("nothing", np.full((60, 80), np.nan)), ("null", 80, 60, None, list(LENS), np.eye(4).tolist())]
    images += [view("ball", sphere_seen(p, 0.5), p) for p in map(around, np.linspace(0, 2 * np.pi, 12, endpoint=False))]
    found = corners(spark, images, 0.05)
    assert set(found) == {"plane", "ball"}
    assert len(found["plane"]) > 1000 and np.abs(found["plane"][:, 2] - 1.5).max() < 1e-6
    off = np.abs(np.linalg.norm(found["ball"], axis=1) - 0.5)
    assert len(found["ball"]) > 3000 and np.quantile(off, 0.95) < 0.025 and off.max() < 0.05
    # All around, as far as the cameras see.
    angle = np.arctan2(found["ball"][:, 0], found["ball"][:, 2])
    assert len(np.unique(np.floor(angle * 6))) >= 37


def test_sums_do_not_depend_on_the_tasks(spark, monkeypatch):
    images = [view("ball", sphere_seen(p, 0.5), p) for p in map(around, (0.0, 0.3, 0.6))]
    once = sorted(map(str, volume.fused(spark.createDataFrame(images, IMAGES).coalesce(1), 0.1).collect()))
    monkeypatch.setattr(volume, "HELD", 3)
    assert once == sorted(map(str, volume.fused(spark.createDataFrame(images, IMAGES).repartition(3), 0.1).collect()))


def test_crossings_of_a_linear_field():
    """Every triangle of a tilted plane lies on it, and together they cover its part of the grid."""
    x, y, z = np.indices((5, 5, 5)).astype(float)
    found = volume.crossings(x + 0.25 * y - 2.1 + 0 * z, np.ones((5, 5, 5), int))
    assert np.abs(found[..., 0] + 0.25 * found[..., 1] - 2.1).max() < 1e-12
    area = np.linalg.norm(np.cross(found[:, 1] - found[:, 0], found[:, 2] - found[:, 0]), axis=1).sum() / 2
    assert area == pytest.approx(16 * np.sqrt(1 + 0.25**2))


def test_ply_files(spark, tmp_path):
    blocks = volume.fused(spark.createDataFrame([view("plane", np.full((60, 80), 1.5)), view("near", np.full((60, 80), 0.9))], IMAGES), 0.1)
    triangles = volume.surface(blocks, 0.1)
    counts = {r["take"]: r["count"] for r in triangles.groupBy("take").count().collect()}
    formats.save(volume.ply_pieces(triangles), str(tmp_path), "ply")
    for take, n in counts.items():
        data = (tmp_path / take / "part000.ply").read_bytes()
        head, body = data.split(b"end_header\n")
        assert f"element vertex {3 * n}\n".encode() in head and f"element face {n}\n".encode() in head and len(body) == n * (36 + 13)
        points = np.frombuffer(body[: 36 * n], "<f4").reshape(-1, 3)
        faces = np.frombuffer(body[36 * n :], np.dtype([("n", "u1"), ("at", "<i4", (3,))]))
        assert np.abs(points[:, 2] - (1.5 if take == "plane" else 0.9)).max() < 1e-5 and (faces["at"].ravel() == np.arange(3 * n)).all()


def test_disparities(spark, monkeypatch):
    """Two planes of disparities 5 and 11 in a textured picture, in strips, with noise; an empty pair gives nothing."""
    r = np.random.default_rng(9)
    monkeypatch.setattr(disparity, "STRIP", 20)
    wide, tall = 120, 50
    texture = r.integers(0, 256, (tall, wide + 40))
    want = np.where(np.indices((tall, wide))[0] < 25, 5, 11)
    right = texture[:, 20 : 20 + wide]
    left = np.stack([texture[k, 20 - want[k, 0] : 20 - want[k, 0] + wide] for k in range(tall)])
    left = np.clip(left + r.integers(-3, 4, left.shape), 0, 255)
    pairs = [("a", wide, tall, bytearray(left.astype(np.uint8).tobytes()), bytearray(right.astype(np.uint8).tobytes())), ("none", 0, 0, bytearray(), bytearray()), ("null", 5, 5, None, None)]
    df = spark.createDataFrame(pairs, "take string, width int, height int, left_pixels binary, right_pixels binary")
    rows = disparity.disparities(df, 16).orderBy("row").collect()
    assert [(x["take"], x["row"], x["rows"]) for x in rows] == [("a", 0, 20), ("a", 20, 20), ("a", 40, 10)]
    found = np.concatenate([np.frombuffer(x["disparity"], "<f4").reshape(x["rows"], wide) for x in rows])
    known = ~np.isnan(found)
    assert known[:, 20:-5].mean() > 0.9 and (np.abs(found - want)[known] < 0.75).mean() > 0.97


def test_runs_hold_whole_keys(monkeypatch):
    monkeypatch.setattr(volume, "ROWS", 3)
    table = pa.table({"k": ["a"] * 2 + ["b"] * 5 + [None] * 4 + ["d"], "x": list(range(12))})
    found = list(volume._runs(iter(table.to_batches(max_chunksize=4)), ["k"]))
    assert sum((b.column("x").to_pylist() for b in found), []) == list(range(12))
    keys = [set(b.column("k").to_pylist()) for b in found]
    assert sum(len(k) for k in keys) == len(set().union(*keys)) == 4


def test_work_is_dealt_and_in_batches(spark):
    """Images of one partition are many tasks' work, no function is called for each block, and neighbours get a layer each."""
    images = spark.createDataFrame([view(f"t{k}", np.full((60, 80), 1.5)) for k in range(8)], IMAGES).coalesce(1)
    triangles = volume.surface(volume.fused(images, 0.1), 0.1)
    plan = triangles._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroups" not in plan and "Generate" not in plan and plan.count("REPARTITION_BY_NUM") == 3
    assert len({tuple(np.round(g.drop(columns="take").to_numpy().sum(0), 6)) for _, g in triangles.toPandas().groupby("take")}) == 1


def test_pictures_together():
    """Several pictures at once have the disparities that each has alone."""
    r = np.random.default_rng(3)
    left, right = r.integers(0, 256, (2, 3, 24, 40)).astype(np.uint8)
    assert np.array_equal(disparity.matched(left, right, 8), np.stack([disparity.matched(a, b, 8) for a, b in zip(left, right, strict=True)]), equal_nan=True)
