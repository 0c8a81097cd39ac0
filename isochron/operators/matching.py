"""Mutual nearest neighbours among the vectors of a group, exactly, in blocks.

A group's vectors are dealt into blocks; each pair of blocks is a task of its own, in which every vector's nearest of
the other block is found, and the nearest of all blocks follows by a minimum for each row. Distances are sums of squared
differences in double precision, added in the order of the components; equal distances go to the smaller id.

Defined results: null groups and ids, and null or empty vectors and those with null or non-finite components, match
nothing; vectors match only vectors of their own length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vectors of a block on average, rows that are compared with a block at a time, components of differences held at once.
BLOCK_ROWS, ROWS, HELD = 2_048, 256, 1 << 22


def _nearest(ids: np.ndarray, x: np.ndarray, others: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, other, distance) of the nearest other vector of each row that has one."""
    square, found = (y * y).sum(1), []
    for low in range(0, len(ids), ROWS):
        own, some = ids[low : low + ROWS], x[low : low + ROWS]
        size = (some * some).sum(1)
        rough = size[:, None] + square[None, :] - 2 * (some @ y.T)
        rough[own[:, None] == others[None, :]] = np.inf
        # What rounding may put behind the least is measured again, component by component.
        row, column = np.nonzero((rough <= rough.min(1, keepdims=True) + 1e-10 * (size[:, None] + square.max())) & np.isfinite(rough))
        far = np.zeros(len(row))
        step = max(1, HELD // x.shape[1])
        for at in range(0, len(row), step):
            part = slice(at, at + step)
            square_of = (some[row[part]] - y[column[part]]) ** 2
            for k in range(x.shape[1]):
                far[part] += square_of[:, k]
        order = np.lexsort((others[column], far, row))
        first = order[np.unique(row[order], return_index=True)[1]]
        found.append((own[row[first]], others[column[first]], far[first]))
    return tuple(np.concatenate(v) for v in zip(*found, strict=True))


def mutual_nearest(rows: DataFrame, group: str, vec_id: str, embedding: str) -> DataFrame:
    """(group, a, b) of the vectors that are each other's nearest in their group; each pair is there both ways."""
    e = F.transform(embedding, lambda v: v.cast("double"))
    clean = rows.select(F.col(group).alias("grp"), F.col(vec_id).cast("long").alias("id"), e.alias("e")).dropna()
    clean = clean.filter((F.size("e") > 0) & F.forall("e", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))).withColumn("dim", F.size("e"))
    sizes = clean.groupBy("grp", "dim").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"))
    dealt = clean.join(sizes, ["grp", "dim"]).withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int")).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    dealt = dealt.select("grp", "dim", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "e")

    def each(table: pa.Table) -> pa.Table:
        ids, block = table["id"].to_numpy(), table["block"].to_numpy()
        x = np.array(table["e"].combine_chunks().flatten().to_numpy(zero_copy_only=False)).reshape(len(ids), -1)
        low = block == table["i"][0].as_py()
        sides = [(low, low)] if low.all() and table["i"][0] == table["j"][0] else [(low, ~low), (~low, low)]
        got = [_nearest(ids[s], x[s], ids[t], x[t]) for s, t in sides if s.any() and t.any()]
        a, b, d = (np.concatenate(v) for v in zip(*got, strict=True)) if got else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        grp = pa.chunked_array([pa.array([table["grp"][0].as_py()] * len(a), table["grp"].type)])
        return pa.table({"grp": grp, "dim": pa.array(np.full(len(a), x.shape[1], np.int32)), "a": a, "b": b, "d": d})

    kind = clean.schema["grp"].dataType.simpleString()
    near = dealt.groupBy("grp", "dim", "i", "j").applyInArrow(each, f"grp {kind}, dim int, a long, b long, d double")
    best = near.groupBy("grp", "dim", "a").agg(F.min(F.struct("d", "b")).alias("m")).select("grp", "dim", "a", F.col("m.b").alias("b"))
    back = best.select("grp", "dim", F.col("b").alias("a"), F.col("a").alias("b"))
    return best.join(back, ["grp", "dim", "a", "b"]).select(F.col("grp").alias(group), "a", "b")


def _words(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Descriptors of one length as rows of 64-bit words, zeros behind them."""
    held = [bytes(x) for x in column.to_pylist()]
    size = -(-len(held[0]) // 8) * 8
    return np.frombuffer(b"".join(x.ljust(size, b"\x00") for x in held), np.uint64).reshape(len(held), -1)


def _nearest_bits(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(id, distance) of each row's nearest one of the others: the smaller id of equals."""
    order = np.argsort(b, kind="stable")
    b, y = b[order], y[order]
    at, far = [], []
    for low in range(0, len(a), ROWS):
        d = np.bitwise_count(x[low : low + ROWS, None, :] ^ y[None, :, :]).sum(2, dtype=np.int64)
        at.append(d.argmin(1))
        far.append(d.min(1))
    return b[np.concatenate(at)], np.concatenate(far)


def mutual_hamming(left: DataFrame, right: DataFrame, group: str, row_id: str, descriptor: str) -> DataFrame:
    """(group, a, b, distance) of left and right rows of a group that are each other's nearest by different bits.

    Descriptors are binary; those of one length are compared, exactly, by a task for each pair of blocks of about BLOCK_ROWS
    rows of either side. Of equals the smaller id is nearest. Null groups, ids and descriptors and empty ones match nothing.
    """
    clean = lambda rows, side: rows.select(F.col(group).alias("grp"), F.col(row_id).cast("long").alias("id"), F.col(descriptor).alias("e"), F.lit(side).alias("side")).dropna().filter(F.length("e") > 0).withColumn("dim", F.length("e"))
    both = clean(left, 0).unionByName(clean(right, 1))
    count = lambda side: F.ceil(F.sum(F.when(F.col("side") == side, 1).otherwise(0)) / BLOCK_ROWS).cast("int")
    sizes = both.groupBy("grp", "dim").agg(count(0).alias("n0"), count(1).alias("n1")).filter("n0 > 0 and n1 > 0")
    dealt = both.join(sizes, ["grp", "dim"]).withColumn("block", F.pmod(F.xxhash64("id"), F.when(F.col("side") == 0, F.col("n0")).otherwise(F.col("n1"))).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.expr("sequence(0, if(side = 0, n1, n0) - 1)")))
    dealt = dealt.select("grp", "dim", F.when(F.col("side") == 0, F.col("block")).otherwise(F.col("other")).alias("i"), F.when(F.col("side") == 0, F.col("other")).otherwise(F.col("block")).alias("j"), "side", "id", "e")

    def each(table: pa.Table) -> pa.Table:
        side, ids, x = table["side"].to_numpy(), table["id"].to_numpy(), _words(table["e"])
        out: dict[str, list] = {"side": [], "a": [], "b": [], "d": []}
        for own in (0, 1):
            s, t = side == own, side != own
            if s.any() and t.any():
                b, d = _nearest_bits(ids[s], x[s], ids[t], x[t])
                for name, values in (("side", np.full(len(d), own, np.int32)), ("a", ids[s]), ("b", b), ("d", d)):
                    out[name].append(values)
        joined = {name: np.concatenate(v) if v else np.empty(0, np.int32 if name == "side" else np.int64) for name, v in out.items()}
        grp = pa.chunked_array([pa.array([table["grp"][0].as_py()] * len(joined["a"]), table["grp"].type)])
        return pa.table({"grp": grp, "dim": pa.array(np.full(len(joined["a"]), table["dim"][0].as_py(), np.int32)), **joined})

    kind = both.schema["grp"].dataType.simpleString()
    near = dealt.groupBy("grp", "dim", "i", "j").applyInArrow(each, f"grp {kind}, dim int, side int, a long, b long, d long")
    best = near.groupBy("grp", "dim", "side", "a").agg(F.min(F.struct("d", "b")).alias("m"))
    there = best.filter("side = 0").select("grp", "dim", "a", F.col("m.b").alias("b"), F.col("m.d").alias("distance"))
    back = best.filter("side = 1").select("grp", "dim", F.col("a").alias("b"), F.col("m.b").alias("a"))
    return there.join(back, ["grp", "dim", "a", "b"]).select(F.col("grp").alias(group), "a", "b", "distance")
