"""Connected components: forests of chunks in the tasks, then large-star and small-star steps in joins and aggregates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isochron.llm.common import cut

#: Links that a task holds at a time; rounds after which something must be wrong (each at least halves a path).
CHUNK, MAX_ROUNDS = 250_000, 100


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of the links' nodes that are not the smallest of their component."""
    nodes, places = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = places[: len(a)], places[len(a) :]
    parent = np.arange(len(nodes))
    while True:
        pu, pv = parent[u], parent[v]
        open_ = pu != pv
        if not open_.any():
            break
        u, v, pu, pv = u[open_], v[open_], pu[open_], pv[open_]
        np.minimum.at(parent, np.maximum(pu, pv), np.minimum(pu, pv))
        while (parent[parent] != parent).any():
            parent = parent[parent]
    below = parent != np.arange(len(nodes))
    return nodes[below], nodes[parent[below]]


def contracted(links: DataFrame) -> DataFrame:
    """(a, b) links to links of the same components: of each CHUNK links of a task, every node to its smallest one."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def settled() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            a, b = forest(table["a"].to_numpy(), table["b"].to_numpy())
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= CHUNK:
                yield settled()
                held.clear()
                size = 0
        if held:
            yield settled()

    return links.select("a", "b").mapInArrow(each, "a long, b long")


def _digest(links: DataFrame) -> tuple[int, int]:
    row = links.agg(F.count("*"), F.coalesce(F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1_000_000_007))), F.lit(0))).first()
    return int(row[0]), int(row[1])


def _towards_least(links: DataFrame) -> DataFrame:
    """The links (a, b) with m, the smallest b of their a; a hub's links are split by the adaptive join, not gathered."""
    return links.join(links.groupBy("a").agg(F.min("b").alias("m")), "a")


def components(edges: DataFrame) -> DataFrame:
    """(a, b) links of long ids to (id, component): component is the smallest id that can be reached; linked ids only.

    Each step replaces links by links to smaller ids: within the chunks of a task, then by a large star (larger
    neighbours go to the smallest neighbour) and a small star (the node and its smaller neighbours do), so stars around
    hubs stay stars and no row's size grows with a degree. No step raises a node's smallest neighbour, and where a whole
    round changes nothing every node hangs on its component's smallest. The state is cut by a checkpoint after each
    round, in as many files as it has chunks.
    """
    stars = cut(contracted(edges.filter("a != b")).distinct())
    before = _digest(stars)
    for _ in range(MAX_ROUNDS if before[0] else 0):
        few = 1 + before[0] // CHUNK
        near = contracted(stars.coalesce(few))
        both = near.union(near.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _towards_least(both).filter("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).filter("a != b")
        small = _towards_least(large).select(F.explode(F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m"))).alias("x"))
        stars = cut(small.select("x.a", F.col("x.m").alias("b")).filter("a != b").distinct().coalesce(few))
        after = _digest(stars)
        if after == before:
            break
        before = after
    else:
        if before[0]:
            raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    members = stars.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return members.union(stars.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
