"""Merkle dataset manifest: postorder traversal of aligned blocks of leaves, whose roots feed the next traversal.

A leaf is the SHA-256 of a row's values, each written with its length. Leaves of one key (the language) stand in the order
of their ids; every two nodes have a parent, the last one alone if its level is odd, until one node is left. Nodes are
numbered by one range sort and the sizes of its parts, so a key may hold most rows. A block is 2**BITS consecutive nodes;
a recursive postorder traversal of a block returns its digest and, while it unwinds, appends each half's digest to the
leaves of the other half. Block roots are the nodes of the next traversal until each key has one; the keys' roots make a
tree of their own in the same way. On the way down a block's proof is put behind those of its leaves. Only digests are
shuffled, no texts, and a task holds one block.

Defined results: null values are written `-`; a null id sorts first and is never tampered with; rows that share an id are
ordered by their leaf; a null key sorts first; an empty table has no rows and no root; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isochron.llm.common import cut

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Levels that one traversal climbs: a block has at most 1,024 leaves.
BITS = 10

_step = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
_path = "array<struct<left:string,right:string>>"


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(values: Sequence[Column]) -> Column:
    """Hexadecimal digest of a row: `-` for a null, else the value's bytes counted, a colon and the value."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf and the digests beside its path make."""
    return F.aggregate(path, start, lambda acc, at: F.sha2(F.concat(at["left"], acc, at["right"]), 256))


def traverse(nodes: list[str], levels: int, paths: list[list[dict]] | None = None) -> str:
    """Digest of the subtree of `levels` levels over these nodes; fills each node's path from below to the subtree's root."""

    def visit(low: int, level: int) -> str:
        if not level:
            return nodes[low]
        middle, high = low + (1 << (level - 1)), min(low + (1 << level), len(nodes))
        left = visit(low, level - 1)
        right = visit(middle, level - 1) if middle < high else ""
        if paths is not None:
            beside = {"left": "", "right": right}, {"left": left, "right": ""}
            for at in range(low, high):
                paths[at].append(beside[at >= middle])
        return digest(left, right)

    return visit(0, levels)


def _levels(block: int, nodes: int, bits: int) -> int:
    """Levels above a block: all of its bits, but for a key's only block as many as its nodes need."""
    return bits if block else (nodes - 1).bit_length()


def numbered(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Adds pos: each row's place, from 0, among the rows of its key in the order of these columns.

    One range sort, written; the places of a part start after the parts before it. Equal rows are kept apart by the number
    they were first written with.
    """
    first = cut(rows.withColumn("row", F.monotonically_increasing_id()))
    ranged = first.repartitionByRange("key", *order, "row").sortWithinPartitions("key", *order, "row")
    at = cut(ranged.drop("row").withColumn("at", F.monotonically_increasing_id())).withColumn("part", F.shiftright("at", 33))
    parts = at.groupBy("key", "part").agg(F.min("at").alias("low"), F.count("*").alias("n"))
    offsets = parts.selectExpr("key", "part", "coalesce(sum(n) over (partition by key order by part rows between unbounded preceding and 1 preceding), 0) - low as shift")
    return at.join(offsets, ["key", "part"]).withColumn("pos", F.col("at") + F.col("shift")).drop("at", "part", "shift")


def roots(nodes: DataFrame, bits: int = BITS) -> DataFrame:
    """(key, pos, node): the blocks' digests as the nodes of the next level; nodes: the same columns."""

    def each(group: pa.Table) -> pa.Table:
        group = group.sort_by("pos")
        block = group["block"][0].as_py()
        found = traverse(group["node"].to_pylist(), _levels(block, group.num_rows, bits))
        return pa.table({"key": group["key"][:1], "pos": pa.array([block], pa.int64()), "node": [found]})

    blocks = nodes.select("key", "pos", "node", F.shiftright("pos", bits).alias("block"))
    return blocks.groupBy("key", "block").applyInArrow(each, "key string, pos bigint, node string")


def proofs(nodes: DataFrame, above: DataFrame | None, bits: int = BITS) -> DataFrame:
    """Adds path, from each node to what `above` (key, pos, path and texts, of the blocks) leads to, and its texts.

    Without `above` each key has one block, and the path ends at its root.
    """
    columns = nodes.columns
    blocks = nodes.withColumn("block", F.shiftright("pos", bits))
    extra = [] if above is None else [c for c in above.columns if c not in ("key", "pos", "node", "path")]
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema)
    schema = ", ".join([own, f"path {_path}", *(f"{c} string" for c in extra)])

    def with_paths(group: pa.Table, head: pa.Table | None) -> pa.Table:
        group = group.sort_by("pos")
        paths: list[list[dict]] = [[] for _ in range(group.num_rows)]
        traverse(group["node"].to_pylist(), _levels(group["block"][0].as_py(), group.num_rows, bits), paths)
        tail = head["path"][0].as_py() if head is not None else []
        out = group.select(columns).append_column("path", pa.array([p + tail for p in paths], _step))
        for c in extra:
            out = out.append_column(c, pa.array([head[c][0].as_py()] * group.num_rows, pa.string()))
        return out

    if above is None:
        return blocks.groupBy("key", "block").applyInArrow(lambda group: with_paths(group, None), schema)
    heads = above.select("key", F.col("pos").alias("block"), "path", *extra)
    return blocks.groupBy("key", "block").cogroup(heads.groupBy("key", "block")).applyInArrow(with_paths, schema)


def forest(nodes: DataFrame, bits: int = BITS) -> tuple[list[DataFrame], DataFrame]:
    """The levels of blocks from these nodes up, and each key's root (key, node)."""
    most = nodes.agg(F.max("pos")).first()[0] or 0
    levels = [nodes]
    while True:
        levels.append(cut(roots(levels[-1], bits)))
        most >>= bits
        if not most:
            return levels, levels[-1].select("key", "node")


def manifest(docs: DataFrame, values: Sequence[Column], key: str = "lang", order: str = "doc_id", tampered: Sequence[Column] | None = None, bits: int = BITS) -> DataFrame:
    """One row per document: its id, leaf, its key's subroot, the root, its path and the tampered leaf (null: as it was).

    The path's steps hold the digests left and right of the node on each level, `""` where there is none.
    """
    spare = leaf(tampered) if tampered is not None else F.lit(None).cast("string")
    named = docs.select(F.coalesce(F.concat(F.lit("v"), F.col(key).cast("string")), F.lit("n")).alias("key"), F.col(order).alias("id"), leaf(values).alias("node"), spare.alias("changed"))
    # A second digest only where there is a second version.
    leaves = numbered(named.withColumn("changed", F.when(F.col("changed") != F.col("node"), F.col("changed"))), ["id", "node"])
    leaves = cut(leaves)
    levels, subroots = forest(leaves.select("key", "pos", "node"), bits)
    # The keys' tree: its nodes are the subroots in the order of their keys, all under one key.
    keys = cut(numbered(subroots.select(F.lit("").alias("key"), F.col("key").alias("own"), "node"), ["own"]))
    upper, _ = forest(keys.select("key", "pos", "node"), bits)
    above = None
    for level in [*upper[1:-1][::-1], keys]:
        above = proofs(level, above, bits)
    above = above.select(F.col("own").alias("key"), F.lit(0).cast("long").alias("pos"), "path", F.col("node").alias("subroot"), fold(F.col("node"), F.col("path")).alias("root"))
    for level in [*levels[1:-1][::-1], leaves]:
        above = proofs(level, above, bits)
    return above.select(F.col("id").alias(order), F.col("node").alias("leaf"), "subroot", "root", "path", "changed")


def report(docs: DataFrame) -> DataFrame:
    """The manifest of `documents` by language, and what each leaf's proof makes of it after one of seven is tampered with."""
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    values = [F.col(c) for c in FIELDS]
    found = manifest(docs, values, tampered=[tampered if c == "n_chars" else F.col(c) for c in FIELDS])
    beside = F.concat(F.lit(""), F.array_join(F.transform("path", lambda at: F.concat(at["left"], at["right"])), ""))
    folded = found.withColumn("folded_root", fold(F.coalesce("changed", "leaf"), F.col("path")))
    return folded.select("doc_id", "leaf", "subroot", "root", F.sha2(beside, 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
