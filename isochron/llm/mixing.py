"""Mixing sources to target weights by a low-discrepancy schedule.

Slot n of the schedule is the van der Corput point of n (its bits mirrored); the cumulative target shares map the point
to a source, and the slot's rank among its source's slots is the block it takes. Blocks of a source whose interval holds
fewer points than it has blocks, as a small source's beside a huge one, get slots after the others. A source's documents, shuffled by a
keyed hash of id and text, are one stream of words that repeats; block r is its words [r * BLOCK, (r + 1) * BLOCK), and the block in
which the target falls is taken in part. A document's words taken are its parts of the blocks taken.

Nothing here orders a whole source in one task: stream offsets and slot ranks are prefix sums in two levels (sums of
buckets or chunks, then rows inside each), so one source may hold most rows. Only tables with a row for each source, or
for each bucket of a source, meet in one window.

Defined results: null text has size 0 and a null source sorts last; documents of size 0 take 0; repeated rows each
count; an empty table gives an empty result; equal hashes are ordered by doc_id, then size, and else are equal rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from isochron.llm.common import cut

BLOCK = 4096
#: Share of all words that the mix takes, and how often a source may be taken at most.
SHARE, LIMIT = 1.5, 2
WEIGHTS = (3.0, 1.0, 2.0)
#: Rows of a bucket on average, slots of a chunk, and the least number of cells that the sources' intervals are looked up by.
BUCKET_ROWS, CHUNK, CELLS = 2_000, 65_536, 1_024
BITS = 40
WORD = r"[^\x20\x09-\x0D]+"


def words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, share: float = SHARE, limit: float = LIMIT, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size) with target: share * all words dealt by weight, as water fills vessels.

    Sources whose limit for each unit of weight is smallest fill first; once the level of what is left lies below a
    source's limit, that source and all after it get their weight times this level. One row for each source.
    """
    every = W.partitionBy(F.lit(0))
    order = every.orderBy(F.col("most") / F.col("weight"), "nth")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    named = sizes.withColumn("nth", F.row_number().over(every.orderBy(F.col("source").isNull(), "source")) - 1)
    named = named.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("nth") % len(weights) + 1).cast("int")))
    named = named.withColumn("most", F.lit(float(limit)) * F.col("source_size"))
    left = F.lit(float(share)) * F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    shared = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = named.withColumn("level", left / shared)
    free = F.when(F.col("level") * F.col("weight") < F.col("most"), F.struct(F.col("most") / F.col("weight"), "nth", "level"))
    level = level.withColumn("water", F.min(free).over(every)["level"])
    return level.select("source", "source_size", "nth", F.least("most", F.coalesce(F.col("water") * F.col("weight"), "most")).alias("target"))


def schedule(quotas: DataFrame, block: int) -> DataFrame:
    """(nth, slot, rank): which source each slot takes, and which block of it; quotas: nth, low, high, blocks."""
    spark = quotas.sparkSession
    n = quotas.agg(F.sum("blocks"), F.count("*")).first()
    total = int((n[0] or 0) * 1.02) + 64 * n[1]
    slots = spark.range(total).withColumn("point", F.conv(F.reverse(F.lpad(F.bin("id"), BITS, "0")), 2, 10).cast("long"))
    # As many cells as sources: a slot then meets two intervals on average, whatever their number.
    width = (1 << BITS) // max(CELLS, 1 << (n[1] - 1).bit_length() if n[1] else 0)
    cells = quotas.filter(F.col("high") > F.col("low")).withColumn("cell", F.explode(F.sequence(F.expr(f"low div {width}"), F.expr(f"(high - 1) div {width}"))))
    dealt = slots.withColumn("cell", F.expr(f"point div {width}")).join(cells, "cell").filter((F.col("point") >= F.col("low")) & (F.col("point") < F.col("high")))
    dealt = dealt.select("nth", F.col("id").alias("slot"), "blocks", F.expr(f"id div {CHUNK}").alias("chunk"))
    sums = dealt.groupBy("nth", "chunk").agg(F.count("*").alias("n"))
    sums = sums.withColumn("base", F.coalesce(F.sum("n").over(W.partitionBy("nth").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    within = F.row_number().over(W.partitionBy("nth", "chunk").orderBy("slot")) - 1
    ranked = dealt.withColumn("within", within).join(sums.drop("n"), ["nth", "chunk"]).withColumn("rank", F.col("base") + F.col("within"))
    ranked = ranked.filter(F.col("rank") < F.col("blocks")).select("nth", "slot", "rank")
    short = quotas.join(sums.groupBy("nth").agg(F.sum("n").alias("dealt")), "nth", "left").withColumn("dealt", F.coalesce("dealt", F.lit(0))).filter(F.col("dealt") < F.col("blocks"))
    ahead = F.coalesce(F.sum(F.col("blocks") - F.col("dealt")).over(W.partitionBy(F.lit(0)).orderBy("nth").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    late = short.withColumn("ahead", ahead).withColumn("rank", F.explode(F.sequence(F.col("dealt"), F.col("blocks") - 1)))
    return ranked.union(late.select("nth", (F.lit(total) + F.col("ahead") + F.col("rank") - F.col("dealt")).alias("slot"), "rank"))


def mix(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", seed: int = 11, block: int = BLOCK) -> DataFrame:
    """doc_id, source, size, source_size, target and taken of each document."""
    sized = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), words(text).alias("size"), F.xxhash64(F.lit(seed), F.col(doc_id), F.col(text)).alias("hash"))
    sized = cut(sized)
    buckets = max(1, sized.count() // BUCKET_ROWS)
    sized = sized.withColumn("bucket", F.expr(f"shiftrightunsigned(hash, 1) % {buckets}"))
    sums = cut(sized.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size")))
    quotas = cut(targets(sums.groupBy("source").agg(F.sum("bucket_size").alias("source_size"))))
    whole = quotas.agg(F.sum("target")).first()[0] or 0.0
    if whole <= 0:
        return sized.select("doc_id", "source", "size", F.lit(0).cast("long").alias("source_size"), F.lit(0.0).alias("target"), F.lit(0).cast("long").alias("taken"))
    up_to = F.sum("target").over(W.partitionBy(F.lit(0)).orderBy("nth"))
    edge = lambda x: F.floor(x / F.lit(whole) * F.lit(float(1 << BITS)))
    quotas = quotas.withColumns({"quota": F.round("target").cast("long"), "low": edge(up_to - F.col("target")), "high": F.least(edge(up_to), F.lit(1 << BITS))})
    quotas = cut(quotas.withColumn("blocks", F.ceil(F.col("quota") / block)))
    slots = schedule(quotas, block)

    key = F.struct(F.col("source").isNull(), "source")
    ahead = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    bases = sums.withColumn("base", F.coalesce(F.sum("bucket_size").over(ahead), F.lit(0))).withColumn("at", key).drop("source", "bucket_size")
    named = quotas.withColumn("at", key).drop("source")
    inside = W.partitionBy("at", "bucket").orderBy("hash", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    placed = sized.withColumn("at", key).withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(bases, ["at", "bucket"]).join(F.broadcast(named) if quotas.count() <= 10_000 else named, "at")
    placed = placed.withColumn("start", F.col("base") + F.col("within"))
    rows = ["doc_id", "source", "size", "source_size", "target"]
    #: Each pass of the repeating stream gives a document one more place; a place spans one block or more.
    passes = F.explode(F.sequence(F.lit(0), F.lit(LIMIT - 1)))
    pieces = placed.filter("size > 0").withColumn("pass", passes).withColumn("low_word", F.col("start") + F.col("pass") * F.col("source_size"))
    pieces = pieces.filter(F.col("low_word") < F.col("quota")).withColumn("high_word", F.least(F.col("low_word") + F.col("size"), "quota"))
    pieces = pieces.withColumn("rank", F.explode(F.sequence(F.expr(f"low_word div {block}"), F.expr(f"(high_word - 1) div {block}"))))
    part = F.least("high_word", (F.col("rank") + 1) * block) - F.greatest("low_word", F.col("rank") * block)
    taken = pieces.select("at", "start", "nth", "rank", part.alias("part")).join(slots.select("nth", "rank"), ["nth", "rank"])
    whole_rows = placed.select("at", F.when(F.col("size") > 0, F.col("start")).alias("start"), *rows)
    got = taken.groupBy("at", "start").agg(F.sum("part").alias("taken"))
    out = whole_rows.join(got, ["at", "start"], "left")
    return out.select(*rows, F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
