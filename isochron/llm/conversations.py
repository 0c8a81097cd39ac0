"""Conversation structure repair: a weighted finite-state composition, and the cheapest path through it.

The input acceptor is the chain of a conversation's rows, the edit transducer keeps, reroles, deletes or inserts, and the
grammar acceptor takes role sequences `(s?(ua)+)?`. The composed machine's states are (rows read, inserts since, grammar
state); its arcs are made when the search first meets a kind of row in a grammar state, and kept. As a third insert in a
row only comes back to a grammar state at a higher cost, at most two stand between rows and the machine has no cycles, so
one pass in the order of the rows finds the least (cost, labels) of each state. Between rows there are four states, whose
label strings all end in a row's label and have as many of those, so none is a prefix of another: their order is kept as a
rank, and weights are compared as (cost, rank of the path before, last labels) without touching the strings. A state holds
one byte a row of its way back and the running digest of its repaired text, so texts are not held.

Rows are shuffled by conversation, once, and stream through in the order of turn (nulls first), role, text's digest. Rows
that repeat an earlier turn's are found beforehand by grouping digests, so no set of them is held either.

Defined results: null role and text count as one space; the first letter of any other role than s, u, a fits nowhere, so
the row is reroled or deleted; rows without a conversation make one conversation; further columns are ignored; an empty
table gives no rows. A conversation is one sequence: its digest and audit are made by one task, in the memory of a row and
five bytes for each row read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isochron.llm.common import slices

#: Grammar acceptor of (s?(ua)+)?: arcs by state and initial; the first and the last state accept.
START, SYSTEM, USER, ASSISTANT = range(4)
GRAMMAR = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
FINAL = (START, ASSISTANT)
ROLES = {"u": "user", "a": "assistant"}
KEEP, REROLE, DELETE, INSERT, UNMENDED = 0, 1, 2, 5, 5
#: Pairs of neighbouring initials that are no fault.
LEGAL = ("su", "ua", "au")
SPACE = " \t\n\x0b\x0c\r"
SUFFIXES = [lead + edit for lead in ("", "I", "II") for edit in "KRD"]


def damage(conversations: DataFrame) -> DataFrame:
    """The rows after damage by crc32(`conv_id:turn`) % 20; dropped ones stay as `dropped` rows without text, for their id."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn"))) % 20
    text = F.when(code <= 1, "").when(code == 2, F.regexp_replace(spaced("text"), "[.!?]", "")).otherwise(spaced("text"))
    role = F.when(code == 4, "user").otherwise(spaced("role"))
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), (code == 0).alias("dropped"), F.when(code == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))).alias("copies"))
    return rows.select("conv_id", "turn", "role", "text", "dropped", F.explode("copies").alias("copy")).drop("copy")


def _streamed(rows: DataFrame) -> DataFrame:
    """All rows with their faults' flags, and before those that repeat an earlier turn a mark, by conversation and order."""
    spaced = lambda c: F.coalesce(F.col(c), F.lit(" "))
    dropped = F.col("dropped") if "dropped" in rows.columns else F.lit(False)
    bare = F.rtrim(F.col("text"), F.lit(SPACE))
    named = rows.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"), dropped.alias("dropped"))
    named = named.select("*", F.sha2("text", 256).alias("digest"))
    kept = named.filter(~F.col("dropped")).select("conv_id", "role", "digest", F.struct(F.col("turn").isNotNull().alias("known"), "turn").alias("at"))
    groups = kept.groupBy("conv_id", "role", "digest").agg(F.min("at").alias("first"), F.max("at").alias("last")).filter("first < last")
    groups = groups.select(F.col("conv_id").alias("g_conv"), F.col("role").alias("g_role"), F.col("digest").alias("g_digest"), "first")
    same = F.expr("conv_id <=> g_conv and role = g_role and digest = g_digest and at > first")
    marks = kept.join(groups, same).select("conv_id", F.col("at.turn").alias("turn"), "role", F.lit("").alias("text"), F.lit(False).alias("dropped"), "digest", F.lit(0).alias("kind"), F.lit(False).alias("blank"), F.lit(False).alias("open"))
    plain = named.select("*", F.lit(1).alias("kind"), (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("open"))
    return plain.unionByName(marks).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "digest", "kind")


@cache
def inserts(state: int) -> tuple[tuple[int, str, tuple[str, ...]], ...]:
    """(grammar state, labels, roles) after none, one or two inserts."""
    found = [(state, "", ())]
    for at, labels, roles in found:
        if len(labels) < 2:
            found += [(GRAMMAR[at, x], labels + "I", (*roles, x)) for x in ROLES if (at, x) in GRAMMAR]
    return tuple(found)


@cache
def arcs(state: int, initial: str, forced: bool, unmended: bool) -> tuple[tuple[int, int, str, tuple[str, ...], str], ...]:
    """(next grammar state, cost, labels, inserted roles, role given: initial, or `` for none, `=` for its own)."""
    found = []
    for at, labels, roles in inserts(state):
        spent = INSERT * len(roles)
        found.append((at, spent + DELETE, labels + "D", roles, ""))
        if forced:
            continue
        fixed = spent + UNMENDED * unmended
        if (at, initial) in GRAMMAR:
            found.append((GRAMMAR[at, initial], fixed + KEEP, labels + "K", roles, "="))
        found += [(GRAMMAR[at, x], fixed + REROLE, labels + "R", roles, x) for x in ROLES if (at, x) in GRAMMAR]
    return tuple(found)


class Search:
    """Shortest path through the composed machine of one conversation, a row at a time."""

    def __init__(self) -> None:
        #: By grammar state: (cost, rank among the label strings, digest of the repaired text so far).
        self.best: dict[int, tuple[int, int, object]] = {START: (0, 0, hashlib.sha256())}
        self.back = bytearray()

    def read(self, role: str, text: bytes, forced: bool, unmended: bool) -> None:
        initial = role[:1] if role[:1] in ("s", "u", "a") else "?"
        found: dict[int, tuple] = {}
        for state, (cost, rank, _) in self.best.items():
            for to, more, labels, roles, given in arcs(state, initial, forced, unmended):
                weight = (cost + more, rank, labels)
                if to not in found or weight < found[to][0]:
                    found[to] = (weight, state, roles, given)
        order = {to: k for k, to in enumerate(sorted(found, key=lambda to: found[to][0][1:]))}
        fresh, ways = {}, bytearray(4)
        for to, ((cost, _, labels), state, roles, given) in found.items():
            running = self.best[state][2].copy()
            first = state == START
            for x in roles:
                running.update(f"{'' if first else chr(10)}{ROLES[x]}:".encode())
                first = False
            if given:
                running.update(f"{'' if first else chr(10)}{role if given == '=' else ROLES[given]}:".encode("utf-8", "surrogatepass"))
                running.update(text)
            fresh[to] = (cost, order[to], running)
            ways[to] = state * len(SUFFIXES) + SUFFIXES.index(labels)
        self.best = fresh
        self.back += ways

    def finish(self) -> tuple[int, str, str]:
        """(cost, labels, digest of the repaired text) of the cheapest accepted path."""
        ends = [((cost + INSERT * len(roles), rank, labels), state, roles) for state, (cost, rank, _) in self.best.items() for at, labels, roles in inserts(state) if at in FINAL]
        (cost, _, labels), state, roles = min(ends)
        running = self.best[state][2].copy()
        for k, x in enumerate(roles):
            running.update(f"{'' if state == START and not k else chr(10)}{ROLES[x]}:".encode())
        pieces = [labels]
        for at in range(len(self.back) - 4, -1, -4):
            state, suffix = divmod(self.back[at + state], len(SUFFIXES))
            pieces.append(SUFFIXES[suffix])
        return cost, "".join(reversed(pieces)), running.hexdigest()


class Summary:
    """Faults and gaps of one conversation beside its search."""

    def __init__(self) -> None:
        self.search, self.counts, self.turns, self.low, self.high = Search(), [0, 0, 0, 0], 0, None, None
        self.before = self.initial = self.mark = None

    def add(self, row: dict) -> None:
        key = (row["turn"], row["role"], row["digest"])
        if not row["kind"]:
            self.mark = key
            return
        if row["dropped"]:
            return
        again = key in (self.mark, self.before)
        fault = 0 if row["blank"] else 1 if again else 2 if row["open"] else 3
        if fault < 3:
            self.counts[fault] += 1
        if row["turn"] is not None and row["turn"] != self.high:
            self.turns += 1
            self.low, self.high = row["turn"] if self.low is None else self.low, row["turn"]
        initial = row["role"][:1]
        if self.initial is not None:
            self.counts[3] += self.initial + initial not in LEGAL
        self.before, self.initial = key, initial
        self.search.read(row["role"], row["text"], fault < 2, fault == 2)

    def result(self, conversation: object) -> tuple:
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        cost, audit, digest = self.search.finish()
        return (conversation, gaps, *self.counts, cost, audit, digest)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in slices(batches):
        batch = batch.set_column(batch.schema.get_field_index("text"), "text", batch.column("text").cast(pa.large_binary() if pa.types.is_large_string(batch.column("text").type) else pa.binary()))
        yield from batch.to_pylist()


def _emitted(rows: Iterator[tuple], schema: pa.Schema, most: int = 1024) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == most:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _conversation_type(rows: DataFrame) -> str:
    return rows.schema["conv_id"].dataType.simpleString()


def report(rows: DataFrame) -> DataFrame:
    """One row per conversation: gaps, faults, the cheapest edits, their cost and the repaired text's digest.

    rows: conv_id, turn (whole numbers), role, text, and `dropped` (true: a row that only names its conversation).
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds: dict[str, pa.DataType] = {}

        def told(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in source:
                kinds["conv_id"] = batch.schema.field("conv_id").type
                yield batch

        def results() -> Iterator[tuple]:
            held, summary = None, None
            for row in _rows(told(batches)):
                if summary is None or row["conv_id"] != held:
                    if summary is not None:
                        yield summary.result(held)
                    held, summary = row["conv_id"], Summary()
                summary.add(row)
            if summary is not None:
                yield summary.result(held)

        whole = [(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
        source = results()
        first = next(source, None)
        if first is not None:
            schema = pa.schema([("conv_id", kinds["conv_id"]), *whole, ("audit", pa.string()), ("repaired_sha256", pa.string())])
            yield from _emitted(_chained(first, source), schema)

    schema = f"conv_id {_conversation_type(rows)}, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
    return _streamed(rows).mapInArrow(each, schema)


def _chained(first: tuple, rest: Iterator[tuple]) -> Iterator[tuple]:
    yield first
    yield from rest


def applied(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of the repaired rows: the audit's labels applied to the rows in order."""
    state = START
    for label in audit:
        if label == "I":
            initial = next(x for x in ROLES if (state, x) in GRAMMAR)
            role, text = ROLES[initial], ""
        else:
            role, text = next(rows)
            if label == "D":
                continue
            initial = role[:1] if label == "K" else next(x for x in ROLES if (state, x) in GRAMMAR)
            role = role if label == "K" else ROLES[initial]
        state = GRAMMAR[state, initial]
        yield label, role, text


def repair(rows: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, pos (from 0), edit (K, R or I), role, text."""
    audits = report(rows).select("conv_id", F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"), F.lit(0).alias("part"), F.lit("").alias("digest"))
    spaced = lambda c: F.coalesce(F.col(c), F.lit(" "))
    kept = rows.filter(~F.col("dropped")) if "dropped" in rows.columns else rows
    plain = kept.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"), F.lit(1).alias("part")).withColumn("digest", F.sha2("text", 256))
    both = plain.unionByName(audits).repartition("conv_id").sortWithinPartitions("conv_id", "part", "turn", "role", "digest")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flat() -> Iterator[tuple]:
            for batch in slices(batches):
                yield from zip(*(batch.column(c).to_pylist() for c in ("conv_id", "part", "role", "text")), strict=True)

        def results() -> Iterator[tuple]:
            source = flat()
            for conversation, _, _, audit in source:  # the audit; as many rows follow as its labels read
                edits = applied(audit, ((role, text) for _, _, role, text in source))
                n = -1
                for n, edit in enumerate(edits):
                    yield (conversation, n, *edit)

        for row in results():
            yield row

    def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds: list[pa.DataType] = []

        def told() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                kinds.append(batch.schema.field("conv_id").type)
                yield batch

        source = each(told())
        first = next(source, None)
        if first is not None:
            schema = pa.schema([("conv_id", kinds[0]), ("pos", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
            yield from _emitted(_chained(first, source), schema, 256)

    return both.mapInArrow(batches_of, f"conv_id {_conversation_type(rows)}, pos bigint, edit string, role string, text string")

