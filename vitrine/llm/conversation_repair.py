"""Repair of conversations: faults of turns, the cheapest audit of edits, the repaired turns.

1. ``plan`` looks at what each turn amounts to: its number, its role, the digest of role and text,
   blank or truncated. These small rows are dealt by conversation, sorted, and read as a stream;
   a byte per turn goes into the search over the edit lattice (``edit_lattice``).
2. ``repaired`` and ``report`` deal the turns themselves in the same way, the audit of each
   conversation before them, and edit or hash them one by one.

No task holds a conversation's texts: it keeps a byte and a digest per turn in the first step and
the audit in the second, so a conversation with very many turns costs time in one task, which its
one audit and one running digest ask for, but not memory by its texts.

Defined cases: a null role or text is one space. Turns without a number come first. Turns of one
number are taken by role, then by the digest of role and text. Turns without a conversation are a
conversation of their own, the null one. A role with another initial than s, u, a, or an empty
one, is illegal beside any other and cannot be kept. Repeated turns are duplicates. Conversations
of ``keys`` without turns get zeros and an empty audit. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .edit_lattice import ASSISTANT, DELETE, EMPTY, FINE, SYSTEM, TRUNCATED, USER, after, cheapest

INITIALS = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
ROLES = {USER: "user", ASSISTANT: "assistant"}
LEGAL = {"su", "ua", "au"}
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
OUT_ROWS = 2_000


def _turns(turns: DataFrame, key: str) -> DataFrame:
    """key, turn, role, text and the digest of both."""
    filled = turns.select(F.col(key).alias(key), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    return filled.withColumn("digest", F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256)))


def damaged(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """Turns with planted faults, by crc32("key:turn") % 20.

    0 drops a turn, 1 empties its text, 2 removes its sentence ends, 3 repeats it, 4 makes it a user's.
    """
    part = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    way = F.crc32(F.concat(part(key), F.lit(":"), part("turn")).cast("binary")) % 20
    text = F.when(way == 1, "").when(way == 2, F.regexp_replace(part("text"), "[.!?]", "")).otherwise(part("text"))
    role = F.when(way == 4, "user").otherwise(part("role"))
    copies = F.when(way == 0, 0).when(way == 3, 2).otherwise(1)
    out = turns.select(key, F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), F.array_repeat(F.lit(0), copies).alias("copy"))
    return out.select(key, "turn", "role", "text", F.explode("copy")).drop("col")


def _streamed(rows: DataFrame, key: str, *order) -> DataFrame:
    """All rows of a conversation behind one another in one partition."""
    return rows.repartition(F.col(key)).sortWithinPartitions(F.col(key).asc_nulls_first(), *order)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _packed(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    size = 0
    for r in rows:
        held.append(r)
        size += 50 + sum(len(x) for x in r if isinstance(x, str))
        if len(held) >= OUT_ROWS or size > 8_000_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


class _Plan:
    """What one conversation's turns, given in order, add up to."""

    def __init__(self, key):
        self.key, self.codes, self.seen, self.before = key, bytearray(), set(), None
        self.turns, self.first, self.last = 0, None, None
        self.n = dict.fromkeys(COUNTS, 0)

    def add(self, turn, initial: str, digest: bytes, blank: bool, open_end: bool) -> None:
        if turn is not None and turn != self.last:
            self.turns, self.last = self.turns + 1, turn
            self.first = turn if self.first is None else self.first
        again = digest in self.seen
        self.seen.add(digest)
        fault = "blank" if blank else "duplicate" if again else "truncated" if open_end else None
        if fault:
            self.n[fault] += 1
        if self.before is not None:
            self.n["illegal"] += self.before + initial not in LEGAL
        self.before = initial
        self.codes.append(INITIALS.get(initial, 0) + (FINE if fault is None else TRUNCATED if fault == "truncated" else DELETE))

    def row(self) -> tuple:
        cost, audit = cheapest(bytes(self.codes))
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        return (self.key, gaps, *(self.n[c] for c in COUNTS[1:-1]), cost, audit)


def plan(turns: DataFrame, keys: DataFrame | None = None, key: str = "conv_id") -> DataFrame:
    """One row per conversation: key, gaps, blank, duplicate, truncated, illegal, cost, audit.

    ``keys`` holds keys that are reported even without a turn; each key is reported once.
    """
    space = r"\x20\x09-\x0D"
    rows = _turns(turns, key).select(
        key, "turn", "role", "digest", (~F.col("text").rlike(f"[^{space}]")).alias("blank"), (~F.col("text").rlike(rf"[.!?][{space}]*\z")).alias("open_end"), F.lit(True).alias("real"))
    if keys is not None:
        named = keys.select(F.col(key).alias(key)).distinct()
        rows = rows.unionByName(named.withColumn("real", F.lit(False)), allowMissingColumns=True)
    kind = rows.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), *(T.StructField(c, T.LongType()) for c in COUNTS), T.StructField("audit", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def plans() -> Iterator[tuple]:
            now = None
            for k, turn, role, digest, blank, open_end, real in _rows(batches):
                if now is None or k != now.key:
                    if now is not None:
                        yield now.row()
                    now = _Plan(k)
                if real:
                    now.add(turn, role[:1], digest, blank, open_end)
            if now is not None:
                yield now.row()

        yield from _packed(plans(), arrow)

    arrow = to_arrow_schema(schema)
    return _streamed(rows, key, F.col("turn").asc_nulls_first(), "role", "digest").mapInArrow(run, schema)


def _with_audits(turns: DataFrame, plans: DataFrame, key: str) -> DataFrame:
    """Turns behind the plan of their conversation, streamed by conversation."""
    rows = _turns(turns, key).unionByName(plans.select(key, F.struct(*COUNTS, "audit").alias("plan")), allowMissingColumns=True)
    ordered = _streamed(rows, key, F.col("plan").isNull(), F.col("turn").asc_nulls_first(), "role", "digest")
    return ordered.select(key, "plan", "role", "text")


def _edited(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(key, plan, letter, role, text) of each plan and, behind it, of each of its edits."""
    now = None
    for k, p, role, text in rows:
        if p is not None:
            if now is not None:
                yield from now.inserts()
            now = _Edits(k, p["audit"])
            yield k, p, None, None, None
        else:
            yield from now.inserts()
            yield now.edit(role, text)
    if now is not None:
        yield from now.inserts()


class _Edits:
    """The place in a conversation's audit."""

    def __init__(self, key, audit: str):
        self.key, self.audit, self.at, self.state = key, audit, 0, EMPTY

    def inserts(self) -> Iterator[tuple]:
        """The inserts before the next turn."""
        while self.audit[self.at : self.at + 1] == "I":
            self.at, self.state = self.at + 1, after(self.state, "I")
            yield self.key, None, "I", ROLES[self.state], ""

    def edit(self, role: str, text: str) -> tuple:
        letter = self.audit[self.at]
        self.at, self.state = self.at + 1, after(self.state, letter, INITIALS.get(role[:1], 0))
        return self.key, None, letter, ROLES[self.state] if letter == "R" else role, text


def repaired(turns: DataFrame, plans: DataFrame, key: str = "conv_id") -> DataFrame:
    """The repaired turns: key, place (from 0), edit (K, R or I), role, text.

    ``plans`` is the result of ``plan`` for the same turns.
    """
    rows = _with_audits(turns, plans, key)
    schema = T.StructType([T.StructField(key, rows.schema[key].dataType), T.StructField("place", T.LongType()), *(T.StructField(c, T.StringType()) for c in ("edit", "role", "text"))])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def turns_out() -> Iterator[tuple]:
            place = 0
            for k, p, letter, role, text in _edited(_rows(batches)):
                if p is not None:
                    place = 0
                elif letter != "D":
                    yield k, place, letter, role, text
                    place += 1

        yield from _packed(turns_out(), arrow)

    return rows.mapInArrow(run, schema)


def report(turns: DataFrame, plans: DataFrame, key: str = "conv_id") -> DataFrame:
    """``plans`` with repaired_sha256, the digest of the repaired ``role:text`` lines, worked out turn by turn."""
    rows = _with_audits(turns, plans, key)
    schema = T.StructType([*plans.schema.fields, T.StructField("repaired_sha256", T.StringType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def hashed() -> Iterator[tuple]:
            now, digest, lines = None, None, 0
            for k, p, letter, role, text in _edited(_rows(batches)):
                if p is not None:
                    if now is not None:
                        yield (*now, digest.hexdigest())
                    now, digest, lines = (k, *p.values()), hashlib.sha256(), 0
                elif letter != "D":
                    digest.update((("\n" if lines else "") + role + ":" + text).encode())
                    lines += 1
            if now is not None:
                yield (*now, digest.hexdigest())

        yield from _packed(hashed(), arrow)

    return rows.mapInArrow(run, schema)
