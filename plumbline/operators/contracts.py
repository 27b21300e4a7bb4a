"""Contracts as data, and the gate that runs them in one pass (VF-13).

A contract is a row of a relation. The gate does not run one query per contract. Each relation is
scanned once, whatever the number of contracts on it, and every row gives *entries*
``(slot, key, side, amount)``:

- a check of the row alone (``cause``, ``unit``, ``provenance``) gives an entry only where it fails;
- a check of keys gives an entry per row: ``grain`` on one side; ``domain``, ``fk``, ``keys``, ``fanout``,
  ``measure``, ``rows`` and ``equal`` on two, where the other relation gives entries with side 1.

One aggregation by slot and key, combined before the shuffle, counts both sides and adds up their
amounts; each contract then is a condition on those numbers. Contracts on the same edge and key
share a slot, and so does a grain contract on one of its sides. Only violations are counted further.
A key that is a digest travels as its 16 bytes, a row of ``equal`` as its fingerprint beside its key.
With ``sums_first`` the keys of an edge are first added up by bucket on either side, which shuffles
next to nothing; equal bags hold equal keys, so only keys of buckets that differ are entries. Checks of
the row alone are then counted where the rows are, and the keys of a grain shuffled as hashes of 8 bytes,
of which only those that repeat are looked at as keys.
``time`` needs the order of versions and keeps a window of its own; ``schema`` reads no row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import astuple, dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

from plumbline.functions.values import NULL_MARK, row_fingerprint
from plumbline.operators.verify import check_schema, check_time
from plumbline.sources.relations import relation
from plumbline.sources.shared import checked_keys

CONTRACT_SCHEMA = (
    "stage int, scope string, check string, kind string, relation string, other string, "
    "grain array<string>, reads array<string>, unit string, time_semantics string, rule_id string, "
    "disposition string, limits array<double>"
)
CONTRACT_FIELDS = ["grain", "unit", "time_semantics", "evidence", "rule_id", "disposition"]
# Contracts, and the rules of a policy, are read on the driver to become expressions.
MAX_CONTRACTS = MAX_RULES = 2_000
AMOUNT = "decimal(38,6)"
# Keys that are digests travel as 16 bytes.
DIGEST = "^[0-9a-f]{32}$"
# An edge is compared by so many sums a side first.
BUCKETS = 1024


@dataclass(frozen=True)
class Contract:
    """One contract on a stage or an edge, as a row of data. ``kind`` is the check to run on
    ``relation`` (and ``other``, where it compares two; for ``rows`` several, joined by ``+``); ``grain``
    names the columns that identify a row, ``reads`` those the check looks at. ``unit`` and
    ``time_semantics`` say what values mean, ``rule_id`` and ``disposition`` who decides on a violation
    and what becomes of it; ``limits`` are the bounds of a plausible ratio."""

    stage: int
    scope: str
    check: str
    kind: str
    relation: str
    other: str | None
    grain: tuple[str, ...]
    reads: tuple[str, ...]
    unit: str | None
    time_semantics: str | None
    rule_id: str
    disposition: str
    limits: tuple[float, ...] = ()


def contracts_relation(spark: SparkSession, contracts: Sequence[Contract]) -> DataFrame:
    return relation(spark, CONTRACT_SCHEMA, [astuple(c) for c in contracts])


def read_contracts(contracts: DataFrame) -> list[Contract]:
    """The contracts in order; refuses a relation beyond ``MAX_CONTRACTS``."""
    fields = [part.split()[0] for part in CONTRACT_SCHEMA.split(", ")]
    rows = contracts.select(*fields).orderBy("stage", "scope", "check").take(MAX_CONTRACTS + 1)
    if len(rows) > MAX_CONTRACTS:
        raise ValueError("too many contracts for one gate")
    return [Contract(*[tuple(v) if isinstance(v, list) else v for v in r]) for r in rows]


def named(df: DataFrame, columns: Sequence[str]) -> Column:
    """Columns as one text; NULL is a value."""
    parts = []
    for c in columns:
        binary = isinstance(df.schema[c].dataType, BinaryType)
        text = F.lower(F.hex(c)) if binary else F.col(c).cast("string")
        if isinstance(df.schema[c].dataType, StringType) and len(columns) > 1:
            text = F.replace(text, F.lit("|"), F.lit("\\|"))
        parts.append(F.coalesce(text, F.lit(NULL_MARK)))
    return parts[0] if len(parts) == 1 else F.concat_ws("|", *parts)


def key_parts(df: DataFrame, columns: Sequence[str]) -> tuple[Column, Column]:
    """``named`` in two parts of which one is NULL: the 16 bytes of a digest, or the text."""
    text = named(df, columns)
    kind = df.schema[columns[0]].dataType if len(columns) == 1 else None
    if isinstance(kind, BinaryType):
        own = F.col(columns[0])
        short = F.coalesce(F.octet_length(own) == 16, F.lit(False))
        return F.when(short, own), F.when(~short, text)
    if isinstance(kind, StringType):
        short = text.rlike(DIGEST)
        return F.when(short, F.unhex(text)), F.when(~short, text)
    return F.lit(None).cast("binary"), text


class Gate:
    """Entries by relation, and conditions by slot."""

    def __init__(self, frames: Mapping[str, DataFrame]):
        self.frames = frames
        self.slots: dict[tuple, int] = {}
        self.entries: dict[str, list[tuple]] = {}
        self.tests: list[Column] = []
        self.found: list[Column] = []
        self.kinds: dict[int, dict[str, list[int]]] = {}
        self.measured = self.whole_rows = False
        self.apart: dict[int, DataFrame] = {}
        self.known: dict[int, int] = {}

    def key(self, frame: str, columns: Sequence[str]) -> tuple[Column, Column]:
        return key_parts(self.frames[frame], columns)

    def slot(self, name: tuple) -> tuple[int, bool]:
        """Its number, and whether it is new."""
        fresh = name not in self.slots
        return self.slots.setdefault(name, len(self.slots)), fresh

    def give(
        self, frame: str, slot: int, side: int, key: tuple[Column, Column], amount: Column | None = None,
        when: Column | None = None, row: Column | None = None,
    ) -> None:
        """An entry of each row of ``frame``, or of those of ``when``. ``row`` is the fingerprint of the whole row."""
        self.measured = self.measured or amount is not None
        self.whole_rows = self.whole_rows or row is not None
        self.entries.setdefault(frame, []).append((slot, side, key, amount, when, row))

    def entry(self, slot: int, side: int, key: tuple[Column, Column], amount: Column | None, row: Column | None) -> Column:
        fields = [F.lit(slot).alias("slot"), key[0].alias("short"), key[1].alias("text"), F.lit(side).alias("side")]
        if self.measured:
            fields.append((F.lit(None) if amount is None else amount).try_cast(AMOUNT).alias("amount"))
        if self.whole_rows:
            # Rows are compared within their key, so beside a digest 64 bits tell them apart.
            none = F.lit(None).cast("bigint")
            halves = [none, none] if row is None else [row["a"], F.when(key[0].isNull(), row["b"])]
            fields += [halves[0].alias("a"), halves[1].alias("b")]
        return F.struct(*fields)

    def test(
        self, no: int, slot: int, condition: Column, weight: Column | None = None, kind: str | None = None
    ) -> None:
        """Contract ``no`` is violated by the keys of a slot for which ``condition`` holds."""
        count = (F.lit(1) if weight is None else weight).cast("bigint")
        found = (F.col("slot") == slot) & condition
        self.found.append(F.coalesce(found, F.lit(False)))
        self.kinds.setdefault(slot, {}).setdefault(kind or "other", []).append(no)
        self.tests.append(F.when(found, F.struct(F.lit(no).alias("no"), count.alias("n"), F.col("key").alias("shown"))))

    def row(self, no: int, c: Contract, bad: Column) -> None:
        """A check of single rows: those that fail count each."""
        slot, _ = self.slot(("row", no))
        self.give(c.relation, slot, 0, self.key(c.relation, c.grain), when=F.coalesce(bad, F.lit(False)))
        self.test(no, slot, F.lit(True), F.col("n0"), kind="row")

    def edge(self, c: Contract, left: Sequence[str], right: Sequence[str], measure: str | None = None) -> int:
        """The slot of two relations' keys."""
        slot, fresh = self.slot(("edge", c.relation, c.other, tuple(left), tuple(right), measure))
        if fresh:
            for side, frame, key in ((0, c.relation, left), (1, c.other, right)):
                self.give(frame, slot, side, self.key(frame, key), amount=None if measure is None else F.col(measure))
        return slot

    def values(self, no: int, c: Contract, null_is_legal: bool) -> None:
        """Values of one column that the other relation's does not have; each counts once."""
        own, legal = c.reads[0], c.reads[1]
        slot, fresh = self.slot(("values", c.relation, c.other, own, legal, null_is_legal))
        if fresh:
            when = F.col(own).isNotNull() if null_is_legal else None
            self.give(c.relation, slot, 0, self.key(c.relation, [own]), when=when)
            self.give(c.other, slot, 1, self.key(c.other, [legal]), when=F.col(legal).isNotNull())
        self.test(no, slot, (F.col("n0") > 0) & (F.col("n1") == 0))

    def grain(self, no: int, c: Contract) -> None:
        for name, slot in self.slots.items():
            if name[0] == "edge" and (name[1], name[3]) == (c.relation, c.grain):
                return self.test(no, slot, F.col("n0") > 1)
            if name[0] == "edge" and (name[2], name[4]) == (c.relation, c.grain):
                return self.test(no, slot, F.col("n1") > 1)
        slot, fresh = self.slot(("grain", c.relation, c.grain))
        if fresh:
            self.give(c.relation, slot, 0, self.key(c.relation, c.grain))
        return self.test(no, slot, F.col("n0") > 1, kind="grain")

    def add(self, no: int, c: Contract) -> None:
        n0, n1 = F.col("n0"), F.col("n1")
        if c.kind == "grain":
            self.grain(no, c)
        elif c.kind in ("domain", "fk"):
            self.values(no, c, null_is_legal=c.kind == "fk")
        elif c.kind == "cause":
            self.row(no, c, F.col(c.reads[1]) < F.col(c.reads[0]))
        elif c.kind == "unit":
            measure, unit, reference = map(F.col, c.reads)
            implied = F.try_divide(measure.cast("double"), reference.cast("double"))
            plausible = (implied >= c.limits[0]) & (implied <= c.limits[1])
            self.row(no, c, ~(unit.eqNullSafe(c.unit) & F.coalesce(plausible, F.lit(False))))
        elif c.kind == "provenance":
            self.row(no, c, self.unproven(c))
        elif c.kind in ("keys", "fanout", "measure"):
            slot = self.edge(c, c.grain, c.grain, c.reads[0] if c.kind == "measure" else None)
            uneven = (n0 == 0) | (n1 == 0)
            moved = ~F.col("a0").eqNullSafe(F.col("a1"))
            found = {"keys": uneven, "fanout": (n0 > 0) & (n1 > n0), "measure": uneven | moved}
            self.test(no, slot, found[c.kind], kind=c.kind)
        elif c.kind == "rows":
            slot, _ = self.slot(("rows", no))
            for side, frame in [(0, c.relation), *[(1, other) for other in c.other.split("+")]]:
                self.give(frame, slot, side, (F.lit(None).cast("binary"), F.lit("rows")))
            self.test(no, slot, n0 != n1, F.abs(n0 - n1))
        elif c.kind == "equal":
            slot, _ = self.slot(("equal", no))
            columns = self.frames[c.relation].columns
            for side, frame in ((0, c.relation), (1, c.other)):
                self.give(frame, slot, side, self.key(frame, c.grain), row=row_fingerprint(columns))
            self.test(no, slot, n0 != n1)
        elif c.kind == "time":
            faults = check_time(self.frames[c.relation], list(c.grain))
            self.apart[no] = faults.select(F.lit(no).alias("no"), F.lit(1).cast("bigint").alias("n"), named(faults, [*c.grain, "fault"]).alias("shown"))
        elif c.kind == "schema":
            self.known[no] = check_schema(self.frames[c.relation], self.frames[c.other].schema).count()
        else:
            raise ValueError(f"no such kind of contract: {c.kind}")

    def unproven(self, c: Contract) -> Column:
        """Rule id, disposition or evidence absent, or not of the policy. An empty evidence map is
        legal only where the rule reads nothing."""
        rules = self.frames[c.other].select("rule_id", "disposition", F.size("reads")).take(MAX_RULES + 1)
        if len(rules) > MAX_RULES:
            raise ValueError("too many rules for one gate")
        reads = F.lit(None).cast("int")
        if rules:
            pairs = [part for r, said, n in rules for part in (F.lit(f"{r}|{said}"), F.lit(n))]
            reads = F.try_element_at(F.create_map(*pairs), F.concat_ws("|", "rule_id", "disposition"))
        absent = F.col("rule_id").isNull() | F.col("disposition").isNull()
        return absent | reads.isNull() | (F.coalesce(F.size("evidence"), F.lit(0)) < reads)

    def compare_sums(self) -> None:
        """Edges that only ask which keys there are, and how often: their keys are added up by bucket, and of
        each bucket with the same sums on both sides all entries are left out. The sums are those of a
        128-bit fingerprint in four parts, which cannot overflow. Runs one job."""
        named_slots = {slot for slot, kinds in self.kinds.items() if kinds.keys() <= {"keys", "fanout"}}
        bucket = lambda key: F.pmod(F.xxhash64(*key), F.lit(BUCKETS))
        out = None
        for frame, entries in self.entries.items():
            given = [
                F.struct(F.lit(slot).alias("slot"), F.lit(1 - 2 * side).cast("bigint").alias("sign"), bucket(key).alias("bucket"), *[
                    F.xxhash64(F.lit(seed), key[0].isNull(), *key).alias(half) for half, seed in (("a", 1), ("b", 2))
                ])
                for slot, side, key, _, when, _ in entries if slot in named_slots and when is None
            ]
            if given:
                part = self.frames[frame].select(F.inline(F.array(*given)))
                out = part if out is None else out.unionByName(part)
        if out is None:
            return
        low = lambda half: F.col(half).bitwiseAND(F.lit(0xFFFFFFFF))
        parts = [part for half in "ab" for part in (low(half), F.shiftrightunsigned(half, 32))]
        sums = [F.sum(F.col("sign")) != 0, *[F.sum(F.col("sign") * part) != 0 for part in parts]]
        differs = out.groupBy("slot", "bucket").agg(reduce(or_, sums).alias("differs")).where("differs")
        # At most BUCKETS numbers an edge.
        left: dict[int, list[int]] = {slot: [] for slot in named_slots}
        for row in differs.collect():
            left[row["slot"]].append(row["bucket"])
        for frame, entries in self.entries.items():
            kept = []
            for slot, side, key, amount, when, row in entries:
                if slot in named_slots and len(left[slot]) < BUCKETS:
                    if not left[slot]:
                        continue
                    when = bucket(key).isin(left[slot])
                kept.append((slot, side, key, amount, when, row))
            self.entries[frame] = kept
        self.entries = {frame: entries for frame, entries in self.entries.items() if entries}

    def set_apart(self, every: bool = True) -> None:
        """Checks that shuffle less on their own: rows that fail are counted where they are, and keys that
        should not repeat are told apart by a hash first; keys of one hash are then compared in full. Not
        with ``every`` check only that of rows of a relation that is read for nothing else."""
        for frame, entries in self.entries.items():
            kept = []
            if not every and (len(entries) > 1 or self.kinds[entries[0][0]].keys() != {"row"}):
                continue
            for slot, side, key, amount, when, row in entries:
                kinds, df = self.kinds[slot], self.frames[frame]
                shown = F.coalesce(key[1], F.lower(F.hex(key[0]))).alias("shown")
                if kinds.keys() == {"row"}:
                    found = df.where(when).select(shown).agg(F.count(F.lit(1)).alias("n"), F.min("shown").alias("shown"))
                elif kinds.keys() == {"grain"} and when is None:
                    hashed = df.select(F.xxhash64(key[0].isNull(), *key).alias("hash"), *[part.alias(name) for part, name in zip(key, ("short", "text"))])
                    again = hashed.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hash")
                    same = hashed.join(checked_keys(again), "hash", "left_semi").groupBy("short", "text").agg(F.count(F.lit(1)).alias("n"))
                    shown = F.coalesce("text", F.lower(F.hex("short"))).alias("shown")
                    found = same.where("n > 1").select(F.lit(1).cast("bigint").alias("n"), shown)
                else:
                    kept.append((slot, side, key, amount, when, row))
                    continue
                for no in [no for numbers in kinds.values() for no in numbers]:
                    self.apart[no] = found.select(F.lit(no).alias("no"), "n", "shown")
            self.entries[frame] = kept
        self.entries = {frame: entries for frame, entries in self.entries.items() if entries}

    def violations(self) -> DataFrame | None:
        """``no, n, shown`` per violation. Entries that are absent are dropped once they are rows, and
        only keys that violate a contract are opened: a higher-order filter on arrays would take the
        expressions that make entries out of generated code."""
        out = None
        for frame, given in self.entries.items():
            entries = []
            for slot, side, key, amount, when, row in given:
                entry = self.entry(slot, side, key, amount, row)
                entries.append(entry if when is None else F.when(when, entry))
            part = self.frames[frame].select(F.explode(F.array(*entries)).alias("e")).where("e IS NOT NULL").select("e.*")
            out = part if out is None else out.unionByName(part)
        if out is not None:
            side = lambda n: F.col("side") == n
            counts = {f"n{n}": F.count_if(side(n)) for n in (0, 1)}
            # Amounts are summed only where a contract compares them.
            if self.measured:
                counts |= {f"a{n}": F.sum(F.when(side(n), F.col("amount"))) for n in (0, 1)}
            by = ["slot", "short", "text", *(["a", "b"] if self.whole_rows else [])]
            counted = out.groupBy(*by).agg(*[c.alias(name) for name, c in counts.items()])
            wrong = counted.where(reduce(or_, self.found)).withColumn("key", F.coalesce("text", F.lower(F.hex("short"))))
            out = wrong.select(F.explode(F.array(*self.tests)).alias("e")).where("e IS NOT NULL").select("e.*")
        for part in self.apart.values():
            out = part if out is None else out.unionByName(part)
        return out


def contract_gate(
    contracts: DataFrame, frames: Mapping[str, DataFrame], sums_first: bool = False
) -> DataFrame:
    """VF-13 from data: one row per contract with its violations and what it carries: grain,
    unit, time semantics, evidence (the columns it reads), rule id, and the disposition that its
    violations get (``NONE`` where there are none). ``sums_first`` is for stored relations that
    most often agree, as it reads their keys twice where they do not."""
    rows = read_contracts(contracts)
    gate = Gate(frames)
    # Edges first, so that grain contracts find their slots.
    for no, c in sorted(enumerate(rows), key=lambda r: r[1].kind == "grain"):
        gate.add(no, c)
    if sums_first:
        gate.compare_sums()
    gate.set_apart(sums_first)
    carried = relation(
        contracts.sparkSession,
        "no int, stage int, scope string, check string, grain string, unit string, time_semantics string, "
        "evidence string, rule_id string, _said string, _known bigint",
        [
            (no, c.stage, c.scope, c.check, ",".join(c.grain), c.unit, c.time_semantics, ",".join(c.reads),
             c.rule_id, c.disposition, gate.known.get(no, 0))
            for no, c in enumerate(rows)
        ],
    )
    found = gate.violations()
    if found is None:
        found = carried.select("no", F.lit(0).cast("bigint").alias("n"), F.lit(None).cast("string").alias("shown")).limit(0)
    summed = found.groupBy("no").agg(F.sum("n").alias("_n"), F.min("shown").alias("sample_key"))
    violations = F.coalesce("_n", F.lit(0)) + F.col("_known")
    return (
        carried.join(summed, "no", "left")
        .withColumn("violations", violations)
        .withColumn("passed", F.col("violations") == 0)
        .withColumn("disposition", F.when(F.col("passed"), F.lit("NONE")).otherwise(F.col("_said")))
        .select("stage", "scope", "check", "violations", "sample_key", "passed", *CONTRACT_FIELDS)
    )
