"""The policy and the reference data of the worked pipeline, kept apart from its queries."""

from __future__ import annotations

from dataclasses import astuple, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.classify import RULE_SCHEMA, Rule, read_rules
from plumbline.operators.govern import Fault
from plumbline.sources.relations import relation

# The line policy. Order decides; a line none of them covers is a hole.
LINE_RULES = [
    Rule("R1", 1, 2, "l_shipdate < o_orderdate", ("l_shipdate", "o_orderdate"), "REJECT"),
    Rule(
        "R2", 2, 1, "l_returnflag = 'R' AND l_linestatus = 'O'",
        ("l_returnflag", "l_linestatus"), "REVIEW",
    ),
    Rule("R3", 3, 3, "l_discount >= 0.08", ("l_discount",), "DISCOUNT"),
    Rule("R4", 4, 1, "l_returnflag = 'N'", ("l_returnflag",), "ACCEPT"),
]

# The next version: R3 from 0.07 on.
LINE_RULES_NEXT = [
    replace(r, predicate="l_discount >= 0.07") if r.rule_id == "R3" else r for r in LINE_RULES
]

# R2 before R1, the rule-order fault.
LINE_RULES_SWAPPED = [
    replace(r, ord={"R1": 2, "R2": 1}.get(r.rule_id, r.ord)) for r in LINE_RULES
]

VERSIONS = {"current": LINE_RULES, "next": LINE_RULES_NEXT, "swapped": LINE_RULES_SWAPPED}


def policy_relation(spark: SparkSession) -> DataFrame:
    """All versions of the line policy as one relation of rules."""
    rows = [(name, *astuple(r)[:4], list(r.reads), r.disposition) for name, rules in VERSIONS.items() for r in rules]
    return relation(spark, f"version string, {RULE_SCHEMA}", rows)


def line_policy(spark: SparkSession, version: str = "current") -> list[Rule]:
    """A version of the line policy as queries get it: read from the relation."""
    return read_rules(policy_relation(spark).where(F.col("version") == version))


# The event policy.
EVENT_RULES = [
    Rule("E1", 1, 1, "event_type = 'error'", ("event_type",), "FAILED"),
    Rule("E2", 2, 1, "event_type = 'purchase'", ("event_type",), "SOLD"),
    Rule("E3", 3, 1, "value >= 100", ("value",), "LARGE"),
]

# Code meanings.
STATUS = [("F", "FILLED"), ("O", "OPEN"), ("P", "PENDING")]
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
BANDS = [("LOW", 0.0, 10.0), ("MID", 10.0, 50.0), ("HIGH", 50.0, 100.0), ("TOP", 100.0, None)]

# The faults of the comparison and the stage each belongs to. A condition says
# which rows a value fault changes; all rows of every table run through the pipeline.
FAULTS = [
    Fault("F1", 1, "price", "price * 100", "l_orderkey % 97 = 0"),
    Fault("F2", 2, "status_meaning", "'FILLED'", "o_orderstatus = 'P'"),
    Fault("F3", 3, "customer_key", "customer_key + 1", "customer_key % 50 = 0"),
    Fault("F4", 3),
    Fault("F5", 4),
    Fault("F6", 5),
    Fault("F7", 6),
    Fault("F8", 7),
]
FAULT = {f.fault_id: f for f in FAULTS}
