"""Shared pieces of the check SQL. It is written apart from the operators, in another
engine's dialect, so that the two can disagree."""

LINE_KEY = """md5(concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber,
    CAST(l_quantity AS DECIMAL(18,2)), CAST(l_extendedprice AS DECIMAL(18,2)),
    CAST(l_discount AS DECIMAL(4,2)), CAST(l_tax AS DECIMAL(4,2)),
    l_returnflag, l_linestatus, strftime(l_shipdate, '%Y-%m-%d')))"""

OPEN_END = "TIMESTAMP '9999-12-31 00:00:00'"

KEYED = f"keyed AS (SELECT {LINE_KEY} AS record_key, * FROM lineitem)"
JOINED = f"{KEYED}, joined AS (SELECT * FROM keyed JOIN orders ON l_orderkey = o_orderkey)"


def history(orders: str = "orders", prefix: str = "") -> str:
    """CTEs ending in ``{prefix}hist``."""
    return f"""{prefix}day AS (
      SELECT o_custkey, o_orderdate, max_by(o_orderpriority, o_orderkey) AS p
      FROM {orders} GROUP BY o_custkey, o_orderdate),
    {prefix}lagged AS (
      SELECT *, lag(p) OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS prev FROM {prefix}day),
    {prefix}hist AS (
      SELECT o_custkey, o_orderdate AS valid_from,
        coalesce(lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate), {OPEN_END}) AS valid_to,
        p AS o_orderpriority,
        lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate) IS NULL AS is_current
      FROM {prefix}lagged WHERE prev IS NULL OR prev <> p)"""


HISTORY_OUT = """SELECT o_custkey, strftime(valid_from, '%Y-%m-%d') AS valid_from,
  strftime(valid_to, '%Y-%m-%d') AS valid_to, o_orderpriority, is_current"""


def rule(first: str = "R1", second: str = "R2", discount: str = "0.08") -> str:
    tests = {
        "R1": "l_shipdate < o_orderdate",
        "R2": "l_returnflag = 'R' AND l_linestatus = 'O'",
    }
    return f"""CASE WHEN {tests[first]} THEN '{first}' WHEN {tests[second]} THEN '{second}'
      WHEN l_discount >= {discount} THEN 'R3' WHEN l_returnflag = 'N' THEN 'R4' ELSE 'HOLE' END"""


RULE = rule()
