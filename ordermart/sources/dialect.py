"""SRC-3: SQL written for a PostgreSQL warehouse, run by Spark.

Spark reads most of such SQL as it is. What it reads differently is respelled,
clause by clause, before ``spark.sql`` gets the statement:

* ``numeric`` without digits is ``decimal(10,0)`` in Spark: it becomes
  ``decimal(38,12)``; ``double precision``, ``float8``, ``int4`` and ``int8``
  casts get Spark's names;
* ``EXTRACT(DOW FROM x)`` counts from Sunday = 0: a temporary SQL function;
* ``CORR(x, y)`` of constant input is null rather than an error;
* ``ORDER BY`` puts nulls last, or first with ``DESC``, where it doesn't say;
* double quotes are names, not strings.

Text in quotes and comments is left alone.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from ordermart.sources.views import register_views

#: Temporary SQL functions that the respelled text calls.
FUNCTIONS = {
    "warehouse_dow": "(t TIMESTAMP_NTZ) RETURNS BIGINT RETURN CAST(dayofweek(t) - 1 AS BIGINT)",
    "warehouse_share": "(x DOUBLE, y DOUBLE) RETURNS DOUBLE RETURN x / nullif(y, 0D)",
}
#: Type names of casts, as the warehouse and as Spark spells them.
TYPES = {"double precision": "double", "float8": "double", "int4": "int", "int8": "bigint", "numeric": "decimal(38,12)"}

QUOTED = re.compile(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|--[^\n]*|/\*.*?\*/", re.S)
#: What ends an ORDER BY besides a closing parenthesis.
ENDS = re.compile(r"\b(?:LIMIT|OFFSET|FETCH|ROWS|RANGE|GROUPS|UNION|EXCEPT|INTERSECT)\b|;", re.I)


def _items(sql: str, start: int, ends: re.Pattern | None = None) -> tuple[list[str], int]:
    """The parts between top-level commas from ``start`` on, up to the closing
    parenthesis, a top-level match of ``ends`` or the end; and where that is."""
    depth, parts, begun, k = 0, [], start, start
    while k < len(sql):
        c = sql[k]
        if depth == 0 and (c == ")" or (ends and ends.match(sql, k))):
            break
        depth += (c == "(") - (c == ")")
        if c == "," and depth == 0:
            parts.append(sql[begun:k])
            begun = k + 1
        k += 1
    return [*parts, sql[begun:k]], k


def _nulls(item: str) -> str:
    """A sort key with the place of its nulls."""
    bare = item.rstrip()
    if not bare.strip() or re.search(r"\bNULLS\s+(?:FIRST|LAST)$", bare, re.I):
        return item
    place = " NULLS FIRST" if re.search(r"\bDESC$", bare, re.I) else " NULLS LAST"
    return bare + place + item[len(bare) :]


def to_spark(sql: str) -> str:
    """A statement in the warehouse's SQL as Spark must read it."""
    held: list[str] = []

    def hold(match: re.Match) -> str:
        text = match.group()
        if text.startswith('"'):
            text = "`" + text[1:-1].replace('""', '"').replace("`", "``") + "`"
        held.append(text if not text.startswith("--") else text + "\n")
        return f"\x00{len(held) - 1}\x00"

    sql = QUOTED.sub(hold, sql)
    for name, ours in TYPES.items():
        pattern = name.replace(" ", r"\s+") + r"\b(?!\s*\()"
        sql = re.sub(r"::\s*" + pattern, f"::{ours}", sql, flags=re.I)
        sql = re.sub(r"(\bCAST\s*\((?:[^()]|\([^()]*\))*\bAS\s+)" + pattern, rf"\g<1>{ours}", sql, flags=re.I)
    sql = re.sub(r"\bEXTRACT\s*\(\s*DOW\s+FROM\b", "warehouse_dow(", sql, flags=re.I)
    out, rest = "", sql
    while match := re.search(r"\bCORR\s*\(", rest, re.I):
        (x, y), end = _items(rest, match.end())
        # An aggregate's FILTER, if any, belongs to each of the three.
        only = re.match(r"\)\s*(FILTER\s*\()", rest[end:], re.I)
        after, filtered = end + 1, ""
        if only:
            conditions, close = _items(rest, end + only.end())
            filtered, after = f" FILTER ({','.join(conditions)})", close + 1
        x, y = (f"CAST(({v}) AS DOUBLE)" for v in (x, y))
        both = [f"stddev_pop(CASE WHEN {b} IS NOT NULL THEN {a} END){filtered}" for a, b in ((x, y), (y, x))]
        out += rest[: match.start()] + f"warehouse_share(covar_pop({x}, {y}){filtered}, {both[0]} * {both[1]})"
        rest = rest[after:]
    sql = out + rest
    place = 0
    while match := re.compile(r"\bORDER\s+BY\b", re.I).search(sql, place):
        items, end = _items(sql, match.end(), ENDS)
        keys = ",".join(map(_nulls, items))
        sql = sql[: match.end()] + keys + sql[end:]
        place = match.end()
    return re.sub("\x00(\\d+)\x00", lambda m: held[int(m.group(1))], sql)


def register_functions(spark: SparkSession) -> None:
    for name, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")


def run_warehouse_sql(spark: SparkSession, tables: Mapping[str, DataFrame], sql: str) -> DataFrame:
    """``sql`` in the warehouse's dialect over ``tables`` (a lazy DataFrame)."""
    register_views(tables)
    register_functions(spark)
    return spark.sql(to_spark(sql).rstrip().rstrip(";"))
