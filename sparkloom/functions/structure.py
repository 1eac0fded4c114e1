"""Counts of what gives a statement its structure, by rules over its text.

Literals and comments are taken out first, so words inside them count for nothing. No parser runs:
the rules are deterministic, never time out and give a row for statements that do not parse.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkloom.functions.text import deepest_parentheses

#: What each metric counts, as a pattern over the cleaned statement in upper case.
PATTERNS = {
    "node_count": r"[A-Z0-9_]+|[^A-Z0-9_\s]",
    "with_count": r"\bWITH\b",
    "cte_count": r"(?:\bWITH(?:\s+RECURSIVE)?\s+|,\s*)[A-Z0-9_]+\s+AS\s*\(",
    "lateral_view_count": r"\bLATERAL\b",
    "window_func_count": r"\bOVER\s*\(",
    "distinct_count": r"\bDISTINCT\b",
    "having_count": r"\bHAVING\b",
    "case_when_count": r"\bCASE\b",
    "coalesce_null_if_count": r"\b(?:COALESCE|NULLIF|NVL|IFNULL)\s*\(",
    "union_count": r"\bUNION\b",
    "union_all_count": r"\bUNION\s+ALL\b",
    "subquery_count": r"\(\s*SELECT\b",
}
#: What is taken out, and what takes its place.
NOISE = ((r"'[^']*'", "''"), (r"--[^\n]*", " "), (r"(?s)/\*.*?\*/", " "))


def cleaned(query: Column) -> Column:
    """The statement in upper case, without literals and comments."""
    out = F.coalesce(query, F.lit(""))
    for pattern, instead in NOISE:
        out = F.regexp_replace(out, pattern, instead)
    return F.upper(out)


def structure_metrics(query: Column) -> dict[str, Column]:
    """The metrics by name, as integers; zeros for a null statement.

    A CTE's body is no subquery, UNION ALL is no UNION; depth is that of parentheses, breadth the
    number of listed items, and max_branches the most WHENs between one CASE and the next.
    """
    u = cleaned(query)
    found = {name: F.regexp_count(u, F.lit(pattern)) for name, pattern in PATTERNS.items()}
    found["subquery_count"] = F.greatest(found["subquery_count"] - found["cte_count"], F.lit(0))
    found["union_count"] = found["union_count"] - found["union_all_count"]
    cases = F.split(u, r"\bCASE\b", -1)
    branches = F.transform(F.slice(cases, F.lit(2), F.size(cases)), lambda x: F.regexp_count(x, F.lit(r"\bWHEN\b")))
    found["max_branches"] = F.coalesce(F.array_max(branches), F.lit(0))
    found["depth"] = deepest_parentheses(u).cast("int")
    found["breadth"] = F.regexp_count(u, F.lit(",")) + 1
    return {name: value.cast("int") for name, value in found.items()}
