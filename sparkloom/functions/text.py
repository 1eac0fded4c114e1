"""Column helpers over SQL text: counting, searching, table names, literals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns whose matches must equal the published feature definitions (fixed values).
FROM_NAME = r"(?i)FROM\s+([a-zA-Z0-9_.]+)"
JOIN_NAME = r"(?i)JOIN\s+([a-zA-Z0-9_.]+)"
# Starting at the head of a run finds the same names and keeps long runs linear.
THREE_PART = r"(?<![a-zA-Z0-9_])([a-zA-Z0-9_]++)\.([a-zA-Z0-9_]++)\.([a-zA-Z0-9_]++)"
TWO_PART = r"(?i)(?:FROM|JOIN)\s+([a-zA-Z0-9_]+)\.([a-zA-Z0-9_]+)"
IN_LIST = r"(?i)IN\s*\(([^)]+)\)"
WHERE_BODY = r"(?is)WHERE\s+(.*?)(?:GROUP BY|ORDER BY|LIMIT|HAVING|UNION|EXCEPT|INTERSECT|$)"
GROUP_BODY = r"(?s)GROUP BY\s+([^;]+?)(?:HAVING|ORDER BY|LIMIT|$)"
USE_BOTH = r"(?i)USE\s+([a-zA-Z0-9_]+)\.([a-zA-Z0-9_]+)"
USE_SCHEMA = r"(?i)USE\s+([a-zA-Z0-9_]+)(?:\s|$|;)"

# Literals and their placeholders, in the order in which they are replaced (fixed values).
LITERALS = (
    (r"\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}", " TIMESTAMP_VALUE "),
    (r"\d{4}-\d{2}-\d{2}", " DATE_VALUE "),
    (r"\d{2}/\d{2}/\d{4}", " DATE_VALUE "),
    (r"'[^']*'", " STRING_LITERAL "),
    (r'"[^"]*"', " STRING_LITERAL "),
    (r"\b\d+\b", " NUMERIC "),
)


def free_name(columns: list[str], name: str) -> str:
    """A column name that is not taken: the given one, with underscores in front as long as it is.

    Names that differ in case alone count as taken, as the session may not tell them apart.
    """
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def count_of(text: Column, part: str) -> Column:
    """Occurrences of a substring that do not overlap, as a double."""
    lost = F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))
    return (lost / F.lit(len(part))).cast("double")


def flag(condition: Column) -> Column:
    """1.0 where a condition holds, else 0.0."""
    return F.when(condition, 1.0).otherwise(0.0)


def has(text: Column, part: str) -> Column:
    """1.0 where a text holds a substring (not: a word)."""
    return flag(text.contains(part))


def has_keyword(text: Column, keyword: str, case_sensitive: bool = False) -> Column:
    """Whether a text holds a keyword; never for a null text or an empty keyword."""
    if not keyword:
        return F.lit(False)
    found = text.contains(keyword) if case_sensitive else F.upper(text).contains(keyword.upper())
    return F.coalesce(found, F.lit(False))


def count_pattern(text: Column, pattern: str) -> Column:
    """Matches of a pattern, in either case; 0 for a null text or an empty pattern."""
    return F.coalesce(F.regexp_count(text, F.lit(f"(?i){pattern}")), F.lit(0)) if pattern else F.lit(0)


def at_most_one(value: Column, scale: float) -> Column:
    """value / scale, cut at 1."""
    return F.least(value / F.lit(float(scale)), F.lit(1.0))


def safe_divide(a: Column, b: Column, default: float = 0.0) -> Column:
    """a / b, or the default where b is zero or null."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(default))


def clamp(value: Column, low: float, high: float) -> Column:
    """value within low and high."""
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def stable_bucket(text: Column, buckets: int) -> Column:
    """A bucket below `buckets` that depends on the text alone: the first 32 bits of its MD5."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint") % buckets


def hash_feature(text: Column, buckets: int) -> Column:
    """The bucket as a share; 0 for a missing or empty text."""
    return F.when(F.coalesce(text, F.lit("")) == "", 0.0).otherwise(stable_bucket(text, buckets) / float(buckets))


def strip(text: Column) -> Column:
    """The text without white space at its ends."""
    return F.regexp_replace(text, r"^\s+|(?<!\s)\s+$", "")


def table_names(query: Column) -> Column:
    """The distinct names after FROM and JOIN, sorted."""
    found = [F.regexp_extract_all(query, F.lit(p), F.lit(1)) for p in (FROM_NAME, JOIN_NAME)]
    return F.sort_array(F.array_union(*found))


def three_part_names(query: Column, group: int = 0) -> Column:
    """Names of the form a.b.c anywhere; group 1, 2 or 3 gives one part."""
    return F.regexp_extract_all(query, F.lit(THREE_PART), F.lit(group))


def two_part_names(query: Column, group: int = 0) -> Column:
    """Names of the form a.b after FROM or JOIN, once names of three parts are taken out."""
    rest = F.regexp_replace(query, THREE_PART, "")
    return F.regexp_extract_all(rest, F.lit(TWO_PART), F.lit(group))


def where_body(query: Column) -> Column:
    """The text of the first WHERE, up to the next clause."""
    return strip(F.regexp_extract(query, WHERE_BODY, 1))


def in_lists(text: Column) -> Column:
    """The bodies of IN (...)."""
    return F.regexp_extract_all(text, F.lit(IN_LIST), F.lit(1))


def use_names(query: Column) -> tuple[Column, Column]:
    """(catalog, schema) of a USE statement; null where it names none."""
    both = F.regexp_extract(query, USE_BOTH, 0) != ""
    catalog = F.when(both, F.regexp_extract(query, USE_BOTH, 1))
    alone = F.nullif(F.regexp_extract(query, USE_SCHEMA, 1), F.lit(""))
    return catalog, F.when(both, F.regexp_extract(query, USE_BOTH, 2)).otherwise(alone)


def inferred_names(query: Column) -> tuple[Column, Column]:
    """(catalogs, schemas): the distinct names that a query mentions."""
    use_catalog, use_schema = use_names(query)
    catalogs = F.concat(three_part_names(query, 1), F.array(use_catalog))
    schemas = F.concat(three_part_names(query, 2), two_part_names(query, 1), F.array(use_schema))
    nothing = F.array(F.lit(None).cast("string"))
    return F.array_except(catalogs, nothing), F.array_except(schemas, nothing)


def normalise_sql(query: Column) -> Column:
    """The query with placeholders for its literals."""
    out = F.coalesce(query, F.lit(""))
    for pattern, placeholder in LITERALS:
        out = F.regexp_replace(out, pattern, placeholder)
    return out


def deepest_parentheses(query: Column) -> Column:
    """The greatest depth of nesting; closing without opening does not go below zero."""
    signs = F.regexp_replace(query, r"[^()]", "")
    zero = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(acc, sign):
        now = F.when(sign == "(", acc["now"] + 1).when(sign == ")", F.greatest(acc["now"] - 1, F.lit(0))).otherwise(acc["now"])
        return F.struct(now.alias("now"), F.greatest(acc["most"], now).alias("most"))

    return F.aggregate(F.split(signs, ""), zero, step, lambda acc: acc["most"].cast("double"))


def word_count(text: Column) -> Column:
    """Runs between white space."""
    return F.regexp_count(text, F.lit(r"\S+")).cast("double")
