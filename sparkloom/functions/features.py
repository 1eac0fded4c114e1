"""The 78 base features as native columns, by group, in their fixed order.

Groups read staged columns: the query, its upper case, its WHERE body and the depth of its
parentheses, so each is computed once per row. Their names give way to those of the input. Depth
needs a fold, which generated code cannot hold, so it stays in the staging projection; all
features themselves are generated code. Rows whose query is blank or too long get zeros.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import text as T

MAX_QUERY_LENGTH = 1_000_000

# Divisors of the structure features (fixed values).
STRUCTURE_SCALE = {
    "ast_depth": 10.0,
    "ast_breadth": 100.0,
    "ast_with_count": 3.0,
    "ast_cte_count": 3.0,
    "ast_lateral_view_count": 3.0,
    "ast_window_func_count": 5.0,
    "ast_distinct_count": 10.0,
    "ast_having_count": 3.0,
    "ast_case_when_count": 5.0,
    "ast_coalesce_null_if_count": 10.0,
}


@dataclass
class Staged:
    """The staged columns of a frame: query, upper case, WHERE body, depth of parentheses, validity."""

    query: Column
    upper: Column
    where: Column
    depth: Column
    valid: Column


def sql_group(s: Staged) -> dict[str, Column]:
    q, u = s.query, s.upper
    limit = F.regexp_extract(u, r"LIMIT\s+(\d+)", 1)
    return {
        "query_length": F.length(q).cast("double"),
        "token_count": T.word_count(q),
        "line_count": T.count_of(q, "\n") + 1.0,
        "has_select_star": T.has(u, "SELECT *"),
        "has_distinct": T.has(u, "DISTINCT"),
        "has_order_by": T.has(u, "ORDER BY"),
        "has_limit": T.has(u, "LIMIT"),
        "limit_value": F.coalesce(F.nullif(limit, F.lit("")).cast("double"), F.lit(0.0)),
        "has_offset": T.has(u, "OFFSET"),
        "comment_ratio": (20.0 * T.count_of(q, "--") + 30.0 * T.count_of(q, "/*")) / F.greatest(F.length(q), F.lit(1)),
        "parentheses_depth": F.when(s.depth.isNull(), 0.0).otherwise(s.depth),
        "quoted_strings_count": F.floor(T.count_of(q, "'") / 2).cast("double"),
        "numeric_literals_count": F.regexp_count(q, F.lit(r"\b\d+\b")).cast("double"),
        "wildcard_count": T.count_of(q, "%"),
        "semicolon_count": T.count_of(q, ";"),
    }


def table_join_group(s: Staged) -> dict[str, Column]:
    q, u = s.query, s.upper
    where = F.locate("WHERE", u)
    return {
        "table_count": F.size(T.table_names(q)).cast("double"),
        "join_count": T.count_of(u, "JOIN"),
        "left_join_count": T.count_of(u, "LEFT JOIN"),
        "inner_join_count": T.count_of(u, "INNER JOIN"),
        "cross_join_present": T.has(u, "CROSS JOIN"),
        "full_outer_join_present": T.has(u, "FULL OUTER JOIN"),
        "self_join_count": F.lit(0.0),
        "with_clause_count": T.count_of(u, "WITH"),
        "nested_with_depth": F.lit(0.0),
        "recursive_cte_present": T.has(u, "RECURSIVE"),
        "subquery_in_from_count": T.count_of(u, "FROM ("),
        "correlated_subquery_likely": T.flag((where > 0) & F.substring(u, where, F.length(u)).contains("SELECT")),
    }


def where_group(s: Staged) -> dict[str, Column]:
    w = s.where
    upper = F.upper(w)
    lists = T.in_lists(w)
    # No list holds a closing parenthesis, so one parts the lists; what is left is commas.
    commas = F.regexp_replace(F.array_join(lists, ")"), "[^,)]", "")
    longest = F.array_max(F.split(commas, "\\)", -1))
    return {
        "where_condition_count": T.count_of(w, "=") + T.count_of(w, "<") + T.count_of(w, ">"),
        "where_and_count": T.count_of(upper, " AND "),
        "where_or_count": T.count_of(upper, " OR "),
        "where_not_count": T.count_of(upper, " NOT "),
        "in_clause_count": F.size(lists).cast("double"),
        "in_list_total_items": F.when(F.size(lists) == 0, 0.0).otherwise(T.count_of(commas, ",") + F.size(lists)),
        "max_in_list_size": F.when(F.size(lists) == 0, 0.0).otherwise((F.length(longest) + 1).cast("double")),
        "between_count": T.count_of(upper, "BETWEEN"),
        "like_pattern_count": T.count_of(upper, "LIKE"),
        "exists_count": T.count_of(upper, "EXISTS"),
    }


def aggregation_group(s: Staged) -> dict[str, Column]:
    u = s.upper
    body = F.regexp_extract(u, T.GROUP_BODY, 1)
    return {
        "group_by_count": F.when(body == "", 0.0).otherwise(F.size(F.split(body, ",", -1)).cast("double")),
        "having_clause_present": T.has(u, "HAVING"),
        "count_function_count": T.count_of(u, "COUNT("),
        "sum_avg_function_count": T.count_of(u, "SUM(") + T.count_of(u, "AVG("),
        "min_max_function_count": T.count_of(u, "MIN(") + T.count_of(u, "MAX("),
        "distinct_aggregation_count": T.count_of(u, "DISTINCT"),
        "window_function_count": T.count_of(u, "OVER ("),
        "unbounded_window_present": T.has(u, "UNBOUNDED"),
    }


def structure_group(s: Staged) -> dict[str, Column]:
    """The deterministic definition: counts of what marks structure, scaled and cut at 1."""
    u = s.upper
    with_count = T.count_of(u, "WITH ")
    raw = {
        "ast_depth": T.count_of(u, "(") + T.count_of(u, "SELECT"),
        "ast_breadth": T.count_of(u, ",") + 1.0,
        "ast_with_count": with_count,
        "ast_cte_count": with_count,
        "ast_lateral_view_count": T.count_of(u, "LATERAL VIEW"),
        "ast_window_func_count": T.count_of(u, "OVER (") + T.count_of(u, "ROW_NUMBER") + T.count_of(u, "RANK"),
        "ast_distinct_count": T.count_of(u, "DISTINCT"),
        "ast_having_count": T.count_of(u, "HAVING"),
        "ast_case_when_count": T.count_of(u, "CASE WHEN"),
        "ast_coalesce_null_if_count": T.count_of(u, "COALESCE") + T.count_of(u, "NULLIF"),
    }
    return {name: T.at_most_one(value, STRUCTURE_SCALE[name]) for name, value in raw.items()}


def context_group(s: Staged) -> dict[str, Column]:
    hour = F.coalesce(F.col("hour").cast("int"), F.lit(12))
    angle = hour * F.lit(2 * math.pi / 24)
    return {
        "user_hash": T.hash_feature(F.col("user"), 1_000_000),
        "catalog_hash": T.hash_feature(F.col("catalog"), 10_000),
        "schema_hash": T.hash_feature(F.col("schema"), 10_000),
        "hour_of_day": hour / 24.0,
        "hour_sin": F.sin(angle),
        "hour_cos": F.cos(angle),
        "is_business_hours": T.flag(hour.between(9, 17)),
        "client_info_length": F.coalesce(F.length("clientInfo"), F.lit(0)).cast("double"),
    }


def query_type_group(s: Staged) -> dict[str, Column]:
    u = s.upper
    head = T.strip(u)
    return {
        "is_select_query": T.flag(head.startswith("SELECT")),
        "is_insert_query": T.flag(head.startswith("INSERT")),
        "is_create_table_as": T.flag(u.contains("CREATE TABLE") & u.contains("AS SELECT")),
        "is_delete_query": T.flag(head.startswith("DELETE")),
        "is_update_query": T.flag(head.startswith("UPDATE")),
    }


def set_operation_group(s: Staged) -> dict[str, Column]:
    q, u = s.query, s.upper
    except_, intersect = T.count_of(u, "EXCEPT"), T.count_of(u, "INTERSECT")
    return {
        "except_count": except_,
        "intersect_count": intersect,
        "set_operation_total": except_ + intersect + T.count_of(u, "UNION"),
        "has_multiple_statements": T.flag(T.count_of(q, ";") > 1),
    }


def null_aware_group(s: Staged) -> dict[str, Column]:
    q = s.query
    missing = lambda c: T.flag(F.coalesce(F.col(c), F.lit("")) == "")
    three, two = F.size(T.three_part_names(q)), F.size(T.two_part_names(q))
    catalogs, schemas = T.inferred_names(q)
    level = F.when(F.size(T.table_names(q)) == 0, 0.0).when(three > 0, 2.0).when(two > 0, 1.0).otherwise(0.0)
    return {
        "is_catalog_null": missing("catalog"),
        "is_schema_null": missing("schema"),
        "has_qualified_tables": T.flag((three > 0) | (two > 0)),
        "inferred_catalog_count": F.size(catalogs).cast("double"),
        "inferred_schema_count": F.size(schemas).cast("double"),
        "table_qualification_level": level,
    }


#: The groups in their order; feature k of the vector is the k-th name overall.
GROUPS = {
    "sql": sql_group,
    "table_join": table_join_group,
    "where": where_group,
    "aggregation": aggregation_group,
    "structure": structure_group,
    "context": context_group,
    "query_type": query_type_group,
    "set_operation": set_operation_group,
    "null_aware": null_aware_group,
}


def staged(df: DataFrame) -> tuple[DataFrame, Staged]:
    """(df with the columns that the groups read, those columns)."""
    names = [T.free_name(df.columns, n) for n in ("_query", "_upper", "_where", "_depth", "_valid")]
    query, upper, where, depth, valid = names
    q = F.coalesce(F.col("query"), F.lit(""))
    df = df.withColumns({query: q, upper: F.upper(q), valid: valid_query()})
    # A query without parentheses has no depth; the others are folded.
    folded = F.when(F.col(query).contains("("), T.deepest_parentheses(F.col(query)))
    return df.withColumns({where: T.where_body(F.col(query)), depth: folded}), Staged(*map(F.col, names))


def valid_query() -> Column:
    """Whether a query is neither blank nor too long."""
    q = F.coalesce(F.col("query"), F.lit(""))
    return q.rlike(r"\S") & (F.length(q) <= MAX_QUERY_LENGTH)


def group_columns(df: DataFrame, group: str, keep: list[str]) -> DataFrame:
    """The kept columns and the features of one group; only the columns that they read are scanned."""
    rows, s = staged(df)
    return rows.select(*keep, *[F.when(s.valid, c).otherwise(0.0).alias(n) for n, c in GROUPS[group](s).items()])


def feature_names() -> dict[str, list[str]]:
    """The names of each group's features, in their fixed order."""
    nothing = Staged(*[F.lit(None)] * 5)
    return {name: list(make(nothing)) for name, make in GROUPS.items()}


def with_features(df: DataFrame, names: list[str] | None = None, output: str = "features") -> DataFrame:
    """df with an array<double> of the named features (all 78 by default), in that order.

    Features that are not named are never computed.
    """
    layer, s = staged(df)
    cells = {n: c for make in GROUPS.values() for n, c in make(s).items()}
    names = list(cells) if names is None else names
    unknown = [n for n in names if n not in cells]
    if unknown:
        raise ValueError(f"unknown features: {unknown}")
    array = F.array(*[cells[n] for n in names]) if names else F.array().cast("array<double>")
    zeros = F.array_repeat(F.lit(0.0), len(names))
    return layer.select(*[F.col(f"`{c}`") for c in df.columns], F.when(s.valid, array).otherwise(zeros).alias(output))
