"""SQL of the queries, for an engine that reads the same tables as views."""

from __future__ import annotations

from sparkloom.functions.registry import GROUP_NAMES
from sparkloom.functions.structure import NOISE, PATTERNS
from sparkloom.functions.text import LITERALS
from sparkloom.operators.analysis import RESOURCE_ERRORS
from sparkloom.operators.tfidf import SQL_KEYWORDS
from sparkloom.sources.query_log import DERIVE_SQL


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def count_of(text: str, part: str) -> str:
    return f"CAST((length({text}) - length(replace({text}, {quoted(part)}, ''))) / {len(part)} AS DOUBLE)"


def flag(condition: str) -> str:
    return f"CAST(CASE WHEN {condition} THEN 1 ELSE 0 END AS DOUBLE)"


def has(text: str, part: str) -> str:
    return flag(f"contains({text}, {quoted(part)})")


def bucket(text: str, n: int) -> str:
    return f"(CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT) % {n})"


def strip(text: str) -> str:
    return f"regexp_replace({text}, '^\\s+|\\s+$', '', 'g')"


LOG = "query_log AS (" + DERIVE_SQL.format(events="events").strip() + ")"
LABELLED = """labelled AS (SELECT *,
  coalesce(cpuTime / 1000.0::DOUBLE, 0.0::DOUBLE) AS cpu_time_seconds,
  coalesce(peakUserMemoryBytes / 1073741824.0::DOUBLE, 0.0::DOUBLE) AS memory_gb,
  CAST(CASE WHEN coalesce(cpuTime / 1000.0::DOUBLE, 0) >= 300 OR coalesce(peakUserMemoryBytes / 1073741824.0::DOUBLE, 0) > 10
    OR errorName IN ('EXCEEDED_TIME_LIMIT', 'EXCEEDED_SCAN_LIMIT', 'EXCEEDED_CPU_LIMIT') THEN 1 ELSE 0 END AS INTEGER) AS is_heavy
  FROM query_log)"""
FILTERED = """filtered AS (SELECT * FROM labelled WHERE contains(clientInfo, 'NON-CURATED')
  AND queryType NOT IN ('DATA_DEFINITION', 'DESCRIBE', 'EXPLAIN') AND length(trim(query)) > 0)"""
DISTANCES = """distances AS (SELECT *, abs(cpu_time_seconds - 300) / 300.0::DOUBLE AS cpu_distance, abs(memory_gb - 10) / 10.0::DOUBLE AS memory_distance,
  least(abs(cpu_time_seconds - 300) / 300.0::DOUBLE, abs(memory_gb - 10) / 10.0::DOUBLE) AS boundary_distance FROM labelled)"""
PROBABILITIES = """probabilities AS (SELECT *, CASE WHEN boundary_distance < 0.5 THEN 1.0::DOUBLE
  ELSE 2.0::DOUBLE - 1.95::DOUBLE * least(boundary_distance, 1.0::DOUBLE) END AS sampling_probability FROM distances)"""
SCORES = f"""scores AS (SELECT queryId, is_heavy, least({bucket('queryId', 1000)} / 1000.0::DOUBLE + 0.3::DOUBLE * is_heavy, 1.0::DOUBLE) AS score FROM labelled)"""
def unit(seed: int = 42) -> str:
    return "(" + bucket(f"concat('{seed}:', queryId)", 1_000_000) + " / 1000000.0::DOUBLE)"


UNIT = unit()


def query(select: str, *parts: str) -> str:
    return "WITH " + ",\n".join((LOG, LABELLED, *parts)) + "\n" + select


def r6(expression: str, name: str) -> str:
    return f"round({expression}, 6) AS {name}"


def _disc(column: str, p: float) -> str:
    return f"coalesce(quantile_disc({column}, {p}), 0.0::DOUBLE)"


MEASURED = """measured AS (SELECT *, cpuTime / 1000.0::DOUBLE AS c, peakUserMemoryBytes / 1073741824.0::DOUBLE AS m FROM labelled)"""


def _entity(key: str, other: tuple[str, str], prefix: str = "") -> str:
    names = ", ".join(f"count(DISTINCT {c}) AS {n}" for n, c in (("unique_users", "user_"), other))
    return f"""SELECT k AS {key}, count(*) AS query_count, {r6('avg(CAST(is_heavy AS DOUBLE))', 'heavy_rate')},
  {r6('coalesce(avg(cpuTime) / 1000.0::DOUBLE, 0.0::DOUBLE)', 'avg_cpu_seconds')}, {', '.join(r6(_disc('c', p / 100), f'p{p}_cpu_seconds') for p in (50, 75, 90, 95))},
  {r6('coalesce(avg(peakUserMemoryBytes) / 1073741824.0::DOUBLE, 0.0::DOUBLE)', 'avg_memory_gb')}, {r6(_disc('m', 0.95), 'p95_memory_gb')}, {names}
  FROM (SELECT *, coalesce(nullif({key}, ''), 'NULL') AS k, "user" AS user_ FROM measured) GROUP BY k"""


def stats_sql(kind: str) -> str:
    if kind == "user":
        select = f"""SELECT "user", count(*) AS query_count, {r6('avg(CAST(is_heavy AS DOUBLE))', 'heavy_rate')},
  {r6('coalesce(avg(cpuTime) / 1000.0::DOUBLE, 0.0::DOUBLE)', 'avg_cpu_seconds')}, {r6(_disc('c', 0.9), 'p90_cpu_seconds')}, {r6('coalesce(stddev_samp(c), 0.0::DOUBLE)', 'cpu_stddev')},
  {r6('coalesce(avg(peakUserMemoryBytes) / 1073741824.0::DOUBLE, 0.0::DOUBLE)', 'avg_memory_gb')}, {r6(_disc('m', 0.9), 'p90_memory_gb')},
  count(DISTINCT catalog) AS unique_catalogs, count(DISTINCT schema) AS unique_schemas FROM measured GROUP BY "user" """
    elif kind == "catalog":
        select = _entity("catalog", ("unique_schemas", "schema"))
    else:
        select = _entity("schema", ("unique_catalogs", "catalog"))
    return query(select, MEASURED)


def r10(expression: str, name: str) -> str:
    """Ten places: shares of whole numbers often end in a 5 behind the sixth, which engines round apart."""
    return f"round({expression}, 10) AS {name}"


def historical_sql(known: str = "createTime < TIMESTAMP '2024-01-16'", rows: str = "true") -> str:
    """known: the rows that statistics are made of; rows: those that get features."""
    common = "count(*) AS n, avg(CAST(is_heavy AS DOUBLE)) AS r, coalesce(avg(cpuTime) / 1000.0::DOUBLE, 0) AS a, " + _disc("c", 0.9) + " AS p, coalesce(avg(peakUserMemoryBytes) / 1073741824.0::DOUBLE, 0) AS g"
    sides = {
        "u": f'SELECT "user" AS k, {common}, count(DISTINCT catalog) AS d FROM measured WHERE {known} GROUP BY "user"',
        "cs": f"SELECT coalesce(nullif(catalog, ''), 'NULL') AS k, {common}, count(DISTINCT \"user\") AS d FROM measured WHERE {known} GROUP BY 1",
        "ss": f"SELECT coalesce(nullif(schema, ''), 'NULL') AS k, {common}, 0 AS d FROM measured WHERE {known} GROUP BY 1",
    }
    cut = lambda e, scale: f"least(coalesce({e[0]}, {e[1]}) / {scale}.0::DOUBLE, 1.0::DOUBLE)"
    cells = []
    for kind, t in (("user", "u"), ("catalog", "cs"), ("schema", "ss")):
        cells += [
            r10(cut((f"{t}.n", "1"), 10000), f"{kind}_query_count_norm"), r10(f"coalesce({t}.r, 0.1::DOUBLE)", f"{kind}_heavy_rate"),
            r10(cut((f"{t}.a", "30"), 300), f"{kind}_avg_cpu_seconds_norm"),
        ]
        if kind != "schema":
            cells.append(r10(cut((f"{t}.p", "100"), 300), f"{kind}_p90_cpu_seconds_norm"))
        cells.append(r10(cut((f"{t}.g", "5"), 50), f"{kind}_avg_memory_gb_norm"))
        if kind != "schema":
            cells.append(r10(cut((f"{t}.d", "1"), 100), "user_catalog_diversity_norm" if kind == "user" else "catalog_user_diversity_norm"))
    cells.append("CAST(CASE WHEN u.k IS NULL AND cs.k IS NULL AND ss.k IS NULL THEN 1 ELSE 0 END AS DOUBLE) AS is_cold_start")
    key = lambda c: f"CASE WHEN m.{c} IS NULL OR m.{c} IN ('', 'null', 'NULL') THEN 'NULL' ELSE m.{c} END"
    select = f"""SELECT m.queryId, {', '.join(cells)} FROM measured m
  LEFT JOIN ({sides['u']}) u ON m."user" = u.k LEFT JOIN ({sides['cs']}) cs ON {key('catalog')} = cs.k LEFT JOIN ({sides['ss']}) ss ON {key('schema')} = ss.k WHERE {rows}"""
    return query(select, MEASURED)


def _feature_sql() -> dict[str, str]:
    q, u, w, x = "q", "u", "w", "upper(w)"
    three = r"([a-zA-Z0-9_]+)\.([a-zA-Z0-9_]+)\.([a-zA-Z0-9_]+)"
    names = "list_distinct(list_concat(regexp_extract_all(q, 'FROM\\s+([a-zA-Z0-9_.]+)', 1, 'i'), regexp_extract_all(q, 'JOIN\\s+([a-zA-Z0-9_.]+)', 1, 'i')))"
    threes = lambda g: f"regexp_extract_all(q, '{three}', {g})"
    twos = lambda g: f"regexp_extract_all(regexp_replace(q, '{three}', '', 'g'), '(?:FROM|JOIN)\\s+([a-zA-Z0-9_]+)\\.([a-zA-Z0-9_]+)', {g}, 'i')"
    use_both = "regexp_extract(q, 'USE\\s+([a-zA-Z0-9_]+)\\.([a-zA-Z0-9_]+)', {}, 'i')"
    use_one = "regexp_extract(q, 'USE\\s+([a-zA-Z0-9_]+)(?:\\s|$|;)', 1, 'i')"
    use_schema = f"nullif(CASE WHEN {use_both.format(0)} <> '' THEN {use_both.format(2)} ELSE {use_one} END, '')"
    use_catalog = f"nullif({use_both.format(1)}, '')"
    found = lambda *lists: "CAST(len(list_distinct(list_filter(list_concat(" + ", ".join(lists) + "), lambda z: z IS NOT NULL))) AS DOUBLE)"
    sizes = "list_transform(regexp_extract_all(w, 'IN\\s*\\(([^)]+)\\)', 1, 'i'), lambda z: len(str_split(z, ',')))"
    body = "regexp_extract(u, 'GROUP BY\\s+([^;]+?)(?:HAVING|ORDER BY|LIMIT|$)', 1, 's')"
    hour = "coalesce(hour, 12)"
    scaled = lambda e, s: f"least(({e}) / {s}.0::DOUBLE, 1.0::DOUBLE)"
    depth = """CAST(list_reduce(list_transform(str_split(regexp_replace(q, '[^()]', '', 'g'), ''), lambda z: {'c': CASE z WHEN '(' THEN 1 WHEN ')' THEN -1 ELSE 0 END, 'm': 0}),
    lambda a, z: {'c': greatest(a.c + z.c, 0), 'm': greatest(a.m, a.c + z.c)}, {'c': 0, 'm': 0}).m AS DOUBLE)"""
    hashed = lambda c, n: f"CASE WHEN coalesce({c}, '') = '' THEN 0.0::DOUBLE ELSE {bucket(c, n)} / {n}.0::DOUBLE END"
    begins = lambda word: flag(f"starts_with({strip('u')}, '{word}')")
    missing = lambda c: flag(f"coalesce({c}, '') = ''")
    out = {
        "query_length": "CAST(length(q) AS DOUBLE)", "token_count": "CAST(len(regexp_extract_all(q, '\\S+')) AS DOUBLE)",
        "line_count": count_of(q, "\n").replace("'\n'", "chr(10)") + " + 1",
        "has_select_star": has(u, "SELECT *"), "has_distinct": has(u, "DISTINCT"), "has_order_by": has(u, "ORDER BY"), "has_limit": has(u, "LIMIT"),
        "limit_value": "coalesce(CAST(nullif(regexp_extract(u, 'LIMIT\\s+(\\d+)', 1), '') AS DOUBLE), 0.0::DOUBLE)", "has_offset": has(u, "OFFSET"),
        "comment_ratio": f"(20 * {count_of(q, '--')} + 30 * {count_of(q, '/*')}) / greatest(length(q), 1)", "parentheses_depth": depth,
        "quoted_strings_count": f"floor({count_of(q, chr(39))} / 2)", "numeric_literals_count": "CAST(len(regexp_extract_all(q, '\\b\\d+\\b')) AS DOUBLE)",
        "wildcard_count": count_of(q, "%"), "semicolon_count": count_of(q, ";"),
        "table_count": f"CAST(len({names}) AS DOUBLE)", "join_count": count_of(u, "JOIN"), "left_join_count": count_of(u, "LEFT JOIN"),
        "inner_join_count": count_of(u, "INNER JOIN"), "cross_join_present": has(u, "CROSS JOIN"), "full_outer_join_present": has(u, "FULL OUTER JOIN"),
        "self_join_count": "0.0::DOUBLE", "with_clause_count": count_of(u, "WITH"), "nested_with_depth": "0.0::DOUBLE",
        "recursive_cte_present": has(u, "RECURSIVE"), "subquery_in_from_count": count_of(u, "FROM ("),
        "correlated_subquery_likely": flag("strpos(u, 'WHERE') > 0 AND contains(substr(u, strpos(u, 'WHERE')), 'SELECT')"),
        "where_condition_count": " + ".join(count_of(w, c) for c in "=<>"), "where_and_count": count_of(x, " AND "), "where_or_count": count_of(x, " OR "),
        "where_not_count": count_of(x, " NOT "), "in_clause_count": f"CAST(len({sizes}) AS DOUBLE)", "in_list_total_items": f"CAST(coalesce(list_sum({sizes}), 0) AS DOUBLE)",
        "max_in_list_size": f"CAST(coalesce(list_max({sizes}), 0) AS DOUBLE)", "between_count": count_of(x, "BETWEEN"), "like_pattern_count": count_of(x, "LIKE"), "exists_count": count_of(x, "EXISTS"),
        "group_by_count": f"CASE WHEN {body} = '' THEN 0.0::DOUBLE ELSE CAST(len(str_split({body}, ',')) AS DOUBLE) END", "having_clause_present": has(u, "HAVING"),
        "count_function_count": count_of(u, "COUNT("), "sum_avg_function_count": f"{count_of(u, 'SUM(')} + {count_of(u, 'AVG(')}",
        "min_max_function_count": f"{count_of(u, 'MIN(')} + {count_of(u, 'MAX(')}", "distinct_aggregation_count": count_of(u, "DISTINCT"),
        "window_function_count": count_of(u, "OVER ("), "unbounded_window_present": has(u, "UNBOUNDED"),
        "ast_depth": scaled(f"{count_of(u, '(')} + {count_of(u, 'SELECT')}", 10), "ast_breadth": scaled(f"{count_of(u, ',')} + 1", 100),
        "ast_with_count": scaled(count_of(u, "WITH "), 3), "ast_cte_count": scaled(count_of(u, "WITH "), 3), "ast_lateral_view_count": scaled(count_of(u, "LATERAL VIEW"), 3),
        "ast_window_func_count": scaled(f"{count_of(u, 'OVER (')} + {count_of(u, 'ROW_NUMBER')} + {count_of(u, 'RANK')}", 5), "ast_distinct_count": scaled(count_of(u, "DISTINCT"), 10),
        "ast_having_count": scaled(count_of(u, "HAVING"), 3), "ast_case_when_count": scaled(count_of(u, "CASE WHEN"), 5),
        "ast_coalesce_null_if_count": scaled(f"{count_of(u, 'COALESCE')} + {count_of(u, 'NULLIF')}", 10),
        "user_hash": hashed('"user"', 1_000_000), "catalog_hash": hashed("catalog", 10_000), "schema_hash": hashed("schema", 10_000),
        "hour_of_day": f"{hour} / 24.0::DOUBLE", "hour_sin": f"sin(2 * pi() * {hour} / 24)", "hour_cos": f"cos(2 * pi() * {hour} / 24)",
        "is_business_hours": flag(f"{hour} BETWEEN 9 AND 17"), "client_info_length": "CAST(coalesce(length(clientInfo), 0) AS DOUBLE)",
        "is_select_query": begins("SELECT"), "is_insert_query": begins("INSERT"), "is_create_table_as": flag("contains(u, 'CREATE TABLE') AND contains(u, 'AS SELECT')"),
        "is_delete_query": begins("DELETE"), "is_update_query": begins("UPDATE"),
        "except_count": count_of(u, "EXCEPT"), "intersect_count": count_of(u, "INTERSECT"), "set_operation_total": " + ".join(count_of(u, k) for k in ("EXCEPT", "INTERSECT", "UNION")),
        "has_multiple_statements": flag(f"{count_of(q, ';')} > 1"), "is_catalog_null": missing("catalog"), "is_schema_null": missing("schema"),
        "has_qualified_tables": flag(f"len({threes(0)}) > 0 OR len({twos(0)}) > 0"),
        "inferred_catalog_count": found(threes(1), f"[{use_catalog}]"), "inferred_schema_count": found(threes(2), twos(1), f"[{use_schema}]"),
        "table_qualification_level": f"CAST(CASE WHEN len({names}) = 0 THEN 0 WHEN len({threes(0)}) > 0 THEN 2 WHEN len({twos(0)}) > 0 THEN 1 ELSE 0 END AS DOUBLE)",
    }
    return out


def structure_sql() -> str:
    text = "coalesce(query, '')"
    for pattern, instead in NOISE:
        text = f"regexp_replace({text}, {quoted(pattern.removeprefix('(?s)'))}, {quoted(instead)}, '{'gs' if pattern.startswith('(?s)') else 'g'}')"
    n = {name: f"len(regexp_extract_all(u, {quoted(pattern)}))" for name, pattern in PATTERNS.items()}
    cells = n | {
        "subquery_count": f"greatest({n['subquery_count']} - {n['cte_count']}, 0)", "union_count": f"{n['union_count']} - {n['union_all_count']}",
        "max_branches": "coalesce(list_max(list_transform(string_split_regex(u, '\\bCASE\\b')[2:], lambda z: len(regexp_extract_all(z, '\\bWHEN\\b')))), 0)",
        "breadth": "len(regexp_extract_all(u, ',')) + 1",
    }
    return query("SELECT queryId, " + ", ".join(f"CAST({v} AS INTEGER) AS {k}" for k, v in cells.items()) + f" FROM (SELECT queryId, upper({text}) AS u FROM query_log)")


FEATURES = _feature_sql()
_WHERE = strip("regexp_extract(query, 'WHERE\\s+(.*?)(?:GROUP BY|ORDER BY|LIMIT|HAVING|UNION|EXCEPT|INTERSECT|$)', 1, 'is')")
STAGED = f"staged AS (SELECT *, query AS q, upper(query) AS u, {_WHERE} AS w FROM query_log)"


def group_sql(group: str) -> str:
    cells = ", ".join(f"CASE WHEN regexp_matches(q, '\\S') THEN round({FEATURES[n]}, 6) ELSE 0.0::DOUBLE END AS {n}" for n in GROUP_NAMES[group])
    return query(f"SELECT queryId, {cells} FROM staged", STAGED)


def normalised(column: str) -> str:
    out = f"coalesce({column}, '')"
    for pattern, placeholder in LITERALS:
        out = f"regexp_replace({out}, {quoted(pattern)}, '{placeholder}', 'g')"
    return out


KEYWORDS = ", ".join(f"'{k}'" for k in SQL_KEYWORDS)
ERRORS = ", ".join(f"'{e}'" for e in RESOURCE_ERRORS)


def tokens(column: str, normalise: bool = True) -> str:
    text = normalised(column) if normalise else f"coalesce({column}, '')"
    return f"list_filter(regexp_split_to_array(lower({text}), '[^a-zA-Z0-9_]'), lambda t: length(t) >= 2)"


def terms_sql(table: str, key: str, column: str, normalise: bool, drop: bool) -> str:
    """(key, term): the distinct terms of each row."""
    where = f" WHERE term NOT IN ({KEYWORDS})" if drop else ""
    return f"SELECT DISTINCT k, term FROM (SELECT {key} AS k, unnest({tokens(column, normalise)}) AS term FROM {table}){where}"
